"""Table writers and exports."""
