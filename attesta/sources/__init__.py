"""Readers that turn landed files and payloads into pipeline tables."""
