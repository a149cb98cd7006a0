"""CRM-shaped export of ranked leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Export header, in file order.
HEADERS = (
    "Company name", "Company Domain Name", "City", "State/Region", "Industry", "Phone Number",
    "Number of Employees", "fit_score", "coverage", "met_criteria", "red_flags", "outreach_note",
    "evidence_urls",
)


def crm_rows(ranked: DataFrame) -> DataFrame:
    """Ranked leads as text columns under the fixed headers; blanks stand for nulls."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined = lambda c, sep: F.coalesce(F.array_join(c, sep), F.lit(""))
    columns: list[Column] = [
        blank("name"), blank("domain"), blank("city"), blank("state"), blank("industry"),
        blank("phone"), blank("employee_range"), blank("score"), blank("coverage"),
        joined("met_criteria", "; "), joined("red_flags", "; "), blank("outreach_note"),
        joined("evidence_urls", " "),
    ]
    return ranked.select(*[c.alias(h) for c, h in zip(columns, HEADERS)])


def export_name(profile_name: str) -> str:
    return f"icp-scan-{profile_name.lower().replace(' ', '-')}.csv"


def write_crm_csv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """Write the export. Parts keep the global order by name; ``single_file`` is for small lists."""
    out = rows.coalesce(1) if single_file else rows
    out.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")
