"""Lead lists from CSV files with free headers and mixed encodings."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attesta.session import new_folder, stage

# Header spellings accepted for each field, in order of preference, after
# lower-casing and dropping everything but letters and digits.
HEADER_ALIASES = {
    "name": ("company", "companyname", "name", "business", "businessname"),
    "domain": ("website", "domain", "url", "companydomainname", "companydomain", "site"),
    "industry": ("industry", "category", "sector"),
    "city": ("city", "town"),
    "state": ("state", "stateregion", "region", "province"),
    "employee_range": ("employees", "employeerange", "numberofemployees", "headcount", "companysize"),
    "revenue_estimate": ("revenue", "revenueestimate", "annualrevenue"),
    "phone": ("phone", "phonenumber", "telephone"),
    "linkedin_url": ("linkedin", "linkedinurl", "linkedincompanypage"),
    "source": ("source",),
}
LEAD_FIELDS = tuple(HEADER_ALIASES)

# Header of the seed file.
SEED_HEADER = (
    "Company", "Website", "Industry", "City", "State", "Phone", "Employees", "Revenue", "LinkedIn",
    "Source",
)


BOM = b"\xef\xbb\xbf"


def column_positions(headers: Sequence[str | None]) -> dict[str, int]:
    """Field name to column position. Of two headers that read the same, the later one counts."""
    spelled = {
        "".join(ch for ch in header.lower() if ch.isalnum()): position
        for position, header in enumerate(headers)
        if header
    }
    found = {
        field: next((spelled[a] for a in aliases if a in spelled), None)
        for field, aliases in HEADER_ALIASES.items()
    }
    return {field: position for field, position in found.items() if position is not None}


#: What ``_follow_quotes`` adds to a line, for a split that begins between records (0) or inside quotes (1).
_FOLLOWED = "file string, block long, row long, line binary, in0 boolean, out0 boolean, begun0 long, in1 boolean, out1 boolean, begun1 long"


def read_lead_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of lead lists as the ten lead fields plus ``row_pos``, their place in file order.

    Every file under ``path`` has its own header and encoding: UTF-8 if all its lines are valid, else
    Latin-1. A file without a header or a website column is an error. A file is read in splits, also
    where fields hold line breaks; a quote that is never closed makes the rest of its file one record.
    """
    folder = new_folder(spark, "lead-csv")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line"))
    records = stage(csv_records(stage(lines.mapInArrow(_follow_quotes, _FOLLOWED), f"{folder}/lines")), f"{folder}/records")
    files = records.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("utf8"),
        F.min("place").alias("header_place"), F.min_by("line", "place").alias("header"))
    files = stage(files.mapInPandas(_with_positions, f"{files.schema.simpleString()[7:-1]}, positions array<int>, width int, problem string"), f"{folder}/files")
    bad = files.filter("problem is not null").orderBy("file").first()
    if bad is not None or files.isEmpty():
        raise ValueError(f"{bad.file}: {bad.problem}" if bad else "no line in any lead list")

    width = files.agg(F.max("width")).first()[0]
    told = records.join(files.drop("header"), "file").filter(F.col("place") != F.col("header_place"))
    text = F.when(F.col("utf8"), F.col("line").cast("string")).otherwise(F.decode("line", "ISO-8859-1"))
    filled = told.withColumn("text", text).filter(F.trim("text") != "")
    values = F.from_csv("text", ", ".join(f"c{i} string" for i in range(width)), {"escape": '"'})
    row_pos = F.struct("file", "place.block", "place.row").alias("row_pos")
    # generated, so that a record is parsed once and not once for each field
    parsed = filled.select("positions", row_pos, F.explode(F.array(values)).alias("v")).select(
        "positions", "row_pos", F.array(*[F.col(f"v.c{i}") for i in range(width)]).alias("v"))
    return parsed.select(*[F.get("v", F.get("positions", F.lit(k))).alias(f) for k, f in enumerate(LEAD_FIELDS)], "row_pos")


def csv_records(lines: DataFrame) -> DataFrame:
    """Records (file, place, line) of lines that ``_follow_quotes`` has read split by split.

    What a split does to the state it begins in is one of four things: keep it, turn it, or leave it
    inside or outside quotes whatever it was. So the state at a split's beginning follows from the
    last earlier split that fixed it and the turns since: a running sum over one row per split. Only
    lines of records with line breaks are shuffled.
    """
    order = W.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    whole = lines.groupBy("file", "block").agg(F.max_by(F.struct("out0", "begun0", "out1", "begun1"), "row").alias("end"))
    turns = whole.select("file", "block", "end.*").withColumn(
        "turns", F.sum((F.col("out0") & ~F.col("out1")).cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    fixed = F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").cast("long").alias("out"), "turns"))
    since = turns.withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier)).withColumn("before", F.lag("turns", 1, 0).over(order))
    inside = (F.coalesce("fixed.out", F.lit(0)) + F.col("before") - F.coalesce("fixed.turns", F.lit(0))) % 2 == 1
    placed = since.withColumn("inside", inside)
    begun = F.when(F.col("inside"), F.col("begun1")).otherwise(F.col("begun0"))
    place = F.when(begun.isNotNull(), F.struct("block", begun.alias("row")))
    splits = placed.select("file", "block", "inside", F.last(place, ignorenulls=True).over(earlier).alias("carried"))

    def of_state(name: str):
        return F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    told = lines.join(splits, ["file", "block"]).select(
        "file", F.coalesce(place, "carried").alias("place"), F.struct("block", "row").alias("at"), "line",
        (of_state("in") | of_state("out")).alias("shared"))
    single = told.filter(~F.col("shared")).select("file", "place", "line")
    parts = told.filter("shared").groupBy("file", "place").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("parts"))
    texts = F.transform("parts.line", lambda part: F.decode(part, "ISO-8859-1"))  # every byte has its character
    return single.unionByName(parts.select("file", "place", F.encode(F.array_join(texts, "\n"), "ISO-8859-1").alias("line")))


def _ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside quotes. A quote opens a field only as its first character; inside
    quotes two of them stand for one."""
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(b",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = line.find(b'"', at)
        if at < 0:
            return True
        inside = line[at + 1 : at + 2] == b'"'
        if inside:
            at += 2
            continue
        at = line.find(b",", at) + 1
        if not at:
            return False


def _follow_quotes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with, for both states their split may begin in, whether the line begins and ends inside
    quotes and the row that began its record (null: a row of an earlier split)."""
    split = inside = begun = None
    for batch in batches:
        found: tuple[list, ...] = ([], [], [], [], [], [])
        for *own, row, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "row", "line"))):
            if own != split:
                split, inside, begun = own, [False, True], [None, None]
            if line.startswith(BOM):
                line = line[len(BOM) :]
            for k in (0, 1):
                found[3 * k].append(inside[k])
                if not inside[k]:
                    begun[k] = row
                if b'"' in line:
                    inside[k] = _ends_inside(line, inside[k])
                found[3 * k + 1].append(inside[k])
                found[3 * k + 2].append(begun[k])
        kinds = [pa.bool_(), pa.bool_(), pa.int64()] * 2
        names = ["in0", "out0", "begun0", "in1", "out1", "begun1"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found, kinds)], [*batch.schema.names, *names])


def _with_positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files with the column of each lead field (none: null) and what is wrong with the header."""
    for files in batches:
        rows = []
        for header, utf8 in zip(files["header"], files["utf8"]):
            text = bytes(header).removeprefix(BOM).decode("utf-8" if utf8 else "latin-1")
            names = next(csv.reader(io.StringIO(text, newline="")), [])
            found = column_positions(names)
            problem = None if "domain" in found else "the first line names no website column" if any(names) else "the first line is empty"
            rows.append(([found.get(f) for f in LEAD_FIELDS], len(names), problem))
        yield files.assign(positions=[r[0] for r in rows], width=[r[1] for r in rows], problem=[r[2] for r in rows])
