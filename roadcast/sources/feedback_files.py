"""Feedback logs as delimited text, including mixed-layout files (SC6, SC7).

Appending rows of the current 9-field layout under an older header leaves
files whose lines do not all match their header. Each file is read as text;
its header is the line starting with ``timestamp,``; a line with 9 fields
under a header of another width takes the current layout, every other line
takes its file's header (the current layout where a file has none).

A line is parsed once, into a wide struct, and its fields are found by their
place in the line's own list of names: one pass over the data for all layouts
together, whatever headers there are. A short pass before it finds the
headers, one row a file. Fields are counted by commas left over when quoted
parts are taken out (a quote inside them is doubled), which is linear in the line. A header may name up to
FIELDS columns; of columns that no layout knows, the values are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcast.operators.feedback import FEEDBACK_SCHEMA
from roadcast.operators.sizing import broadcast_if_small

QUOTED = '"[^"]*"'
OLD_HEADER = "timestamp,event_cause,corridor,actual_duration_minutes,requires_road_closure"
FIELDS = 64
WIDE = ", ".join(f"c{i} string" for i in range(FIELDS))


def read_feedback_text(spark: SparkSession, path: str) -> DataFrame:
    """SC7: every line of every file, in the layout it was written with, under the current names."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), "value").where(F.length(F.trim("value")) > 0)
    is_header = F.col("value").startswith("timestamp,")
    headers = lines.where(is_header).groupBy("_file").agg(F.min("value").alias("_header"))
    headers = broadcast_if_small(headers.select("_file", F.transform(F.split("_header", ","), F.trim).alias("_names")))
    current = F.array(*map(F.lit, FEEDBACK_SCHEMA))
    plain = F.regexp_replace("value", QUOTED, "")
    n = F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1
    named = F.when(F.col("_names").isNull() | (n == len(FEEDBACK_SCHEMA)), current).otherwise(F.col("_names"))
    fields = F.from_csv("value", F.lit(WIDE), {"escape": '"'})
    rows = lines.where(~is_header).join(headers, "_file", "left").select(named.alias("_n"), fields.alias("_f"))
    rows = rows.select("_n", F.array(*[F.col(f"_f.c{i}") for i in range(FIELDS)]).alias("_f"))

    def field(name: str):
        return F.get("_f", (F.array_position("_n", name) - 1).cast("int"))

    old = {"actual_requires_road_closure": "requires_road_closure", "event_datetime": "timestamp"}
    out = [F.when(F.array_contains("_n", c), field(c)).otherwise(field(old[c])) if c in old else field(c) for c in FEEDBACK_SCHEMA]
    return rows.select(*(c.alias(name) for c, name in zip(out, FEEDBACK_SCHEMA)))


def write_with_header(rows: DataFrame, path: str, header: str) -> None:
    """Write rows as CSV text; every output file starts with ``header``.

    The lines are one column of that name, written without a separator or quotes of its own.
    """
    lines = rows.select(F.to_csv(F.struct(*rows.columns), {"escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias(header))
    lines.write.mode("overwrite").options(header=True, sep="\u0001", quote="\u0000", escape="\u0000", emptyValue="",
                                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
