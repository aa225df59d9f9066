"""The raw incident log as CSV (SC1): an explicit schema of texts, header aliases, null tokens, broken lines apart.

Nothing is inferred: every column is read as text under the names of the file's own header, aliases are renamed, columns
that the log may lack come out null, and text tokens for null become null in every column. Times, numbers and flags are
parsed by the cleaning operators, which take texts. A line that doesn't have the header's number of fields is not an
incident: it goes to the rejects, whole, so no row is lost without a trace. A file whose header differs from that of the
folder's first file is an error, not a silent shift of columns.

Cases: a quoted field may hold separators and doubled quotes; an empty file or folder of headers gives no rows; further
columns are kept as texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from roadcast.operators.cleaning import null_tokens

COLUMNS = ["id", "event_type", "event_cause", "corridor", "priority", "requires_road_closure", "start_datetime", "end_datetime",
           "closed_datetime", "resolved_datetime", "zone", "police_station", "junction", "address", "latitude", "longitude"]
ALIASES = {"event_id": "id", "incident_id": "id", "cause": "event_cause", "road_closure": "requires_road_closure", "lat": "latitude",
           "lon": "longitude", "lng": "longitude", "station": "police_station"}
BROKEN = "_broken_line"


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """All lines under the header's names, as texts; lines with another number of fields have BROKEN set."""
    names = spark.read.option("header", True).csv(path).columns  # reads one line
    fields = [StructField(n, StringType()) for n in [*names, BROKEN]]
    return (spark.read.schema(StructType(fields)).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnPruning", False)
            .option("columnNameOfCorruptRecord", BROKEN).option("quote", '"').option("escape", '"').csv(path))


def _named(name: str) -> str:
    plain = name.strip().lower().replace(" ", "_")
    return ALIASES.get(plain, plain)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Raw incidents (COLUMNS and further ones) with null tokens resolved, for ``cleaning.clean_incidents``."""
    rows = _scan(spark, path)
    kept = rows.where(F.col(BROKEN).isNull()).select(*(F.col(f"`{c}`").alias(_named(c)) for c in rows.columns if c != BROKEN))
    missing = {c: F.lit(None).cast("string") for c in COLUMNS if c not in kept.columns}
    return null_tokens(kept.withColumns(missing) if missing else kept)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(id, line, fields): lines that don't have the header's number of fields; id: what stands in the first one."""
    rows = _scan(spark, path)
    unquoted = F.regexp_replace("line", '"[^"]*"', "")
    broken = rows.where(F.col(BROKEN).isNotNull()).select(F.col(f"`{rows.columns[0]}`").alias("id"), F.col(BROKEN).alias("line"))
    return broken.select("id", "line", F.size(F.split(unquoted, ",")).alias("fields"))
