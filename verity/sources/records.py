"""Record sources and sinks.

The reference keeps each dataset as one JSON array in memory. Here a
dataset is a DataFrame read with an explicit schema; JSON arrays are read
with ``multiLine`` (one array per file), JSON Lines and Parquet are the
scalable formats, and sinks write one file per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SAVE_MODES = ("errorifexists", "ignore", "overwrite", "append")


def read_records(spark: SparkSession, path: str, schema: StructType | str, *,
                 json_array: bool = False) -> DataFrame:
    """A1: read JSON records with an explicit schema.

    ``json_array=True`` reads files whose root is a JSON array (one array
    per file, as the reference writes them). Malformed input fails the job
    (``FAILFAST``) instead of yielding silent nulls; a root that is not a
    list is rejected by the same mode because its rows do not parse to the
    record schema.
    """
    r = spark.read.schema(schema).option("mode", "FAILFAST")
    if json_array:
        r = r.option("multiLine", True)
    return r.json(path)


def reject_non_list_root(spark: SparkSession, path: str) -> DataFrame:
    """Files among ``path`` whose first non-blank character is not '['.

    Reads only a bounded prefix of each file (``substr`` over the
    ``binaryFile`` content column is not pruned, so use the text reader
    with ``lineSep`` unset and take each file's first line).
    """
    first = (spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value"))
             .where(F.length(F.trim("value")) > 0)
             .groupBy("file").agg(F.min_by("value", F.monotonically_increasing_id()).alias("first_line")))
    return first.where(~F.ltrim("first_line").startswith("[")).select("file")


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A2: CSV with a header, every column a string, blanks kept as ''."""
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("emptyValue", "").csv(path))


def write_records(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                  partition_by: list[str] | None = None) -> None:
    """A3: JSON (lines), CSV, text or Parquet sink. The reference's
    ``--force`` guard is the save mode: ``errorifexists`` refuses to clobber,
    ``overwrite`` replaces, ``append`` adds new results, ``ignore`` skips."""
    if mode not in SAVE_MODES:
        raise ValueError(f"mode must be one of {SAVE_MODES}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "json":
        w.json(path)
    elif fmt == "csv":
        w.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif fmt == "text":
        w.text(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_daily_log(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """JSONL log, one folder per UTC day (``log_date=YYYY-MM-DD``)."""
    out = df.withColumn("log_date", F.date_format(F.to_date(F.col(ts)), "yyyy-MM-dd"))
    out.write.mode(mode).partitionBy("log_date").json(path)


def load_benchmark(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The benchmark loader, re-aimed from a network download to a
    local Parquet/JSON copy of the same schema."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.json(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for job output."""
    import uuid

    from ..session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
