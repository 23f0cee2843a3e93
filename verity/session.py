"""Spark session construction and cluster-level settings.

On a cluster the session is created by the platform; ``get_spark`` only
fills in settings that are unset, so a cluster's own values win.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: AQE for runtime coalescing and skew-join
# splitting, UTC so day labels and watermarks agree with the oracle, ANSI so
# bad casts fail loudly (operators use try_cast/try_divide where the
# reference falls back to a default).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark broadcasts a side only when its measured bytes are below this;
    # keep the automatic threshold modest so Catalyst never broadcasts a side
    # that grows with the data.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "verity") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        # Local mode only: bind to loopback so large task results are not lost.
        builder = builder.config("spark.driver.host", "127.0.0.1")
        builder = builder.config("spark.driver.bindAddress", "127.0.0.1")
        builder = builder.config("spark.driver.memory", os.environ.get("VERITY_DRIVER_MEMORY", "16g"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a folder there that the driver and all executors
    share; only a local master, where there is one machine, gets a folder of
    its own when it is unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        sc = None
    if configured:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="verity-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    if sc is not None:
        sc.setCheckpointDir(local)
    return local


def spread(df):
    """``df`` dealt over all cores if its scan has fewer splits than there are
    (a small file is one split); large inputs are not shuffled. For steps whose
    work a row is heavy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of text that a task of ``parts_for`` takes, on average.
TASK_BYTES = 2 << 20


def parts_for(df, *texts: str) -> int:
    """How many tasks ``df`` is dealt over so that each holds about
    ``TASK_BYTES`` of the given texts, however large the table is: for steps that
    make many rows of a text and sort or group them. One pass over the lengths."""
    from pyspark.sql import functions as F

    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0).cast("long"))
    n = df.agg(F.sum(size)).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_BYTES))


@contextmanager
def settings(spark, **values: str) -> Iterator[None]:
    """Session settings (``__`` for a dot) that hold inside the block."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A table is written once: the shuffle files of the write go with its end, not when the driver collects garbage.
_ONCE = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def stored(df):
    """``df`` as Parquet in the shared checkpoint folder, read back: like
    ``checkpointed``, but later reads take only the columns they use, and
    Spark knows the table's size when it picks a join."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    with settings(spark, **_ONCE):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df, *keys: str):
    """``df`` dealt by keys over as many partitions as ``bucketed`` has buckets."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bucketed(df, *keys: str):
    """(``df``, ``dealt`` by the same keys, stored in buckets of them; the name of its
    catalog entry): later joins and groupings on the keys read it without a
    shuffle. The entry is to be dropped once the last plan over it has run; the
    files lie in the shared checkpoint folder, as those of ``stored``."""
    spark = df.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    with settings(spark, **_ONCE):
        df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys) \
            .option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name), name


def checkpointed(df):
    """``df`` written once to the shared checkpoint folder: several uses read
    stored rows instead of computing them again, and lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
