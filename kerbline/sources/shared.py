"""The folder that the driver and all executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session names none and runs on one machine
    (as in tests) a temporary one is set. On a cluster it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kerbline-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: For tables with rows of megabytes. Parquet looks at the size of a row group after a hundred
#: rows only, and writers and readers hold one whole.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}


def kept(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once, and a lost
    executor costs nothing before it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options or {}).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Shuffle files are deleted when the job that wrote them ends, else whenever the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept_tidily(df: DataFrame, name: str) -> DataFrame:
    """``kept``, and the job's shuffle files go at its end. For plans without cached tables."""
    conf = df.sparkSession.conf
    before = conf.get(_TIDY)
    conf.set(_TIDY, "true")
    try:
        return kept(df, name)
    finally:
        conf.set(_TIDY, before)
