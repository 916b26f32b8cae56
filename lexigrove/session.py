"""Session defaults, scratch locations and bounded materialisation."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# A summary with at most this many rows may live on the driver.
LOCAL_ROW_BOUND = 50_000


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("lexigrove")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's setting, else a folder of this machine, which only a local session may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("executors need a shared folder: set spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrove-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few given rows as a local relation: known size, no job to read it."""
    types = _parse_datatype_string(schema)
    columns = list(zip(*rows)) or [[] for _ in types.names]
    arrow = to_arrow_schema(types)
    table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=types)


def settle(df: DataFrame, bound: int = LOCAL_ROW_BOUND) -> DataFrame:
    """Compute a summary once and reuse it.

    Up to ``bound`` rows it becomes a local relation, whose exact size Spark
    knows, so Spark's own threshold decides whether a join broadcasts it. A
    larger summary is checkpointed and joined with a shuffle.
    """
    head = df.limit(bound + 1).toArrow()
    if head.num_rows <= bound:
        return df.sparkSession.createDataFrame(head, schema=df.schema)
    return checkpointed(df)
