"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type


def local_session(cores: str = "*", app: str = "shelfspark") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.openCostInBytes", "131072")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session gets one of its own.

    On a cluster the folder must be shared, so an unset one is an error there
    rather than a silent machine-local folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="shelfspark-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a wide intermediate result to the shared folder and read it back.

    Cuts lineage like a checkpoint, and later steps read only the columns they
    need and know the table's size when they choose a join.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table the optimizer knows the size of (a local relation).

    Rows handed over as Arrow stay in the plan, so joins against them can be
    broadcast by the session's own size threshold.
    """
    fields = spark.createDataFrame([], schema).schema.fields
    columns = {f.name: [r[i] for r in rows] for i, f in enumerate(fields)}
    table = pa.table({
        f.name: pa.array(columns[f.name], to_arrow_type(f.dataType)) for f in fields
    })
    return spark.createDataFrame(table)
