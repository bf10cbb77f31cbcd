"""Session helpers: scratch space for cutting lineage, and small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tallyspark") -> SparkSession:
    """A session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.debug.maxToStringFields", "200")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables, below ``spark.checkpoint.dir``.

    On a cluster that setting has to name a folder every executor reaches. Only in local mode, and only
    where it is unset, a temporary folder takes its place.
    """
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_SCRATCH[app]


#: Setting under which the shuffles of a query are deleted once it has run; a written table does not need them any more.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the table once to the shared scratch folder and read it back.

    Cuts the lineage, survives executor loss, keeps columns prunable, and fixes
    anything that could differ between two evaluations of the same plan. The tables
    stay until ``drop_scratch``, as results are read from them when they are asked for.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE) if kept is None else spark.conf.set(_FREE, kept)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results not yet read or written are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table from a short list of rows whose number does not grow with the data."""
    plain = lambda v: v.item() if hasattr(v, "item") else v  # noqa: E731  (numpy scalars to Python ones)
    return spark.createDataFrame([tuple(plain(v) for v in r) for r in rows], schema)
