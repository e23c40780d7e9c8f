"""Session helpers: a tuned SparkSession, the shared folder, and materialisation that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "graphloom", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benches; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent the context's checkpoint folder is taken; in a local session (as in tests) without
    one, a folder of this machine is set. On a cluster that would be a folder which executors do not see: it is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


_written: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    _written.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _written[-1]


def release(spark: SparkSession) -> int:
    """Deletes what ``materialize`` and users of ``scratch`` have written in this process; results that read it must have been taken."""
    n = 0
    while _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: the lineage is cut, and a lost
    executor costs only a reread of the file."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame | None) -> bool:
    """Deletes what ``materialize`` wrote for ``df`` (a superseded round of a loop); nothing may read it afterwards. Other frames are left alone."""
    path = getattr(df, "scratch_path", None)
    if path not in _written:
        return False
    _written.remove(path)
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True))


_held: dict[tuple, tuple[str, object]] = {}


def held(spark: SparkSession, key: tuple, tag: str, build):
    """``build(path)`` of a new path in the shared folder, once for a key and application; after ``release`` it is built again."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _held or _held[key][0] not in _written:
        path = scratch(spark, tag)
        _held[key] = path, build(path)
    return _held[key][1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
