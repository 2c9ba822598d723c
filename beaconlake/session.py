"""Session settings and shared scratch space."""
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app="beaconlake", cores="*", partitions="8"):
    """A session for tests and the local bench; a cluster brings its own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", partitions)
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", "12g")
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names, or, only where
    none is named (local tests), a fresh temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


_passing = []           # what was stored inside each open `stored` call


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes the rows (and their partitions) and cuts the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    got = df.checkpoint(eager=True)
    if _passing:
        _passing[-1].append(stored_at(got))
    return got


def stored_at(df: DataFrame) -> str:
    """The folder of a checkpointed table."""
    return df._jdf.logicalPlan().rdd().getCheckpointFile().get()


def stored(make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, stored by a checkpoint. What it stored on the way is deleted then, as nothing
    reads it any more. Shuffle files go when the driver's collector meets their handles, so it is asked to run."""
    _passing.append([])
    try:
        got = checkpointed(make())
    except BaseException:
        _passing.pop()
        raise
    *passed, own = _passing.pop()
    if _passing:
        _passing[-1].append(own)
    removed(got.sparkSession, passed)
    return got


def removed(spark: SparkSession, paths: list[str]):
    """Delete stored tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"
