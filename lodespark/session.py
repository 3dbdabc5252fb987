"""Session helpers: reading tables, cutting lineage, joins behind a size check."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a one- or two-long key table that may be broadcast: 16 bytes each, so 32 MB at most.
BROADCAST_KEYS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the store in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none (tests, a single machine) a temporary folder is set once.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not _one_machine(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodespark-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return own


_stashes: list[tuple[SparkSession, str]] = []


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends at files that outlive any executor.

    The table is there as long as this driver; ``discard`` removes it before, once what reads it has run.
    """
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    if not _stashes:
        atexit.register(discard)
    _stashes.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard() -> None:
    """Remove the tables that ``stash`` has written; what was read from them can't run again."""
    while _stashes:
        spark, path = _stashes.pop()
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
        except Exception:  # the session and its JVM are gone
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for steps that are heavy on each row.

    A scan of fewer pieces than cores is dealt out by ``keys`` first; a larger one, or what is already shuffled, stays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def semi_by_key(df: DataFrame, keys: DataFrame, on: str, bound: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys``.

    ``keys`` is counted first: up to ``bound`` rows it is broadcast and ``df`` isn't shuffled, beyond it both sides are.
    """
    if keys.limit(bound + 1).count() <= bound:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")


def ship(spark: SparkSession) -> None:
    """Send this package to executors that don't have it on their path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if _one_machine(spark) or root in os.environ.get("PYTHONPATH", "").split(":"):
        return
    if getattr(spark.sparkContext, "_lodespark_shipped", False):
        return
    shared = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    # the driver serves the archive, so where the shared folder is no path of this machine any place will do
    folder = os.path.join(shared, f"package-{uuid.uuid4().hex}") if shared.startswith("/") else tempfile.mkdtemp(prefix="lodespark-zip-")
    os.makedirs(folder, exist_ok=True)
    base = os.path.join(folder, "lodespark")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "lodespark"))
    spark.sparkContext._lodespark_shipped = True


def local_session(cpus: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in os.environ.get("PYTHONPATH", "").split(":"):
        os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}".rstrip(":")
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lodespark")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
