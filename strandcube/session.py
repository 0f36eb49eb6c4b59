"""Session builder and the few helpers that touch the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


T = TypeVar("T")


def build_session(app: str = "strandcube", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE with skew handling, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        base["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def _own_folder(prefix: str) -> str:
    """A folder of this process only, removed at its end."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; make a local one only in local mode without that setting."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(_own_folder("strandcube-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they were started."""
    sc = spark.sparkContext
    if getattr(sc, "_strandcube_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(_own_folder("strandcube-ship-")) / "strandcube.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._strandcube_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder; later reads survive the loss of executors.

    The rows are counted on the way, for :func:`small`.
    """
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    out._counted = int(seen.get["n"] or 0)
    return out


class Scratch:
    """Tables written into the shared checkpoint folder and removed together; for rounds, whose plans would grow through :func:`cut`."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"
        self.tables = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.base}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``max_rows`` rows, else as it is.

    A frame that :func:`cut` made was counted then; for others a count runs that
    stops at ``max_rows + 1`` rows, so give it a frame that is cheap to count.
    """
    rows = getattr(df, "_counted", None)
    return F.broadcast(df) if (df.limit(max_rows + 1).count() if rows is None else rows) <= max_rows else df


#: Seconds for which :func:`kept` holds a result.
KEEP_SECONDS = 600.0
_KEPT: dict[tuple, tuple[float, object]] = {}


def kept(spark: SparkSession, folder: str, name: str, make: Callable[[], T]) -> T:
    """The result of ``make``, or the one it gave for the same tables within the last ``KEEP_SECONDS``.

    For models and what they predict, which several queries read. A result is known
    by the session, the files of the folder with their sizes and times, and ``name``.
    Frames among it should come from :func:`cut`, so that they lie in the shared
    folder.
    """
    files = tuple(sorted((str(p), p.stat().st_size, p.stat().st_mtime_ns) for p in Path(folder).rglob("*.parquet"))) if Path(folder).is_dir() else ()
    key = (spark.sparkContext.applicationId, folder, name, files)
    found = _KEPT.get(key)
    if not files or found is None or time.monotonic() - found[0] > KEEP_SECONDS:
        found = (time.monotonic(), make())
        for old in [k for k, (at, _) in _KEPT.items() if time.monotonic() - at > KEEP_SECONDS]:
            del _KEPT[old]
        _KEPT[key] = found
    return found[1]


#: Rows of training data per partition: fits run hundreds of small jobs, which cost more than their rows where those are few.
TRAIN_ROWS = 20_000


def packed(df: DataFrame) -> DataFrame:
    """``df`` computed once (see :func:`cut`) in as few partitions as hold about ``TRAIN_ROWS`` rows each."""
    out = cut(df)
    return out.coalesce(max(1, -(-out._counted // TRAIN_ROWS)))


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def partitions_of(df: DataFrame) -> int:
    """Partitions of ``df`` as planned; a plan with exchanges is not run for it, but taken to have :func:`parallelism`."""
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return parallelism(df.sparkSession)
    return df.rdd.getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: for costly work on rows that came in few splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if partitions_of(df) < cores else df
