"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections import defaultdict
from contextvars import ContextVar
from itertools import count

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables by run, so that runs side by side in one driver leave each other's alone.
_run: ContextVar[int] = ContextVar("run", default=0)
_runs = count(1)
_made: dict[int, list[tuple[SparkSession, str]]] = defaultdict(list)


def begin_run() -> None:
    """From here on tables belong to a run of their own, as far as this thread is concerned."""
    _run.set(next(_runs))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it only a master that is one process gets a folder of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="genoflux-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that goes with the application, or with drop_since."""
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made[_run.get()].append((spark, path))
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts the lineage, survives lost executors,
    and lets Spark drop the shuffle files of the job that made it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = None
    with contextlib.suppress(Exception):
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """How many tables the run has, for drop_since."""
    return len(_made[_run.get()])


def drop_since(since: int, keep: int = 0) -> None:
    """Delete the run's tables made since a mark, but for the last `keep`, once nothing is to be read from them again."""
    own = _made[_run.get()]
    gone = own[since : len(own) - keep]
    del own[since : len(own) - keep]
    for spark, path in gone:
        _delete(spark, path)


@atexit.register
def _sweep() -> None:
    """Scratch tables go with the application; results that are still to be read must not lose them earlier."""
    for own in _made.values():
        for spark, path in own:
            _delete(spark, path)
