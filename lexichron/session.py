"""Session helpers: reading tables, shared scratch space, sizes.

``written`` is the library's way to cut a lineage.  It writes a Parquet table
below the folder named by ``spark.checkpoint.dir``, which all executors share,
so a lost executor costs only its running tasks.  Only where that setting is
missing and all runs in one local process (unit tests, a laptop) a temporary
folder is used; on a cluster the setting must be there.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", "") or conf.get("spark.checkpoint.dir", "")
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(tempfile.mkdtemp(prefix="lexichron-"))
        atexit.register(shutil.rmtree, _OWN_ROOT[0], ignore_errors=True)
    return _OWN_ROOT[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder, read back.

    The files live as long as the folder, or until ``discard``; whoever owns the folder clears it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a written table, once nothing will read it again. Only files below the scratch folder go."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if jvm.org.apache.hadoop.fs.Path(scratch_root(spark)).toUri().getPath() == path.getParent().toUri().getPath():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def timed(label: str, tell: Callable[[str], None] = print) -> Iterator[None]:
    """Tells how long what is done within took."""
    began = time.monotonic()
    try:
        yield
    finally:
        tell(f"{label}: {time.monotonic() - began:.1f} s")


def cores(spark: SparkSession) -> int:
    """Tasks that can run at once, as far as Spark knows."""
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of an explicit repartition: the session's shuffle setting, and no fewer than there are cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores(spark))
