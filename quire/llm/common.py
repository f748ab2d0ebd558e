"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words: space, tab, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


#: Bytes up to which a table of few files is dealt out after the scan.
FEW_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  A small one in fewer files than there are cores may be one row group, which one task
    reads: it is dealt out; the size that allows it is checked, so a large table is never shuffled here."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= FEW_BYTES and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a local
    master, all in one process, gets a folder of its own; on a cluster that would not be shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark removes a query's shuffle files when it ends: staged tables are read from the shared folder.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def worker_cache(key, make):
    """What a Python worker keeps between tasks under key.  It keeps one thing at a time: what another
    stage left is dropped and its memory handed back, so that stages don't add up."""
    import sys
    import types

    kept = sys.modules.setdefault("_quire_worker", types.ModuleType("_quire_worker")).__dict__
    if ("kept", key) not in kept:
        for old in [k for k in kept if isinstance(k, tuple)]:
            del kept[old]
        handed_back()
        kept["kept", key] = make()
    return kept["kept", key]


def handed_back() -> None:
    """Returns freed memory of this process to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library can
        pass


def words_of(text: Column) -> Column:
    """Words of a text as an array; null for null."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def coded_words(texts: list[bytes]):
    """Words of texts (split at ASCII white space), by dictionary: the distinct words, the number of
    each word in turn, and where each text's words begin (one more place than texts)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        column = pa.array(texts, pa.string())
    except (pa.ArrowInvalid, UnicodeDecodeError):
        column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
    lists = pc.ascii_split_whitespace(column)
    coded = lists.values.dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    numbers, places = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    if b"" in words:  # before a leading and behind a trailing space
        keep = numbers != words.index(b"")
        places = np.concatenate(([0], np.cumsum(keep)))[places]
        numbers = numbers[keep]
    return words, numbers, places
