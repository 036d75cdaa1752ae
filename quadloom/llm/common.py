"""What the operators share: checkpoints, word splitting, batches of Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import glob
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator that counts words: a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words. bytes.split() cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """As words_of, with A-Z lower-cased; bytes.lower() touches nothing but A-Z."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a folder of this machine, if Spark runs on it alone."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="ckpt")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the folder that all executors share and forget its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def let_go() -> None:
    """At the end of a task: give what its caches held back to the system, as workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library trims
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def one_thread():
    """Run numpy's matrix products on one thread: thin ones gain nothing from more, which spin beside other work.

    Left as it is where numpy comes with another library than OpenBLAS.
    """
    calls = []
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        with contextlib.suppress(OSError, AttributeError):
            library = ctypes.CDLL(path)
            calls.append((library.scipy_openblas_get_num_threads64_, library.scipy_openblas_set_num_threads64_))
    before = [get() for get, _ in calls]
    try:
        for _, put in calls:
            put(1)
        yield
    finally:
        for (_, put), n in zip(calls, before):
            put(n)


def tidy(task):
    """A mapInPandas function that lets go of its memory when its partition is done."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            let_go()

    return run


#: Rows and bytes of one Arrow batch where rows hold whole texts.
BATCH_ROWS, BATCH_BYTES = 250, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: texts are long, and some very long.

    Left alone where the session has set figures of its own.
    """
    for name, value, usual in (("maxRecordsPerBatch", BATCH_ROWS, "10000"), ("maxBytesPerBatch", BATCH_BYTES, None)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is not None and (usual is None and _bytes(now) > value or now == usual):
            spark.conf.set(key, str(value))


def _bytes(said: str) -> int:
    digits = "".join(c for c in said if c.isdigit())
    unit = said[len(digits) :].strip().lower()[:1]
    return int(digits or 0) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_bucket(column: str, modulus: int):
    """crc32 of the column as text, modulo modulus: the folds of the labelled rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
