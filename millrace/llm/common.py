"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* a null text counts as an empty one unless the operator says otherwise;
* an intermediate result that several jobs read is written as Parquet below
  ``spark.checkpoint.dir`` (:func:`staged`), which all executors share, so a lost
  executor costs a task and never the job;
* working columns are named ``_m_*``; inputs are projected to the named columns
  first, so extra columns of any name do no harm.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes that are none of these (the six ASCII blanks).
BLANKS = " \t\n\x0b\f\r"
BLANK_RE = r"[\x20\x09-\x0D]"

_OWN: dict[str, str] = {}
_SCOPE = ["operators"]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(__import__("shutil").rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{_scratch(df.sparkSession, _SCOPE[-1])}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scratch(spark: SparkSession, scope: str) -> str:
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{scope}"


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables staged inside go to a folder of that name, which :func:`clear` can remove."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def clear(spark: SparkSession, name: str) -> None:
    """Remove what was staged in a scope, once all that reads it has been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark, name))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8; ``bytes.split`` cuts at exactly the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """As :func:`words_of` with A-Z lower-cased (``bytes.lower`` touches ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


@functools.cache
def _trim():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give unused memory back: Python workers live on between stages, and would keep the most they ever took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows, so that results leave before the next part is read."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
        release()


def texts_of(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """The texts of an Arrow column, made in small slices so that a batch's strings are never all in Python at once."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()
    if len(column) > 4096:  # else :func:`parts_of` does
        release()


def crc_fold(key: str, k: int) -> Column:
    """Fold of a row: CRC-32 of the key as text, modulo ``k``. A null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % k


class WordHash(dict):
    """word -> 64-bit hash, remembered; forgets all when it has grown to ``bound`` words."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        import xxhash

        self.of, self.bound = xxhash.xxh3_64_intdigest, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = self.of(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words from the words' hashes; fewer than ``k`` words: of the whole run."""
    n = len(h)
    k = min(k, n)
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    return out
