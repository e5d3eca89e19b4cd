"""Text kernels over Arrow buffers, and tables in the shared scratch folder.

The kernels see a batch of texts as one byte array plus offsets, so a word, a shingle or an
n-gram costs a few vectorised numpy operations and no Python object. Batches are cut into
pieces of about ``CHUNK`` bytes (a longer text is a piece by itself), which bounds memory.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random odd-free 64-bit value for each byte, so that a word's polynomial has large coefficients.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        _powers[:] = [np.concatenate(([_U(1)], np.full(size - 1, b, _U))).cumprod(dtype=_U) for b in (_BASE, _BASE_INV)]
    return _powers[0][:n], _powers[1][:n]


#: The separators of words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK):
    """Yields (first row, row after the last, bytes, offsets) of consecutive pieces of a string column."""
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and where each text's words begin among them."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by differences of one running polynomial."""
    n = len(data)
    p, inv = powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(BYTE_VALUE[data] * p[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * inv[starts])


_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive word hashes (over text ends too)."""
    if len(h) < k:
        return np.zeros(0, _U)
    out = np.zeros(len(h) - k + 1, _U)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _U(_STEP[i])
    return mix64(out)


def count_words(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), np.int64)
    for lo, hi, data, offs in chunks(column):
        out[lo:hi] = np.diff(word_spans(data, offs)[2])
    return out


def char_lengths(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in byte ranges."""
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=c[1:])
    return c[ends] - c[starts]


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="tesserae-scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one run, in a shared folder that goes when the session ends at the latest."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.paths: list[tuple[DataFrame, str]] = []
        self.files.deleteOnExit(self._path(self.folder))

    def _path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, written and read back: short lineage, same rows for each reader."""
        path, schema = f"{self.folder}/{name}-{len(self.paths)}", df.schema
        df.write.parquet(path)
        self.paths.append((out := self.spark.read.schema(schema).parquet(path), path))
        return out

    def drop(self, *spent: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df, path in self.paths:
            if any(df is x for x in spent):
                self.files.delete(self._path(path), True)

    def keep(self, *needed: DataFrame) -> None:
        """Deletes all tables but these."""
        self.drop(*(df for df, _ in self.paths if not any(df is x for x in needed)))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back; the table goes when the session ends."""
    return Scratch(df.sparkSession, name).put(df, "rows")


def crc_mod(column, n: int):
    """crc32 of an integer's decimal text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
