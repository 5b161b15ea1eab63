"""What the operators share: table reading, checkpointing, byte-level word splitting and 64-bit hashing.

Words are maximal runs of bytes outside space and 0x09-0x0D, so they are found on UTF-8 bytes without
decoding; everything here works on whole Arrow batches with numpy, never on one word at a time.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are worked on in pieces of about this many bytes, so that temporary arrays stay small.
PIECE_BYTES = 1 << 19
_WINDOW = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or the context's; in local mode alone one of our own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="flowspark-shared-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there and lost executors cost nothing before it.

    release() removes the table; one that a returned result still reads goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/flowspark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return out


def release(*tables: DataFrame) -> None:
    """Removes what cut() wrote for these; nothing may read them from now on."""
    for df in tables:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Cuts:
    """cut(), for tables that are released together when what follows from them is cut itself."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(cut(df))
        return self.tables[-1]

    def release(self) -> None:
        release(*self.tables)
        self.tables = []


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df marked for broadcast if it is counted to have at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def join_counted(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, least: int = 1000, most: int = 100_000) -> DataFrame:
    """rows joined to table, which has one row a key, with n: how many of the total rows have the key (n goes).

    Keys with at least max(least, total / most) rows are hot. There are at most `most` of them, so they are broadcast, and
    their rows stay where they are; only the others are dealt out by key.
    """
    if total < least:
        return rows.join(table.drop("n"), key)
    hot = F.col("n") >= max(least, total / most)
    tried = rows.join(F.broadcast(table.where(hot).withColumnRenamed("n", "__n")), key, "left")
    added = [c for c in table.columns if c != "n" and c not in ([key] if isinstance(key, str) else key)]
    found = tried.where("__n IS NOT NULL").drop("__n")
    rest = tried.where("__n IS NULL").drop("__n", *added).join(table.where(~hot).drop("n"), key)
    return found.unionByName(rest)


def without(df: DataFrame, names) -> DataFrame:
    """df less its columns of these names in any case: an operator's own columns take their place."""
    names = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in names])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche; a bijection, so it adds no collisions."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


_BYTE = np.arange(256, dtype=np.uint8)
IS_SPACE = (_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))
FOLD = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_EXACT = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FOLDED = _EXACT[FOLD]
_R = 0x2545F4914F6CDD1D
_RINV = pow(_R, -1, 1 << 64)


def _powers(r: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, r, dtype=U64)
        out[0] = 1
        return np.cumprod(out)


_POW = {_R: _powers(_R, 1 << 12), _RINV: _powers(_RINV, 1 << 12)}


def _pow(r: int, n: int) -> np.ndarray:
    if len(_POW[r]) < n:
        _POW[r] = _powers(r, max(n, 2 * len(_POW[r])))
    return _POW[r][:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for each pair of offsets (sorted, not overlapping): polynomials modulo 2**64, mixed."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + _WINDOW, side="right")))
            hi = int(ends[j - 1])
            n = hi - lo
            sums = np.zeros(n + 1, dtype=U64)
            np.cumsum(values[lo:hi] * _pow(_R, n), out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * _pow(_RINV, n + 1)[s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15)
            i = j
    return mix(out)


class Texts:
    """The texts of some rows as one byte array with offsets; null texts are empty."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets

    @classmethod
    def of(cls, column: pa.Array) -> "Texts":
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(buf[offs[0] : offs[-1]], offs - offs[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """For each text, the number of its bytes at which mask holds."""
        total = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs where inside holds, within one text each, and the number of runs before each text."""
        begin, end = inside.copy(), inside.copy()
        if len(inside):
            at = self.offsets[:-1]
            edge = np.zeros(len(inside), dtype=bool)
            edge[at[at < len(inside)]] = True
            begin[1:] &= ~inside[:-1] | edge[1:]
            end[:-1] &= ~inside[1:] | edge[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self, fold: bool = False) -> "Words":
        starts, ends, first = self.runs(~IS_SPACE[self.buf])
        hashes = range_hash((_FOLDED if fold else _EXACT)[self.buf], starts, ends)
        return Words(starts, ends, first, hashes)

    def hashes(self) -> np.ndarray:
        """One hash of each whole text."""
        return range_hash(_EXACT[self.buf], self.offsets[:-1], self.offsets[1:])


class Words:
    """Byte offsets and hashes of the words of some texts; the words of text i are first[i]:first[i + 1]."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray):
        self.starts, self.ends, self.first, self.hashes = starts, ends, first, hashes

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that begin a window of n words of one text, and the windows' hashes."""
        left = self.first[self.owner() + 1] - np.arange(len(self.hashes))
        at = np.flatnonzero(left >= n)
        return at, chain([self.hashes[at + k] for k in range(n)])


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of a sequence of hashes; another order gives another hash."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(parts[0]), dtype=U64)
        for x in parts:
            out = mix(out * U64(0x9E3779B97F4A7C15) + x)
        return out


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows with about PIECE_BYTES of text; a longer text is a slice of its own."""
    lengths = np.array(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    at = 0
    while at < len(lengths):
        n = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + 65536]), PIECE_BYTES, side="right")))
        yield batch.slice(at, n)
        at += n


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)
