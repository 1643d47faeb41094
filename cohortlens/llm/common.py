"""Shared folders, table reading, Arrow buffers and vectorised hashes of words and bytes.

The byte kernels work on the UTF-8 bytes of many texts at once.  White space (0x20, 0x09-0x0D)
is ASCII, so no multi-byte character is ever cut.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import checkpointed, scratch_path

__all__ = ["broadcast_within", "checkpointed", "materialised", "read_table", "scratch_path"]

#: Bytes of text that a kernel works on at once (a longer single text is taken alone); its 64-bit arrays stay within a core's cache.
PIECE_BYTES = 256 << 10
#: Largest table, in bytes, that is sent to every executor; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes of the batches of rows that go to a Python worker and back, see ``small_batches``.
BATCH_BYTES = 4 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODE = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with this package shipped to the Python workers of all executors."""
    context = df.sparkSession.sparkContext
    if getattr(context, "_cohortlens_shipped", None) is None:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="cohortlens-code-"), "cohortlens.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
        context._cohortlens_shipped = archive
    return df.mapInArrow(giving_back(function), schema)


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends batches of at most ``BATCH_BYTES``, unless it names a size itself.

    Batches of 10,000 whole texts lie twice in the executor and twice in each worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def giving_back(function: Callable) -> Callable:
    """An Arrow function that leaves its worker's memory as small as it was; workers are used again by other tasks."""
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        release()
    return run


def release() -> None:
    """Give freed memory back to the system, and the tables of powers that a very long text needed."""
    if len(_powers["up"]) > 16 * PIECE_BYTES:
        for key in _powers:
            _powers[key] = np.ones(1, np.uint64)
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def materialised(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: later uses neither recompute nor need lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose successor is written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_within(df: DataFrame, bytes_of=None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the measured size is within ``limit``; else the join shuffles.

    ``bytes_of`` is a column with the size of a row (64 bytes if not given).
    """
    size = df.agg(F.sum(F.lit(64) if bytes_of is None else bytes_of)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows: (first row, last row + 1, bytes, offsets from 0). Null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column, kind = column.fill_null("" if pa.types.is_string(column.type) else b""), np.int32
    else:
        column, kind = column.fill_null("" if pa.types.is_large_string(column.type) else b""), np.int64
    n = len(column)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset:column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        cut = offsets[row:end + 1]
        yield row, end, data[cut[0]:cut[-1]], cut - cut[0]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``n`` + 1 of each."""
    if len(_powers["up"]) <= n:
        size = 1 << int(n).bit_length()
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size + 1, base, np.uint64)
            factors[0] = 1
            _powers[key] = np.cumprod(factors, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums (modulo 2^64), so that ``span_hash`` costs one subtraction."""
    up, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:len(codes)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of codes; equal spans hash alike wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: byte starts, byte ends, and the first word of every text (one more at the end)."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut) & (np.arange(n + 1) < n))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(byte_codes(data)), starts, ends)


def bit_sums(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Set bits per position and run of ``hashes``; run i is first[i]:first[i + 1]."""
    counts = np.zeros((len(first) - 1, 64), np.int64)
    for low in range(0, len(hashes), 1 << 17):
        own = np.clip(first - low, 0, min(1 << 17, len(hashes) - low))
        full = np.flatnonzero(np.diff(own) > 0)
        bits = np.unpackbits(hashes[low:low + (1 << 17)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[full] += np.add.reduceat(bits, own[full], axis=0, dtype=np.int32)
    return counts


def majority_bits(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if set in over half of the hashes."""
    if not len(counts):
        return np.zeros(0, np.uint64)
    packed = np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little")
    return packed.view(np.uint64).ravel()
