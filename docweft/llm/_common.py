"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once inside a Python task; one longer document forms a slice of its own.
SLICE_BYTES = 1 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def ship(name: str) -> None:
    """Send a module's functions to the workers by value; objects that are broadcast still need the package there."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session may go without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/docweft/{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a table in the shared folder; a lost executor costs no recomputation beyond it."""
    path = f"{scratch_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about `limit` bytes of text at most: the rows, their bytes, their offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def finish(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random value for each byte.
BYTE_VALUE = finish(np.arange(1, 257, dtype=np.uint64) * MIX)
#: ASCII capitals lowered; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUE = BYTE_VALUE[LOWER]
#: Bytes of words: 0-9, a-z, A-Z and whatever is not ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


_POWERS: dict = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1024)
        _POWERS["up"], _POWERS["down"] = powers(BASE, size), powers(BASE_INVERSE, size)
    return _POWERS["up"], _POWERS["down"]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, 64-bit hash (of the lowered bytes) and row of each word; words end at row ends."""
    n = len(data)
    flags = np.zeros(n + 2, np.int8)
    flags[1:-1] = IN_WORD[data]
    change = np.diff(flags)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts = np.flatnonzero(change == 1)
    ends = np.flatnonzero(change == -1)
    inner = np.unique(cut[(flags[cut] == 1) & (flags[cut + 1] == 1)]) if len(cut) else cut
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    up, down = power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LOWER_VALUE[data] * up[:n], out=total[1:])
    h = finish((total[ends] - total[starts]) * down[starts])
    return starts, ends, h, np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(h: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words in one row, and the index of its first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = h[:n].copy()
    for j in range(1, size):
        total = total * np.uint64(BASE) + h[j : j + n]
    at = np.flatnonzero(rows[:n] == rows[size - 1 : size - 1 + n])
    return finish(total[at] + np.uint64(size)), at


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


ship(__name__)
