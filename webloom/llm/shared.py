"""What several operators need of Spark: the shared folder, free column names, checked broadcasts, exchange of packed blobs."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a side of one or two numbers a row up to which it is broadcast; beyond it, Spark joins by shuffle.
BROADCAST_ROWS = 4_000_000
#: Bytes of rows that a worker takes at once.
STEP_BYTES = 4 << 20
#: Bytes of input (as the optimizer estimates them) for each partition that a worker takes whole.
PART_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only where that is unset (a single machine, as in tests) one is made."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it names the folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_place(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor loses nothing of it."""
    at = new_place(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it while df has such a column (in any case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (best a written table), to be broadcast if its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, each: int = PART_BYTES) -> int:
    """Partitions for what is derived from df: what the session names, but more where its input is larger than `each` bytes a partition.
    An input whose size the optimizer doesn't know (it says 2**63 or so) has what the session names."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(partitions(df.sparkSession), -(-size // each) if size < 1 << 56 else 0)


def exchange(df: DataFrame, parts: int) -> DataFrame:
    """Rows (part int, blob binary) to the partition of their number."""
    return df.repartitionById(parts, F.col("part"))


def typed(df: DataFrame, id_col: str, rest: str) -> StructType:
    """The id column as df has it, then other columns (DDL)."""
    return StructType([df.schema[id_col], *StructType.fromDDL(rest).fields])


BLOBS = "part int, blob binary"
Batches = Iterator[pa.RecordBatch]


def blob_rows(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], ["part", "blob"])


def released() -> None:
    """Gives memory that a task no longer uses back to the system, as workers stay for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def rows_of(batches: Batches, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], most: int = STEP_BYTES) -> Batches:
    """step on all rows, at most about `most` bytes (one row at least) at once, whatever the size of the batches."""
    for b in batches:
        rows = max(1, b.num_rows * most // max(b.nbytes, 1))
        for at in range(0, b.num_rows, rows):
            yield from step(b.slice(at, rows))
    released()


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def save(place: str, name: str, array: np.ndarray) -> None:
    """An array as a file; a task that is run again writes the same file."""
    at = _local(place)
    if at is None:
        system, path = fs.FileSystem.from_uri(place)
        with system.open_output_stream(f"{path}/{name}.npy") as f:
            f.write(_npy(array))
        return
    os.makedirs(at, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=at)
    with os.fdopen(handle, "wb") as f:
        f.write(_npy(array))
    os.replace(temporary, f"{at}/{name}.npy")


def _npy(array: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.save(f, array)
    return f.getvalue()


def mapped(place: str, name: str) -> np.ndarray | None:
    """The array of that name, mapped into memory; None if there is none (yet). Where the shared folder isn't a file system (a mount), an array
    can't be mapped and is read whole, so that a mount is needed where arrays are larger than a worker's memory."""
    try:
        return _opened(place, name)
    except FileNotFoundError:
        return None


@cache
def _opened(place: str, name: str) -> np.ndarray:
    at = _local(place)
    if at is not None:
        return np.load(f"{at}/{name}.npy", mmap_mode="r")
    system, path = fs.FileSystem.from_uri(place)
    with system.open_input_stream(f"{path}/{name}.npy") as f:
        return np.load(io.BytesIO(f.read()))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each, compressed by planes of their bytes, with the lengths of both before them."""
    press = zstandard.ZstdCompressor(level=1).compress
    parts = [press(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in map(np.ascontiguousarray, arrays)]
    return b"".join([np.array([[len(a), len(b)] for a, b in zip(arrays, parts)], np.int64).tobytes(), *parts])


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, 2 * len(kinds)).reshape(-1, 2), 16 * len(kinds), []
    for (n, size), kind in zip(sizes.tolist(), kinds):
        wide = np.dtype(kind).itemsize
        raw = zstandard.ZstdDecompressor().decompress(blob[at : at + size], max_output_size=n * wide) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, n).T).reshape(-1).view(kind))
        at += size
    return out


def least_type(top: int):
    """The narrowest kind of number that holds up to top."""
    return np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64
