"""What the corpus operators share: the shared folder, folds, and vectorised work on bytes."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only on a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (folder or f"file:///tmp/larkspur-{os.getuid()}/checkpoints").rstrip("/")


_own: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends (other stores than mounted ones keep it for their own clean-up)."""
    own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if own not in _own and urlparse(own).scheme in ("", "file"):
        _own.add(own)
        atexit.register(shutil.rmtree, mounted(own), ignore_errors=True)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes the files of tables made by :func:`cut` that nothing reads any more."""
    for frame in frames:
        for file in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mounted(uri: str) -> str:
    """The local path of a folder that every executor mounts; memory-mapped files need one."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {uri}")
    return unquote(parts.path)


def save_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Each array as a file of its own; a retried or a second attempt at the task replaces them by the same ones."""
    os.makedirs(folder, exist_ok=True)
    for key, x in arrays.items():
        part = f"{folder}/.{name}.{key}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, x)
        os.replace(part, f"{folder}/{name}.{key}.npy")


_open: dict[str, dict[str, np.ndarray]] = {}


def mapped_arrays(folder: str, name: str, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Saved arrays, mapped into memory; the keys are empty where nothing was saved under that name."""
    if (path := f"{folder}/{name}") not in _open:
        if not os.path.isdir(folder):
            raise FileNotFoundError(f"the folder {folder} is not mounted here")
        there = os.path.exists(f"{path}.{columns[0]}.npy")
        _open[path] = {c: np.load(f"{path}.{c}.npy", mmap_mode="r") for c in columns} if there else {columns[0]: np.zeros(0, np.uint64)}
    return _open[path]


#: Texts may be long: so many rows make an Arrow batch at most, which bounds the memory of both sides of a worker.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS, if they are more (or unlimited)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % parts


#: Bytes of text after which a worker gives freed memory back to the system.
TRIM_BYTES = 32 << 20
_since_trim = 0


def give_back() -> None:
    """Returns the memory that this worker has freed but holds: workers are reused, and their leftovers would add up."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only the GNU library has it
        return


def chunks(batch: pa.RecordBatch, text: int = 0, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in the text column each, one row at least."""
    if not batch.num_rows:
        return
    sizes = text_offsets(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    global _since_trim
    _since_trim += int(sizes[-1])
    if _since_trim >= TRIM_BYTES:
        _since_trim = 0
        give_back()


def text_offsets(column: pa.Array) -> np.ndarray:
    """Offsets into the bytes of a string or binary column, nulls as empty."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and their offsets (nulls as empty)."""
    import pyarrow.compute as pc

    kind = pa.large_binary()
    column = pc.fill_null(column.cast(kind), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Lower case for A-Z only; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word rule: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (by default ``[^\\x20\\x09-\\x0D]+``), and the number of words of each text. No word crosses texts."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(separators[data], out=inside[:-1])
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[offsets] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (breaks | ~before))
    ends = np.flatnonzero(before & (breaks | ~inside))
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 64, size=256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every output bit depends on every input bit (a finaliser of shifts and products)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes or of 64-bit hashes: :func:`span_hashes` gets the hash of any span from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_CODES[data] if data.dtype == np.uint8 else data) * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, wherever in the buffer it lies."""
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of the texts, A-Z in lower case; and the number of words of each text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets)
    return span_hashes(prefix_sums(data), starts, ends), counts
