"""Byte-level BPE encoding and decoding with a public vocabulary file.

A piece of text (as the pre-tokenizer splits it) is a doubly linked list of symbols. A priority queue holds
the ranks of the merges that are possible now; an entry whose symbols have changed since is stale and skipped.
Each piece costs O(n log n), so a text without any space is no special case. Decoding concatenates the
vocabulary's byte strings.

Defined cases: a null or empty text has no ids and decodes to the empty text; a null ids value decodes to the
empty text; the strings of added tokens found in a text become those tokens, as the public library does it;
repeated rows are encoded each; other columns are kept as they are, but for the output names, which replace
columns of the same name.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import bounded_batches, chunks

#: Fixed value: how byte-level vocabularies split a text before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps encoded; memory stays bounded and the result is the same with any number.
CACHED = 150_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    keep = set(shown)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Codec:
    """Encodes and decodes with one vocabulary; built once per worker from the bytes of the vocabulary file."""

    def __init__(self, file: bytes):
        import regex

        spec = json.loads(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        to_char = byte_characters()
        to_byte = {c: b for b, c in enumerate(to_char)}
        pair = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pair)}
        self.symbol = [vocab[c] for c in to_char]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.strings[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda s: [s]
        self.pieces = regex.compile(PIECES).findall
        self.cache: dict[str, bytes] = {}

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one piece: the possible merge of the lowest rank, leftmost first, until none is left."""
        merges, ids = self.merges, [self.symbol[b] for b in piece]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one of the two symbols has been merged since
            ids[i], ids[j] = merged, -1
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                if found := merges.get((merged, ids[after])):
                    heapq.heappush(queue, (found[0], i, merged, ids[after], found[1]))
            before = left[i]
            if before >= 0 and (found := merges.get((ids[before], merged))):
                heapq.heappush(queue, (found[0], before, ids[before], merged, found[1]))
        return [x for x in ids if x >= 0]

    def packed(self, piece: str) -> bytes:
        ids = np.array(self.piece_ids(piece.encode()), dtype="<u4").tobytes()
        if len(self.cache) >= CACHED:
            self.cache.clear()
        self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out, get, packed = [], self.cache.get, self.packed
        for part in self.split(text):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out += [get(p) or packed(p) for p in self.pieces(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(file: Broadcast) -> Codec:
    if (key := hash(file.value)) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(file.value)
    return _codecs[key]


def _vocabulary(df: DataFrame, path: str) -> Broadcast:
    """The file is a parameter of fixed size (under 2 MB), so it is broadcast; executors need no copy of it."""
    bounded_batches(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _schema(df: DataFrame, column: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    kept = [c for c in df.columns if c.lower() != column.lower()]
    return kept, T.StructType([*[df.schema[c] for c in kept], T.StructField(column, kind)])


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with the ids of ``text`` in the binary column ``ids`` (little-endian unsigned 32-bit integers)."""
    file = _vocabulary(df, vocabulary)
    kept, schema = _schema(df, ids, T.BinaryType())
    at = df.columns.index(text)
    keep = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file)
        try:
            for batch in batches:
                for part in chunks(batch, at):
                    made = pa.array([codec.encode(x or "") for x in part.column(at).to_pylist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], made], [*kept, ids])
        finally:
            codec.cache.clear()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` in the column ``text``."""
    file = _vocabulary(df, vocabulary)
    kept, schema = _schema(df, text, T.StringType())
    at = df.columns.index(ids)
    keep = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file)
        for batch in batches:
            for part in chunks(batch, at):
                made = pa.array([codec.decode(x or b"") for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], made], [*kept, text])

    return df.mapInArrow(run, schema)
