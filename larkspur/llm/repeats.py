"""Long repeated passages by run-length indexes: everything covered by a string of ``length`` symbols that also starts elsewhere.

Symbols are bytes (``BYTE``), or words of bytes but white space, A-Z in lower case (``WORD``). What is cut of a text
are bytes either way: a run of words goes with the white space in it and after it.

Spreading the work. The anchor of a string of ``length`` symbols is the position of its smallest gram hash (grams of
``Unit.gram`` symbols, leftmost of equal ones), which depends on the string only; equal strings have equal anchors at
the same offset. So each start of a text belongs to one anchor, the starts of an anchor are a short range, and the
symbols that they need (the anchor's context) are all that has to meet. Contexts are counted by their hashes first,
with partial sums before the shuffle:
- an anchor hash seen once: nothing in the context repeats, and it goes no further;
- all others go to the index: a context that is there once, and two copies of one that is there more often, taken from two
  texts (or two places of one) where there are two; further copies get the answer of the first one.

The index. Contexts are dealt by anchor hash to shards of bounded size. As equal strings have their anchors at the same
offset, the contexts of an anchor hash stand in line by their anchors, and symbols in different columns are unlike. Suffixes
that begin at or before an anchor, as all strings of ``length`` do, are sorted from the anchors to the front: the contexts by
what is from the anchor on, and each column's suffixes from the order of the column after it. The
Burrows-Wheeler transform of these is compressed into runs. The suffix at the head of each run is sampled with the length
of its match with the suffix before it. Matching statistics are streamed over the contexts in text order from these
samples: while the transform stays in a run, the match of the next suffix is one shorter, so that a position's match
is its last sample's, less the distance; the samples of run tails give the match with the suffix after it likewise.
A start whose match is ``length`` or longer repeats. An anchor hash with more contexts than a shard should hold is cut:
the starts of its contexts go by their distance to the anchor into ranges of a twelfth of ``length``, and what all
windows of a range have in common, eleven twelfths of a string, is the anchor hash of the pieces. The pieces are counted, and
go to the index, as the contexts do; those that are still too many under one hash are cut into single starts, of which
each hash has one only. So every answer is the index's, and no shard grows with an anchor.

Defined cases: null is the empty text; a text shorter than ``length`` loses nothing; overlapping and same-document
repeats count; matches never cross documents; repeated rows are repeats of each other; an empty table gives an empty
table; other columns are kept whatever their names, but for the output names, which replace columns of the same name;
a text of more than PIECE symbols is worked on in pieces that overlap, which bounds memory and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, bounded_batches, chunks, cut, give_back, mixed, powers, prefix_sums, span_hashes, text_bytes, word_spans

LENGTH = 400
#: Bytes of contexts in a shard on average, contexts of one anchor hash beyond which they are cut, ranges that they are cut into, and symbols of a text that are worked on at once.
SHARD_BYTES, HOT_CONTEXTS, PARTS, PIECE = 1 << 19, 2048, 12, 1 << 22
#: Bytes of texts whose anchors are found at once: arrays of eight bytes a symbol stay in the cache, and their memory is used again.
TEXT_BYTES = 1 << 17
#: A position in a piece; the rest of 64 bits is of the gram's hash.
_POSITION = np.uint64((1 << 28) - 1)


@dataclass(frozen=True)
class Unit:
    """What a text is a sequence of."""

    gram: int  # symbols of a gram
    code: type  # of a symbol

    def symbols(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts one after the other, and their offsets (nulls as empty)."""
        data, offsets = text_bytes(column)
        if self.code is np.uint8:
            return data, offsets
        starts, ends, counts = word_spans(data, offsets)
        return span_hashes(prefix_sums(LOWER[data]), starts, ends), np.concatenate([[0], np.cumsum(counts)])

    def gone_bytes(self, data: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Which bytes of a text go, given which symbols do: words with the white space in and after them, and all of a text without other words."""
        if self.code is np.uint8:
            return gone
        if len(gone) and gone.all():
            return np.ones(len(data), bool)
        starts, _, _ = word_spans(data, np.array([0, len(data)]))
        change = np.zeros(len(data) + 1, np.int8)
        for a, b in zip(*[iter(_ranges(gone))] * 2):
            change[starts[a]] += 1
            change[starts[b] if b < len(starts) else len(data)] -= 1
        return np.cumsum(change[:-1]) > 0


BYTE, WORD = Unit(32, np.uint8), Unit(8, np.uint64)


def anchors(codes: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of a batch of texts: text, hash, context hash, first start, number of starts, all in order."""
    parts = [x for x in _pieces(codes, offsets, length, gram) if len(x["text"])]
    none = {k: np.zeros(0, np.int64) for k in ("text", "start", "starts", "at")} | {k: np.zeros(0, np.uint64) for k in ("hash", "context")}
    return {k: np.concatenate([x[k] for x in parts]) for k in none} if parts else none


def _pieces(codes: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    if len(codes) <= PIECE:
        yield _anchors(codes, offsets, length, gram)
        return
    for text, (begin, end) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        for a in range(begin, end - length + 1, PIECE):
            own = codes[a : min(a + PIECE + length - 1, end)]
            x = _anchors(own, np.array([0, len(own)]), length, gram)
            yield x | {"text": x["text"] + text, "start": x["start"] + a, "at": x["at"] + a}


def _anchors(codes: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return {"text": np.zeros(0, np.int64)}
    sums = prefix_sums(codes)
    n = len(codes) - gram + 1
    grams = mixed((sums[gram:] - sums[:n]) * powers(len(sums))[1][:n])
    width = length - gram + 1
    keyed = (grams & ~_POSITION) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts_of = np.maximum(sizes - length + 1, 0)
    total = int(starts_of.sum())
    text = np.repeat(np.arange(len(sizes)), starts_of)
    start = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(starts_of) - starts_of), starts_of)
    at = (np.minimum(tail[start], head[start + width - 1]) & _POSITION).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    number = np.diff(np.append(begin, total))
    first, at = start[begin], at[begin]
    context = span_hashes(sums, first, first + number + length - 1) ^ mixed((at - first).astype(np.uint64))
    return {"text": text[begin], "hash": grams[at], "context": context, "start": first, "starts": number, "at": at}


def suffix_order(codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order, by doubling; and the ranks by the first few, twice as many, ... symbols. ``left``: symbols up to the context's end.

    The end of a context comes before any symbol; equal rests of contexts are in the order of their positions.
    """
    n, place = len(codes), np.arange(len(codes), dtype=np.uint64)
    packed = n < 1 << 21  # then two ranks and a position fit into one integer, which sorts several times as fast
    bits = (int(codes.max()) + 1).bit_length()
    key, size = np.zeros(n, np.uint64), 43 // bits  # of two symbols at least while packed, as there are fewer than places
    for k in range(size):  # the end of a context is 0
        shifted = np.zeros(n, np.uint64)
        shifted[: n - k] = codes[k:].astype(np.uint64) + np.uint64(1)
        key = (key << np.uint64(bits)) | np.where(left > k, shifted, np.uint64(0))
    levels, longest = [], int(left.max())
    while True:
        if packed:
            ordered = np.sort(key << np.uint64(21) | place)
            order, ordered = (ordered & np.uint64((1 << 21) - 1)).view(np.int64), ordered >> np.uint64(21)
        else:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
        change = np.ones(n, bool)
        np.not_equal(ordered[1:], ordered[:-1], out=change[1:])
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(change, dtype=np.int32)
        levels.append((size, rank))
        if size >= longest or change.all():
            return order, levels
        ahead = np.zeros(n, np.uint64)
        ahead[: n - size] = rank[size:]
        ahead[left <= size] = 0
        key = rank.astype(np.uint64) << np.uint64(21 if packed else 32) | ahead
        size *= 2


def match_lengths(a: np.ndarray, b: np.ndarray, codes: np.ndarray, left: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the common prefix of the suffixes a[i] and b[i], up to the ends of their contexts."""
    most = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    for _ in range(2):
        for size, rank in reversed(levels):
            x, y = a + out, b + out
            ok = out < most
            same = ok.copy()
            same[ok] = rank[x[ok]] == rank[y[ok]]
            out[same] += size
    for _ in range(levels[0][0] - 1):
        ok = np.flatnonzero(out < most)
        ok = ok[codes[a[ok] + out[ok]] == codes[b[ok] + out[ok]]]
        out[ok] += 1
    return np.minimum(out, most)


def aligned_order(codes: np.ndarray, ends: np.ndarray, lead: np.ndarray, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of texts that stand in line, in order, and the match of each with the one before it.

    ``lead``: symbols of each text before its last one, which is at ``ends`` - 1. The last ones stand under each other, and symbols in
    different columns are unlike, as are those of texts that are not compared. ``order``: the texts by what is from their last symbol
    on, which may go on after ``codes``; ``common``: symbols that each has there in common with the one before it. The suffixes of a
    column are those of the column after it, sorted anew by one symbol, so that each symbol is sorted once.
    """
    bits = np.int64(len(ends).bit_length())
    low = (np.int64(1) << bits) - 1
    orders, matches = [ends[order] - 1], [common]
    for j in range(1, int(lead.max()) + 1):  # symbols before the last
        on = np.flatnonzero(lead[order] >= j)
        keys = codes[ends[order[on]] - 1 - j] << bits | on
        keys.sort()
        at, symbol = keys & low, keys >> bits
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        shared = np.full(len(at), -j)  # counted from the last symbols, so that it stays while two texts are alike
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[::2], between[1::2] = at[same] + 1, at[same + 1] + 1
            shared[same + 1] = np.minimum.reduceat(np.append(common, 0), between)[::2]
        order, common = order[at], shared
        orders.append(ends[order] - 1 - j)
        matches.append(common + j)
    return np.concatenate(orders), np.concatenate(matches)


def _common(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def matching_statistics(codes: np.ndarray, left: np.ndarray | None, first: np.ndarray, aligned: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """For each position the longest match with another position of the shard, from samples at the run ends of the transform.

    ``first`` marks the first symbol of each context; ``aligned``: the suffixes in order and their matches, if they are known (without ``left`` then).
    """
    order, levels = (aligned[0], []) if aligned else suffix_order(codes, left)
    before = np.where(first[order], -1 - np.arange(len(order)), codes[order - 1].astype(np.int64))  # the transform; a context's first symbol has none before it
    edge = np.flatnonzero(before[1:] != before[:-1]) + 1  # first row of each run but the first
    heads, tails = order[np.concatenate([[0], edge])], order[np.concatenate([edge - 1, [len(order) - 1]])]
    up = np.zeros(len(heads), np.int64)
    up[1:] = aligned[1][edge] if aligned else match_lengths(order[edge - 1], order[edge], codes, left, levels)
    down = np.zeros(len(tails), np.int64)
    down[:-1] = up[1:]
    best = np.zeros(len(order), np.int64)
    for sampled, length in ((heads, up), (tails, down)):
        value = np.full(len(order), -1, np.int64)
        value[sampled] = length
        last = np.where(value >= 0, np.arange(len(order)), 0)
        np.maximum.accumulate(last, out=last)
        np.maximum(best, value[last] - (np.arange(len(order)) - last), out=best)
    return best


def _ranges(flags: np.ndarray) -> list[int]:
    """First and last + 1 of each run of true values, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.tolist()


def _index(length: int, unit: Unit):
    def shard(table: pa.Table) -> pa.Table:
        data, offsets = text_bytes(table.column("symbols").combine_chunks())
        groups, group = np.unique(table.column("hash").to_numpy(), return_inverse=True)
        lead = table.column("lead").to_numpy().astype(np.int64)
        sizes, width = lead + 1, np.dtype(unit.code).itemsize
        ends = np.cumsum(sizes)
        # a string of ``length`` symbols begins at its anchor or before, and equal ones do so at the same distance
        rests = [data[a:b].tobytes() for a, b in zip((offsets[:-1] + lead * width).tolist(), offsets[1:].tolist())]
        order = sorted(range(len(rests)), key=list(zip(group.tolist(), rests)).__getitem__)
        common = np.array([0, *(_common(rests[a], rests[b]) // width if group[a] == group[b] else 0 for a, b in zip(order, order[1:]))])
        place = np.arange(ends[-1]) - np.repeat(ends - 1, sizes)
        codes = data.view(unit.code)[place + np.repeat(offsets[:-1] // width + lead, sizes)]
        codes = codes.astype(np.int64) if width == 1 else np.unique(codes, return_inverse=True)[1]
        codes += (np.repeat(group, sizes) - place * len(groups)) * (codes.max() + 1)
        first = np.zeros(len(codes), bool)
        first[ends - sizes] = True
        repeats = matching_statistics(codes, None, first, aligned_order(codes, ends, lead, np.array(order), common)) >= length
        repeats &= np.repeat(table.column("copy").to_numpy() == 0, sizes)
        begins = np.flatnonzero(repeats & (first | ~np.roll(repeats, 1)))
        stops = np.flatnonzero(repeats & (np.roll(first, -1) | ~np.roll(repeats, -1))) + 1
        of = np.searchsorted(ends, begins, "right")
        edges = (np.stack([begins, stops], axis=1) - (ends - sizes)[of][:, None]).ravel().astype(np.int32)
        offsets = 2 * np.searchsorted(of, np.arange(len(sizes) + 1)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(edges))
        give_back()
        return pa.table({"hash": table.column("hash"), "context": table.column("context"), "ranges": found})

    return shard


def _cut_contexts(length: int, width: int, unit: Unit):
    """The starts of contexts, in ranges of ``width`` distances to the anchor: what all windows of a range have in common is the new anchor hash.

    A range's windows have ``length - width + 1`` symbols in common, whatever the context has of the range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 3, TEXT_BYTES):
                data, offsets = text_bytes(part.column(3))
                codes = data.view(unit.code)
                offsets = offsets // codes.itemsize
                x = _anchors(codes, offsets, length, unit.gram)  # one for each context
                sums, at, first, last = prefix_sums(codes), x["at"], x["start"], x["start"] + x["starts"] - 1
                near, far = (at - last) // width, (at - first) // width
                of = np.repeat(np.arange(len(at)), far - near + 1)
                group = np.arange(len(of)) - np.repeat(np.cumsum(far - near + 1) - (far - near + 1), far - near + 1) + near[of]
                begin, end = np.maximum(first[of], at[of] - (group + 1) * width + 1), np.minimum(last[of], at[of] - group * width)
                common = span_hashes(sums, at[of] - group * width, at[of] - (group + 1) * width + 1 + length)
                piece = mixed(common ^ mixed(group.astype(np.uint64) ^ x["hash"][of]))
                content = span_hashes(sums, begin, end + length) ^ mixed((at[of] - begin).astype(np.uint64))
                own = [part.column(k).take(pa.array(x["text"][of])) for k in range(3)]
                made = [pa.array(v) for v in (piece.view(np.int64), content.view(np.int64), (begin - first[of]).astype(np.int32), (end - begin + 1).astype(np.int32), (at[of] - begin).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own, *made], ["hash", "context", "copy", "piece", "content", "at", "starts", "lead"])

    return run


def _all_anchors(texts: DataFrame, length: int, unit: Unit) -> DataFrame:
    """``k1, k2, hash, context, n`` for the distinct contexts of each row (n: 1, or 2 if it is there more often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2, TEXT_BYTES):
                x = anchors(*unit.symbols(part.column(2)), length, unit.gram)
                order = np.lexsort((x["context"], x["hash"], x["text"]))
                t, h, c = (x[k][order] for k in ("text", "hash", "context"))
                begin = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(t) else np.zeros(0, np.int64)
                n = np.minimum(np.diff(np.append(begin, len(t))), 2)
                columns = [part.column(k).take(pa.array(t[begin])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(h[begin].view(np.int64)), pa.array(c[begin].view(np.int64)), pa.array(n)], ["k1", "k2", "hash", "context", "n"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, hash long, context long, n long")


def _contexts(wanted: DataFrame, length: int, unit: Unit) -> DataFrame:
    """``hash, context, copy, hot, lead, symbols`` of the wanted contexts of each text (lead: symbols before the anchor); a second copy from another place, if the text has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0, TEXT_BYTES):
                codes, offsets = unit.symbols(part.column(0))
                x = anchors(codes, offsets, length, unit.gram)
                ask: dict[tuple, list[int]] = {}
                for i, ws in enumerate(part.column(1).to_pylist()):
                    for w in ws:
                        ask.setdefault((i, w["hash"], w["context"]), []).append((w["copy"], w["hot"]))
                out, seen = [], {}
                for t, h, c, s, n, at in zip(x["text"].tolist(), x["hash"].view(np.int64).tolist(), x["context"].view(np.int64).tolist(), x["start"].tolist(), x["starts"].tolist(), x["at"].tolist()):
                    if copies := ask.get((t, h, c)):
                        seen[t, h, c] = s, s + n + length - 1, at - s
                        out.append((h, c, *copies.pop(), at - s, codes[s : s + n + length - 1].tobytes()))
                for (t, h, c), copies in ask.items():  # copies of the text as a whole
                    if copies and (t, h, c) in seen:
                        a, b, lead = seen[t, h, c]
                        out += [(h, c, *k, lead, codes[a:b].tobytes()) for k in copies]
                columns = list(zip(*out)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["hash", "context", "copy", "hot", "lead", "symbols"])

    return wanted.mapInArrow(run, "hash long, context long, copy int, hot boolean, lead int, symbols binary")


OUTPUT = (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), ("kept", T.BinaryType()), ("kept_text", T.StringType()))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _marked(x: dict[str, np.ndarray], own: slice, offset: int, size: int, said: dict, length: int) -> np.ndarray:
    """Which symbols of a text go, by the ranges of starts that were decided for its contexts."""
    change = np.zeros(size + 1, np.int32)
    for h, c, s in zip(x["hash"][own].view(np.int64).tolist(), x["context"][own].view(np.int64).tolist(), (x["start"][own] - offset).tolist()):
        ranges = said.get((h, c), ())
        for a, b in zip(ranges[::2], ranges[1::2]):
            change[s + a] += 1
            change[s + b - 1 + length] -= 1
    return np.cumsum(change[:-1]) > 0


def _whole(own: np.ndarray, gone: np.ndarray) -> str:
    """The kept bytes as text; a character of which a part goes, goes whole."""
    edge = _ranges(~gone)
    return "".join(own[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(edge[::2], edge[1::2]))


def _apply(joined: DataFrame, kept: list[str], length: int, unit: Unit) -> DataFrame:
    schema = T.StructType([*[joined.schema[c] for c in kept], *[T.StructField(n, k) for n, k in OUTPUT]])
    at, said_at, keep = joined.columns.index("text"), joined.columns.index("said"), [joined.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at, TEXT_BYTES):
                data, offsets = text_bytes(part.column(at))
                columns = [[] for _ in OUTPUT]
                asked = np.flatnonzero(part.column(said_at).is_valid().to_numpy(zero_copy_only=False))
                codes, places = unit.symbols(part.column(at).take(pa.array(asked)))
                x = anchors(codes, places, length, unit.gram)  # texts with decisions only
                place = np.searchsorted(x["text"], np.arange(len(asked) + 1))
                number = {int(i): k for k, i in enumerate(asked)}
                for i, said in enumerate(part.column(said_at).to_pylist()):
                    own = data[offsets[i] : offsets[i + 1]]
                    gone = np.zeros(len(own), bool)
                    if said:
                        decided: dict = {}
                        for s in said:  # a context's windows may come in several parts
                            decided[s["hash"], s["context"]] = decided.get((s["hash"], s["context"]), []) + s["ranges"]
                        k = number[i]
                        gone = unit.gone_bytes(own, _marked(x, slice(place[k], place[k + 1]), int(places[k]), int(places[k + 1] - places[k]), decided, length))
                    edge = _ranges(gone)
                    spans = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])]
                    for column, value in zip(columns, (len(own), int(gone.sum()), spans, own[~gone].tobytes(), _whole(own, gone))):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), _ARROW_SPANS, pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*kept, *[n for n, _ in OUTPUT]])

    return joined.mapInArrow(run, schema)


def _decided(contexts: DataFrame, length: int, unit: Unit, widths: tuple[int, ...]) -> DataFrame:
    """``hash, context, ranges``: the starts that repeat, of each context with a copy 0; hot ones are cut into ``widths`` of starts in turn.

    A piece of one start is all in its anchor hash, so that none of these is hot.
    """
    total = contexts.agg(F.sum(F.length("symbols"))).first()[0] or 0
    shards = max(16, -(-total // SHARD_BYTES))
    indexed = contexts.where("not hot").groupBy(F.pmod(F.xxhash64("hash"), F.lit(shards))).applyInArrow(_index(length, unit), "hash long, context long, ranges array<int>")
    hot = contexts.where("hot").select("hash", "context", "copy", "symbols")
    if not widths or hot.isEmpty():
        return indexed
    made = hot.mapInArrow(_cut_contexts(length, widths[0], unit), "hash long, context long, copy int, piece long, content long, at int, starts int, lead int")
    pieces = cut(made, "pieces")
    place = F.struct("hash", "context", "copy", "at", "starts", "lead")
    counted = pieces.groupBy("piece", "content").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
    often = counted.groupBy("piece").agg(F.sum("n").alias("all"), F.count("*").alias("contents")).where("all > 1")
    copies = F.array_compact(F.array(F.struct(F.col("a").alias("of"), F.lit(0).alias("copy")), F.when(F.col("n") > 1, F.struct(F.col("b").alias("of"), F.lit(1).alias("copy")))))
    again = (F.col("contents") > HOT_CONTEXTS) & F.lit(len(widths) > 1)
    source = counted.join(often, "piece").select("piece", "content", again.alias("again"), F.explode(copies).alias("x")).select("piece", "content", "again", F.col("x.copy").alias("_copy"), "x.of.*")
    size = np.dtype(unit.code).itemsize
    symbols = F.substring("symbols", F.col("at") * size + 1, (F.col("starts") + length - 1) * size)
    inner = cut(source.join(hot, ["hash", "context", "copy"]).select(F.col("piece").alias("hash"), F.col("content").alias("context"), F.col("_copy").alias("copy"), F.col("again").alias("hot"), "lead", symbols.alias("symbols")), "contexts")
    told = _decided(inner, length, unit, widths[1:]).where(F.size("ranges") > 0).withColumnsRenamed({"hash": "piece", "context": "content"})
    back = pieces.where("copy = 0").join(told, ["piece", "content"]).select("hash", "context", F.transform("ranges", lambda r: r + F.col("at")).alias("ranges"))
    return indexed.union(back)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", unit: Unit = BYTE) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, the removed ``spans`` of bytes, and the ``kept`` bytes of each text, as they are and as whole characters."""
    bounded_batches(docs.sparkSession)
    names, outputs = docs.columns, {n for n, _ in OUTPUT}
    own = [f"c{i}" for i in range(len(names))]  # the given names may be anything
    body, of_row = (own[names.index(c)] for c in (text, doc_id))
    value = F.coalesce(F.col(body), F.lit(""))
    keyed = docs.toDF(*own).withColumns({"text": value, "k1": F.xxhash64(value), "k2": F.xxhash64(F.lit(9), value)})
    rows = cut(_all_anchors(keyed, length, unit), "anchors")
    counted = rows.groupBy("hash", "context").agg(F.sum("n").alias("n"))
    often = counted.groupBy("hash").agg(F.sum("n").alias("all"), F.count("*").alias("contexts")).where("all > 1")
    known = counted.join(often, "hash").select("hash", "context", "n", "contexts")
    here = cut(rows.join(known, ["hash", "context"]).groupBy("k1", "k2", "hash", "context").agg(F.first("contexts").alias("contexts"), F.first(known["n"]).alias("n")), "anchors")

    # one text, or two, supply each context, and one row of each such text
    source = here.groupBy("hash", "context").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b"), F.max("n").alias("n"), (F.max("contexts") > HOT_CONTEXTS).alias("hot"))
    copies = F.array_compact(F.array(F.struct(F.col("a").alias("k"), F.lit(0).alias("copy")), F.when(F.col("n") > 1, F.struct(F.col("b").alias("k"), F.lit(1).alias("copy")))))
    lists = source.select("hash", "context", "hot", F.explode(copies).alias("x")).groupBy("x.k.k1", "x.k.k2").agg(F.collect_list(F.struct("hash", "context", "x.copy", "hot")).alias("wanted"))
    one = keyed.groupBy("k1", "k2").agg(F.min(F.struct(F.col(of_row).isNull().alias("no"), F.col(of_row).alias("id"))).alias("row")).join(lists, ["k1", "k2"])
    one = one.select("k1", "k2", "row.id", "wanted")
    texts = keyed.select("k1", "k2", F.col(of_row).alias("own_id"), "text")
    fetched = texts.join(one, ["k1", "k2"]).where(F.col("own_id").eqNullSafe(F.col("id"))).select("text", "wanted")
    contexts = cut(_contexts(fetched, length, unit).dropDuplicates(["hash", "context", "copy"]), "contexts")
    answers = _decided(contexts, length, unit, (max(1, length // PARTS), 1)).where(F.size("ranges") > 0)
    partly = here.select("k1", "k2", "hash", "context").join(answers, ["hash", "context"])
    # written, so that the copies of one text can be split between tasks when they meet its decisions
    said = cut(partly.groupBy("k1", "k2").agg(F.collect_list(F.struct("hash", "context", "ranges")).alias("said")), "decisions")
    kept = [c for c, name in zip(own, names) if name.lower() not in outputs]
    joined = keyed.select(*kept, "k1", "k2", "text").join(said, ["k1", "k2"], "left")
    return _apply(joined, kept, length, unit).toDF(*[name for name in names if name.lower() not in outputs], *[n for n, _ in OUTPUT])
