"""Removal of repeated byte strings with suffix arrays and longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes around it also starts in an earlier document.
Every such string (a window) belongs to the least of its grams of ``GRAM`` bytes by a
hash, so equal windows meet under one gram wherever they stand. Consecutive windows of one
gram travel together as one fragment, a little longer than the windows are many, packed
and compressed by bucket of the gram. Grams that very many documents hold (found on a
sample, only to balance the work) come last in the order, so that windows at the edge of a
common passage belong to a gram that tells them apart.

Within a bucket, fragments whose gram stands in one document have no match. An
exact copy of a fragment in a later document goes whole. The others are laid end to end in
document order and their suffixes sorted by prefix doubling; next to each other in that
order, previous and next smaller documents give the longest previous factor, and a
window goes where that is ``length`` at least. The spans found return to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.words import STEP, batches, group_starts, mix, run_hashes, trimmed

LENGTH = 50
GRAM = 12
#: bytes of text that are cut into fragments together, and by which buckets are dealt
RUN_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
#: bytes of fragments that are compared at a time, and of those whose suffixes are sorted together
PASS_BYTES, SORT_BYTES = 64 << 20, 4 << 20
#: documents of the sample, at least; documents of it that hold a common gram; and how many of these grams are kept
SAMPLE, COMMON, MOST_COMMON = 512, 8, 65_536
_SLOT_BITS = 22
_LAST = np.uint64(1 << 63)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_OUTPUT = ("n_bytes", "n_removed", "n_spans", "removed", "kept")


def grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the gram at each byte that starts one."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).astype(np.uint64)
    return gram_hash(word[:n], word[GRAM - 8 :])


def gram_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of the first and the last eight bytes of a gram as numbers."""
    h = (first ^ (first >> np.uint64(31))) * STEP + second
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int32)


def common_slots(docs: DataFrame, rows: int, sample: int = SAMPLE) -> list[int]:
    """Slots of grams that at least ``COMMON`` of the sampled texts hold; one text in 5,000 is sampled, or ``sample`` in all."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, size=2 << 20):
            parts = []
            for text in batch.column(0):
                for at in range(0, text.as_buffer().size if text.is_valid else 0, 1 << 20):
                    parts.append(np.unique(slots(grams(np.frombuffer(text.as_buffer(), np.uint8)[at : at + (1 << 20)]))))
            found, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["slot", "n"])

    share = min(1.0, max(sample, rows / 5_000) / max(1, rows))
    counts = docs.sample(share, seed=1).select("text").mapInArrow(trimmed(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    return [r["slot"] for r in counts.filter(F.col("n") >= COMMON).orderBy(F.col("n").desc(), "slot").limit(MOST_COMMON).collect()]


def fragments(raw: np.ndarray, bounds: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First byte, number of windows, offset of the gram and its hash, of each fragment of texts in a row.

    ``last`` marks the slots of grams that come last in the order.
    """
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = grams(raw)
    order = (h >> np.uint64(1)) | np.where(last[slots(h)], _LAST, np.uint64(0))
    width, span, least = length - GRAM + 1, 1, order
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    edge = np.zeros(n + 1, np.int8)  # windows that lie within one text
    fits = np.diff(bounds) >= length
    edge[bounds[:-1][fits]] += 1
    edge[bounds[1:][fits] - length + 1] -= 1
    inside = np.cumsum(edge[:n]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False)) + 1
    wanted, at = least[first], np.full(len(first), -1)
    for j in range(width):
        at[(at < 0) & (order[first + j] == wanted)] = j
    return first, stop - first, at, h[first + at]


def string_hashes(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each of the strings ``raw[first:first + size]``, which come in the order of ``first``."""
    return mix(run_hashes(lambda a, b: _BYTES[raw[a:b]], first, first + size) + size.astype(np.uint64))


def equal_strings(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, block: int = 4 << 20) -> np.ndarray:
    """Whether the bytes from ``a`` on are those from ``b`` on, pair by pair."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + block, "right")))
        n = size[i:j]
        inside = group_starts(n)
        same = raw[np.repeat(a[i:j], n) + inside] == raw[np.repeat(b[i:j], n) + inside]
        out[i:j] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        i = j
    return out


def gathered_bytes(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings ``raw[first:first + size]`` one after the other."""
    return raw[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def in_several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the key of each entry stands in more than one document."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key)
    cuts = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
    own = doc[order]
    apart = np.minimum.reduceat(own, cuts) < np.maximum.reduceat(own, cuts)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(apart, np.diff(np.append(cuts, len(key))))
    return out


def later_copies(raw: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Strings that stand, byte for byte, in an earlier document of these."""
    later = np.zeros(len(first), bool)
    if len(first) < 2:
        return later
    raw = gathered_bytes(raw, first, size)
    first = np.cumsum(size) - size
    h = string_hashes(raw, first, size)
    order = np.lexsort((doc, size, h))
    head = np.ones(len(order), bool)
    head[1:] = (h[order[1:]] != h[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
    begin = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    at = np.flatnonzero(doc[order] > doc[begin])
    later[order[at]] = equal_strings(raw, first[order[at]], first[begin[at]], size[order[at]])
    return later


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first ``length`` bytes, by prefix doubling from eight bytes on."""
    n, have = len(data) - length + 1, 8
    if n <= 0:
        return np.zeros(0, np.int64)
    rank = np.unique(np.ndarray((len(data) - 7,), ">u8", data, strides=(1,)).astype(np.uint64), return_inverse=True)[1].astype(np.int64)
    while have < length:
        step = min(have, length - have)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank[:n]


def previous_smaller(value: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Nearest earlier place of a smaller value without crossing a ``head``, or -1; by jumping along pointers."""
    to = np.arange(-1, len(value) - 1)
    to[head] = -1
    while True:
        at = np.flatnonzero((to >= 0) & (value[to] >= value))
        if not len(at):
            return to
        to[at] = to[to[at]]


def earlier_factors(data: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor at each of ``starts`` is ``length`` bytes at least.

    ``starts`` ascend and each has ``length`` bytes after it; ``doc`` is its document, and
    only factors in smaller documents are previous. In suffix order the factor with the
    previous or the next smaller document is the longest; the common prefix with
    it reaches ``length`` unless a ``head``, where neighbours share less, lies between.
    """
    rank = suffix_ranks(data, length)[starts]
    order = np.argsort(rank, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = rank[order[1:]] != rank[order[:-1]]
    own = doc[order]
    before = previous_smaller(own, head)
    after = previous_smaller(own[::-1], np.append(head[1:], True)[::-1])[::-1]
    out = np.zeros(len(order), bool)
    out[order] = (before >= 0) | (after >= 0)
    return out


_SQUEEZE = zstandard.ZstdCompressor(level=6)
_EXPAND = zstandard.ZstdDecompressor()
#: columns of a packed set of fragments: bytes, windows, offset of the gram, steps of ordinal and of place, documents' steps
_FRAGMENTS = ("<u1", "<i4", "<i4", "<i4", "<i8", "<i8")
_SPANS = ("<i4", "<i8", "<i8")
_TEXTS = ("<i8", "<i8")


def packed(kinds: tuple[str, ...], *columns: np.ndarray) -> bytes:
    parts = [np.array([len(c) for c in columns], "<i8").tobytes()]
    for kind, c in zip(kinds, columns, strict=True):
        parts.append(np.ascontiguousarray(c.astype(kind)).view(np.uint8).reshape(len(c), -1).T.tobytes() if len(c) else b"")
    return _SQUEEZE.compress(b"".join(parts))


def unpacked(kinds: tuple[str, ...], blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(_EXPAND.decompress(blob), np.uint8)
    sizes, at, out = raw[: 8 * len(kinds)].view("<i8"), 8 * len(kinds), []
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(kind).reshape(n))
        at += n * wide
    return out


def steps_of(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def merged(owner: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each owner, overlapping or touching ones put together, in order."""
    order = np.lexsort((first, owner))
    owner, first, stop = owner[order], first[order], stop[order]
    if not len(owner):
        return owner, first, stop
    # owners apart on one line, so that one running maximum serves all
    wide = int(stop.max()) + 2
    place = np.unique(owner, return_inverse=True)[1] * wide
    reach = np.maximum.accumulate(stop + place)
    head = np.ones(len(owner), bool)
    head[1:] = first[1:] + place[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return owner[at], first[at], reach[np.append(at[1:], len(owner)) - 1] - place[at]


class Run:
    """Texts of one task that are cut into fragments together."""

    def __init__(self, number: int, last: np.ndarray, length: int, buckets: int):
        self.number, self.last, self.length, self.buckets = number, last, length, buckets
        self.texts: dict[tuple[int, int, int], bytes] = {}
        self.size = 0

    def add(self, doc: int, tag: int, base: int, text: memoryview) -> None:
        """A repeated row is in the run once."""
        if (doc, tag, base) not in self.texts:
            self.texts[doc, tag, base] = bytes(text)
            self.size += len(text)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, kind, blob): fragments (0) by bucket, spans found here (1) and the texts' keys (2)."""
        keys = sorted(self.texts)
        raw = np.frombuffer(b"".join(self.texts[k] for k in keys), np.uint8)
        bounds = np.cumsum([0, *(len(self.texts[k]) for k in keys)])
        self.texts = {}
        docs, tags, bases = (np.array(x, np.int64) for x in zip(*keys, strict=True))
        parts: list[tuple[np.ndarray, ...]] = []
        a = 0
        while a < len(keys):  # a few megabytes at a time
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (256 << 10), "right")) - 1)
            first, windows, at, h = fragments(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], self.last, self.length)
            parts.append((first + bounds[a], windows, at, h))
            a = b
        first, windows, at, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = (mix(h) % np.uint64(self.buckets)).astype(np.int64)
        ordinal = np.searchsorted(bounds, first, "right") - 1
        place, size = first - bounds[ordinal] + bases[ordinal], windows + self.length - 1
        later = in_several(h, docs[ordinal])
        met = np.flatnonzero(later)
        later[met] = later_copies(raw, first[met], size[met], docs[ordinal[met]])
        home = self.number % self.buckets
        yield home, 2, packed(_TEXTS, docs, tags)
        if later.any():
            yield home, 1, packed(_SPANS, *merged(ordinal[later], place[later], (place + size)[later]))
        rest = np.flatnonzero(~later)
        rest = rest[np.argsort(bucket[rest], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[rest], prepend=-1))
        for own in np.split(rest, cuts[1:]) if len(rest) else []:
            n = size[own]
            found = np.unique(ordinal[own])
            which = np.searchsorted(found, ordinal[own])
            yield int(bucket[own[0]]), 0, packed(
                _FRAGMENTS, gathered_bytes(raw, first[own], n), windows[own], at[own], steps_of(ordinal[own]),
                steps_of(place[own]), np.concatenate([steps_of(docs[found]), np.bincount(which)]),
            )


def cut(texts: DataFrame, last: list[int], length: int, buckets: int, run_bytes: int) -> DataFrame:
    """(bucket, run, kind, blob) of rows (id, tag, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(np.array(last, np.int32))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(1 << _SLOT_BITS, bool)
        marked[shared.value] = True
        number = TaskContext.get().partitionId() << 24
        now = Run(number, marked, length, buckets)

        def out() -> Iterator[pa.RecordBatch]:
            for bucket, kind, blob in now.rows():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([now.number], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())],
                    names=["bucket", "run", "kind", "blob"],
                )

        for batch in batches(source):
            for doc, tag, text in zip(batch.column("id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), strict=True):
                view = memoryview(text.as_buffer())
                for base in range(0, max(1, len(view) - length + 1), run_bytes):  # a piece has the windows that start in it
                    now.add(doc, tag, base, view[base : base + run_bytes + length - 1])
                    if now.size >= run_bytes:
                        yield from out()
                        number += 1
                        now = Run(number, marked, length, buckets)
        if now.texts:
            yield from out()

    return texts.select("id", "tag", "text").mapInArrow(trimmed(run), "bucket int, run long, kind int, blob binary")


def compared(blobs: list[tuple[int, bytes]], length: int, share: int, shares: int) -> tuple[np.ndarray, ...]:
    """Run, ordinal, first and past-the-last byte of what goes, among the fragments of one share of a bucket's grams."""
    columns: list[tuple[np.ndarray, ...]] = []
    base = 0
    for run, blob in blobs:
        raw, windows, at, ordinal, place, ids = unpacked(_FRAGMENTS, blob)
        ordinal, place, size = np.cumsum(ordinal), np.cumsum(place), windows.astype(np.int64) + length - 1
        docs = np.repeat(np.cumsum(ids[: len(ids) // 2]), ids[len(ids) // 2 :])
        first = np.cumsum(size) - size
        word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        h = gram_hash(word[first + at].astype(np.uint64), word[first + at + GRAM - 8].astype(np.uint64))
        if shares > 1:
            own = mix(h + np.uint64(1)) % np.uint64(shares) == share
            raw = raw[np.repeat(own, size)]
            windows, ordinal, place, size, docs, h = (x[own] for x in (windows, ordinal, place, size, docs, h))
            first = np.cumsum(size) - size
            at = at[own]
        columns.append((raw, np.full(len(h), run), ordinal, place, first + base, size, docs, h, at.astype(np.int64)))
        base += len(raw)
    raw, run, ordinal, place, first, size, doc, h, at = (np.concatenate(c) for c in zip(*columns, strict=True))
    met = np.flatnonzero(in_several(h, doc))
    later = later_copies(raw, first[met], size[met], doc[met])
    gone, rest = met[later], met[~later]
    rest = rest[in_several(h[rest], doc[rest])]
    # a window reaches half of its other bytes to one side of the gram at least, so it needs company on that side
    half = GRAM + (length - GRAM + 1) // 2
    # where a fragment has windows past its gram they hold it elsewhere, and fragments of that gram are all compared
    past = size[rest] - length > at[rest]
    company = np.isin(h[rest], h[rest[past]])
    for begin in (at[rest], at[rest] + GRAM - half):
        able = np.flatnonzero((begin >= 0) & (begin + half <= size[rest]))
        own = rest[able]
        side = gathered_bytes(raw, first[own] + begin[able], np.full(len(own), half))
        company[able] |= in_several(string_hashes(side, np.arange(len(own)) * half, np.full(len(own), half)), doc[own])
    rest = rest[company]
    rest = rest[np.argsort(h[rest], kind="stable")]
    out = [(run[gone], ordinal[gone], place[gone], place[gone] + size[gone])]
    # whole grams together, in portions
    cuts = np.flatnonzero(np.concatenate([[True], h[rest[1:]] != h[rest[:-1]]])) if len(rest) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(rest))
    total = np.concatenate([[0], np.cumsum(size[rest])])
    a = 0
    while a < len(cuts):
        b = max(a + 1, int(np.searchsorted(total[ends], total[cuts[a]] + SORT_BYTES, "right")))
        own = rest[cuts[a] : ends[b - 1]]
        own = own[np.lexsort((place[own], ordinal[own], run[own], doc[own]))]
        n = size[own]
        data = gathered_bytes(raw, first[own], n)
        windows = n - length + 1
        within = group_starts(windows)
        starts = np.repeat(np.cumsum(n) - n, windows) + within
        hit = np.flatnonzero(earlier_factors(data, starts, np.repeat(doc[own], windows), length))
        of = np.repeat(own, windows)[hit]
        at = place[of] + within[hit]
        out.append((run[of], ordinal[of], at, at + length))
        a = b
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def match(cuts: DataFrame, length: int) -> DataFrame:
    """(run, kind, blob) with the spans (1) that each bucket adds; other rows pass. Rows come bucket by bucket."""
    def rows(blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        whole = sum(zstandard.get_frame_parameters(b).content_size for _, b in blobs)
        shares = -(-whole // PASS_BYTES)
        for share in range(shares):
            run, ordinal, first, stop = compared(blobs, length, share, shares)
            order = np.argsort(run, kind="stable")
            heads = np.flatnonzero(np.diff(run[order], prepend=-1))
            for own in np.split(order, heads[1:]) if len(order) else []:
                blob = packed(_SPANS, *merged(ordinal[own], first[own], stop[own]))
                yield pa.RecordBatch.from_arrays([pa.array([run[own[0]]], pa.int64()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], names=["run", "kind", "blob"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = -1, []
        for batch in source:
            for bucket, number, kind, blob in zip(*(batch.column(c) for c in ("bucket", "run", "kind", "blob")), strict=True):
                if kind.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py()], x.type) for x in (number, kind, blob)], names=["run", "kind", "blob"])
                    continue
                if bucket.as_py() != now:
                    if blobs:
                        yield from rows(blobs)
                    now, blobs = bucket.as_py(), []
                blobs.append((number.as_py(), blob.as_py()))
        if blobs:
            yield from rows(blobs)

    return cuts.mapInArrow(trimmed(run), "run long, kind int, blob binary")


def gathered(found: DataFrame) -> DataFrame:
    """(id, tag, spans): what goes from each text, ``first << 32 | size`` in order; rows come run by run."""
    def rows(blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        docs, tags = unpacked(_TEXTS, next(b for kind, b in blobs if kind == 2))
        spans = [unpacked(_SPANS, b) for kind, b in blobs if kind == 1]
        if not spans:
            return
        owner, first, stop = merged(*(np.concatenate(c) for c in zip(*spans, strict=True)))
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(owner)).astype(np.int32)), pa.array(first.astype(np.int64) << 32 | (stop - first)))
        yield pa.RecordBatch.from_arrays([pa.array(docs[owner[heads]]), pa.array(tags[owner[heads]]), lists], names=["id", "tag", "spans"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in source:
            for number, kind, blob in zip(*(batch.column(c) for c in ("run", "kind", "blob")), strict=True):
                if number.as_py() != now:
                    if blobs:
                        yield from rows(blobs)
                    now, blobs = number.as_py(), []
                blobs.append((kind.as_py(), blob.as_py()))
        if blobs:
            yield from rows(blobs)

    return found.mapInArrow(trimmed(run), "id long, tag long, spans array<long>")


def repeated_spans(texts: DataFrame, length: int, run_bytes: int = RUN_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, tag, spans: array of arrays) for the texts of rows (id, tag, text) that lose something."""
    rows, whole = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    able = texts.filter(F.octet_length("text") >= length)
    buckets = min(1 << 20, max(16, -(-whole // bucket_bytes)))
    cuts = cut(able, common_slots(able, rows), length, buckets, run_bytes)
    parts = min(buckets, 1 << 16)
    found = match(cuts.repartition(parts, "bucket").sortWithinPartitions("bucket", "run"), length)
    spans = gathered(found.repartition(parts, "run").sortWithinPartitions("run"))
    # a text cut into pieces, or a repeated row, comes from several runs; equal lists count once
    return spans.groupBy("id", "tag").agg(F.collect_set("spans").alias("spans"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """All columns of all rows, with what is left of the text's bytes and what was removed.

    Added: ``kept`` (binary, the bytes left in one piece), ``removed`` (array of
    first byte and size of each removed run), n_bytes, n_removed and n_spans (long). Input
    columns of these names are left out. A null text is an empty one; texts shorter
    than ``length`` bytes lose nothing. Only strings in smaller doc_ids count, null is
    the greatest; rows of one doc_id, repeated rows among them, take nothing from each
    other, and repetition within one text stays. Very long texts are compared in pieces
    that overlap. ``length`` is 13 at least. An empty table gives no rows.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    names = [c for c in docs.columns if c not in _OUTPUT]
    at = names.index("text")
    tag = F.xxhash64(F.col("doc_id").isNull(), "text")
    marked = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), tag.alias("tag"))
    spans = repeated_spans(marked.select("id", "tag", F.col(f"c{at}").alias("text")), length, **sizes)
    joined = marked.join(spans, ["id", "tag"], "left").drop("id", "tag")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, size=2 << 20):
            kept, sizes, removed = [], [], []
            for text, lists in zip(batch.column(at), batch.column(len(names)), strict=True):
                raw = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                flat = lists.values.flatten().to_numpy() if lists.is_valid else np.zeros(0, np.int64)
                _, first, stop = merged(np.zeros(len(flat), np.int64), flat >> 32, (flat >> 32) + (flat & 0xFFFFFFFF))
                view, edges = memoryview(raw), [0, *np.stack([first, stop], 1).ravel().tolist(), raw.size]
                kept.append(b"".join(view[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                sizes.append((raw.size, int((stop - first).sum()), len(first)))
                removed.append([{"first": int(a), "size": int(b - a)} for a, b in zip(first, stop, strict=True)])
            counts = [pa.array([s[i] for s in sizes], pa.int64()) for i in range(3)]
            spans = pa.array(removed, pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, spans, pa.array(kept, pa.binary())], names=[*names, *_OUTPUT])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(trimmed(run), f"{schema}, n_bytes long, n_removed long, n_spans long, removed array<struct<first: long, size: long>>, kept binary")
