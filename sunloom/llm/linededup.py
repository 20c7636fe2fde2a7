"""Line de-duplication by overlapping windows of three lines.

A line ends at a line break, after a word that ends a sentence, and in every ``FOLD``
words without such an end after the one of the smallest hash, the last of equal ones.
That folds text without marks in the same places wherever it stands, but for the
``FOLD`` - 1 words at either end of a passage, whose neighbours differ. So any 50 words
hold four ends in common with their copies, that is three whole lines, whatever stands
around them. From every line on, three lines (and as many more as it takes to hold
``MIN_WORDS`` words) make a window. Windows with equal hashes are one passage: the first
occurrence by (doc_id, position) stays, and the lines of all later ones are removed.
Overlapping windows cover a repeated passage together; covered spans are merged first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.substrings import gathered, merged, packed, steps_of, unpacked
from sunloom.llm.words import batches, chain, hash_words, mix, run_hashes, trimmed

LINES = 3
MIN_WORDS = 15
#: so many words in a row hold the end of a line at least; 6 * FOLD <= 51 for the promise on 50 words
FOLD = 8
#: windows of a task that are sorted together, and bytes of text by which buckets are dealt
RUN_WINDOWS, BUCKET_BYTES = 400_000, 16 << 20
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def folds(hashes: np.ndarray, row: np.ndarray, ends: np.ndarray, fold: int) -> np.ndarray:
    """Words with the smallest hash of some ``fold`` words of one text that hold none of ``ends``."""
    if len(hashes) < fold:
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(ends)])
    at = np.flatnonzero((before[fold:] == before[:-fold]) & (row[fold - 1 :] == row[: len(row) - fold + 1]))
    least, chosen = hashes[at], at.copy()
    for i in range(1, fold):
        h = hashes[at + i]
        chosen = np.where(h <= least, at + i, chosen)
        least = np.minimum(h, least)
    return chosen


def windows(texts: pa.Array, lines: int = LINES, min_words: int = MIN_WORDS, fold: int = FOLD) -> tuple[np.ndarray, ...]:
    """Row, hash, and first and past-the-last byte within its text of every window."""
    row, h, _, first, last = checked_windows(texts, lines, min_words, fold)
    return row, h, first, last


def checked_windows(texts: pa.Array, lines: int, min_words: int, fold: int) -> tuple[np.ndarray, ...]:
    """As :func:`windows`, with 32 bits of a second hash after the first one."""
    words = hash_words(texts)
    raw, first, last, hashed = words.raw, words.first, words.last, words.hashes
    n = len(hashed)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none.view(np.uint64), none.astype(np.uint32), none, none
    row = words.rows()
    final = words.bounds[1:][words.counts > 0] - 1
    breaks = np.append(raw, 10)[last] == 10
    breaks[final] = False  # what follows there may be the next text
    ends = _ENDS[raw[last - 1]] | breaks
    ends[folds(mix(hashed), row, ends, fold)] = True
    ends[final] = True
    starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))  # words that begin a line
    stop = np.append(starts[1:], n)
    line_row = row[starts]
    # a window ends with the line that makes it long enough in lines and in words
    by_lines = np.minimum(np.arange(len(starts)) + lines - 1, len(starts) - 1)
    enough = np.searchsorted(stop, np.minimum(starts + min_words, n))
    until = np.maximum(by_lines, enough)
    whole = (np.arange(len(starts)) + lines <= len(starts)) & (starts + min_words <= n)
    whole[whole] = line_row[until[whole]] == line_row[whole]
    begin, end = starts[whole], stop[until[whole]]
    size = (end - begin).astype(np.uint64)
    h = chain([mix(run_hashes(lambda a, b: hashed[a:b], begin, end)), size])
    again = mix(run_hashes(lambda a, b: mix(hashed[a:b] + np.uint64(1)), begin, end) + size) >> np.uint64(32)
    base = words.begin[row[begin]]
    return row[begin], h, again.astype(np.uint32), first[begin] - base, last[end - 1] - base


#: columns of a packed set of windows: hash, second hash, steps of ordinal and of first byte, size; documents' ids and tags, and how many windows each has
_WINDOWS = ("<u8", "<u4", "<i4", "<i4", "<i4", "<i8", "<u4", "<i4")
_SPANS, _TEXTS = ("<i4", "<i8", "<i8"), ("<i8", "<i8")


class Run:
    """Windows of some texts of one task."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets = number, buckets
        self.texts: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, texts: pa.Array, ids: np.ndarray, tags: np.ndarray, lines: int, min_words: int) -> None:
        """Of repeated rows one takes part."""
        base, new = len(self.texts), []
        for i, key in enumerate(zip(ids.tolist(), tags.tolist(), strict=True)):
            if key not in self.texts:
                self.texts[key] = len(self.texts)
                new.append(i)
        if not new:
            return
        row, h, again, first, last = checked_windows(texts.take(pa.array(new)) if len(new) < len(texts) else texts, lines, min_words, FOLD)
        self.parts.append((row + base, h, again, first, last - first))
        self.size += len(h)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, kind, blob): windows (0) by bucket, spans found here (1) and the texts' keys (2)."""
        keys = list(self.texts)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        ids, tags = (np.array(x, np.int64)[order] for x in zip(*keys, strict=True))
        row, h, again, first, size = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts = []
        ordinal = place[row]
        sort = np.lexsort((first, ordinal, again, h))
        later = np.zeros(len(h), bool)
        later[sort[1:]] = (h[sort[1:]] == h[sort[:-1]]) & (again[sort[1:]] == again[sort[:-1]])
        home = self.number % self.buckets
        yield home, 2, packed(_TEXTS, ids, tags)
        if later.any():
            yield home, 1, packed(_SPANS, *merged(ordinal[later], first[later], (first + size)[later]))
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        rest = np.flatnonzero(~later)
        rest = rest[np.lexsort((first[rest], ordinal[rest], bucket[rest]))]
        for own in np.split(rest, np.flatnonzero(np.diff(bucket[rest], prepend=-1))[1:]) if len(rest) else []:
            found, each = np.unique(ordinal[own], return_counts=True)
            yield int(bucket[own[0]]), 0, packed(
                _WINDOWS, h[own], again[own], steps_of(ordinal[own]), steps_of(first[own]), size[own], steps_of(ids[found]), tags[found].astype(np.uint32), each,
            )


def cut(docs: DataFrame, lines: int, min_words: int, buckets: int) -> DataFrame:
    """(bucket, run, kind, blob) of rows (id, tag, text)."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        now = Run(number, buckets)

        def out() -> Iterator[pa.RecordBatch]:
            for bucket, kind, blob in now.rows():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([now.number], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())],
                    names=["bucket", "run", "kind", "blob"],
                )

        for batch in batches(source):
            now.add(batch.column("text"), batch.column("id").to_numpy(), batch.column("tag").to_numpy(), lines, min_words)
            if now.size >= RUN_WINDOWS:
                yield from out()
                number += 1
                now = Run(number, buckets)
        if now.size:
            yield from out()

    return docs.select("id", "tag", "text").mapInArrow(trimmed(run), "bucket int, run long, kind int, blob binary")


def match(cuts: DataFrame) -> DataFrame:
    """(run, kind, blob) with the windows that stand earlier in another run, as spans (1); other rows pass. Rows come bucket by bucket."""
    def rows(blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        columns = []
        for number, blob in blobs:
            h, again, ordinal, first, size, ids, tags, each = unpacked(_WINDOWS, blob)
            columns.append((h, again, np.repeat(np.cumsum(ids), each), np.repeat(tags, each), np.cumsum(first), np.cumsum(ordinal), size.astype(np.int64), np.full(len(h), number)))
        h, again, ids, tags, first, ordinal, size, run = (np.concatenate(c) for c in zip(*columns, strict=True))
        sort = np.lexsort((first, tags, ids, again, h))
        head = np.ones(len(sort), bool)
        head[1:] = (h[sort[1:]] != h[sort[:-1]]) | (again[sort[1:]] != again[sort[:-1]])
        least = sort[np.flatnonzero(head)][np.cumsum(head) - 1]
        # a repeated row is the same document, not a later one
        later = sort[(ids[sort] != ids[least]) | (tags[sort] != tags[least]) | (first[sort] != first[least])]
        later = later[np.argsort(run[later], kind="stable")]
        for own in np.split(later, np.flatnonzero(np.diff(run[later], prepend=-1))[1:]) if len(later) else []:
            blob = packed(_SPANS, *merged(ordinal[own], first[own], first[own] + size[own]))
            yield pa.RecordBatch.from_arrays([pa.array([run[own[0]]], pa.int64()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], names=["run", "kind", "blob"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = -1, []
        for batch in batches(source):
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


def later_spans(docs: DataFrame, lines: int, min_words: int) -> DataFrame:
    """(id, tag, spans): what repeats earlier windows in each document of rows (id, tag, text), ``first << 32 | size`` in order.

    A task sorts its windows in runs, so a passage that stands everywhere leaves a run
    once; what leaves it is packed by bucket of the hash, and what is found returns by run.
    """
    whole = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(1 << 18, max(12, -(-whole // BUCKET_BYTES)))
    parts = min(buckets, 1 << 15)
    found = match(cut(docs, lines, min_words, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket", "run"))
    spans = gathered(found.repartition(parts, "run").sortWithinPartitions("run"))
    return spans.groupBy("id", "tag").agg(F.first("spans").alias("spans"))


_GAP = re.compile(rb"\s*")


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the merged spans, and how many runs and words were removed."""
    runs: list[list[int]] = []
    for first, last in spans:
        if runs and (first <= runs[-1][1] or not text[runs[-1][1] : first].strip()):
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    out, at, words = bytearray(), 0, 0
    for first, last in runs:
        words += len(text[first:last].split())
        end = _GAP.match(text, last).end()
        out += text[at:first]
        if b"\n" in text[last:end] and out and not out.endswith(b"\n"):
            while out[-1:] in (b" ", b"\t"):
                out.pop()
            out += b"\n"
        at = end
    rest = text[at:]
    return bytes(out + rest if rest else out.rstrip()), len(runs), words


def dedup_lines(docs: DataFrame, lines: int = LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of all rows, ``text`` without later occurrences, with removed_runs and removed_words (long).

    A document with fewer than ``lines`` lines or ``min_words`` words has no window and
    stays as it is; so do null and empty texts. A document that only repeats earlier ones
    ends empty. The order is by doc_id, null last, then by a hash of the text; rows that
    agree in both (31 bits of the hash) count as one document, so a repeated row loses
    nothing to itself. A very long text is hashed in bounded stretches. Input columns named
    removed_runs or removed_words are left out. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("removed_runs", "removed_words")]
    at = names.index("text")
    tag = F.xxhash64(F.col("doc_id").isNull(), "text").bitwiseAND(F.lit(0xFFFFFFFE))
    marked = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), tag.alias("tag"))
    spans = later_spans(marked.select("id", "tag", F.col(f"c{at}").alias("text")), lines, min_words)
    joined = marked.join(spans, ["id", "tag"], "left").drop("id", "tag")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            texts, removed = [], []
            for text, own in zip(batch.column(at), batch.column(len(names)), strict=True):
                if own.is_valid:
                    spans = [(x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in own.values.to_pylist()]
                    cut, runs, words = without(text.as_py().encode(), spans)
                    texts.append(cut.decode())
                    removed.append((runs, words))
                else:
                    texts.append(text.as_py())
                    removed.append((0, 0))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            counts = [pa.array([r[i] for r in removed], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*names, "removed_runs", "removed_words"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(trimmed(run), f"{schema}, removed_runs long, removed_words long")
