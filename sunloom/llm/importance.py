"""Importance resampling towards a target, on hashed word features.

Features of a text are its words and its pairs of neighbouring words; each falls into a
bucket by its CRC-32. The logarithm of how much likelier a bucket is in the target than in
the corpus is the gain of its features; a text's weight is the mean gain, and adding seeded
Gumbel noise to the weights and taking the highest draws without replacement.

Checksums come from matrices: the distinct features of a batch are grouped by their length
in bytes, each group is a two-dimensional array of bytes, and one step along a column
updates the checksums of the whole group. The results go back to the features' places.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunloom.llm.ordinals import bucket_count
from sunloom.llm.words import batches, group_starts, plain, stored, trimmed

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
#: longer features are few and are summed one by one
LONGEST_COLUMN = 512

_SOLID = np.zeros(256, bool)
_SOLID[0x30:0x3A] = _SOLID[0x61:0x7B] = _SOLID[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def crc_of_equal(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional array of bytes, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return ~crc


def crc_of(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of strings that lie one after the other in ``flat``, in ascending order of length."""
    out = np.empty(len(lengths), np.uint32)
    if not len(lengths):
        return out
    sizes, first = np.unique(lengths, return_index=True)
    at = 0
    for size, begin, end in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(lengths)], strict=True):
        until = at + size * (end - begin)
        if size > LONGEST_COLUMN:
            out[begin:end] = [zlib.crc32(flat[a : a + size].tobytes()) for a in range(at, until, size)]
        else:
            out[begin:end] = crc_of_equal(flat[at:until].reshape(end - begin, size))
        at = until
    return out


def crc_of_pieces(data: np.ndarray, first: np.ndarray, size: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of pieces of ``data``, or of two pieces each joined by a space.

    Row i is the piece ``first[i]`` or the pieces ``first[i]`` and ``second[i]`` as
    positions in ``size`` (lengths of pieces that lie one after the other in ``data``).
    """
    begin = np.cumsum(size) - size
    length = size[first] if second is None else size[first] + size[second] + 1
    order = np.argsort(length, kind="stable")
    length = length[order]
    flat = np.full(int(length.sum()), 0x20, np.uint8)
    base = np.cumsum(length) - length

    def put(piece: np.ndarray, start: np.ndarray) -> None:
        n = size[piece]
        inside = group_starts(n)
        flat[np.repeat(start, n) + inside] = data[np.repeat(begin[piece], n) + inside]

    put(first[order], base)
    if second is not None:
        put(second[order], base + size[first[order]] + 1)
    out = np.empty(len(length), np.uint32)
    out[order] = crc_of(flat, length)
    return out


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of a column of texts, and the number of words of each text."""
    column = plain(texts)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = column.buffers()[2]
    raw = _LOWER[np.frombuffer(data, np.uint8)[: offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    solid = np.concatenate([[False], _SOLID[raw], [False]])
    starts, stops = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    starts[inner], stops[inner - 1] = _SOLID[raw[inner]], _SOLID[raw[inner - 1]]
    first = np.flatnonzero(starts)
    size = np.flatnonzero(stops) + 1 - first
    counts = np.diff(np.searchsorted(first, offsets))
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    # words in one buffer without what stands between them, each distinct word once
    ends = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, ends, pa.py_buffer(raw[_SOLID[raw]])]).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    known = coded.dictionary
    spell = np.frombuffer(known.buffers()[2], np.uint8)
    width = np.diff(np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1])
    alone = crc_of_pieces(spell, np.arange(len(known)), width)[code]
    row = np.repeat(np.arange(len(counts)), counts)
    left = np.flatnonzero(row[1:] == row[:-1])
    pairs = pa.array(code[left] * len(known) + code[left + 1]).dictionary_encode()
    distinct = pairs.dictionary.to_numpy()
    both = crc_of_pieces(spell, distinct // len(known), width, distinct % len(known))[pairs.indices.to_numpy()]
    return np.concatenate([row, row[left]]), np.concatenate([alone, both]).astype(np.int64) % buckets, counts


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends one row a bucket at most."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches(source, size=2 << 20):
            total += np.bincount(feature_buckets(batch.column(0), buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(trimmed(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, rounded down; one is added to every count."""
    s, t = (float(x.sum() + len(x)) for x in (corpus, target))
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the mean gain, rounded down; 0 without features) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches(source, size=2 << 20):
            row, bucket, words = feature_buckets(batch.column("text"), len(gain))
            n = np.bincount(row, minlength=len(batch))
            total = np.zeros(len(batch), np.int64)
            np.add.at(total, row, gain[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_words long, n_features long, weight long")


def noisy_score(weight: str, doc_id: str, seed: int) -> F.Column:
    """The weight with Gumbel noise from a hash of seed and doc_id (null: empty), in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.col(weight) + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def draw(weighed: DataFrame, per_cent: int, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Add ``score`` and ``rank`` to the rows of ``weigh``; rank is null for what is not drawn.

    Scores are whole thousandths between fixed bounds (of gains and noise), so a count per
    score is a small table at any size, and running sums over it say where each score's
    ranks begin. Equal rows are counted before they are shuffled and told apart after.
    """
    able = F.col("n_words") >= least_words
    rows = weighed.withColumn("score", noisy_score("weight", "doc_id", seed).cast("long")).groupBy("doc_id", "n_words", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("copies"))
    rows = stored(rows)
    by_score = rows.filter(able).groupBy("score").agg(F.sum("copies").alias("n"))
    before = by_score.select(F.col("score").alias("at"), (F.sum("n").over(Window.orderBy(F.col("score").desc())) - F.col("n")).alias("before"))
    total, every = rows.agg(F.sum(F.when(able, F.col("copies"))), F.sum("copies")).first()
    drawn = per_cent * (total or 0) // 100
    inside = Window.partitionBy("score", able).orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "n_words")
    placed = rows.withColumn("inside", F.sum("copies").over(inside) - F.col("copies"))
    placed = placed.join(F.broadcast(before), able & (F.col("score") == F.col("at")), "left").withColumn("first", F.col("before") + F.col("inside") + 1)
    # a row with very many copies is written by several tasks
    part = 100_000
    parts = placed.withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {part})"))).repartition(bucket_count(every or 0), "score", "doc_id", "part")
    copy = F.explode(F.expr(f"sequence(part * {part}, least(copies, (part + 1) * {part}) - 1)"))
    rank = F.col("first") + F.col("copy")
    return parts.withColumn("copy", copy).select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = 25, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (long) of every row of ``docs``, and n_words.

    ``target`` has a column ``text``. A null or empty text has no words, weight 0, and is
    never drawn, as no text of fewer than ``least_words`` words is. A very long text is a
    row like any other. Ties go to the smaller doc_id, null last; repeated rows count as
    often as they stand and get ranks of their own. An empty corpus gives no rows; an
    empty target leaves all weights to the corpus counts. Other columns are not read, so
    none can clash.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return draw(weigh(docs, gains), per_cent, least_words, seed)
