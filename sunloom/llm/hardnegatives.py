"""Hard negatives by Fagin's threshold algorithm on integer vectors.

Candidates are read in blocks. A block has, for each dimension, its rows in the order of
that component. An anchor goes down all lists at once, from the top where its own component
is positive and from the bottom where it is negative, and the rows it meets are scored in
full by random access. What it has not met scores at most the threshold, the sum over
the dimensions of its component times the value reached in that list; once that is strictly
below the last score wanted in each of its windows (or below what a window admits),
the rest of the block is left alone. What a task has found in earlier blocks counts, so
later blocks end sooner.

A task keeps the best rows of its own part of the candidates; these meet once per anchor.
Anchors are a stated part of the rows, and go through in chunks of bounded bytes, each
of which is sent to all tasks; candidates are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.llm.words import Steps, trimmed

POSITIVES, NEGATIVES = 5, 10
#: a negative's score lies between these per cents of its positive's
LOW, HIGH = 30, 90
#: bytes of a block of candidates, and of a chunk of anchors
BLOCK_BYTES, CHUNK_BYTES = 4 << 20, 2 << 20
#: the lists are read to these parts of a block, one after the other
DEPTHS = (1 / 256, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1)
ABSENT = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: ``v`` is floor(scale * x) of each component.

    Rows with a null label or vector, or a null or non-finite component, are left out.
    Where vec_id is divisible by 7, the label becomes (label + 1) % 10.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    able = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~F.exists("embedding", bad))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return able.select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of ``width`` numbers; shorter ones end with zeros, which add nothing to a product."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy()
    size = np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of two matrices, exact.

    Through doubles where these hold every sum, else in 64-bit integers; vectors whose
    sums could pass 64 bits are refused.
    """
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("inner products of these vectors do not fit 64 bits")
    return a @ b.T


@dataclass
class Block:
    """Rows in the order of their ids, with their rank in the list of each dimension."""

    ids: np.ndarray
    null: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    rank: np.ndarray  # dimension x row: place from the top
    top: np.ndarray  # place x dimension: component at that place from the top

    @classmethod
    def of(cls, ids: np.ndarray, null: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Block:
        order = np.lexsort((ids, null))
        vectors = vectors[order]
        listed = np.argsort(-vectors, axis=0, kind="stable")
        rank = np.empty((vectors.shape[1], len(order)), np.int32)
        places = np.arange(len(order), dtype=np.int32)
        for d in range(vectors.shape[1]):
            rank[d, listed[:, d]] = places
        return cls(ids[order], null[order], labels[order], vectors, rank, np.take_along_axis(vectors, listed, 0))

    def met_at(self, anchors: np.ndarray) -> np.ndarray:
        """For each anchor and row, the least depth at which sorted access meets the row."""
        n = len(self.ids)
        met = np.full((len(anchors), n), n - 1, np.int32)  # an anchor of zeros has no lists to go down
        for d in range(anchors.shape[1]):
            sign = np.sign(anchors[:, d])
            up, down = np.flatnonzero(sign > 0), np.flatnonzero(sign < 0)
            met[up] = np.minimum(met[up], self.rank[d])
            met[down] = np.minimum(met[down], n - 1 - self.rank[d])
        return met

    def thresholds(self, anchors: np.ndarray, depths: list[int]) -> np.ndarray:
        """For each anchor and depth, the most that a row can score which is not met above that depth."""
        at = np.array(depths) - 1
        high, low = self.top[at], self.top[len(self.ids) - 1 - at]
        return products(np.maximum(anchors, 0), high) + products(np.minimum(anchors, 0), low)


@dataclass
class Found:
    """The best rows of each window: anchor x window x place, empty places last."""

    score: np.ndarray
    ids: np.ndarray
    null: np.ndarray

    @classmethod
    def empty(cls, anchors: int, windows: int, k: int) -> Found:
        shape = (anchors, windows, k)
        return cls(np.full(shape, ABSENT), np.zeros(shape, np.int64), np.zeros(shape, bool))

    def add(self, anchor: int, window: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        k = self.score.shape[2]
        score, ids, null = (np.concatenate([old[anchor, window], new]) for old, new in ((self.score, score), (self.ids, ids), (self.null, null)))
        best = np.lexsort((ids, null, ~score))[:k]  # ~x descends as x ascends, for every x
        self.score[anchor, window], self.ids[anchor, window], self.null[anchor, window] = score[best], ids[best], null[best]


def search(block: Block, anchors: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, found: Found) -> int:
    """Put the rows of a block into the windows of all anchors; returns how many scores were computed.

    ``low`` and ``high`` (anchor x window) bound the scores that a window admits. ``same``
    says whether rows of the anchor's label are wanted, or those of other labels.
    """
    n, k = len(block.ids), found.score.shape[2]
    depths = sorted({max(1, int(n * part)) for part in DEPTHS})
    limit = block.thresholds(anchors, depths)
    met = block.met_at(anchors)
    able = high >= low
    ceiling = np.where(able, high, ABSENT).max(1)
    scored = 0
    step, before = np.zeros(len(anchors), np.int64), np.zeros(len(anchors), np.int64)
    for a in np.flatnonzero(~able.any(1)):
        step[a] = len(depths)
    while True:
        active = np.flatnonzero(step < len(depths))
        if not len(active):
            return scored
        # a last score wanted is at most the top of its window: down to where the threshold is below all tops nothing can end
        for a in active:
            tops = high[a, able[a]].min()
            while step[a] < len(depths) - 1 and limit[a, step[a]] >= tops:
                step[a] += 1
        depth = np.array(depths)[step[active]]
        own = block.labels == labels[active, None]
        fresh = (met[active] < depth[:, None]) & (met[active] >= before[active, None]) & (own if same else ~own)
        asked = np.flatnonzero(fresh.any(0))
        place = np.cumsum(fresh.any(0)) - 1
        score = products(anchors[active], block.vectors[asked])
        scored += int(fresh.sum())
        for i, a in enumerate(active):
            new = np.flatnonzero(fresh[i])
            of = score[i, place[new]]
            fits = (of <= ceiling[a]) & (of >= low[a].min())
            new, of = new[fits], of[fits]
            order = np.argsort(of, kind="stable")
            values = of[order]
            done = True
            for w in np.flatnonzero(able[a]):
                until = np.searchsorted(values, high[a, w], "right")
                begin = max(np.searchsorted(values, low[a, w]), 0)
                if until - begin > k:  # all that tie with the last one go on, and the ids decide
                    begin = max(begin, np.searchsorted(values, values[until - k]))
                if until > begin:
                    at = new[order[begin:until]]
                    if until - begin > 2 * k:  # rows stand in the order of their ids: of equal scores the first k do
                        ties = int(np.searchsorted(values, values[begin], "right")) - begin
                        at = np.concatenate([np.sort(at[:ties])[:k], at[ties:]])
                    found.add(a, w, score[i, place[at]], block.ids[at], block.null[at])
                last = max(found.score[a, w, -1], low[a, w])
                done &= bool(limit[a, step[a]] < last)
            before[a] = depth[i]
            step[a] = len(depths) if done else step[a] + 1


def blocks(source: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    rows = max(64, BLOCK_BYTES // (8 * max(1, width)))
    held: list[pa.RecordBatch] = []
    for batch in source:
        at = 0
        while at < len(batch):
            part = batch.slice(at, rows - sum(map(len, held)))
            held.append(part)
            at += len(part)
            if sum(map(len, held)) == rows:
                yield _block(held, width)
                held = []
    if held:
        yield _block(held, width)


def _block(parts: list[pa.RecordBatch], width: int) -> Block:
    table = pa.Table.from_batches(parts)
    ids = table["vec_id"].combine_chunks()
    return Block.of(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), table["label"].to_numpy(), matrix(table["v"], width))


def best_of(candidates: DataFrame, anchors: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """(anchor, window, score, id): the best ``k`` rows of each window, as they are found in each task."""
    shared = candidates.sparkSession.sparkContext.broadcast((anchors, labels, low, high))
    width = anchors.shape[1]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, low, high = shared.value
        found = Found.empty(*low.shape, k)
        for block in blocks(source, width):
            room = max(1, (16 << 20) // (8 * len(block.ids)))  # scores held at a time
            for at in range(0, len(anchors), room):
                s = slice(at, at + room)
                search(block, anchors[s], labels[s], low[s], high[s], same, Found(found.score[s], found.ids[s], found.null[s]))
        anchor, window, place = np.nonzero(found.score != ABSENT)
        for at in range(0, len(anchor), 50_000):
            s = slice(at, at + 50_000)
            which = anchor[s], window[s], place[s]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[s].astype(np.int32)), pa.array(window[s].astype(np.int32)), pa.array(found.score[which]), pa.array(found.ids[which], mask=found.null[which])],
                names=["anchor", "window", "score", "id"],
            )

    out = candidates.mapInArrow(trimmed(run), "anchor int, window int, score long, id long")
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine_chunk(candidates: DataFrame, chunk: pa.Table, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Rows of the anchors of one chunk; what the driver holds is bounded by the chunk."""
    anchors, labels, ids = matrix(chunk["v"], width), chunk["label"].to_numpy(), chunk["vec_id"].to_numpy()
    n = len(ids)
    whole = np.full((n, 1), -np.iinfo(np.int64).max), np.full((n, 1), np.iinfo(np.int64).max)
    near = best_of(candidates, anchors, labels, *whole, True, positives + 1).toArrow()
    own = np.array([products(a[None], a[None])[0, 0] for a in anchors], np.int64) if n else np.zeros(0, np.int64)
    anchor, score, place = (near[c].to_numpy() for c in ("anchor", "score", "place"))
    order = np.lexsort((place, anchor))
    anchor, score, partner = anchor[order], score[order], near["id"].combine_chunks().take(pa.array(order))
    # the anchor's own row is one of those with its id and its own product; it stands among these or below them all
    self_ = partner.is_valid().to_numpy(zero_copy_only=False) & (partner.fill_null(0).to_numpy() == ids[anchor]) & (score == own[anchor])
    first = np.flatnonzero(self_)[np.unique(anchor[self_], return_index=True)[1]]
    kept = np.setdiff1d(np.arange(len(anchor)), first)
    place = np.arange(len(kept)) - np.searchsorted(anchor[kept], anchor[kept])
    kept, place = kept[place < positives], place[place < positives]
    bottom, top = np.zeros((n, positives), np.int64), np.full((n, positives), -1)
    bottom[anchor[kept], place] = [-(-low * s // 100) for s in score[kept].tolist()]
    top[anchor[kept], place] = [high * s // 100 for s in score[kept].tolist()]
    hard = best_of(candidates, anchors, labels, bottom, top, False, negatives)
    pairs = pa.table({
        "anchor": pa.array(anchor[kept].astype(np.int32)), "window": pa.array(place.astype(np.int32)), "positive_id": partner.take(pa.array(kept)),
        "positive_score": pa.array(score[kept]), "anchor_id": pa.array(ids[anchor[kept]]), "copies": chunk["copies"].combine_chunks().take(pa.array(anchor[kept])),
    })
    named = F.broadcast(candidates.sparkSession.createDataFrame(pairs))
    rows = hard.join(named, ["anchor", "window"]).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return rows.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding; other columns are not read, so none can clash.
    ``anchor`` says which rows are anchors (vec_id divisible by 100). Rows with a null label,
    vector or component take no part; a null vec_id stands last among equal scores and is
    never an anchor. Vectors of unequal length are compared as if zeros followed the shorter;
    an empty one scores 0 with all. A repeated row is another row: it can be positive to its
    copy, and repeated anchors give their rows as often as they stand. Of rows with equal
    score and vec_id either may come first, which no column shows. An anchor without
    positives, a positive without negatives and an empty table give no rows.
    """
    spark = rows.sparkSession
    steps = Steps(spark)
    try:
        candidates = steps(whole_vectors(rows))
        chosen = candidates.filter(F.col("vec_id").isNotNull() & (F.col("vec_id") % 100 == 0 if anchor is None else anchor)).groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("copies"))
        chosen = steps(chosen)
        width, count = candidates.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0], chosen.count()
        parts = max(1, -(-count * 8 * max(1, width) // CHUNK_BYTES))
        part = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(parts))
        results = []
        for i in range(parts):
            chunk = chosen.filter(part == i).toArrow()
            if len(chunk):
                results.append(steps(mine_chunk(candidates, chunk, max(1, width), positives, negatives, low, high)))
        if not results:
            results = [spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")]
        out = results[0]
        for other in results[1:]:
            out = out.unionByName(other)
        return steps.finish(out)
    except BaseException:
        steps.close()
        raise
