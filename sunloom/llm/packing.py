"""Packing documents into sequences by a configuration linear program.

A configuration says how many pieces of each length share one sequence. The program
asks for the least number of sequences whose configurations cover the histogram of
lengths. It is solved by multiplicative weights: prices fall where lengths are covered, the
most valuable configuration at the present prices is used next, and knapsack dynamic
programming finds it; the prices also bound from below how few sequences can do, which
tells the gap. Lengths are counted in units of 1/256 of a sequence. The
solution is rounded to whole sequences, what that leaves is solved again, and the last pieces,
the shortest among them, are packed best fit into the room that is left over. All of this
works on the histogram (one number per length), so its cost and the size of the plan
depend on the capacity and not on the number of documents. The pieces themselves stay
in Spark: they are numbered within their length and look up their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.ordinals import bucket_count, with_ordinals
from sunloom.llm.words import batches, group_starts, stored, tokens, trimmed

CAPACITY = 4096


@dataclass(frozen=True)
class Group:
    """``times`` sequences that hold ``items`` = ((length, how many), ...)."""

    items: tuple[tuple[int, int], ...]
    times: int


def price_knapsack(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length the best configuration has, at most ``most`` of each; dynamic program over capacity."""
    value = np.zeros(capacity + 1)
    moves: list[tuple[int, int, np.ndarray]] = []
    for k in np.argsort(-prices / lengths, kind="stable"):
        left, n, length = min(int(most[k]), capacity // int(lengths[k])), 1, int(lengths[k])
        while left > 0:  # 1, 2, 4, ... of a kind make every number up to the bound
            n = min(n, left)
            size = n * length
            with_it = value[: capacity + 1 - size] + n * prices[k]
            taken = with_it > value[size:] + 1e-12
            if taken.any():
                np.copyto(value[size:], with_it, where=taken)
                moves.append((int(k), n, taken))
            left -= n
            n *= 2
    counts = np.zeros(len(lengths), np.int64)
    at = capacity
    for k, n, taken in reversed(moves):
        size = n * int(lengths[k])
        if at >= size and taken[at - size]:
            counts[k] += n
            at -= size
    return counts


#: the program stops when it needs at most this many times what its prices show to be needed
GAP = 1.05
#: how full a sequence of each phase is at least
FULL = (0.9995, 0.9995, 0.999, 0.998, 0.995, 0.99, 0.97, 0.9, 0.8, 0.6)
#: units of a sequence in which the program counts lengths
UNITS = 256


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, most_priced: int = 120, uses: int = 80, rate: float = 0.25) -> tuple[np.ndarray, np.ndarray, float]:
    """Configurations (one a row), how often each is used as fractions, and the gap reached.

    Every length is covered in full. A round prices one new configuration and then uses
    those known, the most valuable at a time, ``uses`` times.
    """
    known = np.diag(np.minimum(demand, capacity // lengths))  # one kind alone, so that each is covered at all
    used = np.zeros(len(known))
    price = lengths / capacity
    covered = np.zeros(len(lengths))
    best, least = np.inf, 0.0
    answer = used
    for _ in range(most_priced):
        counts = price_knapsack(lengths, price, demand, capacity)
        least = max(least, float(price @ demand) / float(price @ counts))
        known, used = np.vstack([known, counts]), np.append(used, 0.0)
        share = known / demand
        for _ in range(uses):
            j = int(np.argmax(known @ price))
            has = known[j] > 0
            step = rate / share[j, has].max()
            used[j] += step
            covered += share[j] * step
            price = price * np.exp(-share[j] * step)
            price /= price.max()
        if covered.min() > 0 and used.sum() / covered.min() < best:
            best, answer = used.sum() / covered.min(), used / covered.min()
        if best <= gap * least:
            break
    answer = np.append(answer, np.zeros(len(known) - len(answer)))
    chosen = np.flatnonzero(answer)
    return known[chosen], answer[chosen], best / least


def best_fit(histogram: np.ndarray, capacity: int, begun: Sequence[Group] = ()) -> list[Group]:
    """Best fit from the longest down, on runs of equal sequences, into those ``begun`` first."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    done: list[Group] = []
    free_sizes = np.zeros(capacity + 1, bool)

    def put(free: int, items: dict[int, int], times: int) -> None:
        if free:
            open_.setdefault(free, []).append((items, times))
            free_sizes[free] = True
        else:
            done.append(Group(tuple(sorted(items.items())), times))

    for g in begun:
        put(capacity - sum(length * n for length, n in g.items), dict(g.items), g.times)
    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            fits = np.flatnonzero(free_sizes[length:])
            if len(fits):
                free = length + int(fits[0])
                items, times = open_[free].pop()
                if not open_[free]:
                    free_sizes[free] = False
                n = min(left, times)
                if times > n:
                    put(free, items, times - n)
                put(free - length, items | {length: items.get(length, 0) + 1}, n)
                left -= n
            else:
                each = min(capacity // length, left)
                n = left // each
                put(capacity - each * length, {length: each}, n)
                left -= each * n
    for groups in open_.values():
        done += [Group(tuple(sorted(items.items())), times) for items, times in groups]
    return done


def taken_from(left: np.ndarray, spans: list[np.ndarray], counts: dict[int, int], times: int, capacity: int, enough: float) -> Iterator[Group]:
    """``times`` sequences of a configuration (kind: how many) in real lengths, taken out of ``left``.

    Of each kind the longest goes first; one piece, of the kind that has most left, is
    the longest of all lengths that still fits, which takes up what rounding to kinds
    lost. Ends early where a sequence would not be full enough. Sequences differ only where
    a length runs out, so there are few groups.
    """
    free = max(counts, key=lambda k: int(left[spans[k]].sum()))
    while times > 0:
        items: dict[int, int] = {}
        for kind, n in counts.items():
            n -= kind == free
            for length in spans[kind].tolist():
                now = min(n, int(left[length]))
                if now:
                    items[length] = now
                    n -= now
        room = capacity - sum(length * n for length, n in items.items())
        fits = np.flatnonzero(left[: max(room, 0) + 1])
        while len(fits) and left[fits[-1]] <= items.get(int(fits[-1]), 0):
            fits = fits[:-1]
        if not len(fits) or room - int(fits[-1]) > (1 - enough) * capacity:
            return
        items[int(fits[-1])] = items.get(int(fits[-1]), 0) + 1
        same = min(times, *(int(left[length]) // n for length, n in items.items()))
        for length, n in items.items():
            left[length] -= n * same
        times -= same
        yield Group(tuple(sorted(items.items())), same)


def programmed(histogram: np.ndarray, capacity: int, full: Sequence[float] = FULL, share: float = 0.91) -> tuple[list[Group], np.ndarray]:
    """Groups that the program places, and what is left of the histogram.

    A phase solves for what is left and takes its configurations by use, each in whole
    sequences; one of which some pieces are gone is taken without them while it is full
    enough, which is asked less of later phases. It ends once ``share`` of the pieces are
    placed: the shortest of the others are what fills the gaps afterwards.
    """
    left = np.array(histogram, np.int64)
    most_left = int((1 - share) * left.sum())
    unit = -(-capacity // UNITS)
    whole = capacity // unit
    kind = np.clip((np.arange(len(left)) + unit // 2) // unit, 1, whole)
    kind[0] = 0
    spans = [np.flatnonzero(kind == k)[::-1] for k in range(whole + 1)]
    groups: list[Group] = []
    for enough in full:
        demand = np.bincount(kind, left, whole + 1).astype(np.int64)
        kinds = np.flatnonzero(demand)
        if not len(kinds) or left.sum() <= most_left:
            break
        known, used, _ = fractional(kinds, demand[kinds], whole)
        for j in np.argsort(-used, kind="stable"):
            have = np.minimum(known[j], demand[kinds])
            if (have * kinds).sum() < 0.9 * enough * whole:
                continue
            has = have > 0
            times = min(max(1, int(used[j])), int((demand[kinds][has] // have[has]).min()))
            groups += taken_from(left, spans, dict(zip(kinds[has].tolist(), have[has].tolist(), strict=True)), times, capacity, enough)
            demand = np.bincount(kind, left, whole + 1).astype(np.int64)
            if left.sum() <= most_left:
                break
    return groups, left


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Groups of sequences that hold exactly the histogram (index: length)."""
    groups, left = programmed(histogram, capacity)
    return best_fit(left, capacity, groups)


def places(groups: list[Group]) -> dict[str, np.ndarray]:
    """For each length and run of its numbers: where the run begins and where it goes."""
    sequence, taken, rows = 0, {}, []
    for g in groups:
        offset = 0
        for length, n in g.items:
            rows.append((length, taken.get(length, 0), sequence, n, offset))
            taken[length] = taken.get(length, 0) + n * g.times
            offset += length * n
        sequence += g.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long) to rows with a ``length`` from 1 to ``capacity``.

    ``key`` names columns that pieces of one length are dealt by. Equal rows are packed as
    often as they stand. Input columns named sequence_id or offset are left out, all others
    come back; an empty table gives no rows. The driver gets one count per length.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    inner = [f"c{i}" for i in range(len(names))]
    at = f"c{names.index('length')}"
    rows = stored(pieces.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True))))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy(at).count().collect():
        histogram[r[at]] = r["count"]
    table = places(plan(histogram, capacity))
    n = bucket_count(int(histogram.sum()))
    keys = [f"c{names.index(k)}" for k in key]
    # any order will do, so equal rows are dealt to all buckets
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    bucket = F.pmod(F.xxhash64(*keys, "row"), F.lit(n))
    numbered = with_ordinals(rows, [at], bucket, [*(F.col(c) for c in keys), F.col("row")], "rank")

    def look_up(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = table["length"] * (1 << 40) + table["first"]
        for batch in source:
            length, rank = (batch.column(c).to_numpy() for c in (at, "rank"))
            place = np.searchsorted(first, length * (1 << 40) + rank, "right") - 1
            within = rank - table["first"][place]
            each = table["each"][place]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in inner), pa.array(table["sequence"][place] + within // each), pa.array(table["offset"][place] + within % each * length)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return numbered.select(*inner, "rank").mapInArrow(trimmed(look_up), f"{schema}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Token ids of whole texts, each followed by ``end``, cut into pieces of ``capacity``.

    Returns doc_id, piece, start, length and ids_crc32. A null text is an empty one and
    gives the end alone. Rows are treated one by one, so repeated rows give repeated pieces.
    """
    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens(vocabulary)
        for batch in batches(source):
            ids, bounds = model.encode(batch.column("text"), end)
            total = np.diff(bounds)
            pieces = -(-total // capacity)
            row, piece = np.repeat(np.arange(len(total)), pieces), group_starts(pieces)
            start = piece * capacity
            length = np.minimum(capacity, total[row] - start)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (bounds[row] + start) * 4
            crc = np.fromiter((zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end alone. A text of any length is cut into pieces; its
    tokens are held by one task. Repeated rows and null doc_ids are packed as they stand, ties
    of length go in any order, and an empty table gives no rows. Other columns are not
    read, so none can clash.
    """
    return pack(token_pieces(docs, vocabulary, end, capacity), ["doc_id", "piece", "ids_crc32", "start"], capacity)
