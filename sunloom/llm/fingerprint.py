"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A text is a set of paragraphs: lines, and within long lines runs of words that end after
a mark of punctuation or at a word whose hash says so. Each paragraph's digest is added to
one cell in each of three parts of a table; a cell keeps how many digests it got, their
sum and the sum of their checks. Subtracting two tables leaves the cells of the paragraphs
that differ, and peeling takes these out one by one: a cell with one digest tells it, and
taking it from its other cells frees further ones.

The stored sketch grows with the paragraphs until it peels by itself, so nothing but two
stored sketches is needed for their difference. The cells of each part are a power of two:
the larger of two sketches is folded to the size of the smaller and they are subtracted.
Where peeling gets stuck, the table was too small for the difference, and one as large as
the larger, then twice as large each time, is filled from what each sketch gives alone.
The likeness of two texts is the Jaccard similarity of their paragraph sets, from the size
of each set and the paragraphs recovered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.words import chain, group_starts, hash_words, mix, trimmed

PARTS = 3
#: least number of cells of each part of a sketch, a power of two
FIRST_CELLS = 4
#: cells of each part for a paragraph, before sketches that do not peel are doubled
ROOM = 0.45
#: bytes of a stored cell: count, sum of digests, sum of checks
CELL = 2 + 8 + 4
#: bytes of the text that, with doc_id, decide the range a row belongs to
PREFIX = 16
#: one word in so many ends a paragraph by its hash
FOLD = 10
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;")] = True


def digests(texts: pa.Array, fold: int = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paragraph digests (uint64) of all texts, by text, and the bounds of each text."""
    words = hash_words(texts)
    n = len(words.hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw, last, hashed = words.raw, words.last, words.hashes
    ends = _ENDS[raw[last - 1]] | (np.append(raw, 10)[last] == 10) | (mix(hashed) % np.uint64(fold) == 0)
    ends[words.bounds[1:][words.counts > 0] - 1] = True
    starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    length = np.diff(np.append(starts, n))
    place = group_starts(length).astype(np.uint64)
    one = np.add.reduceat(mix(hashed ^ mix(place + np.uint64(1))), starts)  # order matters through the place
    digest = chain([one, length.astype(np.uint64)])
    row = words.rows()[starts]
    order = np.lexsort((digest, row))
    row, digest = row[order], digest[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
    row, digest = row[new], digest[new]
    return digest, np.searchsorted(row, np.arange(len(texts) + 1))


def checks(digest: np.ndarray) -> np.ndarray:
    return mix(digest + np.uint64(99)).astype(np.uint32)


class Tables:
    """Cells of many sketches side by side; sketch i has ``cells[i]`` cells in each part.

    Counts, sums and checks wrap around at their stored widths, so a stored sketch and one
    in memory are the same.
    """

    def __init__(self, cells: np.ndarray):
        self.cells = cells.astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.cells * PARTS)])
        size = int(self.base[-1])
        self.count, self.total, self.check = np.zeros(size, np.int16), np.zeros(size, np.uint64), np.zeros(size, np.uint32)

    def add(self, sketch: np.ndarray, digest: np.ndarray, sign: np.ndarray | int) -> None:
        signs = np.broadcast_to(np.asarray(sign, np.int16), digest.shape)
        total, check = (np.where(signs > 0, x, x.dtype.type(0) - x) for x in (digest, checks(digest)))
        for part in range(PARTS):
            at = self.base[sketch] + part * self.cells[sketch] + (mix(digest ^ np.uint64(part + 1)) % self.cells[sketch].astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, at, signs)
            np.add.at(self.total, at, total)
            np.add.at(self.check, at, check)

    def only(self, rows: np.ndarray) -> Tables:
        """The sketches with these numbers."""
        out = Tables(self.cells[rows])
        out.count, out.total, out.check = (taken(x, self.base, rows)[0] for x in (self.count, self.total, self.check))
        return out

    def folded(self, cells: np.ndarray) -> Tables:
        """The same sketches with fewer cells, each number dividing the former one."""
        out = Tables(cells)
        width = np.repeat(self.cells, PARTS)
        place = group_starts(width) % np.repeat(out.cells, self.cells * PARTS)
        first = (out.base[:-1, None] + out.cells[:, None] * np.arange(PARTS)).ravel()
        at = np.repeat(first, width) + place
        for mine, theirs in ((out.count, self.count), (out.total, self.total), (out.check, self.check)):
            np.add.at(mine, at, theirs)
        return out

    def minus(self, other: Tables) -> Tables:
        """Difference, cell by cell, from sketches of the same sizes."""
        out = Tables(self.cells)
        out.count, out.total, out.check = self.count - other.count, self.total - other.total, self.check - other.check
        return out

    def owner(self, cell: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, cell, "right") - 1

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sketch, digest and sign of all that can be recovered; the cells keep the rest."""
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            digest = np.where(sign > 0, self.total[look], np.uint64(0) - self.total[look])
            check = np.where(sign > 0, self.check[look], np.uint32(0) - self.check[look])
            pure = checks(digest) == check
            sketch, digest, sign = self.owner(look[pure]), digest[pure], sign[pure]
            order = np.lexsort((digest, sketch))
            sketch, digest, sign = sketch[order], digest[order], sign[order]
            new = np.ones(len(sketch), bool)
            new[1:] = (sketch[1:] != sketch[:-1]) | (digest[1:] != digest[:-1])
            sketch, digest, sign = sketch[new], digest[new], sign[new]
            if not len(sketch):
                break
            got.append((sketch, digest, sign))
            self.add(sketch, digest, -sign)
            look = np.flatnonzero(np.abs(self.count) == 1)
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int16)
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))  # type: ignore[return-value]

    def stuck(self) -> np.ndarray:
        """Numbers of the sketches that hold something still."""
        rest = np.flatnonzero((self.count != 0) | (self.total != 0) | (self.check != 0))
        return np.unique(self.owner(rest))


def taken(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows and the number, within ``rows``, of the row of each."""
    size = bounds[rows + 1] - bounds[rows]
    return values[np.repeat(bounds[rows], size) + group_starts(size)], np.repeat(np.arange(len(rows)), size)


def sketches(digest: np.ndarray, bounds: np.ndarray) -> Tables:
    """Each text's sketch, doubled until it gives back all its paragraphs by peeling."""
    cells = 1 << np.ceil(np.log2(np.maximum(FIRST_CELLS, np.diff(bounds) * ROOM))).astype(np.int64)
    rows = np.arange(len(cells))
    while len(rows):
        table = Tables(cells[rows])
        own, sketch = taken(digest, bounds, rows)
        table.add(sketch, own, 1)
        table.peel()
        rows = rows[table.stuck()]
        cells[rows] *= 2
    table = Tables(cells)
    table.add(np.repeat(np.arange(len(cells)), np.diff(bounds)), digest, 1)
    return table


def encoded(digest: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Each text's sketch as text: number of paragraphs, a digest of them all, and the cells."""
    table = sketches(digest, bounds)
    packed = np.empty((len(table.count), CELL), np.uint8)
    packed[:, :2] = table.count.astype("<i2").view(np.uint8).reshape(-1, 2)
    packed[:, 2:10] = table.total.astype("<u8").view(np.uint8).reshape(-1, 8)
    packed[:, 10:] = table.check.astype("<u4").view(np.uint8).reshape(-1, 4)
    raw, at = memoryview(packed.tobytes()), table.base * CELL
    out = []
    for i in range(len(bounds) - 1):
        own = digest[bounds[i] : bounds[i + 1]]
        out.append(f"{len(own)}:{xxhash.xxh3_64_hexdigest(own.tobytes())}:{base64.b64encode(raw[at[i] : at[i + 1]]).decode()}")
    return out


def decoded(prints: list[str]) -> tuple[np.ndarray, Tables]:
    """Number of paragraphs and sketch of each stored fingerprint."""
    parts = [p.split(":") for p in prints]
    raw = [base64.b64decode(p[2]) for p in parts]
    table = Tables(np.array([len(r) // (CELL * PARTS) for r in raw], np.int64))
    packed = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, CELL)
    table.count = packed[:, :2].copy().view("<i2").ravel().astype(np.int16)
    table.total = packed[:, 2:10].copy().view("<u8").ravel().astype(np.uint64)
    table.check = packed[:, 10:].copy().view("<u4").ravel().astype(np.uint32)
    return np.array([int(p[0]) for p in parts], np.int64), table


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Jaccard similarity of each stored fingerprint of ``a`` with the same one of ``b``.

    Nothing but the two strings is used. Two empty sets are alike (1).
    """
    (size_a, table_a), (size_b, table_b) = decoded(a), decoded(b)
    only_a, only_b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    rows, small = np.arange(len(a)), np.minimum(table_a.cells, table_b.cells)
    table = table_a.folded(small).minus(table_b.folded(small))
    cells = np.maximum(np.maximum(table_a.cells, table_b.cells), small * 2)
    while True:
        sketch, _, sign = table.peel()
        stuck = table.stuck()
        fine = np.setdiff1d(np.arange(len(rows)), stuck)
        for count, s in ((only_a, 1), (only_b, -1)):
            count[rows[fine]] = np.bincount(sketch[sign == s], minlength=len(rows))[fine]
        if not len(stuck):
            break
        rows = rows[stuck]
        table = Tables(cells[rows])
        for side, s in ((table_a, 1), (table_b, -1)):
            sketch, digest, _ = side.only(rows).peel()
            table.add(sketch, digest, s)
        cells[rows] *= 2
    both = size_a - only_a
    union = both + only_a + only_b
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def places(known: pd.Series, doc_id: pd.Series, written: pd.Series, prefix: pd.Series) -> np.ndarray:
    """Rows as strings of bytes that order as (doc_id, text) do, null first, as far as the prefix tells."""
    out = np.zeros((len(known), 10 + PREFIX), np.uint8)
    out[:, 0], out[:, 9] = known, written
    out[:, 1:9] = (doc_id.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 10:] = np.array([bytes(x) for x in prefix], f"S{PREFIX}").view(np.uint8).reshape(-1, PREFIX)
    return out.view(f"S{10 + PREFIX}").ravel()


def with_next(docs: DataFrame, rows_a_bucket: int, buckets_a_core: int = 64) -> DataFrame:
    """Rows (bucket, doc_id, text, only_next), partitioned by bucket and in order within it.

    Buckets are ranges of (doc_id, text), null first, told by the first bytes of the text,
    so that many rows without a doc_id, or with the same, spread too; their cuts come from
    a sample, for balance alone. Each bucket's first document is also given to the bucket
    before it (of the very first one: to the last) with ``only_next``, as the successor of
    its last document. The driver holds one doc_id and prefix per bucket, and there are at
    most ``buckets_a_core`` of these a core.
    """
    spark = docs.sparkSession
    prefix = F.substring(F.col("text").cast("binary"), 1, PREFIX)
    key = [F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)).cast("long"), F.col("text").isNotNull(), F.coalesce(prefix, F.lit(b""))]
    total = docs.count()
    n = min(max(4, -(-total // rows_a_bucket)), buckets_a_core * spark.sparkContext.defaultParallelism)
    sample = docs.select(*(c.alias(f"c{i}") for i, c in enumerate(key))).sample(min(1.0, 20 * n / max(total, 1)), seed=1).toPandas()
    ordered = np.sort(places(*(sample[c] for c in sample)))
    shared = spark.sparkContext.broadcast(np.unique(ordered[[len(ordered) * i // n for i in range(1, n)]] if len(ordered) else ordered))

    @F.pandas_udf("int")
    def place(known: pd.Series, doc_id: pd.Series, written: pd.Series, prefix: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, places(known, doc_id, written, prefix), "right").astype(np.int32))

    rows = docs.select("doc_id", "text", prefix.alias("prefix"), place(*key).alias("bucket"))
    firsts = sorted((r["bucket"], *r["first"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "prefix")).alias("first")).collect())
    before = [(doc_id, start, firsts[i - 1][0]) for i, (_, doc_id, start) in enumerate(firsts)]
    ahead = spark.createDataFrame(before, "first long, start binary, earlier int")
    copies = F.array(F.struct(F.col("bucket"), F.lit(False).alias("only_next")), F.when(F.col("earlier").isNotNull(), F.struct(F.col("earlier").alias("bucket"), F.lit(True).alias("only_next"))))
    rows = rows.join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("first")) & F.col("prefix").eqNullSafe(F.col("start")), "left")
    rows = rows.select("doc_id", "text", F.explode(F.array_compact(copies)).alias("p")).select("p.bucket", "doc_id", "text", "p.only_next")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "only_next", "doc_id", "text")


def compared(texts: list[str], following: list[str]) -> list:
    """Columns n_chars, edited_sha256, both fingerprints, near_edited and near_next."""
    edited = []
    for text, after in zip(texts, following, strict=True):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    # the next document is most often the next of the batch
    apart = [i for i, after in enumerate(following) if i + 1 == len(texts) or texts[i + 1] != after]
    prints, edited_prints, others = (encoded(*digests(pa.array(x, pa.large_string()))) for x in (texts, edited, [following[i] for i in apart]))
    following_prints = [*prints[1:], ""]
    for i, other in zip(apart, others, strict=True):
        following_prints[i] = other
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(prints), pa.array(edited_prints),
        pa.array(likeness(prints, edited_prints)), pa.array(likeness(prints, following_prints)),
    ]


def fingerprint_documents(docs: DataFrame, rows_a_bucket: int = 2_000, together: int = 4 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is an empty one. The order is by doc_id, null first; of rows with one
    doc_id the smaller text comes first (null before all), so rows that are wholly equal
    follow one another. With one row it is its own successor; an empty table gives none. A
    very long text is one row of one batch. Other columns are not read.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        following: list[str] = []
        held: tuple | None = None
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *compared(texts, following)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            ids.clear(), texts.clear(), following.clear()
            return out

        for batch in source:
            for bucket, doc_id, text, only_next in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if held and held[0] == bucket:
                    ids.append(held[1])
                    texts.append(held[2])
                    following.append(text)
                    size += len(text) + len(held[2])
                held = None if only_next else (bucket, doc_id, text)
                if size > together:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    return with_next(docs, rows_a_bucket).mapInArrow(trimmed(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
