"""Words, hashes and tokens of whole Arrow batches, and the folder for stored steps.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Python sees each distinct word of a batch
once; what is done per word occurrence is done by Arrow and NumPy.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.session import ensure_checkpoint_dir

SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def stored(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the shared folder: computed once, without lineage.

    Spark removes the files once nothing refers to them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Steps:
    """Tables of the steps of one job, in a folder of their own under the checkpoint folder.

    Loops keep their state here rather than in checkpoints: a checkpoint carries on the
    optimizer's estimate of its size, which joins multiply from round to round, while a
    table is as large as its files. The job removes the folder when it has its result.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/steps-{uuid.uuid4().hex}"
        self.n = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, result: DataFrame) -> DataFrame:
        """The result, stored apart from the steps, which are removed."""
        try:
            return stored(result)
        finally:
            self.close()

    def close(self) -> None:
        """Remove the tables of the steps, also where the job failed."""
        remove(self.spark, self.folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def aside(docs: DataFrame, needed: Sequence[str], outputs: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with all but the ``needed`` columns renamed, and what gives them their names back.

    So no name that an operator uses inside can clash. Columns named like an output are
    left out; the second function returns the other columns in their order and then the outputs.
    """
    names = [c for c in docs.columns if c not in outputs]
    inner = [c if c in needed else f"in{i}" for i, c in enumerate(names)]
    renamed = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)))
    return renamed, lambda df: df.select(*(F.col(f"`{i}`").alias(c) for c, i in zip(names, inner, strict=True)), *outputs)


@dataclass
class Words:
    """Words of a column of texts: row i has ``codes[bounds[i]:bounds[i + 1]]`` into ``distinct``."""

    codes: np.ndarray
    bounds: np.ndarray
    distinct: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """Row number of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def plain(column: pa.Array) -> pa.Array:
    """A string column without nulls and with 64-bit offsets that start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), pa.large_string())


def split_words(column: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(plain(column))
    offsets = lists.offsets.to_numpy()
    encoded = lists.values.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(encoded.dictionary, "").as_py() if len(encoded.dictionary) else -1
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return Words(codes, offsets.astype(np.int64), encoded.dictionary)


STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
#: a random number for each byte; white space counts nothing
_BYTES = np.random.default_rng(20_240_607).integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_BYTES[_IS_SPACE] = 0
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: values that are summed together; the table of powers is as long, unless one run is longer
SUMMED = 1 << 18


def powers(n: int) -> list[np.ndarray]:
    """Powers of STEP and of its inverse, at least ``n`` of each; a table of SUMMED is kept for the next call."""
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (STEP, _BACK):
        steps = np.full(max(n, SUMMED), base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if n <= SUMMED:
        _powers[:] = made
    return made


def run_hashes(values: Callable[[int, int], np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run ``first[i]:last[i]`` of a row of numbers: a polynomial mod 2**64 over its numbers.

    Runs come in the order of ``first``; ``values`` gives the numbers of a range. Prefix
    sums over bounded stretches give the hashes of all runs that begin in one.
    """
    out = np.empty(len(first), np.uint64)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + SUMMED // 2)))
        begin, end = int(first[a]), int(last[a:b].max())
        up, down = powers(end - begin + 1)
        total = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(values(begin, end) * up[: end - begin], out=total[1:])
        at = first[a:b] - begin
        out[a:b] = (total[last[a:b] - begin] - total[at]) * down[at]
        a = b
    return out


@dataclass
class HashedWords:
    """Hash of every word of a column; row i has ``hashes[bounds[i]:bounds[i + 1]]``.

    ``first`` and ``last`` are the first and past-the-last bytes of the words in ``raw``,
    which holds all texts, and ``begin`` is where each text begins there.
    """

    hashes: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    last: np.ndarray
    raw: np.ndarray
    begin: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def hash_words(column: pa.Array) -> HashedWords:
    """Words by their bytes: a polynomial over random numbers for bytes, mod 2**64, mixed.

    Prefix sums give it for all words at once, without an object per word.
    """
    column = plain(column)
    begin = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[: begin[-1]] if data is not None else np.zeros(0, np.uint8)
    solid = ~_IS_SPACE[raw]
    starts, stops = solid.copy(), solid.copy()
    if len(raw):
        starts[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        inner = begin[1:-1][(begin[1:-1] < len(raw)) & (begin[1:-1] > 0)]
        starts[inner] = solid[inner]
        stops[inner - 1] = solid[inner - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    run = run_hashes(lambda a, b: _BYTES[raw[a:b]], first, last)
    return HashedWords(mix(run ^ mix((last - first).astype(np.uint64))), np.searchsorted(first, begin), first, last, raw, begin)


def hash_strings(strings: pa.Array, seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(s, seed) for s in strings.to_pylist()), np.uint64, len(strings))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hashes in their order."""
    h = np.full(len(parts[0]), STEP, np.uint64)
    for p in parts:
        h = (h ^ p) * STEP
        h ^= h >> np.uint64(29)
    return mix(h)


def group_starts(lengths: np.ndarray) -> np.ndarray:
    """Position within its group of every member of groups of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


#: stands between chunks that are encoded together; a token by itself, which no chunk without it has
MARK = "\x01"
_KINDS = np.zeros(256, np.uint8)  # 1: ASCII letters and digits, 2: ASCII punctuation but the apostrophe, 3: white space
_KINDS[[c for c in range(0x21, 0x7F) if c != 0x27]] = 2
_KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KINDS[_IS_SPACE] = 3


def punctuation_apart(column: pa.Array) -> pa.Array:
    """Texts with a space before the punctuation that ends a word, where an ASCII letter or digit stands before it.

    Runs of ASCII punctuation without apostrophes, up to white space. A run that meets one of the next
    text is also set apart, as it ends its own text; some at the ends of texts are left.
    """
    column = plain(column)
    begin = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = column.buffers()[2]
    if data is None or begin[-1] < 3:
        return column
    raw = np.frombuffer(data, np.uint8)[: begin[-1]]
    kind = _KINDS[raw]
    edges = np.diff((kind == 2).view(np.int8))
    first, last = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1)
    last = last[1:] if kind[0] == 2 else last
    first = first[: len(last)]
    at = first[(kind[first - 1] == 1) & (kind[last + 1] == 3)]
    spaced = np.insert(raw, at, np.uint8(0x20))
    bounds = begin + np.searchsorted(at, begin)
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(bounds), pa.py_buffer(spaced)])


class Tokens:
    """Token ids of texts by a tokenizer that treats what stands between spaces apart.

    Holds for vocabularies whose pre-tokenizer drops white space and sets punctuation apart
    from letters and digits, whose normaliser lower-cases, and where MARK is one token; checked
    by the tests. A chunk is encoded when a worker first sees it, many in one text; what is
    remembered is bounded by starting anew at ``remember`` chunks.
    """

    def __init__(self, path: str, plain_specials: bool = False, remember: int = 1_000_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = plain_specials
        self.remember = remember
        (self.mark,) = self._ids([MARK])[0]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and how many each has."""
        ids = np.array(self._ids([f" {MARK} ".join(chunks)])[0], np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) == len(chunks) - 1:
            return np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1
        each = self._ids(chunks)  # one of them has the mark in it
        return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def _entries(self, chunks: list[str]) -> np.ndarray:
        """Where each of the distinct chunks is remembered; new ones are encoded."""
        entry = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(entry < 0)
        if len(self.known) + len(unknown) > self.remember and self.known:
            self._clear()
            unknown = np.arange(len(chunks))
        if len(unknown):
            new = [chunks[i] for i in unknown.tolist()]
            parts = [self._encoded(new[at : at + 1_000]) for at in range(0, len(new), 1_000)]
            lengths = np.concatenate([n for _, n in parts])
            entry[unknown] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, *(ids for ids, _ in parts)])
        return entry

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the bounds of each text; every text ends with ``end`` if given."""
        if not pc.any(pc.match_substring(column, "<|")).as_py():  # special tokens are found before lower-casing
            column = punctuation_apart(pc.ascii_lower(column))
        words = split_words(column)
        entry = self._entries(words.distinct.to_pylist())[words.codes]
        size = self.lengths[entry]
        after = np.cumsum(size)
        ids = self.flat[np.repeat(self.starts[entry] - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        bounds = np.concatenate([[0], after])[words.bounds]
        if end is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))


@cache
def tokens(path: str, plain_specials: bool = False) -> Tokens:
    """One for each Python worker, which Spark uses for many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(path, plain_specials)


def give_back() -> None:
    """Return what a Python worker holds unused, which lives on for many tasks, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on a task's batches; what it held is given back when it ends."""
    def inner(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(source)
        finally:
            give_back()

    return inner


def batches(source: Iterator[pa.RecordBatch], rows: int = 2_000, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and bytes; a single row may be longer."""
    for batch in source:
        at = 0
        while at < len(batch):
            part = batch.slice(at, rows)
            while len(part) > 1 and part.nbytes > size:
                part = part.slice(0, max(1, len(part) // 2))
            yield part
            at += len(part)
