"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades 0 < 1 < ... < K share one weight per feature; the chance that a text is above
grade j is ``sigmoid(x . w - cut_j)`` with ordered cuts, and the expected severity is the
sum of these chances. Features are the distinct words of a text and their first four and
five letters (inflected and joined words share these), hashed, valued ``1 + ln(count)``.

The fit sees a bounded sample of labelled rows (``FIT_ROWS``, by a hash of doc_id);
scoring reads every word of every document. The label is 0 or 1; graded severity comes
from how many words of a toxic document are typical of toxic documents: at or below the
median of such documents it is grade 1, above it is grade 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.words import batches, hash_strings, split_words, trimmed

#: labelled documents that the fit sees at most
FIT_ROWS = 8_000
#: features of a text that the fit sees at most
FIT_FEATURES = 2_000
#: features that take part in the fit at most
FEATURES = 20_000
STEMS = (4, 5)
MARKS = ".,;:!?\"'()[]{}*#$%&|<>-_"


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature hash of every occurrence of a feature."""
    words = split_words(pc.utf8_lower(texts))
    bare = pc.utf8_trim(words.distinct, MARKS)
    length = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    row = words.rows()
    rows, hashes = [row], [hash_strings(bare)]
    rows_of = [words.codes]
    for n in STEMS:
        hashes.append(hash_strings(pc.utf8_slice_codeunits(bare, 0, n), n))
        long = length[words.codes] > n
        rows.append(row[long])
        rows_of.append(words.codes[long])
    return np.concatenate(rows), np.concatenate([h[c] for h, c in zip(hashes, rows_of, strict=True)])


def counted(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with their counts, ordered by row."""
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    at = np.flatnonzero(new)
    return row[at], feature[at], np.diff(np.append(at, len(row)))


@dataclass(frozen=True)
class OrdinalModel:
    features: np.ndarray  # sorted uint64
    weights: np.ndarray
    cuts: np.ndarray  # ascending

    def severity(self, texts: pa.Array) -> np.ndarray:
        """Chance to be above each grade, one row per text."""
        x = np.zeros(len(texts))
        if len(self.features):
            row, feature = occurrences(texts)
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            known = self.features[at] == feature
            row, at, count = counted(row[known], at[known])
            x += np.bincount(row, self.weights[at] * (1 + np.log(count)), len(texts))
        return sigmoid(x[:, None] - self.cuts[None, :])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, l1: float = 3e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts that maximise the cumulative-link likelihood, less ``l1 * |w|``.

    Accelerated proximal gradient with a step for each feature, from a bound of the
    curvature in which the features of a row share. The cuts are a first one and positive
    gaps, whose logarithms are the free parameters.
    """
    n, k = len(grade), int(grade.max())
    above = (grade[:, None] >= np.arange(1, k + 1)).mean(0)
    first = -np.log(above[0] / (1 - above[0]))
    gaps = np.log(np.maximum(np.diff(np.log((1 - above) / above)), 0.1))
    w, z, t = np.zeros(width), np.zeros(width), 1.0
    whole = np.bincount(row, np.abs(value), n)
    curve = 0.5 * np.bincount(column, np.abs(value) * whole[row], width) / n + 1e-9
    for _ in range(steps):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        x = np.bincount(row, z[column] * value, n)
        s = sigmoid(x[:, None] - cuts)
        padded = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], 1)
        p = np.maximum(padded[np.arange(n), grade] - padded[np.arange(n), grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], 1)
        low, high = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        by_cut = np.zeros((n, k + 2))  # d(-log p) / d(cut)
        by_cut[np.arange(n), grade] += low
        by_cut[np.arange(n), grade + 1] -= high
        by_x = high - low  # d(-log p) / dx
        gradient = np.bincount(column, by_x[row] * value, width) / n
        by_cut = by_cut[:, 1:-1].mean(0)
        new = z - gradient / curve
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / curve, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
        first -= 0.5 * by_cut.sum()
        gaps = np.clip(gaps - 0.5 * np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(gaps), -5, 3) if k > 1 else gaps
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def severity_grades(row: np.ndarray, feature: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from the label and from how many typical features a toxic text has."""
    known, code = np.unique(feature, return_inverse=True)
    of_toxic = np.bincount(code, toxic[row], len(known))
    of_all = np.bincount(code, minlength=len(known))
    typical = (of_toxic >= 3) & (of_toxic >= 0.8 * of_all)
    many = np.bincount(row, typical[code] * count, len(toxic))
    middle = np.median(many[toxic > 0]) if (toxic > 0).any() else 0
    return (toxic > 0).astype(int) + ((toxic > 0) & (many > middle))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, features: int = FEATURES) -> OrdinalModel:
    """Fit on at most ``rows`` labelled documents, chosen by a hash of doc_id.

    Labels without doc_id or label, and documents without text, take no part; of repeated
    doc_ids one label, the higher, and one text count. Of a text with more than
    ``FIT_FEATURES`` features, a very long one, those of the smallest hashes are seen, so
    what the driver gets is bounded. Other columns are not read. With one class only, the model is the base
    rate and has no weights.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, rows=500):
            row, feature, count = counted(*occurrences(batch.column("text")))
            few = np.arange(len(row)) - np.searchsorted(row, row) < FIT_FEATURES
            row, feature, count = row[few], feature[few], count[few]
            bounds = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (feature.view(np.int64), count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], names=["doc_id", "toxic", "feature", "count"])

    known = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = known.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(trimmed(run), "doc_id long, toxic int, feature array<long>, count array<int>")
    once = F.min_by(F.struct("toxic", "feature", "count"), F.xxhash64("feature", "count")).alias("s")
    table = sample.groupBy("doc_id").agg(once).select("doc_id", "s.*").toArrow().sort_by("doc_id").combine_chunks()
    toxic = (table["toxic"].to_numpy() > 0).astype(int)
    if not len(toxic) or toxic.min() == toxic.max():
        rate = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.0
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([np.inf if not rate else -np.log(rate / (1 - rate))]))
    lists = table["feature"].combine_chunks()
    row = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    feature = lists.values.to_numpy().view(np.uint64)
    count = table["count"].combine_chunks().values.to_numpy()
    grade = severity_grades(row, feature, count, toxic)
    every, code = np.unique(feature, return_inverse=True)
    # features whose documents are toxic more, or less, often than chance explains
    seen, hit = np.bincount(code, minlength=len(every)), np.bincount(code, toxic[row], len(every))
    rate = toxic.mean()
    strength = np.where(seen >= 2, np.abs(hit - rate * seen) / np.sqrt(seen * rate * (1 - rate) + 1), 0)
    best = np.sort(np.argsort(-strength, kind="stable")[:features])
    best = best[strength[best] > 1.5]
    place = np.full(len(every), -1)
    place[best] = np.arange(len(best))
    used = place[code] >= 0
    weights, cuts = fit_ordinal(row[used], place[code[used]], 1 + np.log(count[used]), grade, len(best))
    return OrdinalModel(every[best][weights != 0], weights[weights != 0], cuts)


def score(docs: DataFrame, model: OrdinalModel, reject_above: float = 0.5) -> DataFrame:
    """All columns of all rows with ``severity`` (double), ``grade`` (int) and ``kept``.

    ``severity`` is the expected grade, ``grade`` the nearest whole one. A text without
    words (null, empty) has no sign of toxicity: severity of the base rate, kept. Each row
    stands alone, so ties and repeated rows need no rule; a very long text is one row's
    work. Input columns named like an added one are left out; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("severity", "grade", "kept")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.cuts))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        for batch in batches(source):
            severity = own.severity(batch.column(names.index("text"))).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(severity < reject_above)],
                names=[*names, "severity", "grade", "kept"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(trimmed(run), f"{schema}, severity double, grade int, kept boolean")
