"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its distinct five-word shingles, hashed to 64 bits. Its sketch
is the ``k`` smallest hashes. Documents meet in inverted lists of retained values; the
``k`` smallest of both sketches together estimate the Jaccard similarity; pairs that may
reach the threshold are confirmed on their full sets. Links are closed to components.

Work and memory at scale: documents with equal sets are one node. A pair over the
threshold shares at least ``least_shared`` of its sketch values (the chance to miss is
``MISS`` for a pair exactly at the threshold), so a node needs to be listed only under
its rarest values: prefixes of that length must meet. Values that a passage spread over
the corpus keep out of the lists that way, unless most of a document is such passages.
Nodes that no other size class of a list, nor another node of their own, can reach the
threshold with leave the list first. Within a list all nodes are compared with one pivot,
not with each other; only nodes that are not in the list's largest component afterwards
are compared with the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.words import Steps, batches, chain, hash_words, trimmed

WIDTH = 5
#: values of the long sketches, of the sketches of all documents, and of their first sifting
SKETCH = 1024
SIEVE = 128
SCOUTS = 32
#: values of the sketches that the estimate compares
ESTIMATE = 64
#: similarity as a fraction
LINK = (75, 100)
#: chance that a pair at the threshold is not found
MISS = 1e-9
#: numbers that may be broadcast (8 bytes each)
BROADCAST_NODES = 1_000_000
#: size classes of a list whose sizes differ by a factor of e
CLASSES = 64


def least_shared(k: int, similarity: float, miss: float = MISS) -> int:
    """Most values that a union sketch of ``k`` shares, but for a chance of ``miss``.

    Drawing without repetition scatters less than the binomial law used here.
    """
    below = 0.0
    for m in range(k + 1):
        below += comb(k, m) * similarity**m * (1 - similarity) ** (k - m)
        if below > miss:
            return m
    return k


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text; fewer words make one shingle of all."""
    words = hash_words(pc.ascii_lower(column))
    hashed, counts = words.hashes, words.counts
    n = max(0, len(hashed) - width + 1)
    shingles = chain([hashed[i : i + n] for i in range(width)]).view(np.int64)
    out = []
    for start, count in zip(words.bounds[:-1].tolist(), counts.tolist(), strict=True):
        if count >= width:
            out.append(np.unique(shingles[start : start + count - width + 1]))
        elif count:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashed[start : start + count].tobytes(), count)], np.uint64).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_hash(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def list_column(sets: list[np.ndarray], size: int | None = None) -> pa.ListArray:
    kept = [s[:size] for s in sets]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept)))


def sketches(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, set_hash, sieve and its first values (scouts) of every row, and the columns ``carry``."""
    names = ["doc_id", *carry]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.binary()), list_column(sets, SIEVE), list_column(sets, SCOUTS)],
                names=[*names, "n_shingles", "set_hash", "sieve", "scouts"],
            )

    carried = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*names, "text").mapInArrow(trimmed(run), f"{carried}n_shingles long, set_hash binary, sieve array<long>, scouts array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """set_hash and the sorted set."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.binary()), list_column(sets)], names=["set_hash", "hashes"])

    return docs.select("text").mapInArrow(trimmed(run), "set_hash binary, hashes array<long>")


def prefix_length(n: Column, k: int, link: tuple[int, int]) -> Column:
    """How many of its rarest sketch values a node is listed under.

    Two whole sets share at least the similarity times the size of either. A node far
    below ``k`` shingles meets only whole sets; one nearer to it may also meet a sample,
    with which it shares ``least_shared``, so it has to allow for the smaller of both.
    """
    a, b = link
    own = F.ceil(n * a / F.lit(b))
    required = F.when(n * b < F.lit(k * a), own).otherwise(F.least(own, F.lit(least_shared(k, a / b))))
    return (F.least(n, F.lit(k)) - required + 1).cast("int")


def shared_values(post: DataFrame) -> DataFrame:
    """(value, f) of values that more than one node keeps."""
    return post.groupBy("value").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")


def sifted(nodes: DataFrame, values: str, size: int, link: tuple[int, int]) -> DataFrame:
    """Nodes (row) of which enough of the first ``size`` values are kept by others too."""
    few = nodes.select("row", F.col("n_shingles").alias("n"), F.explode(values).alias("value"))
    need = F.when(F.col("n") < size, F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * link[0] / F.lit(link[1])), F.lit(least_shared(size, link[0] / link[1]))))).otherwise(least_shared(size, link[0] / link[1]))
    return few.join(shared_values(few), "value").groupBy("row").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n")).filter(F.col("hits") >= need).select("row")


def listed(hashes: DataFrame, k: int, link: tuple[int, int]) -> DataFrame:
    """Inverted lists (value, node, n, most) that every linked pair meets in.

    ``most`` bounds the overlap of a pair whose rarest common value is this one: a whole
    set has only the values from that place on left to share with another whole set.
    """
    post = hashes.select("node", F.size("hashes").cast("long").alias("n"), F.explode(F.slice("hashes", 1, k)).alias("value"))
    mine = post.join(shared_values(post), "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("shared"))
    # values that no other node keeps are the rarest of all and take the first places
    room = prefix_length(F.col("n"), k, link) - (F.least(F.col("n"), F.lit(k)).cast("int") - F.size("shared"))
    placed = mine.filter(room > 0).select("node", "n", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), room)).alias("i", "s"))
    most = F.when(F.col("n") <= k, F.col("m") - F.col("i")).otherwise(F.col("n"))
    return placed.select(F.col("s.value").alias("value"), "node", "n", most.cast("long").alias("most"))


def within_reach(lists: DataFrame, k: int, link: tuple[int, int]) -> DataFrame:
    """Entries of the lists for which another entry of the list may reach the threshold, by size and ``most``.

    Each entry is held against the size classes of its list, of which there is a bounded
    number however long the list is. What is left out has no pair that ``sizes_fit``.
    """
    a, b = link
    size = F.floor(F.log("n") * CLASSES)
    classes = lists.groupBy("value", size.alias("size")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("most").alias("best"))
    other = (size != F.col("size")) | (F.col("c") > 1)
    alike = (F.col("n") * a <= F.col("high") * b) & (F.col("low") * a <= F.col("n") * b)
    overlap = (F.greatest("n", "high") > k) | (F.least("most", "best") * (a + b) >= (F.col("n") + F.col("low")) * a)
    return lists.alias("e").join(classes.alias("s"), (F.col("e.value") == F.col("s.value")) & other & alike & overlap, "left_semi")


def small(keys: DataFrame) -> DataFrame:
    """Rows of numbers, broadcast if there are few; else they are joined by shuffle."""
    return F.broadcast(keys) if keys.count() * len(keys.columns) <= BROADCAST_NODES else keys


def union_estimate(a: np.ndarray, b: np.ndarray, k: int, link: tuple[int, int]) -> bool:
    """Whether the ``k`` smallest of both sketches leave the threshold possible."""
    union = np.union1d(a, b)[:k]
    shared = len(np.intersect1d(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True))
    if len(union) < k:  # both sets are whole
        return shared * link[1] >= link[0] * len(union)
    return shared >= least_shared(k, link[0] / link[1])


def exact(a: np.ndarray, b: np.ndarray, k: int, link: tuple[int, int]) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * link[1] >= link[0] * (len(a) + len(b) - both)


def passing(pairs: DataFrame, hashes: DataFrame, test, k: int, link: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose hashes pass the test; ``hashes`` has (node, hashes)."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            (left, la), (right, lb) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("ha"), batch.column("hb")))
            yes = pa.array([test(left[la[i] : la[i + 1]], right[lb[i] : lb[i + 1]], k, link) for i in range(len(batch))], pa.bool_())
            yield batch.select(["a", "b"]).filter(yes)

    of_a = hashes.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    of_b = hashes.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    return of_b.join(small(pairs), "b").join(of_a, "a").select("a", "b", "ha", "hb").mapInArrow(trimmed(run), "a long, b long")


def components(edges: DataFrame, stored: Steps) -> DataFrame:
    """(node, comp) of every node with an edge (a, b); comp is the smallest node reached.

    Every root hooks onto its smallest neighbouring root and climbs up to eight hooks;
    edges follow their ends, so what is not at the top yet stays connected to it. The
    number of roots with edges at least halves each time. ``edges`` are read twice.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    labels = None
    while True:
        up = stored(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        near = F.broadcast if up.count() * 2 <= BROADCAST_NODES else (lambda df: df)
        for _ in range(3):
            onward = up.select(F.col("a").alias("to"), F.col("to").alias("next"))
            up = up.join(near(onward), "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        up = stored(up)
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("to").alias("comp"))
        else:
            labels = stored(onto(labels, up.select(F.col("a").alias("node"), F.col("to").alias("comp")), near))
        at_b = up.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = both.join(near(up), "a", "left").join(near(at_b), "b", "left").select(F.coalesce("to", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        both = stored(moved.filter("a <> b").distinct())
        if both.isEmpty():
            return labels


def onto(labels: DataFrame, moved: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Labels (node, comp) after their components got the labels ``moved``."""
    return labels.join(near(moved.select(F.col("node").alias("comp"), F.col("comp").alias("to"))), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))


def linked(lists: DataFrame, hashes: DataFrame, k: int, link: tuple[int, int], stored: Steps, rounds: int = 3) -> DataFrame:
    """(node, comp) of nodes with links, from inverted lists (value, node, n).

    Every list is first compared with a pivot, the node with the fewest values of its own.
    Then its largest component and its former pivots are done with: members of one
    component need no comparing, and pivots have met the whole list. Two members of
    different other components may still be alike, so they choose further pivots, and once
    what is left to compare is no more than a few times the lists (or after ``rounds``),
    all remaining pairs of different components are compared. Pairs of sizes that cannot
    reach the threshold are left out. Where there are more pairs than nodes, a short
    sketch of each sifts them before full sets are sent.
    """
    lists = stored(within_reach(lists, k, link).select("value", "node", "n", "most"))
    budget, nodes = 16 * lists.count(), hashes.count()
    sketch = hashes.withColumn("hashes", F.slice("hashes", 1, ESTIMATE))
    # a sample (more than k values) shares values that it does not keep, so then ``most`` is no bound
    most = F.when(F.greatest("na", "nb") > k, F.least("na", "nb")).otherwise(F.least("ma", "mb"))
    sizes_fit = (F.least("na", "nb") * link[1] >= F.greatest("na", "nb") * link[0]) & (most * (link[0] + link[1]) >= (F.col("na") + F.col("nb")) * link[0])
    done, labels, last = None, None, False
    for turn in range(rounds + 1):
        if labels is None:
            rest = placed = lists.withColumn("comp", F.col("node"))
        else:
            placed = stored(lists.join(small(labels), "node", "left").select("value", "node", "n", "most", F.coalesce("comp", "node").alias("comp")))
            # only one component of a list may go: members of two have not met each other
            sizes = placed.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("c"))
            largest = sizes.groupBy("value").agg(F.max(F.struct("c", "comp")).alias("l"), F.sum("c").alias("length")).filter("l.c < length")
            met = done.groupBy("value").agg(F.collect_list("node").alias("met"))
            of_list = largest.join(met, "value", "left").select("value", F.col("l.comp").alias("large"), "met", "length")
            left = placed.join(of_list, "value").filter("comp <> large and not coalesce(array_contains(met, node), false)")
            rest = stored(left.select("value", "node", "n", "most", "comp", "length"))
            work = rest.agg(F.sum("length")).first()[0] or 0
            if not work:
                break
            last = work <= budget or turn == rounds
        other = placed.select("value", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("comp").alias("cb"))
        if last:
            one = rest.select("value", F.col("node").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("comp").alias("ca"))
        else:
            central = F.struct((F.col("most") / F.col("n")).alias("share"), (-F.col("node")).alias("order"), "node", "n", "most", "comp")
            pivots = rest.groupBy("value").agg(F.max(central).alias("p"))
            pivots = stored(pivots.select("value", F.col("p.node").alias("pivot"), "p.n", "p.most", "p.comp"))
            met = pivots.select("value", F.col("pivot").alias("node"))
            done = met if done is None else done.union(met)
            one = pivots.select("value", F.col("pivot").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("comp").alias("ca"))
        pairs = one.join(other, "value").filter((F.col("ca") != F.col("cb")) & sizes_fit)
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if pairs.count() > nodes:
            pairs = stored(passing(pairs, sketch, union_estimate, ESTIMATE, link))
        found = stored(passing(pairs, hashes, exact, k, link))
        if labels is None:
            labels = components(found, stored)
        elif not found.isEmpty():  # links between components: only these move
            comp = small(labels)
            ends = found.join(comp.withColumnsRenamed({"node": "a", "comp": "ca"}), "a", "left").join(comp.withColumnsRenamed({"node": "b", "comp": "cb"}), "b", "left")
            moved = components(stored(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), stored)
            labels = stored(onto(labels, small(moved), lambda df: df).union(moved.join(labels, "node", "left_anti")))
        if last:
            break
    return labels


def near_duplicates(docs: DataFrame, k: int = SKETCH, link: tuple[int, int] = LINK, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    With columns to ``carry``, such as a key of rows that share a doc_id, these and
    component_row are added: a number that the rows of one component have in common
    (null without words).

    Texts without words (null, empty, white space) have empty sets and link with nothing.
    Rows with equal sets are linked whatever their doc_id. component_id is the smallest
    doc_id of the component (nulls last; null if it has none) and ``kept`` is
    doc_id = component_id, so repeated rows with the smallest doc_id are all kept and a
    row without doc_id is kept where no other is linked. A very long text is hashed in
    bounded stretches; its set is held by one task. Other columns are not read.
    """
    stored = Steps(docs.sparkSession)
    table = stored(sketches(docs, carry).withColumn("row", F.monotonically_increasing_id()))
    filled = table.filter("n_shingles > 0").select("row", "doc_id", "set_hash")
    classes = stored(filled.groupBy("set_hash").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")))
    first = table.select("row", "n_shingles", "scouts").join(classes.select(F.col("node").alias("row")), "row")
    near = stored(sifted(first, "scouts", SCOUTS, link))
    near = stored(sifted(table.select("row", "n_shingles", "sieve").join(small(near), "row"), "sieve", SIEVE, link))

    nodes = filled.join(small(near), "row").select(F.col("row").alias("node"), "doc_id", "set_hash")
    nodes = stored(nodes)
    texts = docs.select("doc_id", "text").alias("d").join(small(nodes.select("doc_id").distinct()).alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    hashes = stored(full_sets(texts).dropDuplicates(["set_hash"]).join(nodes.select("node", "set_hash"), "set_hash").select("node", "hashes"))
    lists = stored(listed(hashes, k, link))

    labels = linked(lists, hashes, k, link, stored)
    named = classes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least").alias("component"))
    of_class = named.join(least, "comp").select("set_hash", "component", F.col("comp").alias("component_row"))
    out = table.select("doc_id", *carry, "n_shingles", "set_hash").join(of_class, "set_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    more = [*carry, F.when(F.col("n_shingles") > 0, F.col("component_row")).alias("component_row")] if carry else []
    return stored.finish(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *more))
