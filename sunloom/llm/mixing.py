"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the wanted words by its weight. A source whose share
exceeds ``max_epochs`` times its own words is clamped there, and what it cannot take
is shared again by weight among the others until no share is too large. A source is
then taken as often in whole as fits, and the rest by documents in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.llm.ordinals import bucket_count, with_ordinals
from sunloom.llm.words import WORD, stored


def word_count(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: Column | float, max_epochs: int) -> DataFrame:
    """Add ``target`` (double) to rows of (source, source_size long, weight).

    One row is one source. Each round clamps every open source whose share is above
    its limit; it ends when none is, after as many rounds as there are sources at most.
    Only the sums of a round come to the driver. If all limits together are below the
    total, every source gets its limit. Sources without words or weight get 0.
    """
    rows = stored(sources.withColumn("_limit", (F.col("source_size") * max_epochs).cast("double")))
    wanted = total if isinstance(total, (int, float)) else float(rows.agg(total.cast("double")).first()[0] or 0.0)
    clamped = F.lit(False)
    while True:
        sums = rows.agg(
            F.sum(F.when(clamped, F.col("_limit")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(clamped, 1)).alias("n"),
        ).first()
        if not sums["open"]:
            return rows.withColumn("target", F.when(clamped, F.col("_limit")).otherwise(0.0)).drop("_limit")
        free = wanted - sums["taken"]
        over = clamped | (F.lit(free) * F.col("weight") > F.col("_limit") * F.lit(sums["open"]))
        if rows.agg(F.count(F.when(over, 1))).first()[0] == sums["n"]:
            break
        clamped = over
    share = F.when(clamped, F.col("_limit")).otherwise(F.lit(free) * F.col("weight") / F.lit(sums["open"]))
    return rows.withColumn("target", share.cast("double")).drop("_limit")


def mix(docs: DataFrame, size: str, source: str, targets: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Add ``epochs`` (how often a document is taken), ``source_size`` and ``target``.

    ``targets`` has (source, source_size, target). All documents are taken
    ``floor(target / source_size)`` times; one time more those that come first by
    ``key`` (a hash of seed and document, a 60-bit number) until the rest of the target
    is reached. The document that crosses the target counts if its middle lies before
    it, so a source misses its target by half of one document at most. Documents
    without words are taken with the whole repetitions and cost nothing.
    """
    t = targets.select(F.col("source").alias("_src"), "source_size", "target")
    rows = docs.join(t, F.col(source).eqNullSafe(F.col("_src")), "left").drop("_src").withColumn("_key", key)
    rows = rows.withColumn("_whole", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    n = bucket_count(docs.count())
    numbered = with_ordinals(rows, [source], F.floor(F.col("_key") / F.lit((1 << 60) // n)), [F.col("_key"), *order], "_at", [size])
    rest = F.coalesce(F.col("target"), F.lit(0.0)) - F.col("_whole") * F.col("source_size")
    more = F.col(f"before_{size}") * 2 + F.col(size) < 2 * rest
    return numbered.withColumn("epochs", F.col("_whole") + F.when((F.col(size) > 0) & more, 1).otherwise(0)).drop("_key", "_whole", "_at", f"before_{size}")


def seeded_key(seed: int, doc_id: Column) -> Column:
    """60 bits of an MD5, which any engine can compute."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_weights(sizes: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Weights by the place of the source name in code point order, null last, repeating."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")))


def mix_documents(
    docs: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 17, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, epochs, taken, and the columns ``carry``.

    Null text has size 0; a null source is a source of its own. Repeated doc_ids share
    their hash in the order and are told apart by their size and by ``carry``, so each row
    has a place of its own. A very long text counts by its words alone. An empty table gives
    no rows. Columns but those of ``carry`` are not read, so none can clash.
    """
    slim = stored(docs.select("doc_id", "source", word_count("text").alias("size"), *carry))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = F.sum("source_size") * F.lit(share)
    targets = water_fill(source_weights(sizes, cycle), total, max_epochs)
    order = [F.col("doc_id"), F.col("size"), *(F.col(c) for c in carry)]
    mixed = mix(slim, "size", "source", F.broadcast(targets), seeded_key(seed, F.col("doc_id")), order)
    return mixed.withColumn("taken", F.col("epochs") * F.col("size"))
