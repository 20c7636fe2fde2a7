"""A corpus from filter to packed sequences: five stages, each an operator of ``sunloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the ``docs`` of the next. All but the last return the columns
of ``documents``; the last returns the places of the pieces of all documents it got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm import linededup, mixing, neardup, packing, toxicity
from sunloom.llm.queries import documents, labels, vocabulary
from sunloom.llm.words import Steps, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: columns that stages add inside
KEY, COPIES = ("_pipeline_file", "_pipeline_row"), "_pipeline_copies"

#: a document stays if its expected severity is below this
SEVERITY = 0.5


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with their place in the files they are read from, which tells repeated rows apart.

    The places are the same in every reading of a Parquet table, which a stage is given.
    """
    return docs.withColumns({KEY[0]: F.col("_metadata.file_path"), KEY[1]: F.col("_metadata.row_index")})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents among ``docs``, score all, drop the toxic ones.

    Row by row: null, empty and repeated rows are judged by their own text, and a text
    without words stays. Without labels, or with labels of one kind, all stay.
    """
    scored = toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)), SEVERITY)
    return scored.filter("kept").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of passages; a document that held nothing else goes.

    The order is by doc_id, null last. Null and empty texts have nothing to lose and stay;
    a repeated row (equal doc_id and text) loses nothing to itself.
    """
    cleaned = linededup.dedup_lines(docs)
    left = cleaned.filter((F.col("removed_words") == 0) | (F.col("text") != ""))
    return with_length(left.select(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, of the smallest doc_id, null last.

    Rows are told apart by a key of their own, so of repeated rows one stays, and rows
    that share a doc_id, or have none, are judged each by its text. Texts without words
    are like nothing and stay.
    """
    rows = keyed(docs)
    marked = neardup.near_duplicates(rows, carry=KEY)
    first = F.min_by(F.struct(*KEY), F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("k")
    # what has no component is a row of its own
    whole = F.col("n_shingles") > 0
    group = F.when(whole, F.lit("")).otherwise(F.col(KEY[0])), F.when(whole, F.col("component_row")).otherwise(F.col(KEY[1]))
    kept = stored(marked.groupBy(group[0].alias("_file"), group[1].alias("_row")).agg(first).select(*(F.col(f"k.{c}").alias(c) for c in KEY)))
    return rows.join(kept, list(KEY), "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents until every source has its target; repeats are rows.

    Each row has epochs of its own, also where rows share a doc_id or have none. Rows
    without words cost nothing and are taken with the whole repetitions of their source.
    """
    rows = keyed(docs)
    taken = stored(mixing.mix_documents(rows, carry=KEY).filter("epochs > 0").select(*KEY, F.col("epochs").cast("int").alias(COPIES)))
    chosen = rows.join(taken, list(KEY)).withColumn(COPIES, F.explode(F.sequence(F.lit(1), F.col(COPIES))))
    return chosen.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of at most 4096 tokens.

    A null or empty text is the end token alone; repeated rows are packed as often as they
    stand; an empty table gives no rows.
    """
    return packing.pack_documents(docs, vocabulary())


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: no stage but the fourth can be written in SQL; the tests hold run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result does not depend on the steps any more."""
    steps, docs = Steps(spark), documents(spark, sf_dir)
    try:
        for _, stage in STAGES[:-1]:
            docs = steps(stage(spark, docs, sf_dir))
        return steps.finish(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        steps.close()
