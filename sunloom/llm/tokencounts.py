"""Token counts of documents by scanning flat, unindexed token files for separators.

A token file holds nothing but 16-bit token ids, one document after the other, each ended
by the end-of-document id. The scan cuts files into blocks wherever they fall, searches a
block for the id at once, and returns one row per block: how many documents end in it, the
tokens before the first end and after the last. A prefix scan over these rows gives every
block the number of its first document and the tokens that document has from the blocks
before, whatever number of blocks it spans. Nothing but block summaries is moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunloom.llm.words import batches, remove, stored, tokens, trimmed
from sunloom.session import ensure_checkpoint_dir

ID_BYTES = 2


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI, or of a plain path on a shared disk."""
    return pyarrow.fs.FileSystem.from_uri(uri) if ":" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end: int) -> DataFrame:
    """Write all texts as token files; returns the order table (file, nth, doc_id), stored.

    One file per partition, named anew in every attempt; only files of attempts that
    succeeded are in the table, and whoever reads goes by the table. A null text is an
    empty one. Marks of special tokens inside texts are plain text, so that ``end`` stands
    for ends alone.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens(vocabulary, plain_specials=True)
        files, path = opened(folder)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.tokens"
        nth, out = 0, None
        for batch in batches(source):
            ids, _ = model.encode(batch.column("text"), end)
            if out is None:
                out = files.open_output_stream(f"{path}/{name}")
            out.write(ids.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch)), pa.array(np.arange(nth, nth + len(batch))), batch.column("doc_id")], names=["file", "nth", "doc_id"])
            nth += len(batch)
        if out is not None:
            out.close()

    return stored(docs.select("doc_id", "text").mapInArrow(trimmed(run), "file string, nth long, doc_id long"))


def blocks(spark: SparkSession, folder: str, files: DataFrame, block_tokens: int) -> DataFrame:
    """(file, block, at) of all blocks of the named files; ``at`` counts tokens."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for batch in source:
            for name in batch.column("file").to_pylist():
                size = system.get_file_info(f"{path}/{name}").size // ID_BYTES
                at = np.arange(0, size, block_tokens)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.arange(len(at))), pa.array(at)], names=["file", "block", "at"])

    return files.select("file").mapInArrow(trimmed(run), "file string, block long, at long")


def separator_scan(spark: SparkSession, folder: str, files: DataFrame, end: int, block_tokens: int = 1 << 20) -> DataFrame:
    """(file, nth, start, n_tokens) of every document in the files, its end not counted.

    Tokens after the last end of a file are a document that was cut off, and are returned
    with ``n_tokens`` so far and ``complete`` false. Blocks are read twice: for their
    summaries, and for the documents that end in them.
    """
    def ends_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        system, path = opened(folder)
        for i, (name, at) in enumerate(zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True)):
            with system.open_input_file(f"{path}/{name}") as f:
                ids = np.frombuffer(f.read_at(block_tokens * ID_BYTES, at * ID_BYTES), "<u2")
            yield i, len(ids), np.flatnonzero(ids == end)

    def summary(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n, tail = [], []
            for _, size, at in ends_of(batch):
                n.append(len(at))
                tail.append(size - int(at[-1]) - 1 if len(at) else size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(tail, pa.int64())], names=[*batch.schema.names, "ends", "tail"])

    def documents(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            nth, carried = batch.column("first_nth").to_pylist(), batch.column("carried").to_pylist()
            last = batch.column("last").to_pylist()
            for i, size, at in ends_of(batch):
                base = batch.column("at")[i].as_py()
                begin = np.concatenate([[-carried[i]], at + 1])  # of each document, and of what follows the last
                stop = np.append(at, size)
                n = len(at) + bool(last[i] and begin[-1] < size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("file")[i].as_py()] * n, pa.string()), pa.array(nth[i] + np.arange(n)), pa.array(base + begin[:n]), pa.array((stop - begin)[:n]), pa.array(np.arange(n) < len(at))],
                    names=["file", "nth", "start", "n_tokens", "complete"],
                )

    schema = "file string, block long, at long"
    listed = blocks(spark, folder, files, block_tokens)
    spread = listed.repartition("file", "block")
    found = stored(spread.mapInArrow(trimmed(summary), f"{schema}, ends long, tail long"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # tails add up from the last block that has an end; its own tail is the first of them
    run_of = F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block"))
    carried = F.coalesce(F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block")) - F.col("tail"), F.lit(0))
    runs = found.withColumn("run", run_of).withColumn("until", carried + F.col("tail"))
    scanned = runs.select(
        "file", "block", "at", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first_nth"),
        F.coalesce(F.lag("until").over(Window.partitionBy("file").orderBy("block")), F.lit(0)).alias("carried"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("last"),
    )
    return scanned.repartition("file", "block").mapInArrow(trimmed(documents), "file string, nth long, start long, n_tokens long, complete boolean")


def count_tokens(docs: DataFrame, vocabulary: str, end: int, block_tokens: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, file, start of every row, from token files written and scanned.

    The files lie in a new folder under the shared checkpoint folder, and are removed when
    they have been counted. Null and empty
    texts have 0 tokens; repeated rows are counted one by one.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    order = write_token_files(docs, folder, vocabulary, end)
    found = separator_scan(spark, folder, order.select("file").distinct(), end, block_tokens)
    # Spark takes the scan's output to be as small as its list of blocks, and would broadcast it
    counts = stored(order.join(found.hint("merge"), ["file", "nth"]).select("doc_id", "n_tokens", "file", "start"))
    remove(spark, folder)
    return counts
