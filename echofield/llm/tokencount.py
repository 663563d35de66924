"""Token counts from flat token files by a separator scan.

The files are little-endian 16-bit ids and nothing else: no index, no lengths. A document ends at its end id. Blocks of a
file are searched on their own, by vector comparison; a prefix scan over the blocks' summaries (tokens, ends, place of the
last end) then tells each block how many documents and which open document come before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import by_text, cut, shared_folder
from .packing import batch_of, token_ids, word_ids

#: The id that ends each document; the tokenizer never makes it from text.
END = 49407
#: Tokens of a file that a writer fills before it opens the next, and of a block.
FILE_TOKENS, BLOCK_TOKENS = 1 << 20, 1 << 16


def write_tokens(documents: DataFrame, folder: str, tokenizer_path: str, end: int = END) -> DataFrame:
    """Writes the documents as token files into a shared folder, and returns which document is where: file, nth, doc_id.

    Files are named by partition and attempt, and only those that the returned rows name belong to the result, so a task
    that ran twice does no harm. Null and empty texts are documents without tokens. Memory: one file's ids.
    """
    schema = pa.schema([("file", pa.string()), ("nth", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        words, task = word_ids(tokenizer_path, special_as_text=True), TaskContext.get()
        stop, number, held, ids = np.array([end], dtype="<u2"), 0, [], []

        def close() -> pa.RecordBatch:
            name = f"{task.partitionId()}-{task.taskAttemptId()}-{number}"
            with store.open_output_stream(f"{path}/{name}") as out:
                for x in ids:
                    out.write(x.tobytes())
            return batch_of([[name] * len(held), range(len(held)), held], schema)

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(doc_id)
                ids += [token_ids(text.as_py(), words).astype("<u2"), stop]
                size += len(ids[-2]) + 1
                if size >= FILE_TOKENS:
                    yield close()
                    size, number, held, ids = 0, number + 1, [], []
        if held:
            yield close()
        words.clear()  # the worker goes on to other tasks, of other operators

    return by_text(documents).select("doc_id", "text").mapInArrow(run, "file string, nth long, doc_id long")


def blocks(files: DataFrame, size: int = BLOCK_TOKENS, end: int = END) -> DataFrame:
    """(file, block, n, ends) from (file, content): the tokens of each block and the places of end ids in it."""

    def run(content: pa.Array) -> pa.Array:
        out = []
        for x in content:
            ids = np.frombuffer(x.as_buffer(), dtype="<u2") if x.is_valid else np.empty(0, "<u2")
            at = np.flatnonzero(ids == end)
            cuts = range(0, max(1, len(ids)), size)
            edges = np.searchsorted(at, [*cuts, len(ids)])
            out.append([{"block": i, "n": min(size, len(ids) - a), "ends": (at[edges[i] : edges[i + 1]] - a).astype(np.int32)} for i, a in enumerate(cuts)])
        return pa.array(out, pa.list_(pa.struct([("block", pa.int32()), ("n", pa.int32()), ("ends", pa.list_(pa.int32()))])))

    return files.select("file", F.explode(arrow_udf(run, "array<struct<block int, n int, ends array<int>>>")("content")).alias("b")).select("file", "b.*")


def documents_of(scanned: DataFrame) -> DataFrame:
    """(file, nth, start, n_tokens, ended) for each document of the blocks, its end id not counted; ids after a file's last
    end id are a document that has not ended. Blocks of a file are numbered from 0; an empty file has no documents."""
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file")
    base = scanned.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "seen": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)), "total": F.sum("n").over(whole)})
    after = F.col("base") + F.element_at("ends", -1) + 1
    placed = base.withColumn("last", F.when(F.size("ends") > 0, after)).withColumns({"open": F.coalesce(F.max("last").over(before), F.lit(0)), "final": F.coalesce(F.max("last").over(whole), F.lit(0)), "all": F.sum(F.size("ends")).over(whole)})
    each = placed.select("file", "base", "seen", "open", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.col("ends")[F.col("i") - 1] + 1)
    ended = each.select("file", (F.col("seen") + F.col("i")).alias("nth"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = placed.where("block = 0 AND total > final").select("file", F.col("all").alias("nth"), F.col("final").alias("start"), (F.col("total") - F.col("final")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(rest)


def scan(spark, folder: str, end: int = END) -> DataFrame:
    """The documents of all token files in a folder."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return documents_of(blocks(files, end=end))


def token_counts(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and n_tokens of each document, by way of token files in the shared folder, which are removed in the end.

    Null and empty texts have no tokens. Repeated rows and rows without an id are counted like any other. An empty table
    gives an empty result. Only doc_id and text are read.
    """
    spark = documents.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(hadoop)
    try:
        where = cut(write_tokens(documents, store.makeQualified(hadoop).toString(), tokenizer_path))
        if not where.head(1):
            return spark.createDataFrame([], "doc_id long, n_tokens long")
        return cut(where.join(scan(spark, folder).where("ended"), ["file", "nth"]).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")))
    finally:
        store.delete(hadoop, True)
