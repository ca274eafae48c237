"""Token counts from flat token files: a separator scan without any index.

A token file is a run of little-endian 16-bit ids in which an end id closes each document. Files are
scanned in blocks, each a byte range that any task can read; a vectorised comparison finds the end ids.
A block knows the lengths of the documents that begin and end in it, how many tokens stand before its
first end id, and how many after its last. A prefix scan over a file's blocks then adds, to the first
document that ends in a block, the open tokens of the blocks before it, and numbers the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramwell.llm.store import work_path, written
from gramwell.llm.textbytes import column, sliced
from gramwell.llm.tokens import default_vocabulary, encoder

END_ID, WIDTH = 50_256, 2
FILE_BYTES, BLOCK_BYTES = 32 << 20, 1 << 20


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, folder: str, end_id: int = END_ID, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes token files into a folder that all executors share; returns the written list of documents.

    Rows: file, size (bytes of the file), ordinal (of the document in its file, from 0), id_column. A file
    is named by its task attempt, and only files in the list count: what a lost executor left is ignored.
    A null or empty text is an end id alone.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[id_column].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        e, end = encoder(vocabulary), int(end_id).to_bytes(WIDTH, "little")
        context, made = TaskContext.get(), 0
        ids: list[pa.Array] = []
        out, size, name = None, 0, ""

        def closed() -> pa.RecordBatch:
            out.close()
            own = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array([size] * len(own), pa.int64()), pa.array(range(len(own)), pa.int64()), own], ["file", "size", "ordinal", id_column])

        for whole in batches:
            for b in sliced(whole, "_text", 4 << 20):
                if out is None:
                    name = f"{folder}/tokens-{context.partitionId():06d}-{context.taskAttemptId()}-{made:05d}.bin"
                    out, size, ids, made = system.open_output_stream(f"{root}/{name.rpartition('/')[2]}"), 0, [], made + 1
                data = b"".join(x for text in column(b, "_text").to_pylist() for x in (e.encode(text), end))
                out.write(data)
                size += len(data)
                ids.append(b.column(b.schema.get_field_index("_id")))
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return written(texts.mapInArrow(write, f"file string, size long, ordinal long, {id_column} {kind}"), "files")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, size of a folder's files, as Spark's file source lists them."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"))


def scan_token_files(files: DataFrame, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """files: file, size. One row per document: file, ordinal, n_tokens (less the end id), closed.

    Tokens after a file's last end id are a document that is not closed; an empty file has none. A file of
    an odd number of bytes raises ValueError. block_bytes must be even.
    """
    if block_bytes % WIDTH:
        raise ValueError("a block must hold whole ids")
    blocks = files.select("file", "size").distinct().where("size > 0")
    last = F.floor((F.col("size") - 1) / block_bytes)
    blocks = blocks.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.repartition(F.col("file"), F.floor(F.col("block") / 16))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, size, block in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("file", "size", "block")), strict=True):
                if size % WIDTH:
                    raise ValueError(f"{file} holds half an id")
                system, path = file_system(file)
                with system.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes), "<u2")
                ends = np.flatnonzero(ids == end_id)
                lengths = np.diff(np.concatenate([[-1], ends])) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                rows.append((file, block, len(ends), tail, lengths))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["file", "block", "n_ends", "tail", "lengths"])

    found = blocks.mapInArrow(scan, "file string, block long, n_ends long, tail long, lengths array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("ended", F.sum((F.col("n_ends") > 0).cast("long")).over(upto)).withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    # open tokens up to a block: its run of blocks since one that had an end
    opened = Window.partitionBy("file", "ended").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("open", F.sum("tail").over(opened))
    order = Window.partitionBy("file").orderBy("block")
    found = found.withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0))).withColumn("next", F.lead("block").over(order))
    ends = found.where("n_ends > 0").select("file", "first", "carry", F.posexplode("lengths").alias("k", "length"))
    closed = ends.select("file", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(F.lit(0))).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = found.where("next is null and open > 0").select("file", (F.col("first") + F.col("n_ends")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    listed = write_token_files(docs, work_path(spark, "tokens"))
    counted = scan_token_files(listed.select("file", "size"))
    # file sizes say little about these rows: never broadcast
    return listed.hint("merge").join(counted, ["file", "ordinal"], "left").select("doc_id", "n_tokens", "closed")
