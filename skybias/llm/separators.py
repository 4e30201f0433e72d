"""Token counts of documents in flat token files: a search for end-of-document ids.

A flat token file is a run of little-endian 16-bit ids without an index; documents end with a separator id. Files are read as
blocks of fixed size. Each block is searched on its own, as one vectorised comparison, and stitched to its neighbours by two
numbers: how many tokens follow its last separator and how many separators it has. An exclusive prefix sum over a file's blocks
gives the document number and start that a block begins with. The sum runs over groups of blocks first and over the groups' totals
then, so no task holds a whole file's blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skybias.llm.registry import query
from skybias.llm.tables import stored, table
from skybias.llm.tokens import default_path, encoder

#: One past the tokenizer's vocabulary: its own end-of-text id comes out of texts that spell the end-of-text mark.
SEPARATOR = 49408
BLOCK_TOKENS, GROUP_BLOCKS = 1 << 16, 1 << 10
#: Blocks that are read in one go (8 MB), and tasks that read one set of files.
RUN_BLOCKS, MOST_TASKS = 1 << 6, 1 << 13
#: Schemes of Spark's paths that pyarrow calls otherwise.
STORES = {"s3a": "s3", "s3n": "s3"}
BLOCKS = "file long, block long, data binary"


def write_blocks(docs: DataFrame, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The ids of ``docs`` (column text), each text followed by the separator, as the blocks of one flat file per task."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size, block, file = encoder(path), [], 0, 0, TaskContext.get().partitionId()

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, block
            flat = np.concatenate(held) if held else np.zeros(0, "<u2")
            end = len(flat) if last else len(flat) // block_tokens * block_tokens
            for at in range(0, end, block_tokens):
                yield pa.record_batch([pa.array([file]), pa.array([block]), pa.array([flat[at:min(at + block_tokens, end)].tobytes()], pa.binary())],
                                      ["file", "block", "data"])
                block += 1
            held, size = [flat[end:]], len(flat) - end

        for batch in batches:
            for _, _, ids, first in coder.encode(batch.column("text")):
                flat = np.insert(ids, first[1:], SEPARATOR)
                if ids.max(initial=0) >= SEPARATOR:
                    raise ValueError(f"ids below the separator {SEPARATOR} are asked for; the tokenizer's vocabulary is larger")
                held.append(flat.astype("<u2"))
                size += len(flat)
                if size >= 8 * block_tokens:
                    yield from cut(False)
        yield from cut(True)

    return docs.select("text").mapInArrow(run, BLOCKS)


def open_file(path: str) -> BinaryIO:
    """A file of any store that pyarrow knows (mounted, hdfs, viewfs, s3, gs, abfs), opened in a worker; only what is read is fetched."""
    scheme, rest = re.match("([^:/]+):/*(.*)", path, re.DOTALL).groups()
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file(f"/{rest}")
    store, inside = fs.FileSystem.from_uri(f"{STORES.get(scheme, scheme)}://{quote(rest, safe='/:@')}")
    return store.open_input_file(inside)


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, opener: Callable[[str], BinaryIO] = open_file,
                     run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """Blocks of raw token files (16-bit ids) of any size: runs of blocks are dealt to tasks, which seek and read only these.

    ``opener`` opens a path as Spark lists it, in a worker, for stores that need more than ``open_file`` (credentials, other schemes). An
    empty file gives no block. A file that is shorter when it is read than when it was listed is an error.
    """
    step = 2 * block_tokens

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opener(r["path"]) as f:
                    f.seek(r["first"] * step)
                    for k in range(r["first"], min(r["first"] + run_blocks, -(-r["length"] // step))):
                        want = min(step, r["length"] - k * step)
                        data = bytearray()
                        while len(data) < want and (more := f.read(want - len(data))):
                            data += more
                        if len(data) < want:
                            raise EOFError(f"{r['path']} ends before its listed length of {r['length']} bytes")
                        yield pa.record_batch([pa.array([r["file"]]), pa.array([k]), pa.array([bytes(data)], pa.binary())], ["file", "block", "data"])

    files = spark.read.format("binaryFile").load(path).withColumn("file", F.xxhash64("path"))
    # without the content, a file is only listed
    listed = files.select("file", "path", "length")
    runs = listed.where("length > 0").withColumn("first", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / step), F.lit(run_blocks))))
    count = listed.agg(F.sum(F.ceil(F.col("length") / (step * run_blocks)))).first()[0] or 0
    return runs.repartition(min(max(count, 1), MOST_TASKS)).mapInArrow(seek, BLOCKS)


def search(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """One row per block: tokens, separators, tokens after the last one, and the places of the separators."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, count, tail, places = [], [], [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", "<u2")
                at = np.flatnonzero(ids == separator)
                size.append(len(ids))
                count.append(len(at))
                tail.append(len(ids) - (at[-1] + 1 if len(at) else 0))
                places.append(at.astype(np.int32))
            yield pa.record_batch([batch.column("file"), batch.column("block"), *(pa.array(x, pa.int64()) for x in (size, count, tail)),
                                   pa.array(places, pa.list_(pa.int32()))], ["file", "block", "size", "count", "tail", "places"])

    return blocks.select("file", "block", "data").mapInArrow(run, "file long, block long, size long, count long, tail long, places array<int>")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Documents in the files' order: file, document (from 0), start and n_tokens (with the separator).

    Tokens behind a file's last separator make a last document that is ``open``. Two separators in a row enclose an empty document of
    one token. A null or empty block has no tokens; blocks without any row give no document. The number of a block must be unique
    in its file, and neither may be null.
    """
    found = stored(search(blocks, separator), "separators").withColumn("part", F.floor(F.col("block") / group_blocks))
    inside = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # the end of the last separator, counted from the start of the group or file
    ended = F.when(F.col("count") > 0, F.col("before") + F.col("size") - F.col("tail"))
    one = (found.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
           .withColumn("documents", F.coalesce(F.sum("count").over(inside), F.lit(0))).withColumn("since", F.max(ended).over(inside)))
    groups = (one.groupBy("file", "part").agg(F.sum("size").alias("size"), F.sum("count").alias("count"), F.max(ended).alias("ended"))
              .withColumn("g_before", F.coalesce(F.sum("size").over(across), F.lit(0)))
              .withColumn("g_documents", F.coalesce(F.sum("count").over(across), F.lit(0)))
              .withColumn("g_since", F.coalesce(F.max(F.col("g_before") + F.col("ended")).over(across), F.lit(0)))
              .select("file", "part", "g_before", "g_documents", "g_since"))
    stitched = one.join(groups, ["file", "part"]).select(
        "file", "places", (F.col("g_documents") + F.col("documents")).alias("documents"), (F.col("g_before") + F.col("before")).alias("before"),
        F.coalesce(F.col("g_before") + F.col("since"), F.col("g_since")).alias("since"))
    closed = stitched.select("file", "documents", "since", "before", "places", F.posexplode("places").alias("k", "at")).select(
        "file", (F.col("documents") + F.col("k")).alias("document"),
        F.when(F.col("k") == 0, F.col("since")).otherwise(F.col("before") + F.expr("get(places, k - 1)") + 1).alias("start"),
        (F.col("before") + F.col("at") + 1).alias("end"), F.lit(False).alias("open"))
    last = (found.withColumn("documents", F.col("count")).groupBy("file")
            .agg(F.sum("count").alias("document"), F.sum("size").alias("end"),
                 F.max(F.struct(F.when(F.col("count") > 0, F.col("block")).otherwise(-1).alias("block"), "tail")).alias("last"))
            .join(found.select("file", F.col("block").alias("b"), F.col("size").alias("s")), "file")
            .groupBy("file", "document", "end", "last").agg(F.sum(F.when(F.col("b") > F.col("last.block"), F.col("s")).otherwise(0)).alias("beyond"))
            .select("file", "document", (F.col("end") - F.col("beyond") - F.when(F.col("last.block") >= 0, F.col("last.tail")).otherwise(0)).alias("start"),
                    "end", F.lit(True).alias("open")).where("start < end"))
    return closed.unionByName(last).select("file", "document", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "open")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(stored(write_blocks(table(spark, sf_dir, "documents")), "tokens"))
