"""Fuzzy line deduplication by MinHash.

Lines are compared in lower case without blanks around them. Equal lines are one item from the start. Every different line gets a MinHash
signature of its character shingles, stored only for lines that share a band with another; lines that agree in a band of it are candidates if enough of their signatures agrees. They are
confirmed by the exact Jaccard similarity of their shingle sets and joined by a distributed union-find. Lines that share a band but stay
apart are compared pair by pair inside tasks (``linking``). Of each component the first line, by doc_id and place, stays.

One of 14 bands of 5 coordinates is shared by a pair at the threshold of 0.8 with 99.6 %, at 0.9 with more than 1 - 10^-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.llm import minhash
from skybias.llm.linking import agreeing, fixed, least_share, leftover, link, recoded
from skybias.llm.registry import query
from skybias.llm.tables import placed, stored, table, text_of

SHINGLE_CHARS, THRESHOLD, BANDS, ROWS = 5, 0.8, 14, 5
FINER = [(8, 40), (12, 80)]  # coordinates in a run, runs
LINES_PER_BUCKET = 1 << 14


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, id, line) of lines that hold anything; ``id`` is the hash of the line as it is compared."""
    rows = docs.select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.lower(F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")))).where("line <> ''")
    return rows.withColumn("id", F.xxhash64("line"))


def _keyed(chars: int):
    """A key for each band; the signatures are not kept, as most lines need them never again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, value, offsets in minhash.char_shingles(batch.column("line"), chars):
                keys = minhash.run_keys(minhash.shortened(minhash.signatures(value, offsets, BANDS * ROWS)), ROWS)
                yield pa.record_batch([batch.column("id").slice(a, b - a), fixed(keys)], ["id", "keys"])

    return run


def _signed(chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, value, offsets in minhash.char_shingles(batch.column("line"), chars):
                size = np.diff(minhash.distinct_shingles(value, offsets)[1])
                short = minhash.shortened(minhash.signatures(value, offsets, BANDS * ROWS))
                part = batch.slice(a, b - a)
                yield pa.record_batch([*part.columns, pa.array(size.astype(np.int64)), fixed(short)], [*part.schema.names, "size", "signature"])

    return run


def _confirmed(chars: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sides = []
                for c in ("ta", "tb"):
                    value, size = [], []
                    for _, _, v, offsets in minhash.char_shingles(part.column(c), chars):
                        v, offsets = minhash.distinct_shingles(v, offsets)
                        value.append(v)
                        size.append(np.diff(offsets))
                    sides.append((np.concatenate(value), np.concatenate([[0], np.cumsum(np.concatenate(size))])))
                x, y, both = minhash.overlaps(*sides)
                keep = pa.array(both >= threshold * (x + y - both))
                yield pa.record_batch([part.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _brief(chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, value, offsets in minhash.char_shingles(batch.column("line"), chars):
                yield pa.record_batch([batch.column("id").slice(a, b - a), pa.array(minhash.brief(*minhash.distinct_shingles(value, offsets)), pa.binary())], ["id", "shingles"])

    return run


def kept_lines(docs: DataFrame, chars: int = SHINGLE_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, lines): the lines that stay, as structs of line_no and the hash of the line."""
    # every different line once, with its first place
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "line")).alias("f")
    lines = _lines(docs).groupBy("id").agg(first).select("id", "f.*")
    items = placed(lines, "lines", "id")
    width, n = BANDS * ROWS, items.count()

    share, alike = least_share(threshold, width), items

    def meeting(ids: DataFrame) -> None:
        """Lines that share no band with another take no part in what follows: the others are stored for it, with size and signature."""
        nonlocal alike
        met = items.select("id", "line").join(ids, "id", "left_semi")
        alike = placed(met.mapInArrow(_signed(chars), "id long, line string, size long, signature binary"), "alike", "id")

    def confirm(pairs: DataFrame) -> DataFrame:
        for side in "ba":
            pairs = pairs.join(alike.select(F.col("id").alias(side), F.col("line").alias(f"t{side}")), side)
        return pairs.mapInArrow(_confirmed(chars, threshold), "a long, b long")

    def verify(pairs: DataFrame) -> DataFrame:
        return confirm(agreeing(pairs, alike, width, share))

    def finer(ids: DataFrame, level: int) -> DataFrame | None:
        return recoded(alike.join(ids, "id", "left_semi"), width, *FINER[level - 1], level) if level <= len(FINER) else None

    def rest(apart: DataFrame, nearest: bool) -> DataFrame:
        sets = None
        if not nearest:
            wanted = alike.select("id", "line").join(apart.select("id").distinct(), "id", "left_semi")
            sets = stored(wanted.mapInArrow(_brief(chars), "id long, shingles binary"), "shingles")
        return leftover(apart, alike, width, share, threshold, rows=ROWS, nearest=nearest, sets=sets)

    keys = items.select("id", "line").mapInArrow(_keyed(chars), "id long, keys binary")
    _, label = link(keys, verify, finer, max(1, -(-n // LINES_PER_BUCKET)), rest, confirm, meeting)
    # of every component all but the first place goes
    linked = stored(items.select("id", "last", "doc_id", "line_no").join(label, "id"), "linked")
    best = linked.groupBy("component").agg(F.min(F.struct("last", "doc_id", "line_no", "id")).alias("f"))
    gone = stored(linked.select("id", "component").join(best, "component").where("id <> f.id").select("id"), "gone")
    return items.select("id", "doc_id", "line_no").join(gone, "id", "left_anti").groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "id")).alias("lines"))


def dedup_lines(docs: DataFrame, chars: int = SHINGLE_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the lines that stay in ``text``, and n_lines, n_kept (lines that hold anything, before and after).

    Lines of blanks are no lines here: they stay where they are and don't count. A null text stays null and has none. Repeated rows (same
    doc_id and text) lose or keep the same lines; rows without a doc_id come last and are one document in that sense. Other columns
    stay, but those named n_lines or n_kept are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_kept")]
    kept = kept_lines(docs, chars, threshold).withColumnRenamed("doc_id", "kept_doc")
    # the text moves once, not in the row too
    others = [c for c in names if c not in ("doc_id", "text")]
    rows = docs.select(F.struct(*others).alias("row"), "doc_id", "text")
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_doc")), "left")
    # every line, its number and how it is compared; then those that stay
    rows = rows.withColumn("all", F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(
        x.alias("x"), i.alias("i"), F.lower(F.trim(x, F.lit(" \t\r\x0b\x0c"))).alias("c"))))
    held = F.coalesce(F.col("lines"), F.array().cast("array<struct<line_no:int,id:bigint>>"))
    rows = rows.withColumn("stay", F.filter("all", lambda s: (s["c"] == "") | F.array_contains(held, F.struct(s["i"].alias("line_no"), F.xxhash64(s["c"]).alias("id")))))

    def count(lines: str):
        return F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(lines, lambda s: s["c"] != ""))).cast("long")

    rows = rows.select("row", "doc_id", F.array_join(F.transform("stay", lambda s: s["x"]), "\n").alias("text"), count("all").alias("n_lines"), count("stay").alias("n_kept"))
    return rows.select(*(F.col(f"row.`{c}`") if c in others else F.col(c) for c in names), "n_lines", "n_kept")


def without_emptied(deduped: DataFrame) -> DataFrame:
    """Drop the documents that lost all their lines; those that never had any stay."""
    return deduped.where("NOT (n_lines > 0 AND n_kept = 0)").drop("n_lines", "n_kept")


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_kept", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
