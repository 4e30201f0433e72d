"""Near-duplicate documents by an inverted join over MinHash coordinates.

A document is posted under its signature's coordinate-value pairs. The prefix: a pair of documents that agrees in at least
``match`` of ``coordinates`` coordinates misses at most coordinates - match of them, so among that many runs plus one, one run agrees
throughout; postings under runs of ``rows`` coordinate-value pairs lose no such pair. The skip: documents with equal shingle sets are
posted once, postings whose documents are already in one component are skipped, and a posting pairs its documents with a leader
instead of with each other. Documents that stay apart under a posting, such as those with a common passage, are compared pair by pair
inside tasks, but for sizes too different for a link (``linking``); very large postings get longer runs first. Collisions are
counted over all coordinates, pairs above the match threshold, which follows from the wanted similarity, are kept, and each is
confirmed on the full shingle sets of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.llm import minhash, texts
from skybias.llm.linking import agreeing, coded, least_share, leftover, link, recoded
from skybias.llm.registry import query
from skybias.llm.tables import placed, stored, table, text_of

COORDINATES, ROWS = 126, 3
FINER = [(6, 42), (10, 84)]  # coordinates in a run, runs
DOCS_PER_BUCKET = 4096


def _signed(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, value, offsets in minhash.word_sets(batch.column("text"), shingle_words):
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                set_hash, sign = ([None] * (b - a) for _ in range(2))
                if len(full):
                    at = offsets[:-1][full]
                    one, two = np.add.reduceat(value, at), np.add.reduceat(texts.mix(value), at)
                    signature = minhash.signatures((value >> np.uint64(32)).astype(np.uint32), np.append(at, len(value)), COORDINATES)
                    short = minhash.shortened(signature)
                    for k, i in enumerate(full):
                        set_hash[i] = one[k].tobytes() + two[k].tobytes() + int(size[i]).to_bytes(8, "little")
                        sign[i] = short[k].tobytes()
                yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "text_hash")), pa.array(size.astype(np.int64)), *(pa.array(x, pa.binary()) for x in (set_hash, sign))],
                                      ["doc_id", "text_hash", "n_shingles", "set_hash", "signature"])

    return run


def _confirmed(shingle_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = []
                for c in ("ta", "tb"):
                    value, size = [], []
                    for _, _, v, offsets in minhash.word_sets(part.column(c), shingle_words):
                        value.append(v)
                        size.append(np.diff(offsets))
                    sides.append((np.concatenate(value), np.concatenate([[0], np.cumsum(np.concatenate(size))])))
                x, y, both = minhash.overlaps(*sides)
                keep = pa.array(100 * both >= percent * (x + y - both))
                yield pa.record_batch([part.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _brief(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, value, offsets in minhash.word_sets(batch.column("text"), shingle_words):
                yield pa.record_batch([batch.column("id").slice(a, b - a), pa.array(minhash.brief(value, offsets), pa.binary())], ["id", "shingles"])

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked where their sets of distinct shingles have a Jaccard similarity of at least ``percent`` %; component_id is the
    smallest doc_id that links reach. Null, empty and wordless texts have no shingles and no links. Documents with fewer words than a
    shingle are one shingle. Rows with the same doc_id but different sets are documents of their own, each with its own links; a row
    without doc_id takes no part: its component_id is null and it is kept.
    """
    docs = docs.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = docs.mapInArrow(_signed(shingle_words), "doc_id long, text_hash long, n_shingles long, set_hash binary, signature binary")
    # equal sets are one item, named by their hash; its first text stands for it
    signed = stored(signed.withColumn("id", F.when(F.col("doc_id").isNotNull(), F.xxhash64("set_hash"))).withColumn(
        "id", F.when(F.col("n_shingles") > 0, F.col("id"))), "signatures")
    first = F.min(F.struct("doc_id", "text_hash", F.col("n_shingles").alias("size"), "signature")).alias("s")
    items = placed(signed.where("id IS NOT NULL").groupBy("id").agg(first).select("id", "s.*"), "sets", "id")
    n = items.count()

    @cache
    def different() -> DataFrame:
        """(text_hash, text), every different text once: it is moved here, and only pairs are after that."""
        return placed(docs.where("doc_id IS NOT NULL").groupBy("text_hash").agg(F.min("text").alias("text")), "texts", "text_hash")

    share = least_share(percent / 100, COORDINATES)

    def verify(pairs: DataFrame) -> DataFrame:
        return confirm(agreeing(pairs, items, COORDINATES, share))

    def confirm(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        for side in "ba":
            pairs = pairs.join(items.select(F.col("id").alias(side), F.col("text_hash").alias(f"h{side}")), side)
        pairs = stored(pairs, "candidates")
        for side in "ba":
            pairs = pairs.join(different().select(F.col("text_hash").alias(f"h{side}"), F.col("text").alias(f"t{side}")), f"h{side}")
        return pairs.mapInArrow(_confirmed(shingle_words, percent), "a long, b long")

    def finer(ids: DataFrame, level: int) -> DataFrame | None:
        return recoded(items.join(ids, "id", "left_semi"), COORDINATES, *FINER[level - 1], level) if level <= len(FINER) else None

    def rest(apart: DataFrame, nearest: bool) -> DataFrame:
        sets = None
        if not nearest:
            wanted = stored(items.select("id", "text_hash").join(apart.select("id").distinct(), "id", "left_semi"), "wanted")
            sets = stored(wanted.join(different(), "text_hash").select("id", "text").mapInArrow(_brief(shingle_words), "id long, shingles binary"), "shingles")
        return leftover(apart, items, COORDINATES, share, percent / 100, rows=ROWS, nearest=nearest, sets=sets)

    _, label = link(coded(items, COORDINATES, ROWS), verify, finer, max(1, -(-n // DOCS_PER_BUCKET)), rest, confirm)
    # the smallest doc_id of all sets of a component names it
    classes = items.select("id", "doc_id").join(label, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    names = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = classes.select("id", "component").join(names, "component").select("id", "component_id")
    rows = signed.select("doc_id", "n_shingles", "id").join(classes, "id", "left")
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: list_aggregate(w[i:i+2], 'string_agg', ' ')))
                      WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END AS s FROM words),
classes AS (SELECT md5(list_aggregate(list_sort(s), 'string_agg', chr(10))) AS k, any_value(s) AS s, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY 1),
posts AS (SELECT id, len(s) AS n, unnest(s) AS x FROM classes),
shared AS (SELECT p.id AS a, q.id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS both_have
           FROM posts p JOIN posts q ON p.x = q.x AND p.id < q.id AND 100 * p.n >= 85 * q.n AND 100 * q.n >= 85 * p.n GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * both_have >= 85 * (na + nb - both_have)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, to_id) AS (SELECT id, id FROM classes UNION SELECT r.id, e.b FROM reach r JOIN ends e ON r.to_id = e.a),
lowest AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY 1),
named AS (SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, lowest.component_id
          FROM sets LEFT JOIN classes c ON len(sets.s) > 0 AND md5(list_aggregate(list_sort(sets.s), 'string_agg', chr(10))) = c.k
          LEFT JOIN lowest ON lowest.id = c.id)
SELECT doc_id, n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM named
"""


@query("op8_near_dedup", SQL)
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)
