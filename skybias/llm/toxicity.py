"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Tokens are words without closing punctuation, hashed to ``BUCKETS``. Their log-odds between toxic and clean training texts carry an
informative Dirichlet prior: every bucket starts with ``PRIOR`` pseudo-counts, shared by the classes' sizes. A token scores its
log-odds less ``DRIFT``, so ordinary text has a negative drift, and the maximal scoring segments of a text are found in one
linear scan. For a text of n tokens, a segment of score s is expected K n exp(-lambda s) times by chance: lambda solves
sum p exp(lambda s) = 1 over the clean tokens, K comes from the clean calibration texts' best segments (the mean of the Gumbel distribution).
A document's best and summed significances give its score through a logistic function, fitted on at most ``CALIBRATION_ROWS`` rows.

Counts come from all labelled rows that may be used and have a distinct text, but for those with remainder 4, which calibrate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.llm import texts
from skybias.llm.registry import query
from skybias.llm.tables import stored, table, text_of

BUCKET_BITS, PRIOR, DRIFT, CALIBRATION_ROWS, SIGNIFICANT = 20, 6.0, 0.5, 200_000, 0.05
BUCKETS = 1 << BUCKET_BITS
FILTER_BITS = 1 << 24
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,;:!?\"')"]] = True


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with the buckets of their words and the offsets of the rows."""
    raw, offsets = texts.buffers(column)
    for a, b in texts.slices(offsets):
        part, at = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, first = texts.spans(part, at)
        for _ in range(3):
            ends = ends - (_CLOSING[part[ends - 1]] & (ends - starts > 1))
        yield a, b, (texts.hashes(part, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for a, b, bucket, first in tokens(batch.column("text")):
            label = np.repeat(toxic[a:b] == 1, np.diff(first))
            for k in (0, 1):
                counts[k] += np.bincount(bucket[label == bool(k)], minlength=BUCKETS)
    found = np.flatnonzero(counts.any(0))
    yield pa.record_batch([pa.array(found), pa.array(counts[0][found]), pa.array(counts[1][found])], ["bucket", "clean", "toxic"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([c.to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in batch.columns], batch.schema.names)


def token_scores(clean: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Score of each bucket, and lambda. Without texts of both classes no token scores above its drift."""
    n = np.array([clean.sum(), toxic.sum()], float)
    if not n.all():
        return np.full(len(clean), -DRIFT, np.float32), 1.0
    share = n / n.sum()
    odds = [np.log((y + PRIOR * s) / np.maximum(total + PRIOR * s * len(clean) - y - PRIOR * s, 1.0))
            for y, s, total in ((clean, share[0], n[0]), (toxic, share[1], n[1]))]
    score = odds[1] - odds[0] - DRIFT
    p, low, high = clean / n[0], 0.0, 1.0
    while p @ np.exp(high * score) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if p @ np.exp(middle * score) < 1 else (low, middle)
    return score.astype(np.float32), max(high, 1e-3)


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one scan: candidates are merged as long as their joint score grows."""
    up = np.flatnonzero(score > 0)
    total = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    kept: list[list] = []  # start, end, sum before, sum at the end, index of the last candidate with a smaller sum before
    for i in up.tolist():
        now = [i, i + 1, total[i], total[i + 1], -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= now[2]:
                j = kept[j][4]
            now[4] = j
            if j < 0 or kept[j][3] >= now[3]:
                kept.append(now)
                break
            now = [kept[j][0], now[1], kept[j][2], now[3], -1]
            del kept[j:]
    return [(a, b, float(high - low)) for a, b, low, high, _ in kept]


FOUND = "n_tokens long, best double, total double, passages array<struct<start:long,end:long,score:double,expected:double>>"


def _scanner(score: np.ndarray, lam: float, k: float):
    def features(segments: list, n: int) -> tuple[float, float, list]:
        best, total, found = -5.0, 0.0, []
        for a, b, s in segments:
            surprise = lam * s - np.log(n) - np.log(k)  # minus the logarithm of the expected number
            best, total = max(best, surprise), total + max(surprise, 0.0)
            if surprise >= -np.log(SIGNIFICANT):
                found.append({"start": a, "end": b, "score": s, "expected": float(np.exp(-surprise))})
        return float(best), float(total), found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = score.value if hasattr(score, "value") else score
        for batch in batches:
            out = []
            for a, b, bucket, first in tokens(batch.column("text")):
                s = weight[bucket]
                positive = np.add.reduceat(np.append(s > 0, False), first[:-1]) if len(s) else np.zeros(b - a)
                for i in range(b - a):
                    n = int(first[i + 1] - first[i])
                    out.append((n, *features(maximal_segments(s[first[i]:first[i + 1]]) if n and positive[i] else [], n)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct(
                [("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))), strict=True)]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*(batch.column(c) for c in names), *columns], [*names, "n_tokens", "best", "total", "passages"])

    return scan


def _design(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(best)), np.clip(best, -5, 50), np.log1p(total)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return beta


def fit(labelled: DataFrame, calibration: str = "calibration") -> dict:
    """Model from ``labelled`` (doc_id, text, toxic 0/1, and whether a row calibrates instead of being counted); texts to count are distinct."""
    sums = labelled.where(~F.col(calibration)).select("text", "toxic").mapInArrow(_count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    clean, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for row in sums.mapInArrow(_pack, "bucket binary, clean binary, toxic binary").collect():
        bucket = np.frombuffer(bytes(row["bucket"]), np.int64)
        clean[bucket], toxic[bucket] = (np.frombuffer(bytes(row[c]), np.int64) for c in ("clean", "toxic"))
    score, lam = token_scores(clean, toxic)
    rows = labelled.where(F.col(calibration)).select("doc_id", "text", "toxic").mapInArrow(_scanner(score, lam, 1.0), f"doc_id long, toxic int, {FOUND}")
    seen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("toxic", "n_tokens", "best", "total").limit(CALIBRATION_ROWS).toPandas()
    chance = seen[(seen.toxic == 0) & (seen.n_tokens > 0) & (seen.best > -5)]
    k = float(np.exp(chance.best.mean() - np.euler_gamma)) if len(chance) else 1.0
    beta = np.array([-3.0, 0.0, 0.0])
    if seen.toxic.nunique() == 2:
        # the total counts significances against K as well
        again = labelled.where(F.col(calibration)).select("doc_id", "text", "toxic").mapInArrow(_scanner(score, lam, k), f"doc_id long, toxic int, {FOUND}")
        seen = again.orderBy(F.xxhash64("doc_id"), "doc_id").select("toxic", "best", "total").limit(CALIBRATION_ROWS).toPandas()
        beta = _logistic(_design(seen.best.to_numpy(), seen.total.to_numpy()), seen.toxic.to_numpy().astype(float))
    return {"score": score, "lambda": lam, "k": k, "beta": beta}


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (doc_id, text, and others but those named here) with n_tokens, best, total, passages (word positions), score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model["score"])  # 4 MB, whatever the corpus
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), FOUND])
    rows = docs.select(*names, text_of().alias("text")).mapInArrow(_scanner(shared, model["lambda"], model["k"]), schema)
    one, best, total = (float(b) for b in model["beta"])
    value = one + best * F.greatest(F.lit(-5.0), F.least(F.lit(50.0), F.col("best"))) + total * F.log1p("total")
    rows = rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), value)))))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def _positions(ids: pa.Array) -> list[np.ndarray]:
    key = texts.mix(ids.fill_null(0).to_numpy().astype(np.uint64))
    return [(texts.mix(key + np.uint64(i)) % np.uint64(FILTER_BITS)).astype(np.int64) for i in range(3)]


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        for at in _positions(batch.column("doc_id")):
            bits[at] = True
    words = np.packbits(bits).view(np.int64)
    found = np.flatnonzero(words)
    yield pa.record_batch([pa.array(found), pa.array(words[found])], ["place", "word"])


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], ["place", "word"])


def likely_labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be among ``ids``: a Bloom filter of ``FILTER_BITS`` bits, whatever their number. With very many ids it
    lets more rows pass; an exact join follows."""
    words = np.zeros(FILTER_BITS // 64, np.int64)
    merged = ids.select("doc_id").mapInArrow(_set_bits, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word"))
    for row in merged.mapInArrow(_pack_words, "place binary, word binary").collect():
        words[np.frombuffer(bytes(row["place"]), np.int64)] = np.frombuffer(bytes(row["word"]), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value.view(np.uint8)).astype(bool)
        for batch in batches:
            there = np.logical_and.reduce([bits[at] for at in _positions(batch.column("doc_id"))]) if batch.num_rows else np.zeros(0, bool)
            yield batch.filter(pa.array(there))

    return docs.mapInArrow(run, docs.schema)


def trained(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on the rows with a label and a remainder other than 0; a doc_id with both labels counts under both.

    Which texts are counted is settled by their hashes: of equal texts of a class the one with the smallest doc_id (all of its rows, if that id
    repeats). Then the texts move once, those of documents without a label not at all.
    """
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(remainder() != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    usable = stored(usable, "toxic-labels")
    rows = docs.where(remainder() != 0).select("doc_id", text_of().alias("text"))
    hashed = likely_labelled(rows.select("doc_id", F.xxhash64("text").alias("_t")), usable).join(usable.hint("merge"), "doc_id")
    calibrates = remainder() == 4
    first = hashed.where(~calibrates).groupBy("_t", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct()
    chosen = stored(first.withColumn("calibration", F.lit(False)).union(usable.where(calibrates).select("doc_id", "toxic", F.lit(True))), "toxic-chosen")
    # one way of joining at every size
    return fit(stored(likely_labelled(rows, chosen).join(chosen.hint("merge"), "doc_id"), "labelled"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) after fitting on ``labels`` (doc_id, toxic).

    Null and empty texts get the score of a text without any passage. Repeated rows score alike; a row without doc_id is scored and counts as
    not held out. Without labels of both classes the score is a small constant.
    """
    rows = score_documents(docs.select("doc_id", "text"), trained(docs, labels))
    return rows.withColumn("held_out", F.coalesce(remainder() == 0, F.lit(False)))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
