"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words (hashed to ``BUCKETS``) and shapes: letter case, closing character and whether a word repeats the one before. Document
frequencies come from all documents. The latent space is spanned by the ``DIMENSIONS`` leading right singular vectors of the weighted term
matrix of the fit rows, found by subspace iteration: each step is a pass over the stored fit rows that sums a fixed-size matrix over the tasks.
The labelled vectors are broadcast (``FIT_ROWS`` x ``DIMENSIONS`` numbers, whatever the corpus); every document is compared with all of them by
blocked cosine products, and its ``NEIGHBOURS`` nearest (with ties, all that are as near) vote for their labels, weighted by similarity.

``FIT_ROWS`` bounds the labelled rows of the classifier: those with the smallest hashes of their doc_id.
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

FIT_ROWS, DIMENSIONS, NEIGHBOURS, STEPS = 8192, 32, 11, 5
BUCKET_BITS, SHAPES, BLOCK_ROWS, TERM_BLOCK = 15, 256, 256, 4096
BUCKETS = 1 << BUCKET_BITS
_UPPER, _LOWER, _CLOSING = np.zeros(256, np.int32), np.zeros(256, np.int32), np.full(256, 7, np.int64)
_UPPER[ord("A"):ord("Z") + 1] = 1
_LOWER[ord("a"):ord("z") + 1] = 1
for _class, _chars in enumerate((".,;:", "!?", "\"')]}", "|", "0123456789")):
    _CLOSING[[ord(c) for c in _chars]] = _class + 1
_CLOSING[ord("A"):ord("Z") + 1] = _CLOSING[ord("a"):ord("z") + 1] = _CLOSING[128:] = 0


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A code below ``SHAPES`` for each word: case, closing character, one of several, repeated."""
    upper, lower = (np.concatenate([[0], np.cumsum(kind[raw])]) for kind in (_UPPER, _LOWER))
    ups, lows = upper[ends] - upper[starts], lower[ends] - lower[starts]
    case = np.where(lows > 0, np.where(ups > 0, 1, 0), np.where(ups > 1, 2, 3))
    long = ends - starts > 1
    closing = _CLOSING[raw[ends - 1]]
    twice = long & (_CLOSING[raw[np.maximum(ends - 2, 0)]] == closing) & (closing > 0)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[first[:-1][first[:-1] < len(word)]] = False
    return case + 4 * closing + 32 * twice + 64 * same


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, end row, and the row, bucket and count of each different term of a row."""
    raw, offsets = texts.buffers(column)
    for a, b in texts.slices(offsets):
        part, at = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, first = texts.spans(part, at)
        word = texts.hashes(part, starts, ends)
        bucket = SHAPES + (word % np.uint64(BUCKETS - SHAPES)).astype(np.int64)
        row = np.repeat(np.arange(b - a), np.diff(first)) << BUCKET_BITS
        key, count = np.unique(np.concatenate([row | bucket, row | _shapes(part, starts, ends, word, first)]), return_counts=True)
        yield a, b, key >> BUCKET_BITS, key & (BUCKETS - 1), count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for _, _, _, bucket, _ in term_counts(batch.column("text")):
            seen += np.bincount(bucket, minlength=BUCKETS)
    found = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(np.append(found, -1)), pa.array(np.append(seen[found], rows))], ["bucket", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Logarithm of rows over rows with the term, for each bucket, over all of ``docs``: at most ``BUCKETS`` sums reach the driver."""
    sums = docs.select(text_of().alias("text")).mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    n, total = np.zeros(BUCKETS), float(found.n[found.bucket < 0].sum())
    real = found[found.bucket >= 0]
    n[real.bucket.to_numpy()] = real.n.to_numpy()
    return np.log((total + 1) / (n + 1)).astype(np.float32)


def _weighted(idf: np.ndarray, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """Term weights with unit length in each row."""
    value = ((1 + np.log(count)) * idf[bucket]).astype(np.float32)
    size = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, minlength=rows))
    return value / np.maximum(size, 1e-12)[row].astype(np.float32)


def _project(basis: np.ndarray, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    out, edge = np.zeros((rows, basis.shape[1])), np.searchsorted(row, np.arange(rows + 1))
    for a, b in texts.slices(edge, 1 << 15):  # whole rows: equal texts have equal sums
        part, start = slice(edge[a], edge[b]), edge[a:b][edge[a:b] < edge[a + 1:b + 1]]
        if len(start):
            out[row[start]] = np.add.reduceat(basis[bucket[part]] * value[part, None].astype(np.float64), start - edge[a], axis=0)
    return out


def _vectors(basis: np.ndarray, idf: np.ndarray, column: pa.Array) -> np.ndarray:
    """Unit latent vectors of the texts; a text without words has a zero vector."""
    out = [np.zeros((0, basis.shape[1]))]
    for a, b, row, bucket, count in term_counts(column):
        out.append(_project(basis, row, bucket, _weighted(idf, row, bucket, count, b - a), b - a))
    x = np.concatenate(out)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _terms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, bucket, count in term_counts(batch.column("text")):
                value, edge = _weighted(shared.value, row, bucket, count, b - a), np.searchsorted(row, np.arange(b - a + 1))
                cells = [(bucket[i:j].astype(np.int32).tobytes(), value[i:j].tobytes()) for i, j in zip(edge, edge[1:], strict=False)]
                yield pa.record_batch([pa.array([c[k] for c in cells], pa.binary()) for k in (0, 1)], ["bucket", "value"])

    return run


def _multiplied(shared):
    """Partial sums of x (x Q) over the rows x of a task, in blocks of terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        total = np.zeros(basis.shape, np.float32)
        for batch in batches:
            for bucket, value in zip(batch.column("bucket").to_pylist(), batch.column("value").to_pylist(), strict=True):
                bucket, value = np.frombuffer(bucket, np.int32), np.frombuffer(value, np.float32)
                total[bucket] += value[:, None] * (value @ basis[bucket])  # a row has each bucket once
        for i in range(0, len(total), TERM_BLOCK):
            yield pa.record_batch([pa.array([i]), pa.array([total[i:i + TERM_BLOCK].tobytes()], pa.binary())], ["block", "part"])

    return run


def _added(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(p, np.float32).astype(np.float64) for p in group.column("part").to_pylist()], axis=0)
    return pa.table([group.column("block")[:1], pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "part"])


def latent_basis(terms: DataFrame, dimensions: int = DIMENSIONS, steps: int = STEPS) -> np.ndarray:
    """Leading right singular vectors of the rows of ``terms``, by ``steps`` rounds of subspace iteration."""
    context, wide = terms.sparkSession.sparkContext, dimensions + 8
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((BUCKETS, wide)))[0]
    for _ in range(steps):
        sent = context.broadcast(q.astype(np.float32))
        parts = terms.mapInArrow(_multiplied(sent), "block long, part binary").groupBy("block").applyInArrow(_added, "block long, part binary").collect()
        y = np.zeros((BUCKETS, wide))
        for block, part in parts:
            y[block:block + TERM_BLOCK] = np.frombuffer(bytes(part), np.float32).reshape(-1, wide)
        turn = np.linalg.eigh(q.T @ y)[1][:, ::-1]  # Ritz vectors, largest first
        q = np.linalg.qr(y @ turn)[0]
    return np.ascontiguousarray(q[:, :dimensions])


def _labelled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, idf = shared.value
        for batch in batches:
            x = _vectors(basis, idf, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "quality", "vector"])

    return run


def vote(x: np.ndarray, labelled: np.ndarray, label: np.ndarray, neighbours: int, prior: float) -> np.ndarray:
    """Share of label 1 among the nearest rows of ``labelled``, weighted by cosine; ``prior`` where none is similar."""
    out = np.full(len(x), prior)
    k = min(neighbours, len(labelled))
    if not k:
        return out
    for i in range(0, len(x), BLOCK_ROWS):
        near = x[i:i + BLOCK_ROWS] @ labelled.T
        last = np.partition(near, len(labelled) - k, axis=1)[:, len(labelled) - k]
        weight = np.where((near >= last[:, None] - 1e-9) & (near > 1e-9), near, 0)
        total = weight.sum(1)
        out[i:i + BLOCK_ROWS] = np.where(total > 0, weight @ label / np.maximum(total, 1e-12), prior)
    return np.clip(out, 0.0, 1.0).round(9)  # copies in other batches differ by less


def _scorer(shared, neighbours: int, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, idf, labelled, label = shared.value
        for batch in batches:
            score = vote(_vectors(basis, idf, batch.column("text")), labelled, label, neighbours, prior)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(score)], [*names, "score"])

    return run


def remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, dimensions: int = DIMENSIONS) -> dict:
    """Fit on the labelled rows with a remainder other than 0; a doc_id with both labels votes for both."""
    context = docs.sparkSession.sparkContext
    idf = inverse_frequencies(docs)
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(remainder() != 0).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    # at most fit_rows pairs of numbers
    rows = stored(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id"), "quality-fit")
    terms = stored(rows.mapInArrow(_terms(context.broadcast(idf)), "bucket binary, value binary"), "quality-terms")
    basis = latent_basis(terms, dimensions)
    # repeated doc_ids could make more rows than were chosen, so the bound is applied again
    found = (rows.mapInArrow(_labelled(context.broadcast((basis, idf))), "doc_id long, quality int, vector binary")
             .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "vector").limit(fit_rows).toPandas())
    vectors = np.stack([np.frombuffer(bytes(v)) for v in found.vector]) if len(found) else np.zeros((0, dimensions))
    label = found.quality.to_numpy().astype(np.float64)
    return {"basis": basis, "idf": idf, "vectors": vectors, "label": label, "prior": float(label.mean()) if len(label) else 0.5}


def score_documents(docs: DataFrame, model: dict, neighbours: int = NEIGHBOURS, cut: float = 0.3) -> DataFrame:
    """``docs`` (text, and others but those named here) with score and predicted in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast((model["basis"], model["idf"], model["vectors"], model["label"]))
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "score double"])
    rows = docs.select(*names, text_of().alias("text")).mapInArrow(_scorer(shared, neighbours, model["prior"]), schema)
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by its labelled neighbours; ``labels`` has doc_id and quality.

    Null and empty texts, and texts that share no term with a labelled one, get the share of label 1 in the fit rows (0.5 without any). Repeated
    rows score alike; a row without doc_id is scored and counts as not held out. Labels that are null or not 0 or 1, or without document, are not used.
    """
    rows = score_documents(docs.select("doc_id", "text"), trained(docs.select("doc_id", "text"), labels, fit_rows))
    return rows.withColumn("held_out", F.coalesce(remainder() == 0, F.lit(False)))


@query("op11_quality")
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")
