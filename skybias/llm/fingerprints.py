"""Threshold-scaled sketches of documents, by DataFrame functions only.

A document's shingles are runs of five words, hashed to 48 bits; a shorter document is one shingle. Its sketch keeps every hash
below a fixed fraction of the range, the same for documents of all sizes, so sketches of any two sets can be compared and merged,
however unequal the sets. The sketch names its threshold (sketches of unlike fractions are compared below the lower one) and carries
a digest of the whole set, which tells equal sets from unlike ones where no hash lies below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skybias.llm.registry import query
from skybias.llm.tables import free_name, table, text_of

SHINGLE_WORDS, FRACTION, HASH_BITS = 5, 1 / 2, 48
CHUNK_BITS, FANOUT_BITS = 8, 12
BLANKS = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text: str, out: str, shingle_words: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """Add ``out``: struct(threshold long, digest long, hashes array<long>, ascending)."""
    words, found = (free_name(df, f"_{out}_{x}") for x in ("words", "found"))
    limit = int(fraction * (1 << HASH_BITS))

    def hashed(*parts: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*parts), 64 - HASH_BITS)

    n, w = F.size(words), F.col(words)
    df = df.withColumn(words, F.filter(F.split(F.col(text), BLANKS), lambda x: x != ""))
    df = df.withColumn(found, F.when(n >= shingle_words, F.transform(
        F.sequence(F.lit(0), F.greatest(n - shingle_words, F.lit(0))), lambda i: hashed(*(w[i + j] for j in range(shingle_words)))))
        .when(n > 0, F.array(hashed(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))).drop(words)
    df = df.withColumn(found, F.sort_array(F.array_distinct(found)))
    return df.withColumn(out, F.struct(F.lit(limit).cast("long").alias("threshold"), F.xxhash64(found).alias("digest"),
                                       F.filter(found, lambda h: h < limit).alias("hashes"))).drop(found)


def encoded(sketch: str) -> Column:
    """The sketch as text: threshold, digest and hashes in hexadecimal digits."""
    digits = HASH_BITS // 4
    hashes = F.array_join(F.transform(f"{sketch}.hashes", lambda h: F.lpad(F.hex(h), digits, "0")), "")
    return F.concat_ws(":", F.hex(F.col(f"{sketch}.threshold")), F.hex(F.col(f"{sketch}.digest")), hashes)


def _below(sketch: str, threshold: Column) -> Column:
    return F.filter(f"{sketch}.hashes", lambda h: h < threshold)


def _common(a: str, b: str) -> tuple[Column, Column, Column]:
    threshold = F.least(f"{a}.threshold", f"{b}.threshold")
    x, y = _below(a, threshold), _below(b, threshold)
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def _equal(a: str, b: str) -> Column:
    """Whether the digests say that both sets are the same; a merged sketch has no digest."""
    return F.coalesce(F.col(f"{a}.digest") == F.col(f"{b}.digest"), F.lit(False))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two documents' shingle sets: 1 for equal sets, 0 for unlike sets without any hash below the threshold."""
    both, x, y = _common(a, b)
    return F.when(_equal(a, b), F.lit(1.0)).when(x + y == 0, F.lit(0.0)).otherwise(both / (x + y - both)).cast("double")


def containment(a: str, b: str) -> Column:
    """Estimated share of the first document's shingles that the second has, however long either is: 1 for equal sets, else null if the
    first has no hash below the threshold."""
    both, x, _ = _common(a, b)
    return F.when(_equal(a, b), F.lit(1.0)).when(x > 0, both / x).cast("double")


def merged(a: str, b: str) -> Column:
    """Sketch of the union of two documents; its digest is known only for equal sets."""
    threshold = F.least(f"{a}.threshold", f"{b}.threshold")
    return F.struct(threshold.alias("threshold"), F.when(_equal(a, b), F.col(f"{a}.digest")).alias("digest"),
                    F.sort_array(F.array_union(_below(a, threshold), _below(b, threshold))).alias("hashes"))


def _next_chunks(ids: DataFrame) -> DataFrame:
    """For each chunk (``chunk``, ``top`` its largest id) the largest id of the next lower chunk, after the lowest of the highest.

    Chunks are grouped into ranges of fixed size, and these again, so no window holds more than 2 ** FANOUT_BITS rows.
    """
    ends = ids.agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"), F.max("top").alias("top")).first()
    if ends["low"] is None:
        return ids.withColumn("next_id", F.col("top"))
    depth, span = 1, max(abs(ends["high"]), abs(ends["low"]))
    while span >> (FANOUT_BITS * depth):
        depth += 1

    def down(level: DataFrame, left: int) -> DataFrame:
        parent = F.shiftright("chunk", FANOUT_BITS) if left else F.lit(0).cast("long")
        inside = level.withColumn("parent", parent).withColumn(
            "next_id", F.lead("top").over(Window.partitionBy("parent").orderBy(F.desc("chunk"))))
        if not left:
            return inside.drop("parent").fillna(ends["top"], ["next_id"])
        above = down(inside.groupBy("parent").agg(F.max("top").alias("top")).withColumnRenamed("parent", "chunk"), left - 1)
        above = above.select(F.col("chunk").alias("parent"), F.col("next_id").alias("far"))
        return inside.join(above, "parent").select("chunk", "top", F.coalesce("next_id", "far").alias("next_id"))

    return down(ids, depth)


def with_next(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """``docs`` (doc_id, text) with their sketch and ``next``, the text and sketch of the next row by descending doc_id.

    After the last row comes the first. The order is found by chunks of the id's range: the text is shuffled once, by chunk, and only
    the first row of a chunk is sent to the chunk before. Rows with the same doc_id follow each other by text. A row without
    doc_id has no place in the order; its next text is empty.
    """
    docs = docs.select("doc_id", text_of().alias("text")).withColumn("chunk", F.shiftright("doc_id", CHUNK_BITS))
    placed = docs.where("doc_id IS NOT NULL AND chunk IS NOT NULL")
    chunks = _next_chunks(placed.groupBy("chunk").agg(F.max("doc_id").alias("top")))
    # the text travels alone and once: sketches are taken behind the exchange, which both branches read
    dealt = placed.repartition("chunk")
    order = Window.partitionBy("chunk").orderBy(F.desc("doc_id"), "text")
    rows = with_sketch(dealt, "text", "sketch", shingle_words, fraction)
    rows = rows.withColumn("next", F.lead(F.struct("text", "sketch")).over(order))
    tops = dealt.withColumn("place", F.row_number().over(order)).where("place = 1").select("doc_id", "text")
    heads = with_sketch(tops, "text", "sketch", shingle_words, fraction).select(
        F.col("doc_id").alias("next_id"), F.struct("text", "sketch").alias("head"))
    heads = chunks.join(heads, "next_id").select(F.col("chunk").alias("last_of"), "head")
    done = rows.join(heads, (F.col("chunk") == F.col("last_of")) & F.col("next").isNull(), "left")
    done = done.select("doc_id", "text", "sketch", F.coalesce("next", "head").alias("next"))
    loose = with_sketch(docs.where("doc_id IS NULL").withColumn("none", F.lit("")), "text", "sketch", shingle_words, fraction)
    loose = with_sketch(loose, "none", "empty", shingle_words, fraction).select(
        "doc_id", "text", "sketch", F.struct(F.col("none").alias("text"), F.col("empty").alias("sketch")).alias("next"))
    return done.unionByName(loose)


def edit_and_compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with the likeness of the first to the second and to the next document's.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document. A null text counts as empty;
    an empty text's fingerprint has no hashes and equals that of any text without words. Repeated rows give one row each. A likeness is
    exact for equal sets and an estimate from the kept half of the shingles otherwise.
    """
    half = F.expr("n_chars div 2")
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                                              F.substring(F.col("next.text"), F.lit(1), half.cast("int"))))
    rows = with_sketch(rows.select("doc_id", "n_chars", "sketch", "edited", F.col("next.sketch").alias("next_sketch")), "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), encoded("sketch").alias("fingerprint"),
        encoded("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"))


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_and_compare(table(spark, sf_dir, "documents"))
