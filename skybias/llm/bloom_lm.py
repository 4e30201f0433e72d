"""Language-model scores from a log-frequency Bloom filter.

Every n-gram count is quantised to a level on a geometric scale and its n-gram is inserted once for each level up to it; a
reader probes level after level until one is missing. The filter holds bigram counts, and for each context the sum of its
(quantised) bigram counts and its number of different followers, which smooth the bigram estimate by Witten and Bell:

    P(w | v) = (c(v, w) + d(v) * P1(w)) / (C(v) + d(v))

P1 is the add-one estimate from the word's own count.

The filter is cut into segments. Contexts are dealt to slices, and consecutive slices form waves of at most ``wave_mb``, so a
broadcast has a fixed bound: scoring makes one pass over the documents for each wave and adds up. The exact counts of words, for P1
and for ``base_score``, come from the head (broadcast, at most ``head_words`` entries) and from a join for all other words: a token
outside the head leaves its wave as (word, a, b) with P = a + b * P1(word).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.llm import texts
from skybias.llm.registry import query
from skybias.llm.tables import stored, table, text_of

#: The token that ends each text and precedes its first word.
END = np.uint64(0x5851F42D4C957F2D)
BITS_PER_ENTRY, RATIO, SALTS, PART_MB = 12, 1.5, 16, 12
#: An entry sets this many bits in each of two 64-bit words, so a probe reads two places of memory.
WORD_BITS = 3
FLUSH_TOKENS = 1 << 20
U64, SLICE_WORDS = np.uint64, 1 << 22


def count_levels() -> np.ndarray:
    """The counts that quantised levels stand for: 1, 2, 3, 4, 6, 9, ... by the ratio, rounded down."""
    levels = [1]
    while levels[-1] < 1 << 60:
        levels.append(max(levels[-1] + 1, int(levels[-1] * RATIO)))
    return np.array(levels, np.int64)


LEVELS = count_levels()
#: Added to the key of an n-gram for its count, a context's total and its followers.
PAIR, TOTAL, FOLLOWERS = U64(0x1000000000001), U64(0x2000000000003), U64(0x3000000000005)


def quantise(counts: np.ndarray, up: bool = False) -> np.ndarray:
    """Number of levels inserted for each count; ``up`` rounds to the next level above."""
    return np.searchsorted(LEVELS, counts, "left") + 1 if up else np.searchsorted(LEVELS, counts, "right")


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return texts.mix(v * U64(0x9E3779B97F4A7C15) + texts.mix(w))


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their token hashes, each row followed by END, and the offsets of the rows."""
    for a, b, word, first in texts.words(batch.column("text")):
        yield a, b, np.insert(word, first[1:], END), first + np.arange(b - a + 1)


def previous(token: np.ndarray) -> np.ndarray:
    """The token before each one: END before the first of a row, as each row ends with END."""
    return np.concatenate([[END], token[:-1]]).astype(U64)


def buckets_of(v: np.ndarray, pair: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a bigram: a context's followers are spread over several buckets, so none holds all of a frequent word's."""
    return ((texts.mix(v) >> U64(20)) + (pair >> U64(7)) % U64(SALTS)) % U64(buckets)


def slices_of(v: np.ndarray, slices: int) -> np.ndarray:
    return (texts.mix(v + PAIR) >> U64(24)) % U64(slices)


COUNTED = "kind int, bucket int, a binary, b binary, n binary"


def _packed(kind: int, bucket: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket.astype(np.int64), kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    cut = [*first[1:], len(order)]
    a, b, n = a[order], b[order], n[order].astype(np.int64)
    rows = list(zip(first, cut, strict=True))
    return pa.record_batch([
        pa.array([kind] * len(rows), pa.int32()), pa.array(names.astype(np.int32)),
        *(pa.array([x[i:j].tobytes() for i, j in rows], pa.binary()) for x in (a, b)),
        pa.array([_narrow(n[i:j]) for i, j in rows], pa.binary())], ["kind", "bucket", "a", "b", "n"])


def _narrow(n: np.ndarray) -> bytes:
    """Counts in the fewest bytes; the number of bytes per count follows from the lengths."""
    top = n.max(initial=0)
    return n.astype(np.uint8 if top < 256 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _wide(n: bytes, size: int) -> np.ndarray:
    return np.frombuffer(n, {1: np.uint8, 4: np.uint32, 8: np.uint64}[len(n) // size]).astype(np.int64) if size else np.zeros(0, np.int64)


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, the place of one of each, and the sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], order[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in values)]


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            w = np.concatenate(held)
            held.clear()
            ones = np.ones(len(w), np.int64)
            word, _, n = _sums(w, ones)
            yield _packed(0, (word >> U64(11)) % U64(buckets), word, np.zeros((len(word), 0), U64), n)
            v = previous(w)
            pair, at, n = _sums(pair_keys(v, w), ones)
            yield _packed(1, buckets_of(v[at], pair, buckets), v[at], pair, n)

        size = 0
        for batch in batches:
            for _, _, token, _ in tokens(batch):
                held.append(token)
                size += len(token)
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return count


def _segment(keys: np.ndarray, level: np.ndarray, bits: int = BITS_PER_ENTRY) -> bytes:
    """64-bit words of a filter that holds each key at the levels 1 .. level, with ``bits`` bits for each of these entries."""
    size = int(level.sum())
    width = max(8, -(-size * bits // 64))
    held = np.zeros(width * 64, bool)
    step = np.arange(size) - np.repeat(np.cumsum(level) - level, level) + 1
    draw = _draw(np.repeat(keys, level), step)
    for draw in (draw, texts.mix(draw)):
        word = _word(draw, width) << 6
        for bit in _bits(draw):
            held[word + bit.astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def _draw(key: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """The first random number of a key at a level; its mix is the second one."""
    return texts.mix(key + np.asarray(level).astype(U64) * U64(0xD1342543DE82EF95))


def _word(draw: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """A word of ``width``, from the upper half of a random number."""
    return (((draw >> U64(32)) * np.asarray(width).astype(U64)) >> U64(32)).astype(np.int64)


def _bits(draw: np.ndarray) -> list[np.ndarray]:
    return [(draw >> U64(6 * j)) & U64(63) for j in range(WORD_BITS)]


def _mask(draw: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(draw), U64)
    for bit in _bits(draw):
        mask |= U64(1) << bit
    return mask


MERGED = "kind int, slice int, bucket int, a binary, b binary, n binary"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3
    names = ["kind", "slice", "bucket", "a", "b", "n"]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def _merger(buckets: int, slices: int, bits: int):
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        kind, bucket = (k.as_py() for k in key)
        a, b, n = (group.column(c).to_pylist() for c in "abn")
        first = np.frombuffer(b"".join(a), U64)
        second = np.frombuffer(b"".join(b), U64)
        count = np.concatenate([_wide(x, len(y) // 8) for x, y in zip(n, a, strict=True)])
        if kind == 0:
            word, _, count = _sums(first, count)
            return _rows([(0, 0, bucket, word.tobytes(), b"", count.tobytes())])
        pair, at, count = _sums(second, count)
        v, level = first[at], quantise(count)
        where, rows = slices_of(v, slices), []
        for s in np.unique(where):
            one = where == s
            rows.append((1, int(s), bucket, _segment(pair[one] + PAIR, level[one], bits), b"", b""))
        v, _, total, followers = _sums(v, LEVELS[level - 1], np.ones(len(v), np.int64))
        home = (texts.mix(v) >> U64(20)) % U64(buckets)
        part = _packed(2, home, v, total.astype(U64), followers)
        rows += [(2, 0, *(part.column(c)[i].as_py() for c in ("bucket", "a", "b", "n"))) for i in range(part.num_rows)]
        return _rows(rows)

    return merge


def _contexts(slices: int, bits: int):
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        a, b, n = (group.column(c).to_pylist() for c in "abn")
        followers = np.concatenate([_wide(x, len(y) // 8) for x, y in zip(n, a, strict=True)])
        v, _, total, followers = _sums(np.frombuffer(b"".join(a), U64), np.frombuffer(b"".join(b), U64).astype(np.int64), followers)
        where, rows = slices_of(v, slices), []
        for s in np.unique(where):
            one = where == s
            keys = np.concatenate([v[one] + TOTAL, v[one] + FOLLOWERS])
            level = np.concatenate([quantise(total[one], up=True), quantise(followers[one])])
            rows.append((2, int(s), key[0].as_py(), _segment(keys, level, bits), b"", b""))
        return _rows(rows)

    return merge


class Filter:
    """The segments (kind, slice, bucket, bits) of one wave, ``size`` bytes in all, as one array."""

    def __init__(self, segments: Iterable[tuple], size: int, buckets: int, slices: int, low: int, high: int):
        self.buckets, self.slices, self.low, self.high = buckets, slices, low, high
        self.start, self.width = np.zeros((2, 2 * slices * buckets), np.int64)
        self.data, at = np.zeros(size // 8, U64), 0
        for kind, s, bucket, bits in segments:
            i = ((kind - 1) * slices + s) * buckets + bucket
            self.start[i], self.width[i] = at, len(bits) // 8
            self.data[at:at + self.width[i]] = np.frombuffer(bits, U64)
            at += self.width[i]

    def level(self, kind: int, part: np.ndarray, bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Level of each key: probes go on until one finds nothing."""
        data = self.data
        i = (((kind - 1) * self.slices + part.astype(np.int64)) * self.buckets + bucket.astype(np.int64))
        start, width = self.start[i], self.width[i]
        found = np.zeros(len(key), np.int64)
        alive = np.flatnonzero(width > 0)
        start, width, key = start[alive], width[alive], key[alive]
        for level in range(1, len(LEVELS) + 1):
            draw = _draw(key, level)
            for last in (False, True):
                mask = _mask(draw)
                hit = np.flatnonzero(data[start + _word(draw, width)] & mask == mask)
                alive, start, width, key, draw = alive[hit], start[hit], width[hit], key[hit], draw[hit]
                if not last:
                    draw = texts.mix(draw)
            if not len(alive):
                break
            found[alive] = level
        return found

    def mixtures(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and b with P(w | v) = a + b * P1(w), for tokens whose context lies in this wave."""
        values = np.concatenate([[0], LEVELS])
        pair, at, back = np.unique(pair_keys(v, w), return_index=True, return_inverse=True)
        pv = v[at]
        c = values[self.level(1, slices_of(pv, self.slices), buckets_of(pv, pair, self.buckets), pair + PAIR)][back]
        context, back = np.unique(v, return_inverse=True)
        part, home = slices_of(context, self.slices), (texts.mix(context) >> U64(20)) % U64(self.buckets)
        total = values[self.level(2, part, home, context + TOTAL)][back]
        followers = values[self.level(2, part, home, context + FOLLOWERS)][back]
        known = (total > 0) & (followers > 0)
        c = np.minimum(c, total)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(known, c / (total + followers), 0.0), np.where(known, followers / (total + followers), 1.0)


class Head:
    """Counts of the most frequent words; ``n`` tokens and ``v`` different words in all."""

    def __init__(self, word: np.ndarray, count: np.ndarray, n: int, v: int):
        order = np.argsort(word)
        self.word, self.count, self.n, self.v = word[order], count[order], n, v

    def counts(self, w: np.ndarray) -> np.ndarray:
        """Count of each word, -1 outside the head."""
        if not len(self.word):
            return np.full(len(w), -1, np.int64)
        # each different word is looked up once, in order, so that neighbours in memory are read one after the other
        w, back = np.unique(w, return_inverse=True)
        at = np.minimum(np.searchsorted(self.word, w), len(self.word) - 1)
        return np.where(self.word[at] == w, self.count[at], -1)[back]

    def p1(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.n + self.v + 1)


def _scorer(shared, first_wave: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, lm = shared.value
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, token, first in tokens(batch):
                v = previous(token)
                part, count = slices_of(v, lm.slices), np.full(len(token), -1, np.int64)
                mine = np.flatnonzero((part >= lm.low) & (part < lm.high))
                wanted = slice(None) if first_wave else mine  # the base needs all words, once
                count[wanted] = head.counts(token[wanted])
                known = count >= 0
                log = np.zeros(len(token))
                own, share = lm.mixtures(v[mine], token[mine])
                here = known[mine]
                log[mine[here]] = np.log10(own[here] + share[here] * head.p1(count[mine[here]]))
                at = mine[~here]
                offsets = pa.array(np.searchsorted(at, first).astype(np.int32))
                lists = {"word": token[at].view(np.int64), "a": own[~here], "b": share[~here]}
                columns = {"_row": pa.array(np.arange(row_id, row_id + b - a)), "score": pa.array(np.add.reduceat(log, first[:-1])),
                           "other": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in lists.values()], list(lists)))}
                if first_wave:
                    base = np.where(known, np.log10(head.p1(np.maximum(count, 0))), 0.0)
                    columns |= {
                        "n_tokens": pa.array(np.diff(first).astype(np.int64)), "n_head": pa.array(np.add.reduceat(known.astype(np.int64), first[:-1])),
                        "base": pa.array(np.add.reduceat(base, first[:-1]))}
                    keep = batch.slice(a, b - a)
                    columns = {c: keep.column(c) for c in ("doc_id", "held_out")} | columns
                row_id += b - a
                yield pa.record_batch(list(columns.values()), list(columns))

    return score


def fit(docs: DataFrame, head_words: int = 1 << 20, bucket_words: int = 1 << 19, bits: int = BITS_PER_ENTRY) -> dict:
    """Count the words and bigrams of ``docs`` (column text) and build the filter's segments (``bits`` for an entry), all as stored tables."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(SALTS, -(-size // (6 * bucket_words)))
    slices = max(1, -(-size // (6 * SLICE_WORDS)))
    counted = docs.select("text").mapInArrow(_counter(buckets), COUNTED)
    merged = stored(counted.groupBy("kind", "bucket").applyInArrow(_merger(buckets, slices, bits), MERGED), "ngrams")
    contexts = stored(merged.where("kind = 2").groupBy("bucket").applyInArrow(_contexts(slices, bits), MERGED), "contexts")
    words = merged.where("kind = 0").mapInArrow(_unpacked, "word long, n long")
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # the least count that at most head_words words reach
    sizes = words.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count()
    limit, room = (1 << 20) + 1, head_words
    for row in sizes.orderBy(F.desc("n")).toLocalIterator():
        room -= row["count"]
        if room < 0:
            break
        limit = row["n"]
    # one Python step: a task with two of them has two workers, and later all of them hold a copy of each broadcast
    head = merged.where("kind = 0").mapInArrow(_frequent(limit), "word binary, n binary").collect()
    return {"buckets": buckets, "slices": slices, "segments": merged.where("kind = 1").unionByName(contexts), "words": words, "limit": limit,
            "head": Head(np.frombuffer(b"".join(bytes(r["word"]) for r in head), U64), np.frombuffer(b"".join(bytes(r["n"]) for r in head), np.int64),
                         totals["n"] or 0, totals["v"])}


def _unpacked(batches):
    for batch in batches:
        for a, n in zip(batch.column("a"), batch.column("n"), strict=True):
            yield pa.record_batch([pa.array(np.frombuffer(a.as_py(), np.int64)), pa.array(np.frombuffer(n.as_py(), np.int64))], ["word", "n"])


def _frequent(limit: int):
    """The words that occur ``limit`` times at least, packed as they were."""
    def run(batches):
        for batch in batches:
            for a, n in zip(batch.column("a"), batch.column("n"), strict=True):
                word, count = np.frombuffer(a.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64)
                keep = count >= limit
                yield pa.record_batch([pa.array([x[keep].tobytes()], pa.binary()) for x in (word, count)], ["word", "n"])

    return run


def waves(model: dict, wave_mb: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of slices and their bytes, whose segments have at most ``wave_mb`` together (a single slice has about 4 M tokens)."""
    rows = model["segments"].groupBy("slice").agg(F.sum(F.octet_length("a")).alias("b")).orderBy("slice").collect()
    sizes, low, held = {r["slice"]: r["b"] for r in rows}, 0, 0
    for s in range(model["slices"]):
        if held and held + sizes.get(s, 0) > wave_mb << 20:
            yield low, s, held
            low, held = s, 0
        held += sizes.get(s, 0)
    yield low, model["slices"], held


def _segments(model: dict, low: int, high: int, size: int) -> Iterator[tuple]:
    """The segments of a wave, fetched in parts of about ``PART_MB``."""
    rows = model["segments"].where(F.col("slice").between(low, high - 1)).select("kind", "slice", "bucket", "a")
    parts = -(-size // (PART_MB << 20))
    for k in range(parts):
        for r in rows.where(F.col("bucket") % parts == k).collect():
            yield r["kind"], r["slice"], r["bucket"], r["a"]


def score(docs: DataFrame, model: dict, wave_mb: int = 64) -> DataFrame:
    """Score ``docs`` (doc_id, held_out, text) with a fitted model: one row per row, in any order.

    A null text is empty and has one token, its end. Repeated rows are scored alike; rows with a null doc_id too. With an empty
    training set every probability is that of the unknown word.
    """
    spark, head, partial = docs.sparkSession, model["head"], []
    for low, high, size in waves(model, wave_mb):
        lm = Filter(_segments(model, low, high, size), size, model["buckets"], model["slices"], low, high)
        shared = spark.sparkContext.broadcast((head, lm))
        schema = "_row long, score double, other array<struct<word: long, a: double, b: double>>"
        if not partial:
            schema = f"doc_id long, held_out boolean, {schema}, n_tokens long, n_head long, base double"
        partial.append(stored(docs.select("doc_id", "held_out", "text").mapInArrow(_scorer(shared, not partial), schema), "scores"))
        del lm
        shared.destroy()
    scored, others = partial[0].drop("other"), partial[0].select("_row", "other")
    for other in partial[1:]:
        scored = scored.join(other.select("_row", F.col("score").alias("more")), "_row", "left").withColumn("score", F.col("score") + F.col("more")).drop("more")
        others = others.unionByName(other.select("_row", "other"))
    # the words outside the head, counted per row first; each token is in the list of the wave of its context
    p1 = (F.coalesce("n", F.lit(0)) + 1) / F.lit(float(head.n + head.v + 1))
    rest = (others.select("_row", F.inline("other")).groupBy("_row", "word", "a", "b").count()
            .join(model["words"].where(F.col("n") < model["limit"]), "word", "left")
            .groupBy("_row").agg(F.sum(F.col("count") * F.log10(p1)).alias("rest"), F.sum(F.col("count") * F.log10(F.col("a") + F.col("b") * p1)).alias("rest_score"),
                                 F.sum(F.when(F.col("n") > 0, F.col("count")).otherwise(0)).alias("more")))
    return scored.join(rest, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(head.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"))


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", text_of().alias("text"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"))
    return score(docs, fit(docs.where(~F.col("held_out"))))
