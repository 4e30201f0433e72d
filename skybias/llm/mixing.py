"""Mixing sources to target weights by entropy balancing, by DataFrame functions only.

Targets: sources share all words by weight, none above ``most`` times its own. Rates: among all document rates r, those closest to 1
in relative entropy that give each source its target are r = min(most, exp(lambda * size / mean size)); lambda solves the convex
dual, by Newton steps whose sums run distributed over the (source, size) counts. Rounding: with a hashed u in [0, 1), a document gets
floor(r + u + d) copies. The shift d of a source is found by three passes over ever finer histograms of the places where a copy
more begins, so that the copies fall short of the target by less than one document; the next copy is cut to what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skybias.llm.registry import query
from skybias.llm.tables import stored, table, text_of
from skybias.llm.texts import WORD

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
TOLERANCE, MAX_STEPS = 1e-9, 60
KEY_BITS, STEP_BITS = 40, (15, 14, 14)
STATE = "key source_size mean target lam low high".split()


def source_key(column: str = "source") -> Column:
    """Source names as keys that compare by code point, null last and unequal to any name."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(key, source_size, target): sources are capped in the order of most * size / weight, the rest shares what is left."""
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    # one row per source from here on
    place = F.row_number().over(Window.orderBy("key")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                         / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source that is not capped sets the level of all behind it; the levels fall from there on
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    return per.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.col("level"))).select(
        "key", "source_size", (F.col("source_size") / F.col("documents")).alias("mean"), "target")


def _rate(size: Column, most: float) -> Column:
    """Tilted rate; the exponent is held below the logarithm of the bound, so it can't overflow."""
    import math

    exponent = F.when(F.col("mean") > 0, F.col("lam") * size / F.col("mean")).otherwise(0.0)
    return F.when(exponent >= math.log(most), F.lit(float(most))).otherwise(F.exp(F.least(exponent, F.lit(math.log(most)))))


def solve_rates(sizes: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """Add ``lam`` to the targets. Newton steps, or the middle of the bracket where a step leaves it."""
    counts = stored(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), "counts")
    wide = F.lit(float("inf"))
    state = stored(targets.withColumns({"lam": F.lit(0.0), "low": -wide, "high": wide}).select(STATE), "dual")
    for _ in range(MAX_STEPS):
        rate = _rate(F.col("size"), most)
        weight = F.col("n") * F.col("size")
        sums = counts.join(state, "key").groupBy("key").agg(
            F.sum(weight * rate).alias("got"),
            F.sum(F.when(rate < most, weight * F.col("size") / F.col("mean") * rate).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        # a source whose target is its bound has every rate at the bound
        done = (F.abs(gap) <= TOLERANCE * F.col("target")) | (F.col("target") >= most * F.col("source_size") * (1 - TOLERANCE))
        step = state.join(sums, "key", "left").withColumn("done", F.coalesce(done, F.lit(True)))
        step = step.withColumns({"low": F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))})
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        middle = F.when(F.col("high") == wide, 2 * F.col("lam") + 1).when(F.col("low") == -wide, 2 * F.col("lam") - 1).otherwise((F.col("low") + F.col("high")) / 2)
        new = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        state = stored(step.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(new)).select(*STATE, "done"), "dual")
        if state.where("NOT done").isEmpty():
            break
        state = state.drop("done")
    # to nine digits: the order of sums does not show
    full = F.col("target") >= most * F.col("source_size") * (1 - TOLERANCE)
    return state.select("key", "source_size", "mean", "target", F.when(full, wide).otherwise(F.round("lam", 9)).alias("lam"))


def _begin(copy: int | Column, most: int) -> Column:
    """Where the given copy of a document begins on the scale of the shift, as a whole number of KEY_BITS binary places."""
    rate = F.when(F.col("lam") == float("inf"), F.lit(float(most))).otherwise(_rate(F.col("size"), most))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("copies"), F.col("doc_id")), 12) / F.lit(float(1 << 52))
    return F.floor((copy - rate - u + most + 1) * float(1 << KEY_BITS)).cast("long")


def _cuts(sizes: DataFrame, rates: DataFrame, most: int) -> DataFrame:
    """Per source the place where copies end: ``at`` and ``last_id`` of the copy that is cut, and ``rest``, its words."""
    begins = sizes.where("size > 0").join(rates, "key").select(
        "key", "doc_id", "size", "target", F.explode(F.array(*(_begin(j, most) for j in range(1, most + 1)))).alias("at"))
    shift, cuts = sum(STEP_BITS), None
    for bits in STEP_BITS:
        shift -= bits
        rows = begins.withColumn("bucket", F.shiftright("at", shift))
        if cuts is not None:
            rows = rows.join(cuts.select("key", "outer", "before"), "key").where(F.shiftright("at", shift + bits) == F.col("outer"))
        rows = rows.withColumn("base", F.lit(0).cast("long") if cuts is None else F.col("before"))
        sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("size"), F.first("base").alias("base"), F.first("target").alias("target"))
        so_far = F.sum("size").over(Window.partitionBy("key").orderBy("bucket"))
        sums = sums.withColumn("after", F.col("base") + so_far).withColumn("before", F.col("after") - F.col("size"))
        cuts = stored(sums.where("before <= floor(target) AND floor(target) < after").select("key", F.col("bucket").alias("outer"), "before"), "cut")
    # the few copies that begin at that very place, by doc_id; rows that are alike share what is left
    ties = (begins.join(cuts, "key").where(F.col("at") == F.col("outer"))
            .groupBy("key", "at", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("before").alias("base"), F.first("target").alias("target")))
    order = Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_last())
    ties = ties.withColumn("after", F.col("base") + F.sum("size").over(order)).withColumn("before", F.col("after") - F.col("size"))
    return ties.where("before <= floor(target) AND floor(target) < after").select(
        "key", "at", F.col("doc_id").alias("last_id"), F.expr("(CAST(floor(target) AS BIGINT) - before) div n").alias("rest"))


def with_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with size, source_size, target, ``copies`` (whole) and ``rest`` (words of one more copy that is cut), taken.

    A null text has no words; a null source is a source of its own, the last. A document without words gets no copy, and a source without
    words has the target 0. Rows that are alike in doc_id, source and size get the same copies. An empty table stays empty. Columns of
    docs keep their values; those with the names of the new columns are replaced.
    """
    new = ["size", "source_size", "target", "copies", "rest", "taken"]
    others = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in new]
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    sizes = stored(docs.select("doc_id", source_key().alias("key"), size.alias("size")), "sizes")
    rates = stored(solve_rates(sizes, source_targets(sizes, weights, most), most), "rates")
    plan = stored(rates.join(_cuts(sizes, rates, most), "key", "left"), "copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", source_key().alias("key"), size.alias("size")).join(plan, "key")
    copies, rest = F.lit(0), F.lit(0).cast("long")
    for j in range(1, most + 1):
        at = _begin(j, most)
        whole = F.col("at").isNull() | (at < F.col("at")) | ((at == F.col("at")) & F.col("last_id").isNotNull()
                                                            & F.coalesce(F.col("doc_id") < F.col("last_id"), F.lit(False)))
        whole = whole | ((at == F.col("at")) & F.col("last_id").isNull() & F.col("doc_id").isNotNull())
        copies = copies + F.when(whole, 1).otherwise(0)
        rest = rest + F.when((at == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("last_id")), F.col("rest")).otherwise(0)
    has = F.col("size") > 0
    rows = rows.select("row", "size", "source_size", "target", F.when(has, copies).otherwise(0).cast("long").alias("copies"),
                       F.when(has, rest).otherwise(0).cast("long").alias("rest"))
    return rows.select(*others, *new[:-1], (F.col("copies") * F.col("size") + F.col("rest")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixture itself: each document as often as it has copies, and the cut copies with their first words."""
    names = docs.columns
    rows = with_copies(docs.select(F.struct(*names).alias("whole"), "doc_id", "source", "text"), weights, most)
    whole = rows.where("copies > 0").select("whole", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("whole.*")
    words = F.filter(F.split(text_of(), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = rows.where("rest > 0").withColumn("text", F.array_join(F.slice(words, F.lit(1), F.col("rest").cast("int")), " "))
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.char_length("text").cast("long"))
    made = {"text", "n_chars"}
    return whole.unionByName(cut.select(*(F.col(c) if c in made else F.col(f"whole.`{c}`") for c in names)))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_copies(docs).select("doc_id", "size", "source_size", "target", "taken")
