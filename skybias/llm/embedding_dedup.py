"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label are one item with a count. The centres, at most ``MAX_CENTRES`` for all labels, are fitted on a sample of at most
``SAMPLE_ROWS`` items; every item is assigned to the nearest centre of its label. To lose no link between cells, an item also visits each
lower cell that may hold a vector within the threshold's angle t: with unit centres c (own) and d, a vector x nearer to d has x (d - c) >= 0,
so an item y within t of it satisfies y (c - d) / |c - d| <= sin t. A task holds a block of a cell's residents, past which the visitors stream,
however large a cell is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.llm.linking import components
from skybias.llm.registry import query
from skybias.llm.tables import stored, table

THRESHOLD, CELL_ROWS, BLOCK_ROWS = 0.93, 4096, 8192
PART_ROWS, MEET_ROWS = 65_536, 256
UNIT = ["label", "cell", "block", "part"]
SAMPLE_ROWS, MAX_CENTRES, STEPS = 20_000, 4096, 12


def spherical_kmeans(x: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    """Unit centres of unit vectors; starts from rows spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(steps):
        home = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        centres = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def _unit(column: pa.Array) -> np.ndarray:
    """Unit vectors of an array column whose rows all have the same length."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_cells(items: DataFrame) -> dict[int, np.ndarray]:
    """Centres by label, for labels with more items than a cell is meant to hold."""
    sizes = items.groupBy("label").count().where(F.col("count") > CELL_ROWS).orderBy(F.desc("count")).limit(MAX_CENTRES // 2).collect()
    total = sum(r["count"] for r in sizes)
    sample = items.join(items.sparkSession.createDataFrame([(r["label"],) for r in sizes], "label int"), "label") if sizes else items.limit(0)
    rows = sample.orderBy(F.xxhash64("id"), "id").select("label", "vector").limit(SAMPLE_ROWS).toPandas() if sizes else None
    out = {}
    for r in sizes:
        x = np.array(rows[rows.label == r["label"]].vector.tolist(), np.float64)
        k = min(-(-r["count"] // CELL_ROWS), max(1, int(MAX_CENTRES * r["count"] / total)), len(x))
        if k > 1:
            out[r["label"]] = spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), k)
    return out


def _assigner(shared, threshold: float):
    reach = np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            unit = _unit(batch.column("vector")) if batch.num_rows else np.zeros((0, 1))
            rows, cells, homes = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, bool)]
            for one in np.unique(label):
                at, centres = np.flatnonzero(label == one), shared.value.get(int(one))
                if centres is None:
                    home = np.zeros(len(at), int)
                else:
                    near = unit[at] @ centres.T
                    home = near.argmax(1)
                    # distances between unit centres from their products, rounded up by more than the products' own rounding
                    apart = np.sqrt(np.maximum(2 - 2 * centres[home] @ centres.T, 0)) + 1e-6
                    margin = near[np.arange(len(at)), home][:, None] - near
                    visits = (margin <= reach * apart) & (np.arange(len(centres)) < home[:, None])
                    i, c = np.nonzero(visits)
                    rows.append(at[i])
                    cells.append(c)
                    homes.append(np.zeros(len(i), bool))
                rows.append(at)
                cells.append(home)
                homes.append(np.ones(len(at), bool))
            row, cell, home = np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)
            part = batch.take(pa.array(row))
            yield pa.record_batch([part.column("label"), pa.array(cell), pa.array(home), part.column("id"), part.column("n"), part.column("vector")],
                                  ["label", "cell", "home", "id", "n", "vector"])

    return run


class _Unit:
    """A block of residents of a cell, and what it has met. Links join residents to groups; of a resident only its number of links and its group are kept."""

    def __init__(self, key: tuple):
        self.key, self.ids, self.n, self.unit = key, np.zeros(0, np.int64), np.zeros(0, np.int64), None
        self.root, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, n: np.ndarray, unit: np.ndarray) -> None:
        self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        self.unit = unit if self.unit is None else np.concatenate([self.unit, unit])
        self.root, self.links = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64)

    def join(self, row: np.ndarray, resident: np.ndarray) -> None:
        """Residents that are linked with the same row are one group; ``row`` is in order. The root of a group is its smallest place."""
        first = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff(first, append=len(row))
        while True:
            own = self.root[resident]
            least = np.repeat(np.minimum.reduceat(own, first), size)
            apart = own != least
            if not apart.any():
                return
            np.minimum.at(self.root, own[apart], least[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def _linked(self, close: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``close`` with links, the first resident and the copies that each is linked with; residents count the rows' copies ``n``."""
        linked = np.flatnonzero(close.any(1))
        if not len(linked):
            return linked, linked, linked
        row, resident = np.nonzero(close[linked])
        self.links += np.bincount(resident, n[linked][row], len(self.ids)).astype(np.int64)
        self.join(row, resident)
        return linked, resident[np.flatnonzero(np.diff(row, prepend=-1))], np.bincount(row, self.n[resident], len(linked)).astype(np.int64)

    def meet(self, ids: np.ndarray, n: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, id of a resident it is linked with, copies it is linked with) of the visitors that have links."""
        if self.unit is None:
            return ids[:0], ids[:0], ids[:0]
        linked, first, count = self._linked(unit @ self.unit.T >= threshold, n)
        return ids[linked], self.ids[first], count

    def among(self, threshold: float) -> None:
        """Links between the residents."""
        for at in range(0, len(self.ids), MEET_ROWS):
            close = self.unit[at:at + MEET_ROWS] @ self.unit.T >= threshold
            here = np.arange(len(close))
            close[here, at + here] = True  # so that a row is in the group of its links
            close[np.count_nonzero(close, axis=1) == 1] = False
            linked, _, _ = self._linked(close, self.n[at:at + MEET_ROWS])
            self.links[at + linked] -= self.n[at + linked]

    def out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        root = self.ids[self.root]
        keep = (self.links > 0) | (root != self.ids)
        return self.ids[keep], root[keep], self.links[keep]


def _compare(threshold: float):
    """Links between the residents of a block, and of them with the visitors that follow them: a task holds a block and a batch."""
    def batch_of(ids, root, links) -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(root, pa.int64()), pa.array(links, pa.int64())], ["id", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, settled = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in UNIT])
            ids, n, visits, unit = batch.column("id").to_numpy(), batch.column("n").to_numpy(), np.array(batch.column("visits").to_pylist()), _unit(batch.column("vector"))
            # runs of rows of one block and kind
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1) | (visits[1:] != visits[:-1])])
            for i, j in zip(starts, np.r_[starts[1:], len(ids)], strict=True):
                key = tuple(keys[i].tolist())
                if held is None or held.key != key:
                    if held is not None:
                        if not settled and held.key[-1] == 0:
                            held.among(threshold)
                        yield batch_of(*held.out())
                    held, settled = _Unit(key), False
                if not visits[i]:
                    held.add(ids[i:j], n[i:j], unit[i:j])
                    continue
                if not settled:
                    if key[-1] == 0:  # of the parts that a block's visitors are dealt to, one compares the residents
                        held.among(threshold)
                    settled = True
                for at in range(i, j, MEET_ROWS):
                    to = min(j, at + MEET_ROWS)
                    met = held.meet(ids[at:to], n[at:to], unit[at:to], threshold)
                    if len(met[0]):
                        yield batch_of(*met)
        if held is not None:
            if not settled and held.key[-1] == 0:
                held.among(threshold)
            yield batch_of(*held.out())

    return run


def seated(placed: DataFrame, block_rows: int, part_rows: int) -> DataFrame:
    """The items at each block that they live in or visit.

    Residents of a cell are dealt to blocks. A block meets itself, the residents of the higher blocks and all visitors of its cell, who come to it in
    parts: so a resident is copied once for each part and lower block, a visitor once for each block, and two visitors never meet.
    """
    sizes = placed.groupBy("label", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows"))
    sizes = sizes.select("label", "cell", F.ceil(F.col("homes") / block_rows).alias("blocks"), F.ceil(F.col("rows") / part_rows).alias("parts"))
    sizes = stored(sizes, "sizes")  # a row for each cell: Spark sees that it is small, and no vector moves to meet it
    block, part = F.pmod(F.xxhash64("id"), F.col("blocks")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    seat = lambda b, p, visits: F.struct(b.alias("block"), p.alias("part"), F.lit(visits).alias("visits"))
    own = F.transform(upto(F.col("parts")), lambda p: seat(block, p, False))
    calls = F.transform(upto(F.when(F.col("home"), block).otherwise(F.col("blocks"))), lambda b: seat(b, part, True))
    seats = placed.join(sizes, ["label", "cell"]).withColumn("_seat", F.explode(F.when(F.col("home"), F.concat(own, calls)).otherwise(calls)))
    return seats.select("label", "cell", "_seat.*", "id", "n", "vector")


def linked_in_cells(placed: DataFrame, threshold: float, block_rows: int, part_rows: int) -> DataFrame:
    """(id, root, links) for items with links, some with several rows: links are to be added up, roots are edges."""
    dealt = seated(placed, block_rows, part_rows).repartition(*UNIT).sortWithinPartitions(*UNIT, "visits")
    return dealt.mapInArrow(_compare(threshold), "id long, root long, links long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, vector, label).

    Vectors with the same label are linked at a cosine of at least ``threshold``. A null label links with nothing; neither does a vector that
    is null, empty, zero or holds null or non-finite components, nor do vectors of different lengths. Repeated rows are vectors of their own that link. A row without
    vec_id takes no part: no links, no component, kept.
    """
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0) & (size < float("inf")), F.lit(False))
    good = rows.where(usable)
    classes = good.groupBy("label", F.col("v").alias("vector")).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    items = stored(classes, "vectors")
    # vectors of another length are in another group
    lengths = items.select(F.size("vector").alias("d")).distinct().collect()
    edges, counts = None, None
    for (d,) in lengths:
        own = items.where(F.size("vector") == d)
        shared = vectors.sparkSession.sparkContext.broadcast(fit_cells(own))
        placed = stored(own.mapInArrow(_assigner(shared, threshold), "label int, cell long, home boolean, id long, n long, vector array<double>"), "cells")
        found = stored(linked_in_cells(placed, threshold, BLOCK_ROWS, PART_ROWS), "found")
        edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")) if edges is None else edges.union(found.select("id", "root"))
        counts = found.select("id", "links") if counts is None else counts.union(found.select("id", "links"))
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                        F.lit(True).alias("kept"), usable.alias("_usable"))
    alone = plain.where("NOT _usable").drop("_usable")
    if edges is None:
        return alone
    label = components(edges)
    per = (items.join(counts.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(label, "id", "left")
           .select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    linked = good.withColumnRenamed("v", "vector").join(per, ["label", "vector"]).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(id, to_id) AS (SELECT vec_id, vec_id FROM good UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a),
lowest AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY 1),
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(l.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(l.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN lowest l ON l.id = e.vec_id LEFT JOIN degree d ON d.id = e.vec_id
"""


@query("op10_embedding_dedup", SQL)
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
