"""Links between items that share keys, without a list of all pairs: leaders, verification, union-find.

``stars`` gathers, for every key, its smallest item (the leader) and pairs each other item with it. A task first does so among its own
items and sends one item per key on, so a key that a third of all items share is no larger than the number of tasks. A verified pair
links. Where nothing follows, or where very many items of a key are apart, these are looked at again with another leader, and get new keys from longer
runs of their signatures, which fewer unlike items share. These steps make no more pairs than they have postings. What then is still apart under one of the
first keys is compared item by item inside tasks (``leftover``), so a pair that shares a key is never left out; only pairs that may be links come out
of it as rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skybias.llm import minhash, texts
from skybias.llm.tables import stored

POSTINGS_HELD, EDGES_PER_BLOCK = 1 << 21, 1 << 20
CELL, PAIRS_HELD, ROWS_HELD = 2048, 1 << 18, 1 << 14  # items of a side of a cell; pairs and rows that a task looks at in one go
MANY = 1 << 16  # items of a key that get longer runs before they are compared pair by pair
PAIRS = "id long, leader long, key long"


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges (a, b): every id, and the smallest id it reaches."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, parent = place[:len(a)], place[len(a):], np.arange(len(ids))
    while len(x):
        rx, ry = parent[x], parent[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
    return ids, ids[parent]


def _joined(group: pa.Table) -> pa.Table:
    ids, root = _forest(group.column("a").to_numpy(), group.column("b").to_numpy())
    return pa.table([pa.array(ids), pa.array(root)], ["id", "component"])


def components(edges: DataFrame, block: int = EDGES_PER_BLOCK) -> DataFrame:
    """(id, component) of every end of an edge (a, b): the smallest id that can be reached.

    Blocks of at most about ``block`` edges are joined by union-find, each in a task of its own; the forests that they leave are joined
    over all blocks. There each round hangs every id below its smallest neighbour and contracts the edges; the number of ids at
    least halves. One block needs no such round.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    blocks = max(1, -(-edges.count() // block))
    number = F.pmod(F.xxhash64("a", "b"), F.lit(blocks)).alias("block")
    forest = stored(edges.groupBy(number).applyInArrow(_joined, "id long, component long"), "forest")
    if blocks == 1:
        return forest
    edges = stored(forest.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).distinct(), "edges")
    found = None
    while found is None or not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(ends.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("component")), "parents")
        if found is None:
            found = parent
        else:
            up = parent.select(F.col("id").alias("component"), F.col("component").alias("up"))
            found = stored(found.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "components")
        low = parent.select(F.col("id").alias("a"), F.col("component").alias("x"))
        high = parent.select(F.col("id").alias("b"), F.col("component").alias("y"))
        moved = edges.join(low, "a").join(high, "b").where("x <> y")
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return found


def extended(label: DataFrame, edges: DataFrame) -> DataFrame:
    """``label`` (id, component) after ``edges`` (a, b) are added: only those between components are followed."""
    rows = _labelled(_labelled(edges, label, "a", "x"), label, "b", "y").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    up = components(rows)
    moved = label.join(up.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left")
    moved = moved.select("id", F.coalesce("up", "component").alias("component"))
    return stored(moved.unionByName(up.join(label.select("id"), "id", "left_anti").select("id", "component")), "components")


def _lead(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order, their ids, and the smallest id of each key."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    leader = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(keys)))) if len(keys) else ids
    return keys, ids, leader


def stars(items: DataFrame, buckets: int) -> DataFrame:
    """(id, leader, key) of ``items`` (id long, keys binary of 64-bit numbers), ids unlike their leader only."""
    def packed(bucket: np.ndarray, keys: np.ndarray, ids: np.ndarray, leader: np.ndarray | None) -> pa.RecordBatch:
        order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        cut = [*first[1:], len(order)]
        columns = [[x[order[i:j]].tobytes() if x is not None else b"" for i, j in zip(first, cut, strict=True)] for x in (keys, ids, leader)]
        return pa.record_batch([pa.array(names.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "keys", "ids", "leaders"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            keys, ids, leader = _lead(np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held]))
            held.clear()
            # leaders meet by key; an item that has its leader here goes anywhere
            own = ids == leader
            if own.any():
                yield packed(keys[own] % np.uint64(buckets), keys[own], ids[own], None)
            keys, ids, leader = keys[~own], ids[~own], leader[~own]
            if len(ids):
                yield packed(texts.mix(ids.view(np.uint64) + keys) % np.uint64(buckets), keys, ids, leader)

        for batch in batches:
            data = batch.column("keys").to_pylist()
            flat = np.frombuffer(b"".join(data), np.uint64)
            held.append((flat, np.repeat(batch.column("id").to_numpy(), [len(x) // 8 for x in data])))
            size += len(flat)
            if size >= POSTINGS_HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("keys", "ids", "leaders")), strict=True))
        keys, ids = (np.frombuffer(b"".join(r[i] for r in rows if not r[2]), t) for i, t in ((0, np.uint64), (1, np.int64)))
        keys, ids, leader = _lead(keys, ids)
        far = ids != leader
        local = [np.frombuffer(b"".join(r[i] for r in rows if r[2]), np.int64) for i in (1, 2, 0)]
        out = [np.concatenate(x) for x in zip(local, (ids[far], leader[far], keys[far].view(np.int64)), strict=True)]
        return pa.table([pa.array(x) for x in out], ["id", "leader", "key"])

    sent = items.select("id", "keys").mapInArrow(gather, "bucket int, keys binary, ids binary, leaders binary")
    return sent.groupBy("bucket").applyInArrow(meet, PAIRS)


def agreeing(pairs: DataFrame, items: DataFrame, width: int, share: float) -> DataFrame:
    """Pairs (a, b) whose signatures (``width`` 16-bit values, column ``signature`` of ``items``) agree in that share of coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (_matrix(batch.column(f"s{c}"), np.uint16) for c in "ab")
            keep = pa.array((one == two).sum(1) >= share * width)
            yield pa.record_batch([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    for side in "ba":
        pairs = pairs.join(items.select(F.col("id").alias(side), F.col("signature").alias(f"s{side}")), side)
    return stored(pairs.mapInArrow(run, "a long, b long"), "matches")


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _cells(keyed: DataFrame, least: float, cell: int) -> DataFrame:
    """``keyed`` (id, key, label, size), every row with the cells it is compared in, and its side there.

    A key of at most ``cell`` items is one cell. A larger one is cut by size, so finely that sizes of a ratio of at least ``least`` lie in the
    same class or in neighbouring ones, and each class into chunks: a cell is a chunk (side 0: all pairs) or two chunks of one or two classes
    (sides 1 and 2). Any two items of a key that may be alike meet in exactly one cell.
    """
    large = stored(keyed.groupBy("key").count().where(F.col("count") > cell).select("key"), "large")
    rows = keyed.join(large, "key", "left_anti").withColumn("at", F.struct(F.xxhash64("key").alias("cell"), F.lit(0).alias("side")))
    if large.isEmpty():
        return rows
    wide = keyed.join(large, "key").withColumn("class", F.floor(F.log(F.greatest("size", F.lit(1))) / -math.log(least * 0.999)))
    chunks = stored(wide.groupBy("key", "class").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("n")), "chunks")
    for name, step in (("up", 1), ("down", -1)):
        near = chunks.select("key", (F.col("class") - step).alias("class"), F.col("n").alias(name))
        chunks = chunks.join(near, ["key", "class"], "left").fillna(0, name)
    wide = wide.join(chunks, ["key", "class"]).withColumn("h", F.pmod(F.xxhash64("id"), "n").cast("int"))
    wide = wide.withColumn("at", F.explode(F.expr("""concat(
        transform(sequence(0, n - 1), j -> struct(xxhash64(key, class, 0, least(h, j), greatest(h, j)) AS cell, if(j = h, 0, if(h < j, 1, 2)) AS side)),
        transform(filter(sequence(0, down), j -> j < down), j -> struct(xxhash64(key, class, 1, h, j) AS cell, 1 AS side)),
        transform(filter(sequence(0, up), j -> j < up), j -> struct(xxhash64(key, class + 1, 1, j, h) AS cell, 2 AS side)))""")))
    return rows.unionByName(wide.select(*rows.columns))


def leftover(keyed: DataFrame, items: DataFrame, width: int, share: float, least: float, cell: int = CELL, rows: int = 0, nearest: bool = False,
             sets: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of ``keyed`` (id, key, label) that share a key, have different labels and signatures that agree in ``share``.

    ``items`` has a ``size`` and a ``signature``, or only the ``sketch`` of one; pairs whose sizes have a ratio below ``least`` are no links. Every other pair
    of a key is compared, in a cell of at most two times ``cell`` items, which a task reads one after the other. Where keys are runs of ``rows`` coordinates
    (``coded``), a pair is a row under the first run that it shares only. ``nearest`` leaves one pair for each item, that with the most agreement.
    With ``sets`` (id, shingles: see ``minhash.brief``) pairs whose sets have too few values in common for a similarity of ``least`` are no rows.
    """
    whole, filtered = "signature" in items.columns, sets is not None and not nearest
    held_as, kind = ("signature", np.uint16) if whole else ("sketch", np.uint8)

    def alike(data: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of the items of a pair, and their agreement."""
        at, side, key, ids, label, size, sign, held = data
        brief = [np.frombuffer(x, np.uint16) if x is not None else None for x in held]
        sketch, run = minhash.sketches(sign) if whole else sign, None
        if rows and not nearest:
            run = (minhash.run_keys(sign, rows).view(np.int64) == key[:, None]).argmax(1)
        end = np.searchsorted(at, at, "right")
        todo = end - np.arange(len(at)) - 1
        before, row = np.concatenate([[0], np.cumsum(todo)]), 0
        while row < len(at):
            to = max(row + 1, int(np.searchsorted(before, before[row] + PAIRS_HELD, "right")) - 1)
            x = np.repeat(np.arange(row, to), todo[row:to])
            y = x + 1 + np.arange(len(x)) - (before[x] - before[row])
            row = to
            low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            keep = (label[x] != label[y]) & ((side[x] == 0) | (side[x] != side[y])) & (low >= least * high * (1 - 1e-9))
            x, y = x[keep], y[keep]
            for i in range(0, len(x), ROWS_HELD):
                p, q = x[i:i + ROWS_HELD], y[i:i + ROWS_HELD]
                n = minhash.sketch_agreement(sketch[p], sketch[q], width)
                keep = n >= share * width
                p, q, n = p[keep], q[keep], n[keep]
                if whole:
                    equal = sign[p] == sign[q]
                    n = equal.sum(1)
                    keep = n >= share * width
                    if run is not None:
                        keep &= equal[:, :width // rows * rows].reshape(len(p), width // rows, rows).all(2).argmax(1) == run[p]
                    p, q, n = p[keep], q[keep], n[keep]
                    if filtered:
                        keep = minhash.may_be_alike(p, q, brief, size, least)
                        p, q, n = p[keep], q[keep], n[keep]
                yield p, q, n

    def pairs(data: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, best = data[3], np.zeros(len(data[0]), np.int64)
        for p, q, n in alike(data):
            if nearest:
                np.maximum.at(best, p, n.astype(np.int64) << 32 | q)
                np.maximum.at(best, q, n.astype(np.int64) << 32 | p)
            elif len(p):
                p, q = ids[p], ids[q]
                yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(n)], ["a", "b", "n"])
        p = np.flatnonzero(best)
        yield pa.record_batch([pa.array(ids[p]), pa.array(ids[best[p] & 0xFFFFFFFF]), pa.array(best[p] >> 32)], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side", "key", "id", "label", "size")] 
                            + [_matrix(batch.column(held_as), kind), np.array([*batch.column("shingles").to_pylist(), None], object)[:-1]])
                size += batch.num_rows
            if size >= ROWS_HELD:
                data = [np.concatenate(x) for x in zip(*held, strict=True)]
                # the last cell may go on in the next batch
                cut = int(np.searchsorted(data[0], data[0][-1]))
                if cut:
                    yield from pairs([x[:cut] for x in data])
                held, size = [[x[cut:] for x in data]], len(data[0]) - cut
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)])

    sized = stored(keyed.join(items.select("id", "size"), "id"), "sized")
    cells = _cells(sized, least, cell).select("at.*", "key", "id", "label", "size")
    cells = cells.join(items.select("id", held_as), "id")
    cells = cells.withColumn("shingles", F.lit(None).cast("binary")) if not filtered else cells.join(sets, "id", "left")
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    found = cells.mapInArrow(run, "a long, b long, n long")
    if nearest:
        found = found.groupBy("a").agg(F.max(F.struct("n", "b")).alias("s")).select(F.least("a", "s.b").alias("a"), F.greatest("a", "s.b").alias("b"))
    elif rows and whole:
        return stored(found.select("a", "b"), "leftover")
    return stored(found.select("a", "b").distinct(), "leftover")


def least_share(threshold: float, width: int) -> float:
    """Share of coordinates in which a pair at the threshold agrees but for one time in some ten millions."""
    return threshold - 5.5 * (threshold * (1 - threshold) / width) ** 0.5


def coded(items: DataFrame, width: int, rows: int) -> DataFrame:
    """(id, keys) of ``items``: a key for each run of ``rows`` coordinates."""
    return _coded(items, width, rows, np.arange(width), 0)


def recoded(items: DataFrame, width: int, rows: int, runs: int, seed: int) -> DataFrame:
    """(id, keys) of ``items``: keys of at least ``runs`` runs of ``rows`` coordinates, over shuffled signatures."""
    rng = np.random.default_rng(seed)
    each = width // rows
    return _coded(items, width, rows, np.concatenate([rng.permutation(width)[:each * rows] for _ in range(-(-runs // each))]), seed)


def _coded(items: DataFrame, width: int, rows: int, chosen: np.ndarray, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = minhash.run_keys(_matrix(batch.column("signature"), np.uint16).reshape(-1, width)[:, chosen] + np.uint64(seed << 16), rows)
            yield pa.record_batch([batch.column("id"), fixed(keys)], ["id", "keys"])

    return items.select("id", "signature").mapInArrow(run, "id long, keys binary")


def fixed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)),
                                                          pa.py_buffer(np.ascontiguousarray(rows))])


def link(items: DataFrame, verify: Callable[[DataFrame], DataFrame], finer: Callable[[DataFrame, int], DataFrame | None],
         buckets: int, rest: Callable[[DataFrame, bool], DataFrame] | None = None, confirm: Callable[[DataFrame], DataFrame] | None = None,
         meeting: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges a, b; components id, component) of ``items`` (id, keys), linked where ``verify`` says so.

    ``verify`` takes distinct pairs (a, b), a < b, and returns those that are links. ``finer`` takes ids that are still apart under a key and
    the number of times that happened, and returns their next keys (id, keys), or None after the last ones. ``rest`` takes what is then
    still apart (id, key, label) under the first keys and returns all its pairs that may be links, or the likeliest one of every item; ``confirm``
    (or else ``verify``) says which of them are. ``meeting`` is told first which items (id) share a key with another: none but
    these are in what the others take. With ``rest`` only keys of more than ``MANY`` items that are apart get longer runs.
    """
    pair = [F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")]
    tried = edges = label = first = None

    def settle(new: DataFrame, verify: Callable[[DataFrame], DataFrame] = verify) -> int:
        """Verify pairs that are not ``tried`` yet; returns the number of links."""
        nonlocal tried, edges, label
        if tried is None:
            tried = stored(new, "pairs")
            edges = stored(verify(tried), "links")
            label = components(edges)
            return edges.count()
        new = stored(new.join(tried, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            return 0
        linked, tried = stored(verify(new), "links"), tried.unionByName(new)
        if n := linked.count():
            edges, label = edges.unionByName(linked), extended(label, linked)
        return n

    def apart(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """Postings (id, key, label), of ``ids`` only if given, under keys that hold several components."""
        now = _labelled(rows, label, "id", "label") if ids is None else rows.join(_labelled(ids, label, "id", "label"), "id")
        several = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        return stored(now.join(several, "key", "left_semi"), "keyed")

    def between(star: DataFrame) -> DataFrame:
        """Rows of ``star`` whose ends are in different components."""
        return _labelled(_labelled(star, label, "id", "x"), label, "leader", "y").where("x <> y")

    level = 0
    while items is not None:
        star = stored(stars(items, buckets), "stars")
        if label is None:
            if meeting:
                meeting(star.select("id").union(star.select("leader")).distinct())
            # one leader an item: near copies meet in a few of them, and what that joins needs no other pair
            settle(star.groupBy("id").agg(F.min("leader").alias("leader")).select(*pair).distinct())
        settle(between(star).select(*pair).distinct())
        open_keys = stored(between(star).select("key").distinct(), "open")
        if open_keys.isEmpty():
            break
        # the stars of a key name all its items
        under = star.join(open_keys, "key", "left_semi")
        keyed = apart(under.select("id", "key").union(under.select("leader", "key")).distinct())
        first = keyed if first is None else first
        if rest:
            keyed = stored(keyed.join(keyed.groupBy("key").count().where(F.col("count") > MANY), "key", "left_semi"), "many")
            if keyed.isEmpty():
                break
        # another leader, drawn anew for every key
        draw = F.struct(F.xxhash64(F.lit(level), "key", "id").alias("h"), F.col("id").alias("leader"), F.col("label").alias("led"))
        leaders = keyed.groupBy("key").agg(F.min(draw).alias("s")).select("key", "s.leader", "s.led")
        settle(keyed.join(leaders, "key").where("label <> led").select(*pair).distinct())
        ids = stored(apart(keyed.drop("label")).select("id").distinct(), "apart")
        level += 1
        items = None if ids.isEmpty() else finer(ids, level)
        items = items if items is None else stored(items, "finer")
    if rest and first is not None:
        left = apart(first.drop("label")) if level else first
        # the nearest of every item first, as long as that joins many: what it joins needs none of its other pairs
        again = True
        while again and not left.isEmpty():
            near = rest(left, True)
            # an item that has no like one now has none later
            ends = stored(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "ends")
            again = 10 * settle(near, confirm or verify) > near.count()
            left = apart(left.drop("label"), ends)
        if not left.isEmpty():
            settle(rest(left, False), confirm or verify)
    return edges, label


def _labelled(rows: DataFrame, label: DataFrame, column: str, name: str) -> DataFrame:
    """Add the component of an id, which is itself if it has no link."""
    found = label.select(F.col("id").alias(column), F.col("component").alias("_c"))
    return rows.join(found, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def smallest(groups: DataFrame, by: str, order: str) -> DataFrame:
    return groups.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_n = 1").drop("_n")
