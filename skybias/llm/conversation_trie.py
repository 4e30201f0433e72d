"""Prefix trie of conversations, in balanced parentheses.

Conversations, as sequences of turn digests, are sorted and dealt by ranges to shards, so copies of one conversation and conversations with a
common start may fill any number of shards. A shard writes its trie as balanced parentheses. The excess (opened less closed) of blocks and
of ever larger ranges of blocks is kept as a minimum, and ``find_close`` jumps over ranges whose minimum is too high. A subtree is what lies
between a parenthesis and its partner: the rank of "()" counts its leaves, cumulative sums over nodes and rows give its words.

Only the nodes on a shard's first and last path (its spines) can occur in other shards. Their counts are made additive: a node that the shard
before has on its last path is not new here, and a last path that the next shard goes on with ends in no leaf. Then they are summed by node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skybias.llm.registry import query
from skybias.llm.tables import stored, table
from skybias.llm.texts import WORD

GROUP, SHARED_TURNS = 20, 4
BLOCK, SHARD_TURNS, LARGE_SHARD_TURNS, CHUNK_IDS = 64, 1 << 14, 1 << 20, 4096
NO_IDS = hashlib.sha256(b"").hexdigest()
NODES = ("shard int, spine boolean, on_first boolean, on_last boolean, deepest boolean, a long, b long, parent_a long, parent_b long, "
         "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, total long, once long, "
         "words long, through long, ends_sha256 string, ends array<string>")


def find_close(opened: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the partners of the parentheses opened at ``at``; ``opened`` is true for "(" and balanced."""
    excess = np.cumsum(np.where(opened, 1, -1))
    blocks = -(-len(opened) // BLOCK)
    leaves = 1 << max(0, int(blocks - 1).bit_length())
    padded = np.full(leaves * BLOCK, len(opened) + 1)
    padded[:len(opened)] = excess
    lowest = np.zeros(2 * leaves, np.int64)  # a heap: 1 is the root, leaves + i is block i
    lowest[leaves:] = padded.reshape(leaves, BLOCK).min(1)
    for level in range(leaves.bit_length() - 2, -1, -1):
        own = np.arange(1 << level, 2 << level)
        lowest[own] = np.minimum(lowest[2 * own], lowest[2 * own + 1])
    target, close = excess[at] - 1, np.full(len(at), -1)

    def scan(query: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Look from ``start`` to the end of its block; returns the queries that stay open."""
        place, end = start.copy(), (start // BLOCK + 1) * BLOCK
        while len(query):
            inside = place < end
            hit = inside & (padded[np.minimum(place, len(padded) - 1)] == target[query])
            close[query[hit]] = place[hit]
            go = inside & ~hit
            if not go.all():
                left.append(query[~inside])
                query, place, end = query[go], place[go], end[go]
            place = place + 1
        return np.concatenate(left)

    left: list[np.ndarray] = [np.zeros(0, np.int64)]
    query = scan(np.arange(len(at)), at + 1)
    node = leaves + at[query] // BLOCK
    # up to the first range on the right that gets as low, then down to its first such block
    climbing = np.ones(len(query), bool)
    while climbing.any():
        right = (node & 1 == 0) & climbing
        found = right & (lowest[np.minimum(node + 1, 2 * leaves - 1)] <= target[query])
        node = np.where(found, node + 1, np.where(climbing, node >> 1, node))
        climbing &= ~found
    while (node < leaves).any():
        inner = node < leaves
        first = np.minimum(2 * node, 2 * leaves - 1)
        node = np.where(inner, np.where(lowest[first] <= target[query], first, np.minimum(first + 1, 2 * leaves - 1)), node)
    left.clear()
    left.append(np.zeros(0, np.int64))
    scan(query, (node - leaves) * BLOCK)
    return close


def _before(x: np.ndarray) -> np.ndarray:
    """Sums of what comes before each place, and of all at the end."""
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def shard_nodes(ids: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """All nodes of a shard in preorder, the root first; rows are sorted by path and id, and row i has the turns from offsets[i] on."""
    rows, length = len(ids), np.diff(offsets)
    row = np.repeat(np.arange(rows), length)
    depth = np.arange(len(a)) - offsets[row]
    above = offsets[np.maximum(row - 1, 0)] + depth
    there = (row > 0) & (depth < length[np.maximum(row - 1, 0)])
    above = np.where(there, above, 0)
    same = there & (a[above] == a) & (b[above] == b)
    common, filled = np.zeros(rows, np.int64), length > 0
    if len(a):
        common[filled] = np.minimum.reduceat(np.where(same, length[row], depth), offsets[:-1][filled])
    new = depth >= common[row]
    nodes = 1 + int(new.sum())
    # the parentheses: each row closes what it doesn't share with the row before and opens what is new
    opens, closes = length - common, np.concatenate([[0], length[:-1] - common[1:]])
    counts = np.concatenate([[1], np.column_stack([closes, opens]).ravel(), [length[-1] + 1]])
    kinds = np.concatenate([[True], np.tile([False, True], rows), [False]])
    at_row = np.concatenate([[0], np.repeat(np.arange(rows), 2), [rows]])
    opened, at_row = np.repeat(kinds, counts), np.repeat(at_row, counts)
    at = np.flatnonzero(opened)
    close = find_close(opened, at)
    first_row, last_row = at_row[at], at_row[close]
    rank, pairs = _before(opened), _before(opened[:-1] & ~opened[1:])
    # node of every turn of every row: the last one opened at its depth
    order = np.lexsort((row, depth))
    number = np.where(new, np.cumsum(new), 0)
    node_of = np.zeros(len(a), np.int64)
    if len(a):
        group = depth[order] * (nodes + 1)
        node_of[order] = np.maximum.accumulate(number[order] + group) - group
    turn = np.flatnonzero(new)
    parent = np.zeros(nodes, np.int64)
    parent[1:] = np.where(depth[turn] > 0, node_of[np.maximum(turn - 1, 0)], 0)
    node_words, through = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    sums = _before(words)
    node_words[1:], through[1:] = words[turn], sums[turn + 1] - sums[offsets[row[turn]]]
    n = last_row - first_row
    row_words, node_sums = _before(sums[offsets[1:]] - sums[offsets[:-1]]), _before(node_words)
    ranges = np.column_stack([first_row, last_row]).ravel()
    last = np.arange(offsets[-2], offsets[-1])
    on_last = np.zeros(nodes, bool)
    on_last[np.append(0, node_of[last])] = True
    deep = np.zeros(nodes, np.int64)
    deep[1:] = depth[turn] + 1
    return {
        "conv_id": np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), ranges)[::2], "depth": deep, "parent": parent, "n_convs": n,
        "n_children": np.bincount(parent[1:], minlength=nodes), "n_leaves": pairs[close] - pairs[at],
        "total": row_words[last_row] - row_words[first_row] - n * (through - node_words), "once": node_sums[rank[close]] - node_sums[np.arange(nodes)],
        "words": node_words, "through": through, "on_first": np.arange(nodes) <= length[0], "on_last": on_last,
        "turn": np.append(-1, turn), "end": np.cumsum(opens), "last": np.append(0, node_of[last])}


def _keys(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """128-bit digests of all prefixes of a path, the empty one first."""
    running, out = hashlib.blake2b(digest_size=16), []
    for i in range(len(a) + 1):
        digest = running.copy().digest()
        out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
        if i < len(a):
            running.update(int(a[i]).to_bytes(8, "little", signed=True) + int(b[i]).to_bytes(8, "little", signed=True))
    return out


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, {"int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}.get(kind, pa.list_(pa.string())))
                        for name, kind in (part.rsplit(" ", 1) for part in NODES.split(", "))])
    rows = pa.Table.from_batches(list(batches)) if (batches := [x for x in batches if x.num_rows]) else None
    if rows is None:
        return
    path, ids = rows.column("path").combine_chunks(), rows.column("conv_id").to_numpy()
    offsets = path.offsets.to_numpy().astype(np.int64)
    a, b, words = (path.values.field(c).to_numpy() for c in ("a", "b", "words"))
    a, b, words, offsets = a[offsets[0]:offsets[-1]], b[offsets[0]:offsets[-1]], words[offsets[0]:offsets[-1]], offsets - offsets[0]
    t = shard_nodes(ids, offsets, a, b, words)
    nodes, spine = len(t["depth"]), t["on_first"] | t["on_last"]
    key: dict[int, tuple[int, int]] = {}
    for one, place in ((np.arange(offsets[1] + 1), slice(0, offsets[1])), (t["last"], slice(offsets[-2], offsets[-1]))):
        key.update(zip(one.tolist(), _keys(a[place], b[place]), strict=True))
    sha, ends = [NO_IDS] * nodes, {}
    edge = np.flatnonzero(np.append(True, t["end"][1:] != t["end"][:-1])).tolist()
    for i, j in zip(edge, [*edge[1:], len(ids)], strict=True):
        node, text = int(t["end"][i]), list(map(str, ids[i:j].tolist()))
        if spine[node]:
            ends[node] = [",".join(text[k:k + CHUNK_IDS]) for k in range(0, len(text), CHUNK_IDS)]
        else:
            sha[node] = hashlib.sha256(",".join(text).encode()).hexdigest()
    deepest, shard = np.zeros(nodes, bool), TaskContext.get().partitionId()
    deepest[t["last"][-1]] = True
    parent, step = t["parent"], 1 << 13
    outside = spine[parent]  # the parent's smallest member may lie in another shard
    outside[0] = False
    inside = ~outside
    inside[0] = False
    for i in range(0, nodes, step):
        part = range(i, min(i + step, nodes))
        s = slice(part.start, part.stop)
        own, up = [key.get(v, (None, None)) for v in part], [key[int(parent[v])] if outside[v] else (None, None) for v in part]
        columns = {c: t[c][s] for c in ("on_first", "on_last", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "total", "once", "words", "through")}
        columns |= {"shard": [shard] * len(part), "spine": spine[s], "deepest": deepest[s], "a": [k[0] for k in own], "b": [k[1] for k in own],
                    "parent_a": [k[0] for k in up], "parent_b": [k[1] for k in up],
                    "parent_conv_id": pa.array(t["conv_id"][parent[s]], mask=~inside[s]), "ends_sha256": sha[s], "ends": [ends.get(v) for v in part]}
        yield pa.record_batch([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows with the same node; the ids pass by and are not kept."""
    node, running, done = None, None, []
    for batch in batches:
        for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
            if (a, b) != node:
                if node:
                    done.append((*node, running.hexdigest()))
                node, running = (a, b), hashlib.sha256()
                running.update(text.encode())
            else:
                running.update(b"," + text.encode())
    if node:
        done.append((*node, running.hexdigest()))
    yield pa.record_batch([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])


def rebuilt(conversations: DataFrame, group: int = GROUP, shared: int = SHARED_TURNS) -> DataFrame:
    """(conv_id, path): the first h turns of conversation c - c % group, then c's own after its first h; h is a hash of c below ``shared``.

    A turn is two hashes of its role and text and its number of words: 24 bytes, whatever its text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", F.expr(f"conv_id - conv_id % {group}").alias("base"),
        F.struct("turn", *[F.xxhash64(F.lit(i), role, text).alias(c) for i, c in ((1, "a"), (2, "b"))],
                 F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("turn"))
    # dealt by base: the join below finds both sides in place
    whole = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    heads = whole.where("conv_id = base").select("base", F.slice("turns", 1, shared).alias("head"))
    h = f"int(crc32(cast(cast(conv_id AS string) AS binary)) % {shared})"
    path = f"concat(slice(coalesce(head, slice(turns, 1, 0)), 1, {h}), slice(turns, {h} + 1, size(turns)))"
    return whole.join(heads, "base", "left").selectExpr("conv_id", f"transform({path}, t -> struct(t.a, t.b, t.words)) AS path")


def conversation_trie(conversations: DataFrame, shard_turns: int | None = None) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations of ``conversations`` (conv_id, turn, role, text).

    Turns are in the order of ``turn``, null first; ties are ordered by a hash of role and text, and repeated rows are turns of their own. Null roles
    and texts are empty. Rows without conv_id are left out; an empty table has no node, not even a root. Other columns are ignored. A shard
    holds the digests of its conversations, so a task grows with a single conversation of millions of turns, but not with the number of copies.
    """
    spark = conversations.sparkSession
    paths = stored(rebuilt(conversations), "conversations")
    size = paths.agg(F.coalesce(F.sum(F.size("path") + 1), F.lit(0))).first()[0]
    shards = -(-size // shard_turns) if shard_turns else min(-(-size // SHARD_TURNS), max(4 * spark.sparkContext.defaultParallelism, -(-size // LARGE_SHARD_TURNS)))
    dealt = paths.repartitionByRange(max(1, shards), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = stored(dealt.mapInArrow(_shard, NODES), "trie")
    spine = nodes.where("spine")
    # one row per shard
    order = spine.select("shard").distinct().select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("before"))
    firsts = spine.where("on_first").select("shard", "a", "b", "depth", "through")
    lasts = spine.where("on_last").select(F.col("shard").alias("before"), "a", "b", "deepest")
    known = firsts.join(order, "shard").join(lasts, ["before", "a", "b"])
    edges = known.groupBy("before", "shard").agg(F.max("depth").alias("common"), F.max("through").alias("common_words"), F.max("deepest").alias("goes_on"))
    exact = (spine.join(edges.drop("before", "goes_on"), "shard", "left")
             .join(edges.select(F.col("before").alias("shard"), "goes_on"), "shard", "left"))
    old = F.col("on_first") & (F.col("depth") <= F.col("common"))
    exact = exact.select(
        "a", "b", "depth", "parent_a", "parent_b", "conv_id", "n_convs", "total",
        (F.col("once") - F.when(old, F.col("common_words") - F.col("through") + F.col("words")).otherwise(0)).alias("once"),
        (F.col("n_children") - F.when(old & (F.col("depth") < F.col("common")), 1).otherwise(0)).alias("n_children"),
        (F.col("n_leaves") - F.when(F.col("on_last") & F.col("goes_on"), 1).otherwise(0)).alias("n_leaves"))
    merged = exact.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("depth", "parent_a", "parent_b")],
                                         *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "total", "once")])
    chunks = spine.select("a", "b", "shard", F.posexplode("ends").alias("place", "text")).repartition("a", "b").sortWithinPartitions("a", "b", "shard", "place")
    ends = chunks.select("a", "b", "text").mapInArrow(_hashed, "a long, b long, ends_sha256 string")
    merged = stored(merged.join(ends, ["a", "b"], "left"), "spines")  # two paths per shard; Spark broadcasts it where its files are small
    parents = merged.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    plain = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves"]
    kept = [*plain, (F.col("total") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")]
    inner = nodes.where("NOT spine")
    return (inner.where("parent_a IS NULL").select(*kept)
            .union(inner.where("parent_a IS NOT NULL").drop("parent_conv_id").join(parents, ["parent_a", "parent_b"]).select(*kept))
            .union(merged.join(parents, ["parent_a", "parent_b"], "left").select(*kept)))


SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, s:
           list_reduce([xor(c, s), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rows AS (
  SELECT h.conv_id AS c, t.r, t.role, t.txt FROM heads h JOIN turns t ON t.conv_id = h.base AND t.r <= h.h
  UNION ALL SELECT h.conv_id, t.r + 1000000, t.role, t.txt FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.r > h.h),
paths AS (
  SELECT h.conv_id AS c, coalesce(p.path, []) AS path FROM heads h
  LEFT JOIN (SELECT c, list({'role': role, 'txt': txt} ORDER BY r) AS path FROM rows GROUP BY c) p ON p.c = h.conv_id),
prefixes AS (SELECT c, path, unnest(generate_series(0, len(path))) AS d FROM paths),
nodes AS (
  SELECT list_slice(path, 1, d) AS prefix, d AS depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(path) = d), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
weighed AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.prefix[-1].txt, '[^\\x20\\x09-\\x0D]+')) END AS saved,
         (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND list_slice(k.prefix, 1, n.depth) = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)),
below AS (
  SELECT up.conv_id, up.depth, sum((w.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(w.saved)::BIGINT AS saved_tokens
  FROM weighed w, unnest(generate_series(0, w.depth)) AS s(d)
  JOIN nodes up ON up.depth = s.d AND up.prefix = list_slice(w.prefix, 1, s.d) GROUP BY 1, 2)
SELECT w.conv_id, w.depth::BIGINT AS depth, w.parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       b.n_leaves, b.saved_tokens, w.ends_sha256
FROM weighed w JOIN below b ON b.conv_id = w.conv_id AND b.depth = w.depth
"""


@query("op12_conversation_trie", SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
