"""Quality votes, the conversation trie and whitening against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from skybias.llm import conversation_trie as trie
from skybias.llm import quality as q
from skybias.llm import toxicity
from skybias.llm import whitening as w

DOCS = "doc_id long, text string, score string, predicted string, quality int"
LABELS = "doc_id long, quality int, text string"
TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, n int, component string"


# --- quality --------------------------------------------------------------------------------------

def _prose(i: int) -> str:
    return " ".join(f"word{(i * 7 + j * j) % 50} and so on," for j in range(30))


def _junk(i: int) -> str:
    return " ".join(f"WORD{(i + j) % 20}!!" for j in range(40)) if i % 2 else f"again{i} " * 60


def test_votes_find_junk_in_held_out_texts(spark):
    rows = [(i, _junk(i) if i % 3 == 0 else _prose(i), "x", "y", 5) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), "z") for i in range(300)], LABELS)
    out = q.quality(docs, labels).collect()
    assert len(out) == 300
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in out if r["held_out"])
    # what is held out has no influence: other labels there, the same scores
    turned = spark.createDataFrame([(i, int((i % 3 != 0) ^ (zlib.crc32(str(i).encode()) % 5 == 0)), "z") for i in range(300)], LABELS)
    assert {r["doc_id"]: r["score"] for r in q.quality(docs, turned).collect()} == {r["doc_id"]: r["score"] for r in out}


def test_votes_equal_a_plain_search():
    draws = np.random.default_rng(1)
    x, labelled, label = draws.normal(size=(300, 6)), draws.normal(size=(90, 6)), draws.integers(0, 2, 90).astype(float)
    x, labelled = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, labelled))
    x[7] = 0
    got = q.vote(x, labelled, label, 5, 0.25)
    for i, row in enumerate(x):
        near = sorted(range(90), key=lambda j: -(row @ labelled[j]))[:5]
        weight = np.maximum([row @ labelled[j] for j in near], 0)
        assert got[i] == pytest.approx(0.25 if i == 7 else (weight @ label[near]) / weight.sum(), abs=1e-8)
    # ties: all rows as near as the last neighbour vote
    assert q.vote(np.array([[1.0, 0]]), np.array([[1.0, 0], [1, 0], [1, 0], [0, 1]]), np.array([1.0, 0, 0, 1]), 1, 0.5)[0] == pytest.approx(1 / 3)
    assert q.vote(np.ones((2, 3)), np.zeros((0, 3)), np.zeros(0), 5, 0.5).tolist() == [0.5, 0.5]


def test_latent_basis_equals_a_plain_decomposition(spark):
    draws, rows, dense = np.random.default_rng(0), [], np.zeros((60, q.BUCKETS))
    for i in range(60):
        at = np.unique(np.append(draws.integers(0, 40, 8), i % 3))
        value = draws.uniform(0.1, 1, len(at)) * np.where(at < 3, 6, 1)
        dense[i, at] = value
        rows.append((bytearray(at.astype(np.int32).tobytes()), bytearray(value.astype(np.float32).tobytes())))
    basis = q.latent_basis(spark.createDataFrame(rows, "bucket binary, value binary").repartition(4), 3, 12)
    right = np.linalg.svd(dense[:, :64], full_matrices=False)[2][:3].T
    assert np.linalg.svd(basis[:64].T @ right)[1] == pytest.approx(np.ones(3), abs=1e-3)


def test_document_frequencies_cover_all_documents(spark):
    docs = spark.createDataFrame([(f"common word{i}",) for i in range(50)] + [(None,), ("",)], "text string").repartition(5)
    idf = q.inverse_frequencies(docs)
    counts = defaultdict(int)
    for text in [f"common word{i}" for i in range(50)]:
        for _, _, _, bucket, _ in q.term_counts(pa.array([text])):
            for b in bucket.tolist():
                counts[b] += 1
    assert all(idf[b] == pytest.approx(np.log(53 / (n + 1)), abs=1e-5) for b, n in counts.items())


def test_quality_edges(spark):
    rows = [(i, _prose(i), "x", "y", 1) for i in range(20)]
    rows += [(None, "some text", None, None, None), (101, None, None, None, None), (102, "", "", "", 0), (103, "w " * 400_000, "", "", 0), (104, _prose(1), "", "", 0), (104, _prose(1), "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, "") for i in range(10)] + [(i, 0, "") for i in range(10, 20)] + [(3, 0, ""), (None, 1, ""), (4, None, ""), (5, 7, ""), (9999, 1, "")], LABELS)
    out = q.quality(docs, labels).collect()
    assert len(out) == 26 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r["score"])
    assert by[101] == by[102] and by[104][0] == by[104][1] and not [r for r in out if r["doc_id"] is None][0]["held_out"]
    assert q.quality(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert q.quality(docs.limit(0), labels).count() == 0


# --- labelled documents of the toxicity operator ---------------------------------------------------

def test_likely_labelled_rows_hold_all_labelled_ones(spark):
    docs = spark.createDataFrame([(i * 7 - 3000, f"t{i}") for i in range(1000)] + [(None, "x")], "doc_id long, text string").repartition(5)
    ids = spark.createDataFrame([(i * 21 - 3000,) for i in range(200)] + [(10**15,)], "doc_id long").repartition(3)
    kept = [r["doc_id"] for r in toxicity.likely_labelled(docs, ids).collect()]
    wanted = {i * 21 - 3000 for i in range(200)} & {i * 7 - 3000 for i in range(1000)}
    assert wanted <= set(kept) and len(kept) < len(wanted) + 20
    assert toxicity.likely_labelled(docs, ids.limit(0)).count() == 0 and toxicity.likely_labelled(docs.limit(0), ids).count() == 0


def test_equal_texts_are_counted_once(spark):
    """Copies of a toxic text and repeated rows don't change what is learnt."""
    base = [(i * 5 + 1 + i % 2, ("bad " if i % 3 == 0 else "good ") * 5 + f"word{i} filler text", "a") for i in range(120)]
    labels = spark.createDataFrame([(d, int(t.startswith("bad"))) for d, t, _ in base], "doc_id long, toxic int")
    counted = [d for d, *_ in base if zlib.crc32(str(d).encode()) % 5 not in (0, 4)]
    free = [i for i in range(10_000, 10_400) if zlib.crc32(str(i).encode()) % 5 not in (0, 4)]
    text = {d: t for d, t, _ in base}
    copies = [(n, text[counted[0]], "c") for n in free]
    one = toxicity.trained(spark.createDataFrame(base, "doc_id long, text string, extra string"), labels)
    two = toxicity.trained(spark.createDataFrame(base + copies, "doc_id long, text string, extra string"),
                           labels.union(spark.createDataFrame([(n, int(text[counted[0]].startswith("bad"))) for n in free], "doc_id long, toxic int")))
    assert np.array_equal(one["score"], two["score"]) and one["beta"] == pytest.approx(two["beta"])


# --- conversation trie ----------------------------------------------------------------------------

def _plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in turns.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path) == d))
    out = {}
    for prefix, found in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(x) == len(p) + 1 and x[:len(p)] == p for x in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c, last in sorted(found) if last)
        out[min(found)[0], len(prefix)] = (min(members[prefix[:-1]])[0] if prefix else None, len(found), len(children), len(leaves), saved,
                                           hashlib.sha256(ends.encode()).hexdigest())
    return out


def _found(rows):
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("shard_turns", [3, 40, 100_000])
def test_trie_equals_a_plain_one_for_every_shard_size(spark, shard_turns):
    draws = np.random.default_rng(3)
    rows = []
    for c in range(260):
        # a third are copies of one conversation, a third share a start, some are long
        kind = c % 3
        length = 3 if kind == 0 else int(draws.integers(1, 6)) + (40 if c == 100 else 0)
        for t in range(length):
            text = f"copy {t}" if kind == 0 else f"start {t}" if kind == 1 and t < 2 else f"a b {draws.integers(0, 3)}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    assert _found(trie.conversation_trie(spark.createDataFrame(rows, TURNS), shard_turns).collect()) == _plain_trie(rows)


def test_trie_edges(spark):
    rows = [(40, None, None, None), (40, 2, "user", "x\ty  z"), (41, 1, "user", ""), (41, 1, "user", ""), (None, 1, "user", "gone"), (55, 5, "user", "word " * 50_000), (56, 1, "a", "b"), (57, None, "", ""),
            (-5, 1, "a", "b"), (1 << 40, 0, "user", "only")]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], f"{TURNS}, depth string, n_convs int")
    want = _plain_trie([r for r in rows if r[0] != -5])
    got = _found(trie.conversation_trie(table.where("conv_id IS NULL OR conv_id <> -5")).collect())
    assert got == want
    assert trie.conversation_trie(table.limit(0)).count() == 0
    # ties are in a fixed order
    tied = [(7, 1, "a", "x"), (7, 1, "b", "y"), (8, 1, "b", "y"), (8, 1, "a", "x")]
    first, second = (trie.conversation_trie(spark.createDataFrame(r, TURNS)).collect() for r in (tied, tied[::-1]))
    assert _found(first) == _found(second)


def test_find_close_on_random_parentheses():
    draws = np.random.default_rng(5)
    for size in (1, 2, 40, 700, 5000):
        bits, depth = [True], 1
        while len(bits) + depth < 2 * size:
            up = depth == 1 or draws.random() < 0.5
            bits.append(bool(up))
            depth += 1 if up else -1
        bits = np.array(bits + [False] * depth)
        stack, want = [], {}
        for i, b in enumerate(bits.tolist()):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(bits)
        assert trie.find_close(bits, at).tolist() == [want[i] for i in at.tolist()]


# --- whitening ------------------------------------------------------------------------------------

def _plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    return ((n * x - s) ** 2).sum(1), (x - s / n) @ basis / np.sqrt(np.maximum(values, 1e-30)), values / values.sum()


def test_whitening_equals_eigh(spark):
    vectors = (np.random.default_rng(0).normal(size=(400, 10)) @ np.diag(np.arange(1, 11)) / 20).astype(np.float32)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(vectors)]
    out = w.whitened(spark.createDataFrame(rows, VECTORS).repartition(5)).orderBy("component", "vec_id").collect()
    deviation, white, share = _plain_whitening(vectors)
    assert len(out) == 400 * 8 and {r["n"] for r in out} == {400}
    for k, part in groupby(out, lambda r: r["component"]):
        part = list(part)
        got = np.array([r["whitened"] for r in part])
        assert min(np.abs(got - white[:, k - 1]).max(), np.abs(got + white[:, k - 1]).max()) < 1e-10
        assert [r["deviation"] for r in part] == deviation.tolist()
        assert part[0]["explained"] == pytest.approx(share[k - 1], rel=1e-12)
    assert out[0]["identity_error"] < 1e-12


def test_polynomial_roots_and_repeated_roots(spark):
    draws = np.random.default_rng(2)
    half = draws.integers(-30, 30, (7, 4)).astype(object)
    a = half @ half.T  # rank 4: the root 0 occurs three times
    poly = w.characteristic_polynomial(spark, a)
    assert poly[:3] == [0, 0, 0] and poly[7] == 1
    assert poly[6] == -sum(a[i, i] for i in range(7))
    assert w.roots_above(poly, 0) == 4 and w.roots_above(poly, -1) == 7
    roots = w.leading_roots(poly, int(sum(a[i, i] for i in range(7))), 7)
    assert [m for _, _, m in roots] == [1, 1, 1, 1, 3] and roots[-1][0] == 0
    assert [r / 2 ** s for r, s, _ in roots[:4]] == pytest.approx(np.linalg.eigvalsh(a.astype(float))[::-1][:4], rel=1e-9)
    twice = np.diag(np.array([5, 9, 9, 2], object))
    assert [(r / 2 ** s, m) for r, s, m in w.leading_roots(w.characteristic_polynomial(spark, twice), 25, 4)] == [(9.0, 2), (5.0, 1), (2.0, 1)]
    plane = w.null_space(twice, 9 << w.BITS, 2)
    assert np.abs(plane @ plane.T - np.eye(2)).max() < 1e-12 and np.abs(plane[:, [0, 3]]).max() < 1e-12


def test_exact_sums_of_large_entries():
    import pyarrow as pa
    draws = np.random.default_rng(4)
    for scale in (1.0, 1e5, 1e14):
        x = draws.normal(size=(50, 3)) * scale
        part = next(w._products(iter([pa.record_batch([pa.array(x.tolist(), pa.list_(pa.float64()))], ["vector"])])))
        whole = np.array([[1, *(int(v) for v in row)] for row in np.floor(1024 * x)], object)
        want = whole.T @ whole
        for r in part.to_pylist():
            assert sum(r[f"l{k}"] << (w.LIMB * k) for k in range(w.LIMBS)) == want[r["i"], r["j"]]


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0, ""), (2, [1.0, None], 0, ""), (3, [nan, 1.0], 0, ""), (4, [inf, 1.0], 0, ""), (5, [], 0, ""), (None, [1.0, 0.0], 0, ""), (7, [0.0, 1.0], 0, ""), (7, [0.0, 1.0], 0, ""),
            (8, [3.0, -1.0], 0, ""), (9, [1.0, 2.0, 3.0], 0, "")]
    out = w.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    two = [r for r in out if r["n"] == 4]
    assert sorted((r["vec_id"] or 0, r["component"]) for r in two) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2)]
    assert max(r["identity_error"] for r in two) < 1e-12
    # a single vector of its length has no direction
    one = [r for r in out if r["n"] == 1]
    assert [r["component"] for r in one] == [1, 2, 3] and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in one)
    # in one plane: the third eigenvalue is 0
    flat = spark.createDataFrame([(i, [float(i % 5), float(i % 3), float(i % 5)], 0, "") for i in range(30)], VECTORS)
    third = [r for r in w.whitened(flat).collect() if r["component"] == 3]
    assert all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] < 1e-10 for r in third)
    assert w.whitened(flat.limit(0)).count() == 0
