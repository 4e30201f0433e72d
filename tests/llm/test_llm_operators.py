"""Each operator against a plain version on small tables, with nulls, empty and repeated rows, ties and extra columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skybias.llm import bloom_lm, embedding_dedup, fingerprints, licenses, line_dedup, minhash, mixing, near_dedup, packing, separators, texts, tokens, toxicity
from skybias.llm.linking import components, extended, leftover, link

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().lower().split()


def sets(text, k, lower=True):
    w = words(text) if lower else (text or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def corpus(spark):
    base = [prose(i, 30 + 11 * i) for i in range(25)]
    edited = base[20].split()
    edited[5] = "other"
    texts_ = base + [base[3], base[3], " ".join(edited), None, "", "  \n\t ", "One", "ONE", "é ü x, y.\nline\x0bend", prose(99, 9000)]
    rows = [(i * 7, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts_)]
    return spark.createDataFrame(rows, DOCS), rows


def test_word_hashes_are_those_of_the_words():
    column = pa.array(["A b", None, "", " c\x0bc ", "é É", "b"])
    got = [(a + i, h[f[i]:f[i + 1]].tolist()) for a, b, h, f in texts.words(column) for i in range(b - a)]
    name, sizes = {}, [len(h) for _, h in got]
    for (i, h), text in zip(got, column.to_pylist(), strict=True):
        for x, w in zip(h, words(text), strict=True):
            assert name.setdefault(w, x) == x
    assert len(set(name.values())) == len(name) and sizes == [2, 0, 0, 2, 2, 1]


def test_fingerprints(spark, corpus):
    docs, rows = corpus
    extra = docs.withColumn("chunk", docs.doc_id).withColumn("sketch", docs.text)
    got = {r.doc_id: r for r in fingerprints.edit_and_compare(extra.unionByName(spark.createDataFrame([(None, "no id", "en", "a", 5)], DOCS), True)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (key, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = (sets(t, 5, lower=False) for t in (text, edited, after))
        assert got[key].n_chars == len(text)
        assert got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for like, other in ((got[key].near_edited, b), (got[key].near_next, c)):
            true, union = (len(a & other) / len(a | other), len(a | other)) if a | other else (1.0, 1)
            # five standard deviations of an estimate from half of the union
            assert like == true if true in (0, 1) else abs(like - true) <= 5 * (true * (1 - true) / union) ** 0.5 + 2 / union
    assert got[21].fingerprint == got[25 * 7].fingerprint and got[None].near_next == 0.0


def test_fingerprints_of_nothing(spark):
    assert fingerprints.edit_and_compare(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("fraction", [1 / 2, 1 / 8])
def test_sketches_of_unequal_documents(spark, fraction):
    """Long texts: a page within a book, their union, sketches of unlike fractions, and sets without a hash under the threshold."""
    book = prose(5, 9000, 100_000)
    page, other = " ".join(book.split()[1000:2000]), prose(6, 3000, 100_000)
    df = spark.createDataFrame([(book, page, other, "one two", "three four", "")], "book string, page string, other string, s string, t string, none string")
    for c in df.columns:
        df = fingerprints.with_sketch(df, c, f"{c}_sketch", fraction=fraction)
    df = fingerprints.with_sketch(df, "book", "wide_sketch", fraction=1.0)
    df = df.withColumn("all_sketch", fingerprints.merged("page_sketch", "other_sketch")).withColumn("tiny_sketch", fingerprints.merged("s_sketch", "s_sketch"))
    pairs = {"in_book": fingerprints.containment("page_sketch", "book_sketch"), "of_page": fingerprints.containment("book_sketch", "page_sketch"),
             "in_all": fingerprints.containment("page_sketch", "all_sketch"), "apart": fingerprints.likeness("page_sketch", "other_sketch"),
             "wide": fingerprints.likeness("page_sketch", "wide_sketch"), "same": fingerprints.likeness("book_sketch", "wide_sketch"),
             "small": fingerprints.likeness("s_sketch", "t_sketch"), "small_same": fingerprints.likeness("s_sketch", "tiny_sketch"),
             "none": fingerprints.containment("none_sketch", "s_sketch"), "kept": F.size("book_sketch.hashes")}
    got = df.select(*(c.alias(k) for k, c in pairs.items())).first()
    b, p = sets(book, 5), sets(page, 5)
    true = len(b & p) / len(b | p)
    error = 5 * (true * (1 - true) / (fraction * len(b | p))) ** 0.5
    assert (got.in_book, got.in_all, got.apart, got.same, got.small, got.small_same) == (1.0, 1.0, 0.0, 1.0, 0.0, 1.0)
    assert abs(got.of_page - true) < error and abs(got.wide - true) < error
    assert got.none is None and abs(got.kept / len(b) - fraction) < 5 * (fraction / len(b)) ** 0.5


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_language_model(spark, corpus, head):
    docs, rows = corpus
    docs = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "doc_id % 5 = 0 AS held_out", "lang AS word")
    model = bloom_lm.fit(docs.where("NOT held_out"), head_words=head, bucket_words=100)
    got = {r.doc_id: r for r in bloom_lm.score(docs, model).collect()}
    counts = collections.Counter(w for k, t, *_ in rows if k % 5 for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for key, text, *_ in rows:
        token = [*words(text), None]
        assert got[key].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in token))
        assert (got[key].n_tokens, got[key].n_known, got[key].train_tokens) == (len(token), sum(counts[w] > 0 for w in token), n)
    seen = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen) and all(r.score <= 0 for r in got.values())


@pytest.mark.parametrize("slice_words", [bloom_lm.SLICE_WORDS, 300])
def test_language_model_beyond_the_head(spark, corpus, monkeypatch, slice_words):
    """The head is a cache: scores are the same when most words' counts lie outside it, over one wave and over several."""
    monkeypatch.setattr(bloom_lm, "SLICE_WORDS", slice_words)
    docs = corpus[0].selectExpr("doc_id", "coalesce(text, '') AS text", "doc_id % 5 = 0 AS held_out")
    scores = []
    for head in (1 << 20, 50, 0):
        model = bloom_lm.fit(docs.where("NOT held_out"), head_words=head, bucket_words=100)
        assert len(model["head"].word) <= head and (slice_words > 300 or len(list(bloom_lm.waves(model, 0))) > 2)
        scores.append({r.doc_id: (r.score, r.base_score, r.n_known) for r in bloom_lm.score(docs, model, 64 if slice_words > 300 else 0).collect()})
    for other in scores[1:]:
        assert other.keys() == scores[0].keys()
        assert all(other[k] == pytest.approx(scores[0][k]) for k in other)


def test_scores_are_those_of_a_plain_model(spark, corpus):
    """Witten-Bell with quantised counts, word by word; so many bits that the filter has no false answers."""
    docs, rows = corpus
    docs = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "doc_id % 5 = 0 AS held_out")
    got = {r.doc_id: r.score for r in bloom_lm.score(docs, bloom_lm.fit(docs.where("NOT held_out"), bucket_words=100, bits=2000)).collect()}
    level = lambda n: max(x for x in bloom_lm.LEVELS.tolist() if x <= n)
    text = {k: [*words(t), None] for k, t, *_ in rows}
    single = collections.Counter(w for k in text if k % 5 for w in text[k])
    pairs = {p: level(n) for p, n in collections.Counter(p for k in text if k % 5 for p in zip([None, *text[k]], text[k])).items()}
    total, followers = collections.Counter(), collections.Counter()
    for (v, _), n in pairs.items():
        total[v] += n
        followers[v] += 1
    n, kinds = sum(single.values()), len(single)
    for key, token in text.items():
        want = 0.0
        for v, w in zip([None, *token], token):
            p1, p = (single[w] + 1) / (n + kinds + 1), None
            if followers[v]:
                t, d = min(x for x in bloom_lm.LEVELS.tolist() if x >= total[v]), level(followers[v])
                p = (min(pairs.get((v, w), 0), t) + d * p1) / (t + d)
            want += math.log10(p or p1)
        assert got[key] == pytest.approx(want, rel=1e-9)


def test_language_model_of_odd_tables(spark):
    """No rows, no training rows, null ids and repeated rows."""
    docs = spark.createDataFrame([(None, "a b", True), (1, "a b", True), (1, "a b", True), (2, "", True)], "doc_id long, text string, held_out boolean")
    assert bloom_lm.score(docs.limit(0), bloom_lm.fit(docs.limit(0))).collect() == []
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in bloom_lm.score(docs, bloom_lm.fit(docs.limit(0))).collect())
    assert got == [(0, 3, 0, 0, 0.0, 0.0), (1, 3, 0, 0, 0.0, 0.0), (1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    fitted = bloom_lm.score(docs, bloom_lm.fit(docs))
    assert fitted.where("doc_id = 1 OR doc_id IS NULL").select("n_tokens", "n_known", "base_score", "score").distinct().count() == 1


def test_filter_finds_what_it_holds():
    keys = texts.mix(np.arange(1, 3001, dtype=np.uint64))
    level = np.arange(3000) % 9 + 1
    bits = bloom_lm._segment(keys, level)
    lm = bloom_lm.Filter([(1, 0, 0, bits)], len(bits), 1, 1, 0, 1)
    zero = np.zeros(3000, np.uint64)
    assert (lm.level(1, zero, zero, keys) >= level).all() and (lm.level(1, zero, zero, keys) == level).mean() > 0.98
    assert (lm.level(1, zero, zero, keys + np.uint64(1)) > 0).mean() < 0.02
    assert bloom_lm.LEVELS[:6].tolist() == [1, 2, 3, 4, 6, 9]


def test_near_duplicates_are_those_of_all_pairs(spark, corpus):
    docs, rows = corpus
    for k, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: r for r in near_dedup.near_duplicates(docs.withColumn("keys", docs.text), k, percent).collect()}
        shingles, lead = {r[0]: sets(r[1], k) for r in rows}, {r[0]: r[0] for r in rows}
        for _ in range(3):
            for a in lead:
                for b in lead:
                    if shingles[a] and 100 * len(shingles[a] & shingles[b]) >= percent * len(shingles[a] | shingles[b]):
                        lead[a] = lead[b] = min(lead[a], lead[b])
        assert {a: (len(shingles[a]), lead[a], lead[a] == a) for a in lead} == {a: (r.n_shingles, r.component_id, r.kept) for a, r in got.items()}


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    odd = spark.createDataFrame([(None, "a b c", "", "", 0), (1, "a b c", "", "", 0), (1, "a b c", "", "", 0), (2, None, "", "", 0)], DOCS)
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()) == [
        (0, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_links_between_components_that_leaders_miss(spark):
    """One key for all, and links only between neighbours: leaders alone can't find them."""
    items = spark.createDataFrame([(i, np.array([5], np.uint64).tobytes()) for i in range(40)], "id long, keys binary")
    packed = [(i, np.array([i, i + 1], np.uint64).tobytes()) for i in range(40)]
    neighbours = spark.createDataFrame(packed, "id long, keys binary")

    def finer(ids, level):
        return neighbours.join(ids, "id", "left_semi") if level == 1 else None

    edges, label = link(items, lambda pairs: pairs.where("b - a = 1 AND a % 10 <> 9"), finer, 2)
    assert edges.distinct().count() == 36
    assert {r.id: r.component for r in label.collect()} == {i: i // 10 * 10 for i in range(40)}


def variants(seed, groups, size, length, change):
    """Groups of texts that share most words: pairs on both sides of a threshold, and a passage that all of a group share."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{x}" for x in rng.integers(0, 5000, length)]
        for _ in range(size):
            copy = list(base)
            for at in rng.choice(length, rng.integers(0, change + 1), replace=False):
                copy[at] = f"x{rng.integers(0, 10 ** 6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("percent", [70, 80, 85])
def test_recall_of_near_duplicates(spark, percent):
    texts_ = variants(percent, 12, 25, 120, 6)
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, percent).collect()}
    held = [sets(t, 3) for t in texts_]
    links = [(a, b) for a in range(300) for b in range(a + 1, a // 25 * 25 + 25) if 100 * len(held[a] & held[b]) >= percent * len(held[a] | held[b])]
    assert len(links) > 300 and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    lead = list(range(300))
    for _ in range(300):
        before = list(lead)
        for a, b in links:
            lead[a] = lead[b] = min(lead[a], lead[b])
        if before == lead:
            break
    assert all(lead[i] == lead[c] for i, c in got.items())  # no component is larger than links make it


def test_links_whose_keys_are_all_shared_by_many(spark, monkeypatch):
    """Texts of common passages: a linked pair has no key of its own and rarely the leader of one. Each is found, also where no longer runs help."""
    monkeypatch.setattr(near_dedup, "FINER", [])
    rng = random.Random(11)

    def text(choice):
        return " ".join(f"s{i}o{o}w{w}" for i, o in enumerate(choice) for w in range(6))

    rows = []
    for i in range(400):
        choice = [int(rng.random() < 0.15) for _ in range(30)]
        other = list(choice)
        other[i % 30] = 2
        rows += [(2 * i, text(choice)), (2 * i + 1, text(other))]
    held, lead = [sets(t, 3) for _, t in rows], list(range(800))
    links = [(a, b) for a in range(800) for b in range(a + 1, 800) if 100 * len(held[a] & held[b]) >= 85 * len(held[a] | held[b])]
    for _ in range(800):
        before = list(lead)
        for a, b in links:
            lead[a] = lead[b] = min(lead[a], lead[b])
        if before == lead:
            break
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert len(links) >= 400 and got == dict(enumerate(lead))


@pytest.mark.parametrize("cell", [3, 2048])
def test_leftover_pairs_are_those_of_all_pairs(spark, cell):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, (12, 15))
    sign = np.where(rng.random((120, 15)) < 0.25, rng.integers(0, 1 << 16, (120, 15)), base[np.arange(120) % 12]).astype(np.uint16)
    size, label = rng.integers(1, 60, 120), np.arange(120) % 50
    items = spark.createDataFrame([(i, int(size[i]), x.tobytes()) for i, x in enumerate(minhash.sketches(sign))], "id long, size long, sketch binary")
    keys = [(i, k) for i in range(120) for k in {i % 2, 2 + i % 7}]
    keyed = spark.createDataFrame([(i, k, int(label[i])) for i, k in keys], "id long, key long, label long")
    got = [tuple(r) for r in leftover(keyed, items, 15, 0.5, 0.7, cell).collect()]
    brief = sign & 15
    want = {(a, b) for a, k in keys for b, q in keys if a < b and k == q and label[a] != label[b]
            and min(size[a], size[b]) >= 0.7 * max(size[a], size[b]) and (brief[a] == brief[b]).sum() >= 7.5}
    assert len(want) > 30 and len(got) == len(set(got)) and set(got) == want


def test_recall_of_lines(spark):
    texts_ = variants(5, 12, 25, 30, 5)
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_kept for r in line_dedup.dedup_lines(docs).collect()}
    grams = [{t[i:i + 5] for i in range(len(t) - 4)} for t in texts_]
    links = [(a, b) for a in range(300) for b in range(a + 1, a // 25 * 25 + 25) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    lead = list(range(300))
    for _ in range(300):
        before = list(lead)
        for a, b in links:
            lead[a] = lead[b] = min(lead[a], lead[b])
        if before == lead:
            break
    gone = {i for i in range(300) if lead[i] != i}
    found = {i for i, n in got.items() if n == 0}
    assert len(links) > 300 and found <= gone and len(found) >= 0.95 * len(gone)


def test_one_doc_id_with_two_texts(spark):
    one, two = prose(1, 60), prose(2, 60)
    docs = spark.createDataFrame([(5, one), (5, two), (3, two), (4, one + " more")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs, 3, 85).collect())
    assert got == [(3, 3), (4, 4), (5, 3), (5, 4)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 80), (7, 7)], "a long, b long")
    for block in (1 << 20, 8):
        assert {r.id: r.component for r in components(edges, block).collect()} == {**dict.fromkeys(range(51), 0), 80: 80, 90: 80}


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest"
    rows = [(3, f"{line}\nown third line here", "en", "a", 1), (1, f"first\n\n{line}", "en", "a", 1), (2, f"{line}!\n  FIRST ", "en", None, 1),
            (4, None, "en", "a", 1), (5, "", "en", "a", 1), (None, "first", "en", "a", 1), (6, "ab\nab", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "lang AS stay", "1 AS line_no")
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (f"first\n\n{line}", 2, 2), 2: ("", 2, 0), 3: ("own third line here", 2, 1), 4: (None, 0, 0), 5: ("", 0, 0), None: ("", 1, 0), 6: ("ab", 2, 1)}
    left = line_dedup.without_emptied(line_dedup.dedup_lines(docs))
    assert {r.doc_id for r in left.collect()} == {1, 3, 4, 5, 6} and left.columns == docs.columns
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_maximal_segments():
    score = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], float)
    assert toxicity.maximal_segments(score) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    assert toxicity.maximal_segments(np.array([-1.0, 2, -1, 3])) == [(1, 4, 4.0)] and toxicity.maximal_segments(np.array([-1.0])) == []


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = [f"w{k}" for k in rng.integers(0, 300, 40)]
        if toxic:
            w[10:13] = ["vile", "scum", f"nasty{i % 3},"]
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, 0, int(toxic)))
    rows += [(1000, None, "en", "a", 1), (1001, "", "en", "a", 1), (None, "vile scum", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "n_chars AS best")
    labels = spark.createDataFrame(labels + [(5000, 1, 1), (None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert sum(got[i].predicted == (i % 6 == 0) for i in range(600)) >= 594
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    assert any(p.start <= 10 and p.end >= 12 for p in got[0].passages) and 0 <= got[1000].score == got[1001].score < 0.5
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_packing(spark, corpus):
    docs, rows = corpus
    path = tokens.default_path()
    from tokenizers import Tokenizer
    whole = {k: [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 2] for k, t, *_ in rows}
    pieces = packing.pack(docs, max_segments=6, max_loss_tokens=3000).collect()
    for k, ids in whole.items():
        own = sorted((p.start, p.ids) for p in pieces if p.doc_id == k)
        assert np.frombuffer(b"".join(bytes(x) for _, x in own), "<u4").tolist() == ids
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for sequence in by.values():
        sequence.sort(key=lambda p: p.offset)
        size = sum(p.length for p in sequence)
        assert [p.offset for p in sequence] == np.cumsum([0, *(p.length for p in sequence)])[:-1].tolist()
        assert len(sequence) <= 6 and sum(p.loss_tokens for p in sequence) <= 3000 and size & (size - 1) == 0 and size <= 4096
    assert packing.pack(docs.limit(0)).collect() == []


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer
    column = ["Hello, WORLD!! it's a dog's life... naïve Éa ÷x x÷ straße ß. don't 'll a.b 12ab ab12 İx  q z 東京タワー é 😀.", None, "", "<b>x</b> & \"q\"."]
    plain = Tokenizer.from_file(tokens.default_path())
    coder = tokens.encoder(tokens.default_path())
    got = [ids[f[i]:f[i + 1]].tolist() for a, b, ids, f in coder.encode(pa.array(column)) for i in range(b - a)]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in column]


def test_separator_scan(spark):
    rng = np.random.default_rng(0)
    flat = {f: np.where(rng.random(n) < 0.03, 9, 1).astype("<u2") for f, n in ((1, 1000), (2, 37), (3, 0))}
    rows = [(f, k, x[at:at + 16].tobytes()) for f, x in flat.items() for k, at in enumerate(range(0, max(len(x), 1), 16))]
    got = {(r.file, r.document): (r.start, r.n_tokens, r.open) for r in separators.count_tokens(spark.createDataFrame(rows, "file long, block long, data binary"), 9, 4).collect()}
    want = {}
    for f, x in flat.items():
        ends = [*(np.flatnonzero(x == 9) + 1)]
        for d, (a, b) in enumerate(zip([0, *ends], [*ends, len(x)])):
            if a < b:
                want[f, d] = (a, b - a, d == len(ends))
    assert got == want


def test_documents_that_spell_the_end_of_text(spark):
    """No text makes a separator, and null, empty and repeated texts are documents too."""
    docs = ["before <|endoftext|> after", None, "", "<|endoftext|>", "plain words", "plain words"]
    blocks = separators.write_blocks(spark.createDataFrame([(t,) for t in docs], "text string").coalesce(1), block_tokens=3)
    plain = tokens.encoder(tokens.default_path()).tokenizer
    want = [len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for t in docs]
    assert [r.n_tokens for r in separators.count_tokens(blocks).orderBy("document").collect()] == want


def test_token_files_with_odd_names(tmp_path):
    (tmp_path / "a b%20.bin").write_bytes(b"1234")
    assert separators.open_file(f"file:{tmp_path}/a b%20.bin").read() == b"1234"
    with pytest.raises(pa.ArrowInvalid):
        separators.open_file("nostore://host/a.bin")


def test_token_files_are_read_by_ranges(spark, tmp_path):
    """Files with a partial last block, one of a single short block, an empty one, and one that a row's binary value can't hold."""
    rng = np.random.default_rng(1)
    flat = {n: np.where(rng.random(n) < 0.05, 9, rng.integers(10, 99, n)).astype("<u2") for n in (1000, 37, 0, 128)}
    for n, x in flat.items():
        (tmp_path / f"some tokens {n}.bin").write_bytes(x.tobytes())
    blocks = separators.read_token_files(spark, str(tmp_path), 16, run_blocks=3)
    assert blocks.rdd.getNumPartitions() >= sum(-(-n // 48) for n in flat)
    got = collections.defaultdict(dict)
    for r in blocks.collect():
        got[r.file][r.block] = bytes(r.data)
    assert sorted(b"".join(x[k] for k in range(len(x))) for x in got.values()) == sorted(x.tobytes() for x in flat.values() if len(x))
    assert all(len(x[k]) == 32 for x in got.values() for k in range(len(x) - 1))
    counted = collections.Counter((r.n_tokens, r.open) for r in separators.count_tokens(blocks, 9, 4).collect())
    want = collections.Counter()
    for x in flat.values():
        ends = [0, *(np.flatnonzero(x == 9) + 1), len(x)]
        want += collections.Counter((int(b - a), i == len(ends) - 2) for i, (a, b) in enumerate(zip(ends, ends[1:])) if a < b)
    assert counted == want


def test_token_files_beyond_a_row(spark, tmp_path):
    size = (1 << 31) + 10
    with open(tmp_path / "large.bin", "wb") as f:  # a hole, which takes no disk
        f.truncate(size)
        f.seek(size - 4)
        f.write(np.array([9, 7], "<u2").tobytes())
    got = separators.read_token_files(spark, str(tmp_path), 1 << 20)
    assert got.selectExpr("sum(length(data)) AS n", "count(*) AS blocks").first() == (size, 1025)
    assert bytes(got.where("block = 1024").first().data) == bytes(6) + np.array([9, 7], "<u2").tobytes()[:4]


def test_mixing(spark, corpus):
    docs, rows = corpus
    got = mixing.with_copies(docs.selectExpr("*", "1 AS mean", "2 AS copies", "lang AS key")).collect()
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    total, weight = sum(size.values()), {"a": 5, "b": 2, None: 1}
    target, free = {}, set(size)
    while free:
        rest, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > 3 * size[s]}
        if not over:
            target |= {s: rest * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    taken = collections.Counter()
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r["copies"] * r.size + r.rest <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    mixed = mixing.mixed(docs).collect()
    again = collections.Counter()
    for r in mixed:
        again[r.source] += len(words(r.text))
    assert again == +taken and mixing.mixed(docs).columns == docs.columns
    assert mixing.with_copies(docs.limit(0)).collect() == []


def test_components_with_edges_added(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 60, (34, 2))]

    def plain(edges):
        found = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in found:
            for a, b in edges:
                if a != b:
                    found[a] = found[b] = min(found[a], found[b])
        return found

    def label(rows):
        return sorted((r.id, r.component) for r in rows.collect())

    first, rest = (spark.createDataFrame(x, "a long, b long") for x in (pairs[:20], pairs[20:]))
    one = components(first)
    assert label(one) == sorted(plain(pairs[:20]).items())
    assert label(extended(one, rest)) == sorted(plain(pairs).items())
    assert label(extended(one, rest.where("false"))) == label(one)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base[:30] + 0.12 * rng.normal(size=(30, 8)), base[:10]])
    rows = [(i, v.tolist(), i % 3 if i < 90 else (i - 90) % 3) for i, v in enumerate(x)]
    odd = [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, [None] * 8, 1), (204, x[0].tolist(), None), (205, [1.0], 0), (None, x[0].tolist(), 0), (206, [], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS block")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    lead = np.arange(len(x))
    for _ in range(len(x)):
        lead = np.minimum(lead, np.where(linked, lead, len(x)).min(1))
    old = embedding_dedup.CELL_ROWS, embedding_dedup.BLOCK_ROWS
    for embedding_dedup.CELL_ROWS, embedding_dedup.BLOCK_ROWS in (old, (8, 4)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table).collect()}
        assert {i: got[i] for i in range(len(x))} == {i: (int(linked[i].sum()), int(lead[i]), bool(lead[i] == i)) for i in range(len(x))}
        assert all(got[i] == (0, i, True) for i in range(200, 207)) and got[None] == (0, None, True)
    embedding_dedup.CELL_ROWS, embedding_dedup.BLOCK_ROWS = old
    assert embedding_dedup.near_vectors(table.limit(0)).collect() == []


def test_visitors_of_a_cell_are_not_copied_for_each_other(spark):
    """One cell with many visitors: they meet its residents, in parts, and were copied once for each 1,024 rows of the cell before."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6))
    x = base[rng.integers(0, 40, 900)] + 0.2 * rng.normal(size=(900, 6))
    home = np.arange(900) < 100
    rows = [(1, 0, bool(h), i, 1 + i % 3, v.tolist()) for i, (h, v) in enumerate(zip(home, x))]
    placed = spark.createDataFrame(rows, "label int, cell long, home boolean, id long, n long, vector array<double>").repartition(5)
    seats = embedding_dedup.seated(placed, 30, 250)
    copies = {r["id"]: r["count"] for r in seats.groupBy("id").count().collect()}
    assert all(copies[i] == 4 for i in range(100, 900)) and all(4 <= copies[i] <= 4 + 3 for i in range(100))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (home[:, None] | home[None]) & ~np.eye(900, dtype=bool)
    for blocks, parts in ((30, 250), (1000, 10_000)):
        found = embedding_dedup.linked_in_cells(placed, 0.93, blocks, parts).toPandas()
        count = found.groupby("id").links.sum()
        assert [int(count.get(i, 0)) for i in range(900)] == (linked * (1 + np.arange(900) % 3)).sum(1).tolist()
        lead, near = np.arange(900), np.zeros((900, 900), bool)
        near[found.id, found.root] = near[found.root, found.id] = True
        want = np.arange(900)
        for _ in range(60):
            lead, want = (np.minimum(g, np.where(m, g, 900).min(1)) for g, m in ((lead, near), (want, linked)))
        assert lead.tolist() == want.tolist()


def test_license_scan(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", prose(1, 50)), ("a/b/c/LICENSE", f"{prose(2, 60)}\nLicensed under the Apache License, Version 2.0."),
            ("a/b/c/d/y.txt", prose(3, 20)), ("z/y.txt", None), ("z/gpl.txt", "This work is licensed under the GNU General Public License, version 3."), (None, "")]
    got = {r.path: (r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 AS license")).collect()}
    assert got == {"a/LICENSE": ("MIT", None), "a/b/x.txt": ("MIT", "a"), "a/b/c/LICENSE": ("Apache-2.0", None), "a/b/c/d/y.txt": ("Apache-2.0", "a/b/c"),
                   "z/y.txt": (None, None), "z/gpl.txt": ("GPL-3.0", None), None: (None, None)}


def test_licenses_by_their_headers_and_texts(spark):
    """Real texts, in comments, wrapped, with other holders and between other lines; none of them is a sentence of the tables."""
    known = {(t.name, t.kind, len(t.text) > 150): t.text for t in licenses.common_templates()}
    gpl, mit, bsd = known["GPL-3.0", "header", True], known["MIT", "file", True], known["BSD-2-Clause", "file", True]
    apache, agpl = known["Apache-2.0", "header", True], known["AGPL-3.0", "header", True]
    assert "Permission is hereby granted, free of charge" in mit and "TERMS AND CONDITIONS" in known["GPL-3.0", "file", True]
    code = "\n".join(f"def f{i}(x): return x + {i}" for i in range(300))
    rows = [("p/gpl.py", "#!/usr/bin/env python\n" + "\n".join(f"# {x}" for x in gpl.split("\n")) + "\n" + code),
            ("p/apache.js", "/*\n * Copyright 2020 Someone\n *\n" + "\n".join(f" * {x}" for x in apache.split("\n")) + " */\n" + code),
            ("p/agpl.c", "\n".join(f"// {x}" for x in agpl.split("\n")) + "\n" + code),
            ("p/wrapped.py", code + "\n# Released under\n# the MIT License.\n" + code),
            ("q/LICENSE-MIT", "The MIT License (MIT)\n\nCopyright (c) 1999 A. Nother, all of them\n\n" + mit.split("\n\n", 1)[1].replace("THE SOFTWARE IS", "THIS SOFTWARE IS")),
            ("q/x.py", code), ("r/bsd.h", "/*\n" + "\n".join(f" * {x}" for x in bsd.split("\n")) + " */\n" + code),
            ("s/COPYING.txt", known["GPL-3.0", "file", True].replace("2007", "2007,")), ("s/license.py", code), ("s/t/y.py", code), ("u/license.py", mit), ("u/z.py", code),
            *((f"w/{i}.txt", prose(i, 80)) for i in range(40))]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.license, r.inherited_from) for r in licenses.scan(files).collect() if not r.path.startswith("w/")}
    assert got == {"p/gpl.py": ("GPL-3.0", None), "p/apache.js": ("Apache-2.0", None), "p/agpl.c": ("AGPL-3.0", None), "p/wrapped.py": ("MIT", None),
                   "q/LICENSE-MIT": ("MIT", None), "q/x.py": ("MIT", "q"), "r/bsd.h": ("BSD-2-Clause", None), "s/COPYING.txt": ("GPL-3.0", None),
                   "s/license.py": ("GPL-3.0", "s"), "s/t/y.py": ("GPL-3.0", "s"), "u/license.py": ("MIT", None), "u/z.py": (None, None)}
    own = [licenses.Template("House-1", "header", "internal use of the house only")]
    rows = [("a", "For internal use of the house only\nmore"), ("b", mit)]
    got = licenses.own_licenses(spark.createDataFrame(rows, "path string, text string"), templates=own).collect()
    assert {r.path: r.license for r in got} == {"a": "House-1", "b": None}


def test_square_norms_of_windows():
    rng = np.random.default_rng(0)
    word = rng.integers(0, 9, 60).astype(np.uint64)
    square = (word.astype(float) + 1) / 3
    for size in (1, 7, 59, 60, 90):
        want = [sum(n * n * (float(w) + 1) / 3 for w, n in collections.Counter(word[i:i + size].tolist()).items()) for i in range(60)]
        assert licenses._square_norms(word, square, size) == pytest.approx(want)
