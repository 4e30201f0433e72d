"""What linking makes rows of, and what scoring looks up."""

import numpy as np

from skybias.llm import bloom_lm, line_dedup, minhash, near_dedup, texts


def test_like_texts_that_are_no_links_are_not_listed_in_pairs(spark, monkeypatch):
    """A group whose pairs are all a little below the threshold: their number must not grow with the square of the group."""
    rng, listed = np.random.default_rng(8), []
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(120):
        copy = list(base)
        for at in rng.choice(40, 3, replace=False) * 3:
            copy[at] = f"x{i}y{at}"
        rows.append((i, " ".join(copy)))
    rows.append((120, rows[7][1] + " end"))
    held = [{tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)} for _, t in rows]
    lead = list(range(121))
    for _ in range(121):
        for a in range(121):
            for b in range(a):
                if 100 * len(held[a] & held[b]) >= 85 * len(held[a] | held[b]):
                    lead[a] = lead[b] = min(lead[a], lead[b])
    find = near_dedup.leftover

    def counted(*args, **more):
        found = find(*args, **more)
        listed.append(found.count())
        return found

    monkeypatch.setattr(near_dedup, "leftover", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == dict(enumerate(lead)) and listed and max(listed) <= 2 * len(rows)


def test_signatures_of_large_sets_that_have_nothing_in_common_differ():
    values = texts.mix(np.arange(400_000, dtype=np.uint64)).astype(np.uint32)
    sign = minhash.shortened(minhash.signatures(values, np.array([0, 200_000, 400_000]), 60))
    assert (sign[0] == sign[1]).sum() <= 2


def test_bits_of_sets_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        one = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        other = one.copy()
        other[:rng.integers(0, 60)] = rng.integers(0, 1 << 63, dtype=np.uint64)
        sets += [np.unique(one), np.unique(other)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    held = [np.frombuffer(x, np.uint16) for x in minhash.brief(np.concatenate(sets), offsets)]
    p, q = (x.ravel() for x in np.meshgrid(np.arange(80), np.arange(80), indexing="ij"))
    keep = minhash.may_be_alike(p, q, held, np.diff(offsets), 0.85)
    like = np.array([100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b])) for a, b in zip(p, q, strict=True)])
    assert keep[like].all() and keep.sum() <= like.sum() + 40
    assert minhash.may_be_alike(p[:0], q[:0], held, np.diff(offsets), 0.85).tolist() == []


def test_a_word_is_looked_up_once(monkeypatch):
    head, looked = bloom_lm.Head(np.array([7, 3, 9], np.uint64), np.array([70, 30, 90]), 190, 3), []
    search = np.searchsorted

    def counted(a, v, *more):
        looked.append(np.size(v))
        return search(a, v, *more)

    with monkeypatch.context() as m:
        m.setattr(np, "searchsorted", counted)
        got = head.counts(np.array([9, 9, 1, 3, 9, 1], np.uint64))
    assert got.tolist() == [90, 90, -1, 30, 90, -1] and looked == [3]


def test_lines_without_a_like_are_not_signed_again_nor_joined_in_each_round(spark, monkeypatch):
    """Only lines that share a band are looked up by later steps, and a round of the nearest has no join of its own to choose its lines."""
    rng, looked, chosen = np.random.default_rng(3), [], []
    # a group of lines a little below the threshold, some copies that are links, and lines that are like no other
    base = "".join(chr(97 + x) for x in rng.integers(0, 26, 200))
    near = [base[:20 + 4 * i] + chr(65 + i % 26) * 6 + base[26 + 4 * i:] + f"{i:03d}{i * 7919:06d}" for i in range(40)]
    alone = ["".join(chr(97 + x) for x in rng.integers(0, 26, 80)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(near + [x + "!" for x in near] + alone)), "doc_id long, text string").repartition(4)
    agreeing, leftover, join = line_dedup.agreeing, line_dedup.leftover, type(docs).join

    def seen(step):
        def run(pairs, items, *args, **more):
            looked.append(items.count())
            return step(pairs, items, *args, **more)

        return run

    def counted(self, other, on=None, how=None):
        found = join(self, other, on, how)
        if isinstance(on, str) and (on, how) == ("id", "left_semi") and "key" in self.columns:
            chosen.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "agreeing", seen(agreeing))
    monkeypatch.setattr(line_dedup, "leftover", seen(leftover))
    monkeypatch.setattr(type(docs), "join", counted)
    got = {r.doc_id: r.n_kept for r in line_dedup.dedup_lines(docs).collect()}
    assert all(got[i] == 0 for i in range(40, 80)) and all(got[i] == 1 for i in range(80, 380))
    assert looked and max(looked) <= 100 and not chosen


def test_no_task_of_the_fit_has_two_python_steps(spark, monkeypatch):
    """Each one has a worker of its own, which stays, and the scoring's broadcast is then copied to all of them."""
    docs = spark.createDataFrame([(i, "a b c d"[:i] + f" w{i}") for i in range(1, 8)], "doc_id long, text string")
    steps, collect = [], type(docs).collect

    def seen(self):
        if self.columns == ["word", "n"]:
            steps.append(self._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return collect(self)

    monkeypatch.setattr(type(docs), "collect", seen)
    for most in (1 << 20, 5):
        head = bloom_lm.fit(docs, head_words=most)["head"]
        # a 7, b 5, c 3, the end 7 and seven words of their own, "d" in one text
        assert (sorted(head.count.tolist()) == [1] * 8 + [3, 5, 7, 7]) if most > 5 else (sorted(head.count.tolist()) == [3, 5, 7, 7]), head.count
    assert steps == [1, 1]
