import random
import re

import pytest

from graphloom.llm.ngram_join import Bands, ngram_join, rarest, trie_matches


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(docs, n, num, den):
    sets = [(i, grams(t, n)) for i, t in docs]
    comp = {i: i for i, _ in docs}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((find(i), find(j)))
                comp[q] = p
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(12):
        base = r.choices(vocab, k=r.choice([1, 2, 5, 12, 30, 80, 300]))
        for _ in range(r.choice([1, 1, 3, 12])):
            t = list(base)
            for _ in range(r.randrange(1 + len(t) // 25)):
                t[r.randrange(len(t))] = r.choice(vocab)
            if r.random() < 0.3:
                t += r.choices(vocab, k=r.randrange(8))
            docs.append(" ".join(t))
    hot = " ".join(r.choices(vocab, k=30))
    docs += [hot + " " + " ".join(r.choices(vocab, k=r.randrange(3, 60))) for _ in range(30)]
    docs += [None, "", " \t\n", "One", "one", "ONE TWO", "É x é", "é x é", "a\x0bb c d", docs[0], docs[0]]
    r.shuffle(docs)
    return [*enumerate(docs), (5, docs[5]), (None, docs[3]), (None, docs[3])]


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_against_brute_force(spark, n, num, den):
    docs = corpus(n)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, sig int")
    got = sorted([tuple(r) for r in ngram_join(df, n, num, den, rows_per_block=16).collect()], key=str)
    assert got == brute(docs, n, num, den)


def test_empty(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_walk_equals_sets():
    r = random.Random(2)
    base = sorted(r.sample(range(10000), 120))
    others = []
    for key in range(80):
        s = set(base)
        for x in r.sample(base, r.randrange(16)):
            s.discard(x)
        s |= set(r.sample(range(10000), r.randrange(10)))
        others.append((sorted(s), key))
    want = sorted(k for s, k in others if 100 * len(set(s) & set(base)) >= 90 * len(set(s) | set(base)))
    assert sorted(trie_matches(base, others, 90, 100)) == want


def test_bands_hold_linked_sizes():
    b = Bands(9, 10)
    for size in range(1, 500):
        assert b.band(size * 10 // 9) - b.band(size) in (0, 1)


@pytest.mark.parametrize("words,middle,short", [(68, 65, 60), (118, 115, 105)])
def test_a_shorter_copy_hides_no_link(spark, words, middle, short):
    """A group's first member is too short for the longest set, which links with the one between."""
    r = random.Random(words)
    docs = []
    for trial in range(40):
        base = [f"t{trial}w{i}" for i in range(words)]
        for length in (words, middle, *[short] * 20):
            at = r.randrange(words - length + 1)
            docs.append(" ".join(base[at:at + length]))
    r.shuffle(docs)
    docs = [*enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted([tuple(r) for r in ngram_join(df, 3, 90, 100).collect()], key=str) == brute(docs, 3, 90, 100)


def test_common_signatures_bring_no_sets_together(spark):
    rows = [(100 + s, 2 * 2 + 0, i, 10) for i in range(50) for s in (0, 1000 + i, 2000 + i // 2)]  # two of three are shared by linked sets
    groups = spark.createDataFrame(rows, "sig long, side int, row_id long, n long")
    sizes = groups.groupBy("sig").count().withColumnRenamed("count", "m").where("m > 1")
    left = rarest(groups, sizes).collect()
    assert {(r.sig, r.row_id) for r in left} == {(2100 + i // 2, i) for i in range(50)}  # not the one that all have


def test_groups_compared_chunk_by_chunk(spark, monkeypatch):
    monkeypatch.setattr("graphloom.llm.ngram_join._FEW", 2)
    test_against_brute_force(spark, 1, 50, 100)


def test_pairs_of_many_shared_signatures_are_made_once(spark):
    """Sets that share 40 signatures, most of them with some others too: each pair once, those of a join at most."""
    from graphloom.llm.ngram_join import group_pairs

    r = random.Random(7)
    rows = [(sig, i, 100 + i % 4 * 15, i // 2) for sig in range(40) for i in sorted({*range(6), *r.sample(range(6, 12), 3)})]
    rows += [(99, 1, 20_000, 0), (99, 20, 20_000, 9), (98, 20, 20_000, 9), (98, 21, 30_000, 8)]  # one id of two sets; sizes that cannot link
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[3] != b[3] and (a[2], a[1]) < (b[2], b[1]) and a[2] * 100 >= b[2] * 80}
    found = group_pairs(spark.createDataFrame(rows, "sig long, row_id long, n long, c long"), 80, 100)
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want

    def made(plan):
        own = [m.value() for m in [plan.metrics().get("numOutputRows").get()] if "Generate" in plan.nodeName() or "Join" in plan.nodeName()] if plan.metrics().contains("numOutputRows") else []
        kids = plan.children()
        inner = [plan.finalPhysicalPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else [kids.apply(i) for i in range(kids.size())]
        return own + [x for k in inner for x in made(k)]

    df = found._jdf
    df.collect()
    assert max(made(df.queryExecution().executedPlan())) <= len(rows)  # a join by signature makes over 1,000
