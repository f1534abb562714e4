import hashlib
import random

from graphloom.llm.suffix_dedup import decoded, digest, front_coded, merged, suffix_dedup


def brute(docs, length):
    owner = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            owner[w] = min(owner.get(w, 1 << 63), 1 << 62 if i is None else i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if owner[b[p:p + length]] < (1 << 62 if i is None else i):
                gone[p:p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=5, n=60):
    r = random.Random(seed)
    words = ["the", "of", "éa", "ing", "und", "ß"]
    text = lambda m: " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(m))
    hot, long = text(20), text(60)
    docs = []
    for i in range(n):
        t = text(r.randrange(80))
        if i % 3 == 0:
            t = t[: len(t) // 2] + hot + t[len(t) // 2:]
        if i % 7 == 0:
            t += long[r.randrange(100):]
        docs.append((i, t))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (3, docs[3][1]), (200, None), (201, ""), (202, "x" * 49),
             (203, "x" * 300), (204, "x" * 120), (None, docs[4][1]), (50, docs[9][1] + "z" * 2000)]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "de", 1) for d in docs], "doc_id long, text string, block string, part int")
    for hot in (4096, 2):
        got = sorted([tuple(r) for r in digest(suffix_dedup(df, 50, rows_per_block=8, hot_docs=hot)).collect()], key=str)
        assert got == brute(docs, 50)


def test_other_length_and_empty(spark):
    docs = corpus(9, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted([tuple(r) for r in digest(suffix_dedup(df, 100, rows_per_block=5)).collect()], key=str)
    assert got == brute(docs, 100)
    assert suffix_dedup(df.limit(0)).count() == 0


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(1)
    runs = [sorted({bytes(r.choices(b"ab", k=r.randrange(1, 12))) for _ in range(40)}) for _ in range(5)]
    coded = [front_coded([(x, b"L") for x in run], list(range(len(run)))) for run in runs]
    out = list(merged([decoded(c) for c in coded]))
    assert [x[0] for x in out] == sorted(sum(runs, []))
    before = b""
    for suffix, lcp, left, _, _ in out:
        n = 0
        while n < min(len(before), len(suffix)) and before[n] == suffix[n]:
            n += 1
        assert lcp == n and left == b"L"
        before = suffix
