import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm.line_dedup import edit_distance_within, line_dedup, report


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def mutate(r, s, n):
    s = list(s)
    for _ in range(n):
        p = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(p, r.choice("abcé"))
        elif p < len(s):
            if kind == 1:
                del s[p]
            else:
                s[p] = r.choice("abcé")
    return "".join(s)


def test_banded_distance(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(250):
        a = "".join(r.choices("abcé", k=r.randrange(0, 24)))
        b = mutate(r, a, r.randrange(0, 5))
        if len(a) < len(b):
            a, b = b, a
        pairs.append((a, b))
    for most in (1, 2, 3):
        fit = [(a, b) for a, b in pairs if len(a) - len(b) <= most]
        df = spark.createDataFrame(fit, "a string, b string").withColumn("d", edit_distance_within(F.col("a"), F.col("b"), most))
        for x in df.collect():
            want = edits(x.a, x.b)
            assert x.d == want if want <= most else x.d > most, (x, want)


def brute(docs, most, min_chars):
    places = sorted({(1 << 63 if i is None else i, str(t), n, line) for i, t in docs if t is not None
                     for n, line in enumerate(t.split("\n")) if len(line) >= min_chars}, key=lambda p: (p[0], p[2]))
    gone = set()
    for x, p in enumerate(places):
        if any(edits(p[3], q[3]) <= most for q in places[:x]):
            gone.add((p[0], p[1], p[2]))
    out = []
    for i, t in docs:
        mine = [n for n in range(len(t.split("\n")) if t is not None else 0) if (1 << 63 if i is None else i, str(t), n) in gone]
        out.append((i, 0 if t is None else len(t.split("\n")), len(mine), ",".join(map(str, mine))))
    return out


@pytest.mark.parametrize("most", [1, 2])
def test_against_brute_force(spark, most):
    r = random.Random(most)
    base = ["".join(r.choices("abcdeé ", k=r.randrange(9, 30))) for _ in range(25)]
    docs = []
    for i in range(40):
        docs.append((i, "\n".join(mutate(r, r.choice(base), r.randrange(4)) for _ in range(r.randrange(1, 6)))))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort"), (None, base[0] + "\n" + base[1]), (7, docs[7][1]),
             (104, "y" * 5000), (105, "y" * 5001 + "\nx"), (106, "(.*)[a]$ \\d+ tricky")]
    df = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, no int, mark string")
    got = [tuple(x) for x in report(df, most, 9).collect()]
    want = brute(docs, most, 9)
    assert sorted(got, key=str) == sorted(want, key=str)
    texts = {(x.doc_id, x.text) for x in line_dedup(df, most, 9).collect()}
    for (i, t), (_, _, _, gone) in zip(docs, want, strict=True):
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if str(n) not in gone.split(","))
        assert (i, kept) in texts
    assert line_dedup(df, most, 9).columns == df.columns
    assert report(df.limit(0)).count() == 0


def test_groups_of_near_copies_and_hot_lines(spark):
    """Copies with one changed letter are settled by a leader; copies with two are compared with all, and only those within two edits go."""
    r = random.Random(9)
    base = "".join(r.choices("abcdefgh ijkl", k=60))
    near = [base[:p] + "Z" + base[p + 1:] for p in range(60)]
    far = [mutate(r, mutate(r, base, 2), 3) for _ in range(60)]
    other = ["".join(r.choices("mnopqrst", k=20)) + base[20:] for _ in range(20)]  # two segments of three in common
    docs = [(i, f"{base}\n{r.choice(near + far + other)}\n{r.choice(near)}") for i in range(120)] + [(500 + i, t) for i, t in enumerate(near + far + other)]
    docs = [(i, t if i % 3 else t + "\n" + base) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(x) for x in report(df, 2, 9).collect()) == sorted(brute(docs, 2, 9))
