import random

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_line_dedup import mutate
from tests.llm.test_ngram_join import brute as brute_join


def corpus(n=60, seed=3):
    r = random.Random(seed)
    vocab = ["the", "of", "der", "und"] + [f"w{i}" for i in range(300)]
    line = lambda: " ".join(r.choices(vocab, k=r.randrange(8, 20)))
    hot, long = line(), " ".join(line() for _ in range(6))
    docs = []
    for i in range(n):
        lines = [line() for _ in range(r.randrange(1, 8))]
        if i % 4 == 0:
            lines.insert(0, mutate(r, hot, i % 3))
        if i % 5 == 0:
            lines[-1] += " " + long
        if i % 6 == 0:
            lines[0] += " moron idiot" + str(i % 2)
        docs.append((i, "\n".join(lines), "en", "s", 1))
    for i in range(10):
        docs.append((n + i, mutate(r, docs[i][1], 3), "fr", "s", 1))
    return docs + [(200, None, None, None, None), (201, "", "en", "s", 0), (None, docs[1][1], "en", None, 5)]


def test_stages_against_brute_force(spark, tmp_path):
    docs = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(docs, schema)
    labels = spark.createDataFrame([(d[0], 1, int("moron" in (d[1] or ""))) for d in docs if d[0] is not None], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "suffix_dedup", "packing"]

    def step(name, df):
        out = stages[name](spark, df, str(tmp_path))
        if name != "packing":
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    clean = step("toxicity", df)
    model = corpus_pipeline.toxicity.learn(df, labels.where(~corpus_pipeline.toxicity.held_out()))
    scored = corpus_pipeline.toxicity.score(df, model).collect()
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((r.doc_id for r in scored if r.predicted == 0), key=str)

    lines = step("line_dedup", clean)
    before = [(r.doc_id, r.text) for r in clean.collect()]
    want = set()
    for (i, t), (_, _, _, gone) in zip(before, brute_lines(before, 2, 40), strict=True):
        want.add((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if str(n) not in gone.split(","))))
    rows = lines.collect()
    assert {(r.doc_id, r.text) for r in rows} == want and all(r.text is None or r.n_chars == len(r.text) for r in rows)

    single = step("ngram_join", lines)
    groups = brute_join([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    assert sorted((r.doc_id for r in single.collect()), key=str) == sorted((i for i, _, c in groups if i == c), key=str)

    unique = step("suffix_dedup", single)
    rows = {r.doc_id: (r.text or "").encode() for r in single.collect()}
    for r in unique.collect():
        text, gone = rows[r.doc_id], bytearray(len(rows[r.doc_id]))
        for p in range(len(text) - 99):
            if any(text[p:p + 100] in t for i, t in rows.items() if i is not None and (r.doc_id is None or i < r.doc_id)):
                gone[p:p + 100] = b"\x01" * 100
        assert r.text.encode() == bytes(b for b, g in zip(text, gone) if not g) and r.n_chars == len(r.text)

    packed = step("packing", unique).collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in unique.collect()}


def test_run_on_small_data(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 50


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    """No rows give no rows; columns named like the operators' own are carried through."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, key string, h long, mark string, row_id long, block int, carry string, n_chars int, removed string"
    full = spark.createDataFrame([(i, f"{w} " * 12, "k", i, "m", -i, 3, "c", 1, "r") for i, w in enumerate(("alpha", "beta", "gamma", "delta"))], schema)
    for df, count in ((full.limit(0), 0), (full, 4)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns, name
            assert out.count() == count, name
            assert all(r.carry == "c" and r.removed == "r" for r in out.collect())
        assert (corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() > 0) == (count > 0)
