import random
import zlib

import numpy as np

from graphloom.llm import toxicity
from graphloom.llm.toxicity import Words, best_cut, fit, learn, margins, score


def corpus(n=900, seed=4):
    r = random.Random(seed)
    common = {"en": "the of and to in is that".split(), "de": "der die das und ist nicht ein".split()}
    rows = []
    for i in range(n):
        lang = r.choice(["en", "de"])
        words = [r.choice(common[lang]) if r.random() < 0.4 else "w" + str(r.randrange(500)) for _ in range(r.randrange(20, 120))]
        toxic = int(r.random() < 0.25)
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), {"en": r.choice(["Idiot!", "moron"]), "de": "dumpf" + r.choice("abcdefgh") + "x"}[lang])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = learn(docs, labels.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[0].guessed_lang in ("en", "de")


def test_a_very_long_text_takes_no_other_place(spark):
    rows = corpus(200)
    giant = [(10_000 + i, "long " * 9_000, i % 2) for i in range(6)]  # each above what its class may take
    frame = lambda rs: spark.createDataFrame([(i, t) for i, t, _ in rs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows + giant], "doc_id long, toxic int")
    size = 2 * max(sum(len(t) for _, t, y in rows if y == k) for k in (0, 1))
    size = max(size, 64 * max(len(t) for _, t, _ in rows))
    giant = [(i, "long " * size, y) for i, _, y in giant]
    with_giants, without = (learn(frame(rs), labels, epochs=2, sample_bytes=size) for rs in (rows + giant, rows))
    texts = [t for _, t, _ in rows]
    assert with_giants is not None and np.array_equal(margins(with_giants, texts, Words())[0], margins(without, texts, Words())[0])


def test_null_empty_repeats_and_no_model(spark):
    rows = [(1, None), (1, ""), (None, "a b"), (2, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, y = zip(*[(t, y) for _, t, y in corpus(120)])
    model = fit(list(texts), list(y), epochs=2)
    got = score(docs, model).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert fit(["a"], [1]) is None
    assert {r.score for r in score(docs, None).collect()} == {0.0}
    assert score(docs.limit(0), model).count() == 0


def test_pooling_is_the_maximum_over_windows():
    texts = ["a b c d", "", "e"]
    y = [1, 0, 1] * 4
    model = fit(texts * 4, y, epochs=1)
    words = Words()
    logit, _ = margins(model, texts, words)
    for t, want in zip(texts, logit, strict=True):
        ids = words.ids(t)
        table = toxicity._embedded(model, words.tables()[0])
        top = []
        for w in toxicity.WIDTHS:
            conv = [sum(table[ids[p + j]] @ model[f"W{w}"][j] for j in range(w)) for p in range(len(ids) - w + 1)]
            top.append(np.max(conv, axis=0))
        alone = np.maximum(np.concatenate(top) + model["bias"], 0) @ model["out"] + model["b"][0]
        assert abs(alone - want) < 1e-4


def test_best_cut():
    assert 2 < best_cut(np.array([0.0, 1, 2, 3, 4]), np.array([0, 0, 0, 1, 1])) < 3


def test_rows_beyond_any_sample_are_learned_from(spark):
    r = random.Random(1)
    ids = spark.range(2 * 2_300).orderBy(toxicity.F.xxhash64("id"), "id").collect()  # the order in which a sample was taken
    rows = []
    for y in (0, 1):
        for place, i in enumerate(x.id for x in ids if x.id % 2 == y):
            words = [f"w{r.randrange(60)}" for _ in range(8)]
            words.insert(r.randrange(8), ["plain", "idiot" if place < 1_500 else "moron"][y])
            rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = learn(docs, labels, epochs=3, shard_bytes=1 << 15)
    late = [t for _, t, _ in rows if "moron" in t]
    logit, lang = margins(model, late, Words())
    assert len(late) == 800 and np.mean(logit >= model["cuts"][lang]) > 0.95


def test_shards_learn_one_model(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").where(~toxicity.held_out())
    one, again = (learn(docs.repartition(n), labels, shard_bytes=1 << 16) for n in (2, 5))
    assert all(np.array_equal(one[k], again[k]) for k in one)
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    logit, lang = margins(one, [t for t, _ in held], Words())
    assert np.mean((logit >= one["cuts"][lang]) == [y for _, y in held]) > 0.93
