import random
import re

import pytest

from graphloom.llm import license_scan
from graphloom.llm.queries import PHRASES

SCHEMA = "doc_id long, text string, label string, n_words string, copies int"


def base(text):
    """Places of phrases by looking at every word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for label, phrase in PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({n for _, n in found}))


def scanned(spark, texts):
    rows = [(i, t, "x", "y", 1) for i, t in texts]
    return license_scan.scan(spark.createDataFrame(rows, SCHEMA), PHRASES).collect()


def test_base_places_equal_brute_force(spark):
    rng = random.Random(1)
    parts = ["mit", "License", "MIT license", "apache", "general", "public", "license", "General-Public_license", "é", "x1", "ſ", "İ", "\n", "K"]
    texts = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(300)]
    texts += [(400, None), (401, ""), (402, "..."), (None, "MIT License"), (403, "word " * 30_000 + "mit license"), (404, "mit license " * 5_000), (405, "mit license"), (406, "mit ſlicense")]
    found = {r.doc_id: r for r in scanned(spark, texts)}
    assert len(found) == len(texts)
    for i, t in texts:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1) == (r.n_base > 0)


def test_notices_survive_small_changes(spark):
    notice = dict(license_scan.NOTICES)
    words = notice["bsd"].split()
    cut = " ".join(words[:6] + ["new", "words"] + words[6:12] + words[14:])
    texts = [(1, f"Head.\n{notice['bsd']}.\nTail"), (2, f"Some text. {cut} more"), (3, " ".join(words[:7]) + " and then nothing of it"), (4, notice["mit"].upper()),
             (5, f"{notice['isc']} {'filler ' * 50} {notice['mpl']}"), (6, notice["apache"]), (7, notice["gpl"])]
    found = {r.doc_id: r for r in scanned(spark, texts)}
    assert found[1].labels == "bsd" and found[1].score == 1 and found[1].base_labels == ""
    assert found[2].labels == "bsd" and 0.8 <= found[2].score < 1
    assert found[3].labels == "" and 0 < found[3].score < 0.8
    assert found[4].labels == "mit" and found[5].labels == "isc,mpl"
    assert found[6].labels == "apache" == found[6].base_labels and found[7].labels == "gpl"


def test_neighbouring_diagonals_are_one_span(spark):
    words = dict(license_scan.NOTICES)["bsd"].split()
    text = " ".join(words[:8] + ["inserted"] + words[8:])
    rows = [r for r in license_scan.spans(spark.createDataFrame([(1, text, "", "", 0)], SCHEMA), PHRASES).collect() if r.label == "bsd"]
    assert len(rows) == 1 and (rows[0].first, rows[0].last) == (0, len(words)) and rows[0].similarity == pytest.approx(len(words) / (len(words) + 1))


def test_each_repeated_row_has_its_row(spark):
    texts = [(5, "The MIT License")] * 40 + [(5, "no license here")] * 3 + [(None, None)] * 4
    found = scanned(spark, texts)
    assert sorted((str(r.doc_id), r.n_base) for r in found) == sorted([("5", 1)] * 40 + [("5", 0)] * 3 + [("None", 0)] * 4)


def test_empty_table(spark):
    assert scanned(spark, []) == []
