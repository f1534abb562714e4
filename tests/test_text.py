from graphloom.functions import stem, text as t


def test_short_text_is_one_chunk():
    s = "One sentence here. Another one there."
    assert t.chunk_text(s, 1000, 150) == [s]


def test_packing_and_overlap():
    s = " ".join(f"Sentence number {i} talks about a thing." for i in range(40))
    chunks = t.chunk_text(s, 300, 100)
    assert len(chunks) > 3 and all(len(c) <= 300 for c in chunks)
    last = t.sentences(chunks[0])[-1]
    assert last in chunks[1]


def test_sentences():
    assert t.sentences("It costs 3.5 euros. Really?\nYes; it does… ok\n\nNext") == ["It costs 3.5 euros.", "Really?", "Yes;", "it does…", "ok", "Next"]


def test_headings_and_fences():
    md = "# Guide\nIntro.\n## Install ##\nRun.\n```\n# not a heading\n```\n# Other\n\n"
    got = t.chunk_document(md, 1000, 0)
    assert [g["text"].split("\n")[0] for g in got] == ["Guide", "Guide › Install"]
    assert "# not a heading" in got[1]["text"]
    assert t.chunk_document("plain words")[0] == {"text": "plain words", "page": None, "images": []}


def test_pages_and_images():
    got = t.chunk_document("<!-- page 3 -->\nText on three.\n<!-- image 1 -->\nFigure 1: a cat\n<!-- page 4 -->\n# Only\n<!-- image 2 -->")
    assert got[0]["page"] == 3 and got[0]["images"] == [{"n": 1, "caption": "Figure 1: a cat"}] and "page 3" not in got[0]["text"]
    assert got[1]["images"] == [{"n": 2, "caption": ""}] and got[1]["text"] == "Only"
    assert [c["page"] for c in t.chunk_plain("a b.\fc d.")] == [1, 2] and t.chunk_plain("a")[0]["page"] is None


def test_long_sentence():
    got = t.chunk_text(" ".join(["word"] * 200), 120, 0)
    assert all(len(c) <= 120 for c in got) and sum(len(c.split()) for c in got) == 200


def test_prose_display_clip():
    assert t.prose("a\n```\ncode\n```\nb\n~~~\nrest") == "a\nb\n~~~\nrest" and t.prose("a\n ```x\nrest") == "a"
    assert t.split_heading("A › B\nbody") == ("A › B", "body") and t.split_heading("x\ny") == (None, "x\ny")
    assert t.display_sentences("Short. This sentence is long enough to show. No end mark but also long") == ["This sentence is long enough to show."]
    assert t.clip("abcdef", 3) == "abc…" and t.clip_bytes("é" * 200, 301) == "é" * 150 + "…"
    assert t.fnv64(b"") == "cbf29ce484222325" and t.fnv64(b"a") == "af63dc4c8601ec8c"
    assert sorted(["REQ-10", "REQ-2"], key=t.natural_key) == ["REQ-2", "REQ-10"]


def test_blocks_and_chapters():
    kinds = [b["kind"] for b in t.markdown_blocks("# T\n\npara\nmore\n- a\n- b\n| x |\n> q\n```\nc\n```\n![i](f.png)\n<!-- page 2 -->")]
    assert kinds == ["heading", "paragraph", "list", "table", "quote", "code", "image", "page"]
    assert len(t.chapters("# A\n" + "x" * 50 + "\n# B\ny", 20)) == 2 and t.chapters("# A\nx") == ["# A\nx"]


def test_stems():
    pairs = {"running": "run", "flies": "fli", "happiness": "happi", "relational": "relat", "hopping": "hop", "national": "nation", "agreed": "agre",
             "generously": "generous", "cats": "cat", "skies": "sky", "conditional": "condit", "hoping": "hope"}
    assert {w: stem.english(w) for w in pairs} == pairs
    assert stem.french("chevaux") == "cheval" and stem.french("nationales") == stem.french("nationale")
    assert stem.french("parlerions") == stem.french("parler") == "parl"
    assert stem.analyse("The cats") == ["cat"] or "cat" in stem.analyse("The cats")


def test_fences_hide_markers_and_images_are_placed_once():
    got = t.chunk_document("```\n<!-- page 9 -->\n```\n<!-- page 2 -->\nx.\n")
    assert [(g["page"], "page 9" in g["text"]) for g in got] == [(None, True), (2, False)]
    words = " ".join(f"Sentence {i} is here." for i in range(12))
    got = t.chunk_document(f"{words}\n<!-- image 4 -->\n{words}", 300, 150)
    assert sum(len(g["images"]) for g in got) == 1 and all(g["text"] for g in got)


def test_ranges_against_a_plain_loop():
    import random

    r = random.Random(2)
    for _ in range(300):
        costs = [r.randrange(1, 40) for _ in range(r.randrange(0, 25))]
        size, overlap = r.randrange(20, 90), r.randrange(0, 45)
        want, window, used = [], [], 0
        for i, c in enumerate(costs):
            if window and used + 1 + c > size:
                want.append((window[0], window[-1] + 1))
                kept = [j for j in window if sum(costs[j:i]) + i - j - 1 <= overlap]
                window, used = kept, sum(costs[j] + 1 for j in kept)
            used += c + bool(window)
            window.append(i)
        want += [(window[0], window[-1] + 1)] if window else []
        assert t.ranges(costs, size, overlap) == want


def test_stemmed_search_analyses_passages_once(spark):
    from graphloom.functions import stem
    from graphloom.operators import retrieval

    chunk = spark.createDataFrame([("a", "The nationalization of rapid horses"), ("b", "rapidement, rapid RAPID"), ("c", ""), ("d", None), ("e", "of the")], "id string, text string")
    terms = stem.analyse("rapid horse")
    whole, lengths = retrieval.postings(chunk, stem.stemmed_terms)
    tf, counted = retrieval.postings(chunk, stem.stemmed_terms, terms)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tf.select("chunk_id", "term", "tf")) == rows(whole.where(whole["term"].isin(*terms))) and rows(counted) == rows(lengths)
    found, expected = retrieval.bm25_search(tf, counted, terms, 5), retrieval.bm25_search(whole, lengths, terms, 5)
    assert [(i, round(s, 9)) for i, s in map(tuple, found.collect())] == [(i, round(s, 9)) for i, s in map(tuple, expected.collect())]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_memo_of_stems_is_bounded():
    from graphloom.functions import stem

    memo = stem._Stems(2)
    assert [memo[w] for w in ("running", "développements", "the", "a", "running")] == [("run", "running"), ("développ",), (), (), ("run", "running")] and len(memo) <= 2
