import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", " ", "  \n\t x", "It's we'll  've 123 4567,89 <|endoftext|>tail <|endoftext|>", "Ünïcödé ßtraße ñandú  é é",
    "　 a\x1cb\x85c ​d", "日本語のテキスト 한국어 😀👍🏽", "ΑΣ ΟΔΟΣ σς İstanbul", "a" * 3000, "\x00\x01qzxjq" * 50, "x ,y !!  ... 's'",
    "<|startoftext|>Hi<|endoftext|>", "\r\n\r\n a\n b", "tail   ", "word.\n\nNext.", "¼ ² Ⅷ ٣", "'S 'LL don'T", "�­̀a", "a.b,c;d:e!",
]


def rows(seed=3):
    r = random.Random(seed)
    letters = "abcdefgh ÄÖß.,'\n\t 0123 éñ日"
    return [*enumerate(TEXTS), *((100 + i, "".join(r.choices(letters, k=r.randrange(400)))) for i in range(60)), (None, "no id"), (4, TEXTS[4])]


def test_bpe_equals_the_library(spark):
    data = rows()
    df = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, ids int")
    tok = Tokenizer.from_file(BYTES)
    want = []
    for i, t in data:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.digest(bpe.decode(bpe.encode(df, BYTES), BYTES)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.decode(bpe.encode(df.limit(0), BYTES), BYTES).count() == 0


def test_forced_cuts_are_no_pairs_of_any_token():
    enc = bpe.encoder(BYTES)
    assert enc.cuts("qzxjq") != ["qzxjq"]
    assert "".join(enc.cuts("Ġqzxjqword")) == "Ġqzxjqword"


def check_packing(pieces, want, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for i, ids in want.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == s[0].tier <= window and at & (at - 1) == 0


@pytest.mark.parametrize("buffer", [1 << 22, 700])
def test_packing(spark, buffer):
    data = [d for d in rows() if d[0] is not None][:-1] + [(500, "word " * 9000)]
    df = spark.createDataFrame([(*d, 0, "x") for d in data], "doc_id long, text string, start int, tier string")
    tok = Tokenizer.from_file(WORDS)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in data}
    check_packing(packing.pack(df, WORDS, buffer_tokens=buffer).collect(), want, 4096)
    assert packing.pack(df.limit(0), WORDS).count() == 0


def test_packing_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (7, "b c"), (7, "b c")], "doc_id long, text string")
    got = packing.pack(df, WORDS).collect()
    assert sum(p.length for p in got) == 2 + 1 + 3 + 3
    assert sorted(str(p.doc_id) for p in got if p.start == 0) == ["7", "7", "None", "None"]
