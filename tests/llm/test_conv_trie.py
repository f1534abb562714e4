import hashlib
import random
import re
import zlib

import pytest

from graphloom.llm import conv_trie
from graphloom.llm._shared import cut

SCHEMA = "conv_id long, turn long, role string, text string, key string"


def brute(rows, every=20, most=4):
    """Nodes as a dictionary of prefixes."""
    convs: dict = {}
    hashed = lambda r, x: hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
    for c, turn, role, text, _ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashed(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    again = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % most
        again[c] = own.get(c - c % every if c >= 0 else c + -c % every, [])[:h] + mine[h:]
    members: dict = {}
    for c, t in again.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids: dict = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in below)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(again[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items())


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def family(kind, rng):
    if kind == "random":
        return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d  e f", ""]), "x") for c in range(120) for t in range(rng.randint(1, 5))]
    if kind == "nested":  # each is the beginning of the next
        return [(20 * c, t, "user", f"turn {t} of it", "x") for c in range(40) for t in range(c + 4)]
    if kind == "falling":  # each leaves the long one earlier
        return [(20 * c, t, "user", f"turn {t}" if t < 40 - c else f"own {c} {t}", "x") for c in range(38) for t in range(42 - c)]
    if kind == "copies":
        return [(c, t, "user", f"turn {t}", "x") for c in range(90) for t in range(6)] + [(1000 + c, 0, "user", f"turn {c % 3}", "x") for c in range(30)]
    return [(7, None, None, None, None), (7, None, "user", "z", None), (7, 1, "user", "same", "x"), (7, 1, "user", "same", "x"), (7, 1, "user", "other", "x"), (None, 1, "user", "lost", "x"),
            (20, 0, "user", "base  one", "x"), (21, 0, "user", "x", "x"), (25, 5, "", "", "x"), (-3, 0, "user", "below", "x"), (9, 0, "user", "long " * 20_000, "x")]


@pytest.mark.parametrize("kind", ["random", "nested", "falling", "copies", "odd"])
@pytest.mark.parametrize("per_block", [3, 20_000])
def test_equals_brute_force(spark, kind, per_block):
    rows = family(kind, random.Random(kind))
    assert got(conv_trie.trie(spark.createDataFrame(rows, SCHEMA), per_block=per_block)) == brute(rows)


def test_empty_table(spark):
    assert conv_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_conversation_lies_in_several_tasks(spark):
    rows = [(1, t, "user", f"turn {t}", None) for t in range(600)] + [(c, t, "user", f"turn {t}", None) for c in range(2, 8) for t in range(9)]
    own = {r.conv_id: r for r in cut(conv_trie.sequences(spark.createDataFrame(rows, SCHEMA)), "test").collect()}
    assert len(own[1].key) == 16 * 600 and own[1].words == [2] * 600 and own[1].key[:16 * 9] == own[5].key


def test_shared():
    a = b"".join(bytes([i]) * 16 for i in range(50))
    for n in (0, 1, 2, 3, 7, 31, 49, 50):
        assert conv_trie.shared(a, a[:16 * n] + b"x" * 16) == n and conv_trie.shared(a[:16 * n], a) == n
