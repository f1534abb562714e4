"""Toxicity: a convolutional text classifier trained in numpy.

Words (white-space separated, lower-cased, stripped of punctuation) get hashed embeddings: the sum
of a vector for the whole word and one for its first letters (4 and 6), so unseen forms of a stem
share them.
Filters of several widths slide over the embedded words of the whole text; each filter's maximum
over all positions enters a logistic layer. All labelled rows are learned from: shards of them each pass over
their texts from the same model, and a pass ends with the mean of their changes; thresholds are calibrated by
language on the fifth of the rows that training leaves out, half way to the cut of all languages. The language
is guessed from the text's function words, so a score depends on the text alone.

An empty table gives an empty result; columns other than doc_id and text never enter a score.
Null and empty texts get the score of a text without words. Repeated rows and null ids are scored
each for itself. Without labelled rows of both classes, every score is 0."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import _shared

SCHEMA = "doc_id long, score double, predicted int, guessed_lang string"
DIM, BUCKETS, WIDTHS, FILTERS, STEMS, MIN_DOCS = 12, 1 << 15, (1, 2, 3), 6, (4, 6), 3
#: Function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with be at this by from or an".split(),
    "fr": "le la les de des du un une et est en que qui dans pour sur pas au par avec ce".split(),
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem im als".split(),
    "es": "el la los las de del que y en un una por con para su al se no lo es como".split(),
}
LANGS = [*FUNCTION_WORDS, "other"]
_EDGE = ".,;:!?\"'()[]{}<>«»„“”¡¿…-–—*_#~`|/\\"


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) * 2654435761 >> 9 & (BUCKETS - 1)


class Words(dict):
    """Word -> row in growing tables of word and stem buckets, and of language votes."""

    def __init__(self):
        super().__init__()
        self.buckets = np.zeros((1 << 12, 1 + len(STEMS)), np.int32)
        self.votes = np.zeros((1 << 12, len(FUNCTION_WORDS)), np.float32)
        self.rows = 1  # row 0: no word
        self.new: list[tuple[int, ...]] = []  # buckets of the words that are not in the tables yet
        self.voting: list[tuple[int, list[int]]] = []
        self.member = {w: [int(w in ws) for ws in FUNCTION_WORDS.values()] for ws in FUNCTION_WORDS.values() for w in ws}

    def __missing__(self, word: str) -> int:
        core = word.strip(_EDGE) or word
        if core != word:
            found = self[core]
        else:
            found = self.rows + len(self.new)
            self.new.append((_hash("w" + core), *(_hash(f"{n}" + core[:n]) for n in STEMS)))
            if core in self.member:
                self.voting.append((found, self.member[core]))
        self[word] = found
        return found

    def tables(self):
        """Both tables, with the new words in; votes of words that have any."""
        need = self.rows + len(self.new)
        if need > len(self.buckets):
            room = max(need, 2 * len(self.buckets)) - len(self.buckets)
            self.buckets, self.votes = (np.concatenate([x, np.zeros((room, x.shape[1]), x.dtype)]) for x in (self.buckets, self.votes))
        if self.new:
            self.buckets[self.rows:need] = self.new
        for row, votes in self.voting:
            self.votes[row] = votes
        self.rows, self.new, self.voting = need, [], []
        return self.buckets[:need], self.votes[:need]

    def ids(self, text: str) -> np.ndarray:
        """Word ids, with empty ones around, so that every width has a place."""
        words = text.lower().split()
        return np.fromiter((0, 0, *map(self.__getitem__, words), 0, 0), np.int32, len(words) + 4)


def _pooled(model: dict, ids: np.ndarray, bounds: np.ndarray, table: np.ndarray, arg: bool = False):
    """Each filter's maximum per text; bounds: first position of each text, and the end. table: embedded word rows."""
    out, args, at = [], [], 0
    weights = np.concatenate([model[f"W{w}"][j] for w in WIDTHS for j in range(w)], axis=1)
    project = np.take((table @ weights).T.copy(), ids, axis=1)  # a row for each place of each filter
    for w in WIDTHS:
        n = len(ids) - w + 1
        # positions whose window crosses into the next text see only its padding at most
        values = np.full((FILTERS, len(ids)), -np.inf, np.float32)
        values[:, :n] = project[at:at + FILTERS, :n]
        for j in range(1, w):
            values[:, :n] += project[at + j * FILTERS:at + (j + 1) * FILTERS, j:j + n]
        at += w * FILTERS
        top = np.maximum.reduceat(values, bounds[:-1], axis=1)
        out.append(top.T)
        if arg:  # the first place of the maximum
            args.append([values[:, a:b].argmax(axis=1) + a for a, b in zip(bounds, bounds[1:], strict=False)])
    pooled = np.concatenate(out, axis=1)
    return (pooled, np.array(args)) if arg else pooled


def _used(ids: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word ids, sorted, and the place of each id among them."""
    if rows > 8 * len(ids):
        return np.unique(ids, return_inverse=True)
    there = np.zeros(rows, bool)
    there[ids] = True
    used = np.flatnonzero(there)
    place = np.empty(rows, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    return used, place[ids]


def _embedded(model: dict, buckets: np.ndarray) -> np.ndarray:
    table = model["word"][buckets[:, 0]]
    for i in range(1, buckets.shape[1]):
        table += model["stem"][buckets[:, i]]
    table[0] = 0
    return table


def start(seed: int = 7) -> tuple[dict, np.random.Generator]:
    """A model before training, and the generator to go on with."""
    r = np.random.default_rng(seed)
    model = {"word": r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), "stem": r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)}
    for w in WIDTHS:
        model[f"W{w}"] = r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32)
    n = FILTERS * len(WIDTHS)
    model["bias"], model["out"], model["b"] = np.zeros(n, np.float32), r.normal(0, 0.3, n).astype(np.float32), np.zeros(1, np.float32)
    return model, r


def seen_in(docs: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    """By column of buckets, in how many texts each bucket is."""
    seen = np.zeros((1 + len(STEMS), BUCKETS), np.int64)
    for d in docs:
        for i in range(len(seen)):
            seen[i, np.unique(buckets[d, i])] += 1
    return seen


def forget_rare(model: dict, seen: np.ndarray) -> None:
    """Buckets of fewer than MIN_DOCS texts only help to learn the texts by heart: they stay zero."""
    rare = seen < MIN_DOCS
    model["word"][rare[0]] = 0
    model["stem"][rare[1:].all(0)] = 0


def class_weights(y: np.ndarray, mean: float) -> np.ndarray:
    return np.where(y == 1, 0.5 / max(mean, 1e-6), 0.5 / max(1 - mean, 1e-6)).astype(np.float32)


def one_pass(model: dict, grads2: dict, docs: list[np.ndarray], buckets: np.ndarray, y: np.ndarray, weight: np.ndarray, r: np.random.Generator, rate: float = 0.05) -> None:
    """AdaGrad on the logistic loss, once over the texts; gradients flow to the words at each filter's maximum."""

    def step(name, where, g):
        if where is not None:
            known = model[name][where].any(1)
            where, g = where[known], g[known]
        if where is None:
            grads2[name] += g * g
            model[name] -= rate * g / np.sqrt(grads2[name])
        else:
            rows, back = np.unique(where, return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, back, g)
            grads2[name][rows] += total * total
            model[name][rows] -= rate * total / np.sqrt(grads2[name][rows])

    order = r.permutation(len(docs))
    for a in range(0, len(order), 32):
        batch = order[a:a + 32]
        ids = np.concatenate([docs[i] for i in batch])
        bounds = np.concatenate([[0], np.cumsum([len(docs[i]) for i in batch])])
        used, local = _used(ids, len(buckets))
        table = _embedded(model, buckets[used])
        pooled, args = _pooled(model, local, bounds, table, arg=True)
        hidden = np.maximum(pooled + model["bias"], 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ model["out"] + model["b"], -30, 30)))
        g = ((p - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
        back = (g[:, None] * model["out"]) * (hidden > 0)
        step("out", None, g @ hidden)
        step("b", None, g.sum(keepdims=True))
        step("bias", None, back.sum(0))
        where, grads, changes = [], [], {}
        for x, w in enumerate(WIDTHS):
            gw = back[:, x * FILTERS:(x + 1) * FILTERS]
            change = np.zeros_like(model[f"W{w}"])
            for f in range(FILTERS):
                for j in range(w):
                    at = np.minimum(args[x][:, f] + j, len(ids) - 1)
                    change[j, :, f] += gw[:, f] @ table[local[at]]
                    where.append(ids[at])
                    grads.append(gw[:, f:f + 1] * model[f"W{w}"][j, :, f])
            changes[f"W{w}"] = change
        at, g_words = np.concatenate(where), np.concatenate(grads).astype(np.float32)
        real = at > 0
        step("word", buckets[at[real], 0], g_words[real])
        step("stem", buckets[at[real], 1:].reshape(-1), np.repeat(g_words[real], len(STEMS), axis=0))
        for name, change in changes.items():
            step(name, None, change)


def train(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.05, seed: int = 7) -> dict:
    """A model of texts in memory."""
    model, r = start(seed)
    words = Words()
    docs = [words.ids(t) for t in texts]
    buckets, _ = words.tables()
    forget_rare(model, seen_in(docs, buckets))
    y = np.array(labels, np.float32)
    grads2 = {k: np.full(v.shape, 1e-3, np.float32) for k, v in model.items()}
    for _ in range(epochs):
        one_pass(model, grads2, docs, buckets, y, class_weights(y, y.mean()), r, rate)
    return model


def logits(model: dict, docs: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    ids = np.concatenate(docs)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    used, local = _used(ids, len(buckets))
    pooled = _pooled(model, local, bounds, _embedded(model, buckets[used]))
    return (np.maximum(pooled + model["bias"], 0) @ model["out"] + model["b"]).astype(np.float64)


def languages(docs: list[np.ndarray], votes: np.ndarray) -> np.ndarray:
    """The language whose function words are the most, as its place in LANGS."""
    count = np.array([votes[d].sum(0) for d in docs])
    return np.where(count.max(1) > 0, count.argmax(1), len(FUNCTION_WORDS))


def margins(model: dict, texts: list[str], words: Words):
    """Logits and guessed languages of texts."""
    docs = [words.ids(t) for t in texts]
    buckets, votes = words.tables()
    return logits(model, docs, buckets), languages(docs, votes)


def best_cut(logit: np.ndarray, label: np.ndarray, times: np.ndarray | None = None) -> float:
    """The cut with the fewest weighted errors of both classes; in the middle of its gap. Each value counts `times`."""
    x, back = np.unique(logit, return_inverse=True)
    times = np.ones(len(logit)) if times is None else times
    y, n = np.bincount(back, label * times), np.bincount(back, (1 - label) * times)
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum()) + np.concatenate([np.cumsum(n[::-1])[::-1], [0]]) / max(1, n.sum())
    best = np.flatnonzero(missed <= missed.min() + 1e-12)
    i = best[len(best) // 2]
    return float(x[0] - 1 if i == 0 else x[-1] + 1 if i == len(x) else (x[i - 1] + x[i]) / 2)


def cuts(logit: np.ndarray, label: np.ndarray, lang: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """A cut for each guessed language, of rows that training has not seen (it fits its own rows too well to set a cut)."""
    times = np.ones(len(logit)) if times is None else times
    usable = lambda rows: min((times * (rows & (label == y))).sum() for y in (0, 1)) >= 5
    every = np.ones(len(logit), bool)
    found = np.full(len(LANGS), best_cut(logit, label, times) if usable(every) else 0.0)
    for i in range(len(LANGS)):
        rows = lang == i
        if usable(rows):  # a few rows: steadied by the cut of all languages
            found[i] = 0.5 * best_cut(logit[rows], label[rows], times[rows]) + 0.5 * found[i]
    return found


def fit(texts: list[str], labels: list[int], epochs: int = 12) -> dict | None:
    """A trained model of texts in memory, with a cut for each guessed language; a fifth of them only sets the cuts."""
    if len(set(labels)) < 2:
        return None
    held = np.arange(len(texts)) % 5 == 0
    y = np.array(labels)
    model = train([t for t, h in zip(texts, held, strict=True) if not h], y[~held].tolist(), epochs)
    words = Words()
    parts = [margins(model, texts[a:a + 64], words) for a in range(0, len(texts), 64)]
    logit, lang = (np.concatenate(x) for x in zip(*parts, strict=True))
    model["cuts"] = cuts(logit[held], y[held], lang[held])
    return model


_STEPS = 256  # cuts are set between steps of a logit; there are a bounded number of them
_SLICE = 1024  # rows of a table that are merged in one group


def _codes(words: bytes) -> np.ndarray:
    """A word's buckets as one number above 0; zeros around, so that every width has a place."""
    b = np.frombuffer(words, np.uint16).reshape(-1, 1 + len(STEMS)).astype(np.int64)
    code = b[:, 0]
    for i in range(1, b.shape[1]):
        code = code << 15 | b[:, i]
    return np.concatenate([[0, 0], code + 1, [0, 0]])


def _numbered(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts as word ids, and the buckets of the ids; id 0: no word."""
    each = [_codes(t) for t in texts]
    codes, ids = np.unique(np.concatenate(each), return_inverse=True)
    buckets = np.stack([(codes - 1) >> 15 * i & (BUCKETS - 1) for i in range(len(STEMS), -1, -1)], axis=1).astype(np.int32)
    buckets[0] = 0
    return np.split(ids.astype(np.int32), np.cumsum([len(d) for d in each])[:-1]), buckets


def _as_words(rows: DataFrame) -> DataFrame:
    """rows(doc_id, toxic, held, text) with the guessed language and the buckets of all words in place of the text."""

    def run(batches):
        import pyarrow as pa

        _shared.alone("toxicity")
        words = Words()
        for batch in batches:
            langs, packed = [], []
            for text in batch.column(3).to_pylist():
                if len(words) > 300_000:
                    words = Words()
                ids = words.ids(text or "")
                buckets, votes = words.tables()
                langs.append(int(languages([ids], votes)[0]))
                packed.append(buckets[ids[2:-2]].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(langs, pa.int32()), pa.array(packed, pa.binary())],
                                             names=["doc_id", "toxic", "held", "lang", "words"])

    return rows.select("doc_id", "toxic", "held", "text").mapInArrow(run, "doc_id long, toxic int, held boolean, lang int, words binary")


def _shards(words: DataFrame, shards: int) -> DataFrame:
    """One row a shard: the word ids of its texts, the buckets of the ids, sizes of the texts and labels."""

    def gather(table):
        import pyarrow as pa

        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("toxic").to_pylist(), table.column("words").to_pylist(), strict=True),
                      key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        docs, buckets = _numbered([w for _, _, w in rows])
        parts = (np.concatenate(docs), buckets, np.array([len(d) for d in docs], np.int64), np.array([y for _, y, _ in rows], np.float32))
        return pa.table({"shard": table.column("shard").slice(0, 1), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("ids", "buckets", "sizes", "y"), parts, strict=True)}})

    keyed = words.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).select("shard", "doc_id", "toxic", "words")
    return keyed.repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(gather, "shard int, ids binary, buckets binary, sizes binary, y binary")


def _each_shard(batches):
    """(shard, texts as word ids, buckets of the ids, labels) of each row."""
    _shared.alone("toxicity")
    for batch in batches:
        for row in batch.to_pylist():
            ids, sizes = np.frombuffer(row["ids"], np.int32), np.frombuffer(row["sizes"], np.int64)
            buckets = np.frombuffer(row["buckets"], np.int32).reshape(-1, 1 + len(STEMS))
            yield row["shard"], np.split(ids, np.cumsum(sizes)[:-1]), buckets, np.frombuffer(row["y"], np.float32)


def _seen(shards: DataFrame) -> np.ndarray:
    """seen_in() of all shards; buckets below MIN_DOCS are 0."""

    def run(batches):
        import pyarrow as pa

        for _, docs, buckets, _ in _each_shard(batches):
            seen = seen_in(docs, buckets).reshape(-1)
            key = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(seen[key], pa.int64())], names=["key", "n"])

    found = shards.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS).toArrow()
    seen = np.zeros((1 + len(STEMS)) * BUCKETS, np.int64)
    seen[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return seen.reshape(-1, BUCKETS)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(BUCKETS, DIM) if x.shape == (BUCKETS, DIM) else x.reshape(-1, 1)


_MOVES = "name string, slice int, shard int, at binary, change binary, square binary"


def _round(shards: DataFrame, model: dict, grads2: dict, mean: float, number: int) -> None:
    """One pass over all shards: each goes on from the model by itself; a row of a table moves by the mean
    of the shards that moved it. What the driver gets has the model's size at most."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast((model, grads2))

    def run(batches):
        import pyarrow as pa

        for shard, docs, buckets, y in _each_shard(batches):
            old, old2 = shared.value
            new, new2 = ({k: v.copy() for k, v in x.items()} for x in (old, old2))
            one_pass(new, new2, docs, buckets, y, class_weights(y, mean), np.random.default_rng([number, shard]))
            out = []
            for name in old:
                change, square = _flat(new[name]) - _flat(old[name]), _flat(new2[name]) - _flat(old2[name])
                moved = np.flatnonzero((change != 0).any(1) | (square != 0).any(1))
                for s in np.unique(moved // _SLICE).tolist():
                    at = moved[moved // _SLICE == s]
                    out.append((name, s, shard, at.astype(np.int32).tobytes(), change[at].tobytes(), square[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)],
                                             names=["name", "slice", "shard", "at", "change", "square"]) if out else pa.RecordBatch.from_pylist([], pa.schema(
                                                 [("name", pa.string()), ("slice", pa.int32()), ("shard", pa.int32()), *[(n, pa.binary()) for n in ("at", "change", "square")]]))

    def merge(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["shard"])  # sums of floats depend on the order
        low, total = rows[0]["slice"] * _SLICE, None
        for r in rows:
            at = np.frombuffer(r["at"], np.int32) - low
            parts = [np.frombuffer(r[n], np.float32).reshape(len(at), -1) for n in ("change", "square")]
            if total is None:
                total, times = np.zeros((2, _SLICE, parts[0].shape[1])), np.zeros(_SLICE, np.int64)
            times[at] += 1
            for x in (0, 1):
                total[x, at] += parts[x]
        at = np.flatnonzero(times)
        mean = (total[:, at] / times[at, None]).astype(np.float32)
        return pa.table({"name": [rows[0]["name"]], "slice": pa.array([rows[0]["slice"]], pa.int32()), "shard": pa.array([len(rows)], pa.int32()),
                         "at": [(at + low).astype(np.int32).tobytes()], "change": [mean[0].tobytes()], "square": [mean[1].tobytes()]})

    for r in shards.mapInArrow(run, _MOVES).groupBy("name", "slice").applyInArrow(merge, _MOVES).toArrow().to_pylist():
        at = np.frombuffer(r["at"], np.int32)
        for x, n in ((model, "change"), (grads2, "square")):
            _flat(x[r["name"]])[at] += np.frombuffer(r[n], np.float32).reshape(len(at), -1)
    shared.destroy()


def _cuts(held: DataFrame, model: dict) -> np.ndarray:
    """cuts() of all rows held(toxic, lang, words), counted by language, label and step of the logit."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        _shared.alone("toxicity")
        for batch in batches:
            steps = []
            for words in batch.column(2).to_pylist():
                docs, buckets = _numbered([words])
                steps.append(int(np.rint(np.clip(logits(shared.value, docs, buckets)[0], -40, 40) * _STEPS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(steps, pa.int32())], names=["toxic", "lang", "step"])

    found = held.select("toxic", "lang", "words").mapInArrow(run, "toxic int, lang int, step int").groupBy("toxic", "lang", "step").agg(F.count("*").alias("n")).toArrow()
    shared.destroy()
    toxic, lang, step, n = (found.column(i).to_numpy() for i in range(4))
    return cuts(step / _STEPS, toxic, lang, n) if len(n) else np.zeros(len(LANGS))


def learn(docs: DataFrame, labels: DataFrame, epochs: int = 12, sample_bytes: int | None = None, shard_bytes: int = 8 << 20) -> dict | None:
    """Fit on all ids of labels(doc_id, toxic), one text of each id, whole. Four fifths of the ids, by a hash, train the
    weights in shards of about `shard_bytes` of text; the rest set the cuts.

    Only with `sample_bytes` the texts are bounded: those of up to a 64th of it are taken in the order of a hash of their id, then
    longer ones by length, until they reach half of it for their class; so a very long text takes no other's place."""
    spark = docs.sparkSession
    rows = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    one = docs.select(F.col("doc_id").cast("long"), "text").join(rows, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    if sample_bytes is not None:
        long_ones = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(sample_bytes // 64))
        size = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(long_ones, F.xxhash64("doc_id"), "doc_id"))
        one = one.withColumn("size", size).where(F.coalesce("size", F.lit(0)) <= sample_bytes // 2)
    _shared.small_batches(spark)
    words = _shared.cut(_as_words(one.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0)), "op2-words")
    del rows, one  # the exchange of texts is not needed any more
    _shared.release(spark)
    kinds = words.groupBy("held", "toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("size")).collect()
    trained = [r for r in kinds if not r.held]
    if len({r.toxic for r in kinds}) < 2 or not trained:
        return None
    n = sum(r.n for r in trained)
    shards = _shared.cut(_shards(words.where("not held"), max(1, round(sum(r.size for r in trained) / shard_bytes))), "op2-shards")
    _shared.release(spark)
    _shared.small_batches(spark, 1)  # a row is a shard
    model, _ = start()
    forget_rare(model, _seen(shards))
    grads2 = {k: np.full(v.shape, 1e-3, np.float32) for k, v in model.items()}
    mean = sum(r.n for r in trained if r.toxic) / n
    for number in range(epochs):
        _round(shards, model, grads2, mean, number)
        if number % 4 == 3:
            _shared.release(spark)
    _shared.small_batches(spark)
    model["cuts"] = _cuts(words.where("held"), model)
    for df in (words, shards):
        _shared.drop(df)
    _shared.release(spark)
    return model


def verdicts(model: dict | None, texts: list[str], words: Words):
    """Scores and guessed languages of texts, in slices of bounded size; and the words to go on with."""
    p, lang, a = np.zeros(len(texts)), np.full(len(texts), len(LANGS) - 1), 0
    while model and a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < 1 << 20):
            size += len(texts[b])
            b += 1
        if len(words) > 300_000:  # about 100 bytes each
            words = Words()
        logit, lang[a:b] = margins(model, texts[a:b], words)
        p[a:b] = 1 / (1 + np.exp(-np.clip(logit - model["cuts"][lang[a:b]], -40, 40)))
        a = b
    return p, lang, words


def keep_clean(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all columns; no shuffle."""
    spark = docs.sparkSession
    _shared.small_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        _shared.alone("toxicity")
        words = Words()
        for batch in batches:
            p, _, words = verdicts(shared.value, [t or "" for t in batch.column(at).to_pylist()], words)
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """SCHEMA for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    _shared.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: tables of BUCKETS x DIM floats

    def run(batches):
        import pyarrow as pa

        _shared.alone("toxicity")
        words = Words()
        for batch in batches:
            p, lang, words = verdicts(shared.value, [t or "" for t in batch.column(1).to_pylist()], words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32()),
                 pa.array([LANGS[i] for i in lang], pa.string())], names=["doc_id", "score", "predicted", "guessed_lang"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def held_out() -> F.Column:
    """Rows that learning never sees: crc32 of the id as text, by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
