"""Near-duplicate line removal by a segment-partition edit join; DataFrame functions only.

A line of at least `min_chars` characters is removed when it stands, or a line within `max_edits`
edits of it stands, at an earlier place of the corpus (by doc_id, then line number). Shorter lines
stay.

1. Equal lines are one: their first place, and the hashes of their segments, without their text.
   A line of length l has max_edits + 1 segments of l div (max_edits + 1) characters: one at each
   multiple of that size, the last at the line's end. Two lines within max_edits edits share one of
   them unchanged, with at most i edits before segment i and the others after it; so a line probes
   the substrings that the segments of a line shorter by up to max_edits can equal, at the few
   starts that this leaves. The segments that it files itself are among its probes.
2. Keys that several lines have are found by a pre-aggregated minimum and maximum; only the lines at
   such keys go on, and only their texts are read again.
3. At each key a line meets the earliest line that files it and the earliest that probes it. Those
   within max_edits of such a leader are settled, so a group of near copies of one line costs a few
   rows a member. Each of the rest meets all earlier lines of its keys; letter counts, compared where
   they meet, let through only the pairs that max_edits allows.
4. Pairs are verified by a banded bit-parallel edit distance: one machine word holds the
   2 * max_edits + 1 diagonals, a fold over the characters updates it.

Step 3 compares letter counts of all lines that share a key and are near no leader, which grows
with the square of such a group; only pairs that pass are rows.

Null texts have no lines; an empty text is one empty line. Null ids come last. Rows with equal id
and text count as one document: the same lines go in each. An empty table gives an empty result.
Columns other than doc_id and text are carried along, whatever their names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _shared


#: Line hashes that may be broadcast (8 bytes each); beyond that a shuffle join is used.
_BROADCAST_ROWS = 250_000


def edit_distance_within(a: Column, b: Column, most: int) -> Column:
    """Edit distance of strings where char_length(a) >= char_length(b), the difference at most `most`;
    right up to `most`, above it some larger number.

    Column j of the matrix is kept for rows j - most to j + most, one bit a row: `vp`, `vn` say where the
    next row is one more or one less, `dist` is the value on the main diagonal."""
    width = 2 * most + 1
    mask = (1 << width) - 1
    band = lambda x: x.bitwiseAND(F.lit(mask).cast("long"))
    no = lambda x: band(F.bitwise_not(x))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  evaluates value once

    def distance(chars):
        rows, text, n = chars["a"], chars["b"], F.size(chars["b"])

        def step(s, j):
            ch = F.get(text, j)
            match = F.lit(0).cast("long")
            for bit in range(width):
                row = F.when(j - most + bit >= 0, F.get(rows, j - most + bit))
                match = match.bitwiseOR(F.when(row == ch, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
            after = let(match, lambda eq: let(
                F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"),
                         band(band(eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(eq).bitwiseOR(s["vn"])).alias("d")),
                lambda x: let(
                    F.struct(x["d"].alias("d"), x["vn"].bitwiseOR(no(x["d"].bitwiseOR(x["vp"]))).alias("hp"), x["vp"].bitwiseAND(x["d"]).alias("hn")),
                    lambda y: F.struct(
                        y["hn"].bitwiseOR(no(F.shiftright(y["d"], 1).bitwiseOR(y["hp"]))).alias("vp"),
                        F.shiftright(y["d"], 1).bitwiseAND(y["hp"]).alias("vn"),
                        (s["dist"] + 1 - F.shiftright(y["d"], most).bitwiseAND(F.lit(1).cast("long")).cast("int")).alias("dist")))))
            # a diagonal above 2 * most leaves no cell of the band within `most`
            return F.when(s["dist"] > 2 * most, s).otherwise(after)

        start = F.struct(F.lit(mask ^ ((1 << most) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(0).alias("dist"))
        end = F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), start, step)
        # from the main diagonal's row down to the last row of the longer string
        down = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(rows) - n) - 1
        return let(end, lambda e: F.when(e["dist"] > 2 * most, e["dist"]).otherwise(
            e["dist"] + F.bit_count(F.shiftright(e["vp"], most).bitwiseAND(down)) - F.bit_count(F.shiftright(e["vn"], most).bitwiseAND(down))))

    chars = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    return let(F.struct(chars(a).alias("a"), chars(b).alias("b")), distance)


#: Characters whose counts, by four, tell lines apart before they are compared.
LETTERS = "etaoinsrhldcumpgwfybvkjxqz .,-"


def letter_counts(line: Column) -> Column:
    """The counts of LETTERS in a word of 64 bits, two bits each."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(3)).cast("long"), 2 * i))
    return out


def counts_within(a: Column, b: Column, most: int) -> Column:
    """Whether letter counts allow `most` edits: an edit changes two of them by one at most.

    Differences by four, added up in all pairs of bits at once: 1 and 3 count one, 2 counts two."""
    low = F.lit(int("01" * len(LETTERS), 2)).cast("long")
    odd = a.bitwiseXOR(b).bitwiseAND(low)  # the counts differ by an odd number
    two = F.shiftrightunsigned(a.bitwiseXOR(b), 1).bitwiseAND(low).bitwiseAND(F.bitwise_not(odd))  # by two
    return F.bit_count(odd) + 2 * F.bit_count(two) <= 2 * most


def probes(most: int) -> list[tuple[int, int, int]]:
    """(segment, 1 if it is a character shorter than the line's own, shift): those that a line files, then the others."""
    found = {(i, c, shift) for c in (0, 1) for i in range(most) for shift in range(-i, most + 1)} | {(most, c, 0) for c in (0, 1)}
    return sorted(found, key=lambda x: (x[1] != 0 or x[2] != 0, x))


def segment_keys(lines: DataFrame, most: int) -> DataFrame:
    """lines(line, ...) without `line`, with `size` and `keys`: hashes of the max_edits + 1 segments that
    the line files, then of the other substrings that a segment of a line shorter by 0 to `most` can equal."""
    parts = most + 1
    sized = lines.withColumn("size", F.char_length("line"))
    sized = sized.withColumns({"long": F.expr(f"cast(size div {parts} as int)"), "over": F.col("size") % parts})
    names = []
    for i, c, shift in probes(most):
        size = F.col("long") - c
        # the lines shorter by `least` to `up` have segments of that size
        least, up = (F.lit(0), F.col("over")) if c == 0 else (F.col("over") + 1, F.lit(most))
        at = F.col("size") - size if i == most else i * size + shift
        fits = (size > 0) & (at >= 0) & (at + size <= F.col("size")) & (least <= most)
        if i < most:
            fits = fits & (F.lit(shift) >= F.greatest(F.lit(-i), least - (most - i))) & (F.lit(shift) <= F.least(F.lit(i), up + (most - i)))
        names.append(f"k{len(names)}")
        sized = sized.withColumn(names[-1], F.when(fits, F.xxhash64(F.lit(i), size, F.substring(F.col("line"), at + 1, size))))
    return sized.withColumn("keys", F.array_compact(F.array(*names))).drop("line", "long", "over", *names)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_shared.NO_ID)).alias("doc"), F.xxhash64("text").alias("mark"), "text")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, mark, no, line): lines of min_chars at least; mark tells documents of equal ids apart."""
    lines = _keyed(docs).select("doc", "mark", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.where(F.char_length("line") >= min_chars)


def _few(table: DataFrame) -> DataFrame:
    """Broadcast only when its rows are counted and few."""
    return F.broadcast(table) if table.count() <= _BROADCAST_ROWS else table


def _near(pairs: DataFrame, texts: DataFrame, most: int, label: str) -> DataFrame:
    """(h, h2) of the lines x of pairs(x, y) that are within `most` edits of y."""
    side = lambda n: texts.select(F.col("h").alias(n), F.col("h2").alias(f"{n}_h2"), F.col("line").alias(f"{n}_line"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where("x_line <> y_line")
    x_longer = F.char_length("x_line") >= F.char_length("y_line")
    both = both.withColumns({"longer": F.when(x_longer, F.col("x_line")).otherwise(F.col("y_line")),
                             "shorter": F.when(x_longer, F.col("y_line")).otherwise(F.col("x_line"))})
    near = both.where(edit_distance_within(F.col("longer"), F.col("shorter"), most) <= most)
    return _shared.cut(near.select(F.col("x").alias("h"), F.col("x_h2").alias("h2")).distinct(), label)


def later_lines(first: DataFrame, docs: DataFrame, most: int, min_chars: int) -> DataFrame:
    """(h, h2) of the distinct lines first(h, h2, place, size, keys) that are within `most` edits of an earlier one."""
    # own: the line files the key; kept in the lowest bit of the line's hash
    line = F.shiftleft(F.shiftright("h", 1), 1)
    rows = first.select(line.alias("h"), F.posexplode("keys").alias("pos", "key")).select(
        "key", F.col("h").bitwiseOR(F.when(F.col("pos") <= most, 1).otherwise(0).cast("long")).alias("who"))
    several = rows.groupBy("key").agg(F.min(F.shiftright("who", 1)).alias("lo"), F.max(F.shiftright("who", 1)).alias("hi")).where("lo < hi")
    met = _shared.cut(rows.join(several.select("key").hint("shuffle_hash"), "key", "left_semi"), "op7-met")
    wanted = _shared.cut(met.select(F.shiftright("who", 1).alias("half")).distinct(), "op7-wanted")
    # their texts: the lines of these hashes, once each
    seen = _lines(docs, min_chars).select(F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), "line")
    seen = seen.withColumn("half", F.shiftright("h", 1)).join(_few(wanted), "half", "left_semi")
    known = first.withColumn("half", F.shiftright("h", 1)).join(_few(wanted), "half", "left_semi").select("h", "h2", "place", "size")
    texts = seen.groupBy("h", "h2").agg(F.first("line").alias("line")).join(known, ["h", "h2"])
    texts = _shared.cut(texts.withColumn("counts", letter_counts(F.col("line"))), "op7-texts")
    about = texts.select(F.shiftright("h", 1).alias("half"), "h", "place", "size", "counts")
    rows = met.select("key", F.shiftright("who", 1).alias("half"), (F.col("who").bitwiseAND(F.lit(1)) == 1).alias("own"))
    rows = _shared.cut(rows.join(about, "half").drop("half"), "op7-rows")
    side = lambda table, n: table.select("key", *[F.col(c).alias(f"{n}_{c}") for c in ("h", "own", "place", "size", "counts")])
    # x is the later line; the shorter of the two files the key
    order = (F.col("y_place") < F.col("x_place")) & (F.abs(F.col("x_size") - F.col("y_size")) <= most)
    roles = (F.col("y_own") & (F.col("y_size") <= F.col("x_size"))) | (F.col("x_own") & (F.col("x_size") <= F.col("y_size")))
    meet = order & roles & counts_within(F.col("x_counts"), F.col("y_counts"), most)
    columns = F.struct("place", "h", "own", "size", "counts")
    leaders = rows.groupBy("key").agg(F.min(columns).alias("any"), F.min(F.when(F.col("own"), columns)).alias("filed"))
    leaders = reduce(DataFrame.unionByName, [leaders.where(f"{n} is not null").select("key", f"{n}.*") for n in ("any", "filed")])
    pairs = lambda later, earlier: side(later, "x").join(side(earlier, "y"), "key").where(meet).select(
        F.col("x_h").alias("x"), F.col("y_h").alias("y")).distinct()
    settled = _near(pairs(rows, leaders), texts, most, "op7-settled")
    rest = rows.join(settled.select("h").distinct(), "h", "left_anti")
    return settled.unionByName(_near(pairs(rest, rows), texts, most, "op7-near")).distinct()


def kept_lines(docs: DataFrame, most: int, min_chars: int) -> DataFrame:
    """(doc, mark, kept array<int>): the numbers of the long lines that stay, for documents that have such."""
    if min_chars <= most:
        raise ValueError("lines must be longer than the edits allowed")
    docs = _shared.columns(docs, "doc_id", "text")
    lines = _lines(docs, min_chars).select(F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), F.struct("doc", "mark", "no").alias("place"), "line")
    first = segment_keys(lines, most).groupBy("h", "h2").agg(
        F.min("place").alias("place"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    first = _shared.cut(first, "op7-first")
    _shared.release(docs.sparkSession)
    later = _shared.cut(later_lines(first, docs, most, min_chars), "op7-later")
    kept = first.select("h", "h2", "place").join(_few(later), ["h", "h2"], "left_anti")
    return kept.groupBy("place.doc", "place.mark").agg(F.collect_list("place.no").alias("kept"))


def removed_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 40) -> DataFrame:
    """(doc_id, doc, mark, n_lines, removed array<int>) of every row: its lines, and the numbers, from 0, of those that go."""
    kept = kept_lines(docs, max_edits, min_chars)
    long_enough = F.filter(F.transform("lines", lambda x, i: F.when(F.char_length(x) >= min_chars, i)), lambda i: i.isNotNull())
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_shared.NO_ID)).alias("doc"), F.xxhash64("text").alias("mark"), F.split("text", "\n", -1).alias("lines"))
    rows = rows.select("doc_id", "doc", "mark", F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
                       F.coalesce(long_enough, F.array().cast("array<int>")).alias("nos"))
    none = F.array().cast("array<int>")
    return rows.join(kept, ["doc", "mark"], "left").select(
        "doc_id", "doc", "mark", "n_lines", F.array_sort(F.array_except("nos", F.coalesce("kept", none))).alias("removed"))


def _bounded(table: DataFrame, column: str, most: int = 4_000_000) -> DataFrame:
    """Broadcast only when the numbers in the table are known to be few; else a shuffle join."""
    size = table.agg(F.coalesce(F.sum(F.size(column) + 4), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= most else table


def line_dedup(docs: DataFrame, max_edits: int = 2, min_chars: int = 40) -> DataFrame:
    """docs with the text of the lines that stay, in order; all other columns as they were."""
    gone = removed_lines(docs, max_edits, min_chars).where(F.size("removed") > 0).select("doc", "mark", "removed").distinct()
    gone = _bounded(_shared.cut(gone, "op7-gone"), "removed")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_shared.NO_ID)).alias("doc"), F.xxhash64("row.text").alias("mark"))
    joined = row.join(gone, ["doc", "mark"], "left")
    stay = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(stay)
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, max_edits: int = 2, min_chars: int = 40) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): line counts of every row, and the numbers of lines that go."""
    return removed_lines(docs, max_edits, min_chars).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))
