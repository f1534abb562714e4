"""Scalar rules as Column expressions: they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c) -> Column:
    """White space of any kind to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def token_estimate(c) -> Column:
    """A token for each four bytes, rounded up."""
    return F.ceil(F.octet_length(c) / 4)


def question_key(c) -> Column:
    return F.regexp_replace(collapse(F.lower(c)), r"[?!.… ]+$", "")


def compact_name(c) -> Column:
    """Letters and digits, lower case, without a final plural s."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    plural = (F.octet_length(bare) > 3) & bare.endswith("s") & ~bare.endswith("ss")
    return F.when(plural, F.substring(bare, F.lit(1), F.char_length(bare) - 1)).otherwise(bare)


def entity_id(label, name) -> Column:
    return F.concat(F.lower(label), F.lit(":"), F.lower(name))


def once(c, use) -> Column:
    """use(c) with c evaluated once, however often `use` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def clean_name(c) -> Column:
    """Entity name: collapsed, bare of outer punctuation, a cut-off parenthesis closed again; null under two letters or digits.

    A name of plain letters and digits alone is clean: most are, and pass without the other rules."""
    bare = F.regexp_replace(F.regexp_replace(collapse(c), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")
    closed = once(bare, lambda b: F.when(b.contains("(") & ~b.contains(")"), F.concat(b, F.lit(")"))).otherwise(b))
    checked = once(closed, lambda x: F.when(F.char_length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) >= 2, x))
    return F.when(c.rlike(r"\A[A-Za-z0-9]{2,}\z"), c).otherwise(checked)


def is_noise(c, stopwords) -> Column:
    """A stopword, or one word with neither an upper-case letter nor a digit."""
    plain_word = ~c.rlike(r"\s") & ~c.rlike(r"[\p{Lu}0-9]")
    return F.lower(c).isin(*stopwords) | plain_word


def clip(c, most: int) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("…"))).otherwise(c)


def vector(values) -> Column:
    """A question's vector as one constant."""
    return F.expr("array(" + ", ".join(f"double('{float(x)!r}')" for x in values) + ")")


def cosine(a, b) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-c))


def bm25(tf, length, df, n, mean, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def strength(weight, a, b) -> Column:
    """Jaccard strength of an edge from its weight and its ends' counts."""
    return weight / F.greatest(a + b - weight, weight, F.lit(1))


def relevance_band(c) -> Column:
    return F.when(c >= 0.86, "strong").when(c >= 0.82, "good").otherwise("weak")


def document_kind(source) -> Column:
    """Kind of document by its source's ending."""
    end = F.lower(F.regexp_extract(F.regexp_replace(source, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    return (F.when(end == "pdf", "pdf").when(end.isin("doc", "docx", "odt"), "word").when(end.isin("ppt", "pptx"), "slides")
            .when(end.isin("md", "markdown"), "markdown").when(end.isin("htm", "html") | source.rlike("^https?://"), "web")
            .when(end.isin("txt", "text"), "text").otherwise("other"))


def slug(c) -> Column:
    """Lower case, accents folded, other runs to one hyphen."""
    folded = F.translate(F.lower(c), "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_title(c) -> Column:
    """Title from a file's name."""
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return collapse(F.translate(stem, "_", " "))


def parse_list(c) -> Column:
    """Comma-separated values, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def normal_tags(tags) -> Column:
    """Collapsed, empty ones dropped, the first spelling of each kept."""
    clean = F.filter(F.transform(tags, lambda t: collapse(t)), lambda t: t != "")
    keys = F.transform(clean, lambda t: F.lower(t))
    return F.filter(clean, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1)


def count_label(n, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n <= 1, one).otherwise(many))


def image_type(content) -> Column:
    """png, jpg, gif or webp by the first bytes; null for all others."""
    head = F.hex(F.substring(content, 1, 12))
    return (F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif")
            .when(head.startswith("52494646") & head.endswith("57454250"), "webp"))


def useful_alt(alt) -> Column:
    """Alternative text worth keeping: no automatic description, numbered picture, file name or essay."""
    text = collapse(alt)
    auto = F.lower(text).rlike(r"(automatically|automatiquement)")
    numbered = F.lower(text).rlike(r"^(picture|image|photo|graphic|graphique|figure|img)\s*\d*$")
    file_name = F.lower(text).rlike(r"\.(png|jpe?g|gif|webp|svg|bmp|emf|wmf|tiff?)$")
    return F.when((text != "") & ~auto & ~numbered & ~file_name & (F.char_length(text) <= 300), text)


#: Dotted leaders of a table of contents, some read as U+FFFD.
LEADERS = r"[ \t]*(?:[.·•…_‧∙⋅\uFFFD][ \t]?){4,}"


def clip_bytes(c, most: int = 300) -> Column:
    """At most `most` bytes of UTF-8, cut between characters."""
    raw = c.cast("binary")
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, most - i).cast("string")) for i in range(4)])
    return F.when(F.octet_length(c) > most, F.concat(cut, F.lit("…"))).otherwise(c)


def natural_key(c) -> Column:
    """Sort key where runs of digits compare as numbers and stand after other text: each run behind its length."""
    parts = F.regexp_extract_all(c, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("1"), F.lpad(F.char_length(number(x)).cast("string"), 9, "0"), number(x)))
                       .otherwise(F.concat(F.lit("0"), x)))


def collapse_leaders(c) -> Column:
    """Leaders of four at least become one ellipsis."""
    return F.regexp_replace(c, LEADERS, " … ")


def join_hyphenated(c) -> Column:
    """A word cut at a line's end is joined before a lower-case letter."""
    return F.regexp_replace(c, r"(\p{L})-\n\s*(?=\p{Ll})", "$1")


def age_group(day, today) -> Column:
    """Group of a conversation in a list by age."""
    days = F.datediff(today, day)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, "week").when(days < 30, "month").otherwise("older")


#: Spans of a job's stages, in per cent.
JOB_STAGES = {"queued": (0, 0), "extracting": (0, 5), "chunking": (5, 8), "embedding": (8, 45), "entities": (45, 90), "writing": (90, 99), "done": (100, 100), "failed": (100, 100)}


def stage_percent(stage: str, done: int, total: int) -> int:
    """job_percent() of one job."""
    low, high = JOB_STAGES.get(stage, (100, 100))
    return round(low + (min(done / total, 1) if total > 0 else 0) * (high - low))


def job_percent(stage, done, total) -> Column:
    """Progress of a job from its stage's span and the share of the stage that is done."""
    share = F.when(total > 0, F.least(done / total, F.lit(1.0))).otherwise(F.lit(0.0))
    out = F.lit(0.0)
    for name, (low, high) in JOB_STAGES.items():
        out = F.when(stage == name, F.lit(float(low)) + share * (high - low)).otherwise(out)
    return F.round(out).cast("int")


def highlight(c, terms: list[str], before: str = "**", after: str = "**") -> Column:
    """Whole words of the terms marked, longer terms first."""
    import re

    if not terms:
        return c
    words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}")
