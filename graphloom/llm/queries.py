"""The registered queries of this subpackage: one thin query for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe as op3
from graphloom.llm import conv_trie as op13
from graphloom.llm import html_main as op1
from graphloom.llm import license_scan as op11
from graphloom.llm import line_dedup as op7
from graphloom.llm import ngram_join as op6
from graphloom.llm import nn_descent as op10
from graphloom.llm import nra_topk as op4
from graphloom.llm import packing as op9
from graphloom.llm import suffix_dedup as op8
from graphloom.llm import toxicity as op2
from graphloom.llm import url_reputation as op5
from graphloom.llm import whitening as op12
from graphloom.llm._shared import table

#: (verdict, host and path) of the url rules.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.extract_main(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = op2.learn(docs, labels.where(~op2.held_out()))
    return op2.score(docs, model).select("doc_id", op2.held_out().alias("held_out"), "score", "predicted")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page shows the document whose number ends its path; that document's label judges it."""
    shown = pages.select("page_id", F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint)").alias("doc_id"))
    bad = labels.where("quality is not null or toxic is not null").select("doc_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    return shown.join(bad, "doc_id").select("page_id", "bad")


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = op5.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH split AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS doc_id
  FROM pages),
known AS (
  SELECT host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS bad
  FROM split JOIN labels USING (doc_id) WHERE page_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)),
counted AS (
  SELECT host, sum(n) AS n, sum(b) AS b, string_split(host, '.') AS p FROM (
    SELECT host, 0.0::DOUBLE AS n, 0.0::DOUBLE AS b FROM split GROUP BY host
    UNION ALL SELECT host, count(*)::DOUBLE, sum(bad)::DOUBLE FROM known GROUP BY host) GROUP BY host),
tops AS (
  SELECT *, CASE WHEN len(p) >= 3 AND length(p[-1]) = 2 AND p[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS k FROM counted),
hosts AS (
  SELECT host, n, b, array_to_string(p[-k:], '.') AS suffix,
    array_to_string(p[greatest(len(p) - k, 1):], '.') AS domain FROM tops),
doms AS (SELECT domain, sum(n) AS n, sum(b) AS b, any_value(suffix) AS suffix FROM hosts GROUP BY domain),
sufs AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM doms GROUP BY suffix),
base AS (SELECT (coalesce(sum(b), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m, coalesce(sum(n), 0) AS an FROM sufs),
s0 AS (SELECT suffix, n, b, m, m * (1 - m) / (an + 3) AS v FROM sufs, base),
s1 AS (SELECT coalesce(CASE WHEN sum((n - 1) * n * m * (1 - m)) > 0 THEN least(greatest(
  sum((b - n * m) * (b - n * m) - n * m * (1 - m)) / sum((n - 1) * n * m * (1 - m)), 1.0::DOUBLE / 1001), 0.5) END, 1.0::DOUBLE / 21) AS r FROM s0 WHERE n > 0),
s2 AS (SELECT *, (b + (1 / r - 1) * m) / (n + (1 / r - 1)) AS mean FROM s0, s1),
s3 AS (SELECT suffix, mean AS m, CASE WHEN n > 0 THEN mean * (1 - mean) / (n + 1 / r) ELSE r * m * (1 - m) + (1 - r) * v END AS v FROM s2),
d0 AS (SELECT domain, n, b, m, v FROM doms JOIN s3 USING (suffix)),
d1 AS (SELECT coalesce(CASE WHEN sum((n - 1) * n * m * (1 - m)) > 0 THEN least(greatest(
  sum((b - n * m) * (b - n * m) - n * m * (1 - m)) / sum((n - 1) * n * m * (1 - m)), 1.0::DOUBLE / 1001), 0.5) END, 1.0::DOUBLE / 21) AS r FROM d0 WHERE n > 0),
d2 AS (SELECT *, (b + (1 / r - 1) * m) / (n + (1 / r - 1)) AS mean FROM d0, d1),
d3 AS (SELECT domain, mean AS m, CASE WHEN n > 0 THEN mean * (1 - mean) / (n + 1 / r) ELSE r * m * (1 - m) + (1 - r) * v END AS v FROM d2),
h0 AS (SELECT host, n, b, m, v FROM hosts JOIN d3 USING (domain)),
h1 AS (SELECT coalesce(CASE WHEN sum((n - 1) * n * m * (1 - m)) > 0 THEN least(greatest(
  sum((b - n * m) * (b - n * m) - n * m * (1 - m)) / sum((n - 1) * n * m * (1 - m)), 1.0::DOUBLE / 1001), 0.5) END, 1.0::DOUBLE / 21) AS r FROM h0 WHERE n > 0),
h2 AS (SELECT *, (b + (1 / r - 1) * m) / (n + (1 / r - 1)) AS mean FROM h0, h1),
bound AS (SELECT host, mean - sqrt(CASE WHEN n > 0 THEN mean * (1 - mean) / (n + 1 / r) ELSE r * m * (1 - m) + (1 - r) * v END) AS bad_bound FROM h2),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM split)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN bad_bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN bound USING (host)
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return op3.digest(op3.decode(op3.encode(table(spark, sf_dir, "documents"), path), path))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.ngram_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.report(table(spark, sf_dir, "documents"), max_edits=2, min_chars=40)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.digest(op8.suffix_dedup(table(spark, sf_dir, "documents"), length=50))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


#: Sets of shingles, counted pairs of those that share one, links, and the smallest id reachable.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
ids AS (SELECT s, list(doc_id) AS d FROM shingle GROUP BY 1 HAVING count(*) > 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM shingle x JOIN shingle y USING (s) WHERE x.doc_id < y.doc_id AND s IN (SELECT s FROM ids) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * pairs.both >= 90 * (p.n + q.n - pairs.both)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS c FROM ways UNION SELECT w.b, r.c FROM reach r JOIN ways w ON w.a = r.id),
roots AS (SELECT id, min(c) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN roots ON id = d.doc_id
"""

#: Lines that share a third, at a shift of two at most, and are two edits apart; letters beyond ASCII are single bytes for the distance.
OP7_SQL = r"""
WITH long AS (
  SELECT doc_id, no - 1 AS no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
  WHERE length(line) >= 40),
firsts AS (SELECT line, arg_min({'d': doc_id, 'n': no}, {'d': doc_id, 'n': no}) AS place, length(line) AS l, row_number() OVER () AS h,
  translate(line, 'éèêçäöüßáíóúñàâîôû', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(11) || chr(12) || chr(14) || chr(15) || chr(16) || chr(17) || chr(18) || chr(19) || chr(20) || chr(21)) AS flat
  FROM long GROUP BY line),
own AS (SELECT h, i, l // 3 AS s, substr(line, i * (l // 3) + 1, l // 3) AS part FROM firsts, range(3) r(i)),
ask AS (SELECT DISTINCT h, i, (l - d) // 3 AS s, substr(line, i * ((l - d) // 3) + shift + 1, (l - d) // 3) AS part
  FROM firsts, range(3) r(i), range(3) e(d), range(-2, 3) f(shift) WHERE i * ((l - d) // 3) + shift >= 0),
met AS (SELECT DISTINCT o.h AS a, p.h AS b FROM own o JOIN ask p USING (i, s, part) WHERE o.h <> p.h),
near AS (SELECT x.line AS la, x.place AS pa, y.line AS lb, y.place AS pb FROM met JOIN firsts x ON x.h = a JOIN firsts y ON y.h = b
  WHERE abs(x.l - y.l) <= 2 AND levenshtein(x.flat, y.flat) <= 2),
later AS (SELECT lb AS line FROM near WHERE pa < pb UNION SELECT la FROM near WHERE pb < pa),
gone AS (SELECT doc_id, list(no ORDER BY no) AS g FROM long JOIN firsts USING (line) WHERE place <> {'d': doc_id, 'n': no} OR line IN (FROM later) GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
  coalesce(array_to_string(list_transform(g, lambda x: x::VARCHAR), ','), '') AS removed FROM documents LEFT JOIN gone USING (doc_id)
"""

#: Every 50-byte string with its smallest document; the bytes that later ones cover, as islands; the rest put together.
OP8_SQL = r"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(n - 49)) AS p FROM raw WHERE n >= 50)),
least_of AS (SELECT w, min(doc_id) AS d FROM starts GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM starts JOIN least_of USING (w) WHERE d < doc_id),
marked AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
island AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked) GROUP BY doc_id, g),
edges AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM island GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(len(a) + 1), lambda i:
    substr(x, 2 * (CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1, 2 * ((CASE WHEN i = len(a) THEN n ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE b[i] END)))), '') END)) AS kept_sha256
FROM raw LEFT JOIN edges USING (doc_id)
"""


#: (label, phrase): their words must stand one after another.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.scan(table(spark, sf_dir, "documents"), PHRASES)


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
#: Votes by diagonal, spans of neighbouring diagonals, and the share of words that they cover.
OP11_SQL = r"""
WITH template AS (SELECT no, label, base, regexp_extract_all(lower(notice), '[a-z0-9]+') AS tw FROM (VALUES """ + ", ".join(
    f"({no}, {_quoted(label)}, {base}, {_quoted(text)})" for no, (label, text, base) in enumerate([(n, t, True) for n, t in PHRASES] + [(n, t, False) for n, t in op11.NOTICES])) + r""") AS v(no, label, base, notice)),
sized AS (SELECT *, len(tw) AS size, least(CASE WHEN base THEN 2 ELSE 4 END, len(tw)) AS k FROM template),
place AS (SELECT no, label, base, size, k, unnest(range(size - k + 1)) AS t, tw FROM sized),
gram AS (SELECT no, label, base, size, k, t, array_to_string(tw[t + 1:t + k], ' ') AS gram FROM place),
doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
each AS (SELECT rid, n.k, unnest(range(greatest(len(w) - n.k + 1, 0))) AS p, w FROM doc, (SELECT DISTINCT k FROM sized) n),
hit AS (SELECT e.rid, e.p, g.* FROM each e JOIN gram g ON g.k = e.k AND g.gram = array_to_string(w[e.p + 1:e.p + e.k], ' ')),
vote AS (SELECT rid, no, p - t AS diag, any_value(label) AS label, any_value(base) AS base, any_value(size) AS size, any_value(k) AS k, list(DISTINCT t) AS ts, min(p) AS a, max(p) AS b FROM hit GROUP BY 1, 2, 3),
marked AS (SELECT *, CASE WHEN base OR a - max(b) OVER before - k > 8 OR abs(diag - lag(diag) OVER before) > 8 THEN 1 ELSE 0 END AS new FROM vote
  WINDOW before AS (PARTITION BY rid, no ORDER BY a, diag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spanned AS (SELECT *, sum(new) OVER (PARTITION BY rid, no ORDER BY a, diag) AS s FROM marked),
span AS (SELECT rid, any_value(no) AS no, any_value(label) AS label, any_value(base) AS base, any_value(size) AS size, any_value(k) AS k, list_distinct(flatten(list(ts))) AS ts, min(a) AS a, max(b) AS b FROM spanned GROUP BY rid, no, s),
scored AS (SELECT *, len(list_distinct(flatten(list_transform(ts, lambda t: range(t, t + k))))) / greatest(size, b + k - a) AS sim FROM span),
island AS (SELECT rid, no, a, label, sum(new) OVER (PARTITION BY rid ORDER BY a, e, label) AS s, sim FROM (
  SELECT *, b + k - 1 AS e, CASE WHEN a > max(b + k - 1) OVER (PARTITION BY rid ORDER BY a, b + k - 1, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM scored WHERE NOT base AND sim >= 0.8)),
kept AS (SELECT rid, label FROM island i WHERE sim = (SELECT max(sim) FROM island j WHERE j.rid = i.rid AND j.s = i.s)),
named AS (SELECT rid, count_if(base AND sim = 1) AS n_base, min(a) FILTER (base AND sim = 1) AS first_word, max(a) FILTER (base AND sim = 1) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND sim = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER ((base AND sim = 1) OR (rid, label) IN (SELECT (rid, label) FROM kept)) AS labels,
  max(sim) FILTER (NOT base OR sim = 1) AS score FROM scored GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM doc LEFT JOIN named USING (rid)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.whitened(table(spark, sf_dir, "embeddings"), k=4, scale=256)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.trie(table(spark, sf_dir, "conversations"), every=20, most=4)


#: Nodes as groups of equal prefixes; subtrees by the prefixes of each node's smallest member.
OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS id, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
    lambda s, b: list_reduce([xor(s, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)))) % 4 AS h
  FROM t GROUP BY 1),
again AS (SELECT id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = id - id % 20 AND p <= h
  UNION ALL SELECT id, 1, p, role, text FROM c JOIN t ON t.conv_id = id AND p > h),
placed AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY own, p) AS d, md5(strlen(role) || ':' || role || text) AS h, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM again),
pre AS (SELECT id, d, md5(string_agg(h, '') OVER (PARTITION BY id ORDER BY d)) AS k, words FROM placed UNION ALL SELECT id, 0, '', 0 FROM c),
up AS (SELECT *, lag(k) OVER (PARTITION BY id ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY id) AS ended FROM pre),
node AS (SELECT d, k, any_value(parent) AS parent, min(id) AS conv_id, count(*) AS n, any_value(words) AS w, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (ended) AS ends FROM up GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, parent AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
below AS (SELECT p.d, p.k, count_if(b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.w) AS saved FROM full_node b JOIN pre p ON p.id = b.conv_id AND p.d <= b.d GROUP BY 1, 2)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM full_node x JOIN below USING (d, k) LEFT JOIN node y ON y.d = x.d - 1 AND y.k = x.parent
"""


QUERIES = {"op7_line_dedup": op7_line_dedup, "op4_nra_topk": op4_nra_topk, "op10_nn_descent": op10_nn_descent, "op1_html_main": op1_html_main, "op2_toxicity": op2_toxicity, "op5_url_reputation": op5_url_reputation, "op6_ngram_join": op6_ngram_join, "op3_bpe": op3_bpe, "op8_suffix_dedup": op8_suffix_dedup, "op9_packing": op9_packing,
           "op11_license_scan": op11_license_scan, "op12_whitening": op12_whitening, "op13_conversation_trie": op13_conversation_trie}

ORACLE: dict[str, str] = {"op4_nra_topk": OP4_SQL, "op5_url_reputation": OP5_SQL, "op6_ngram_join": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_suffix_dedup": OP8_SQL,
                          "op11_license_scan": OP11_SQL, "op13_conversation_trie": OP13_SQL}
