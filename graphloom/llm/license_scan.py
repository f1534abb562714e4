"""License scans by diagonal voting.

1. Every text becomes words (A-Z lower-cased); all its rolling word k-grams are rows (place, hash, gram).
2. They are joined by hash to the places of the templates' k-grams, a table of a few thousand rows at most that is
   broadcast; the grams themselves are compared too, so equal hashes of different words are no hit.
3. A hit votes for the diagonal (place in the text - place in the template). Votes are partial sums, so copies of a
   text and frequent words collapse before they are shuffled.
4. Neighbouring diagonals of a template whose hits follow one another are merged into one span: words put in or left
   out of a notice move the rest to the next diagonal.
5. A span is verified by its words: template words that stand in it, over the longer of template and span. Base
   phrases must have all their words on one diagonal.

Null texts are empty, rows of a null id are documents like all others, each repeated row gets its row, no text is cut:
a very long text is one row of grams after another. Other columns are not read. No hit spans two documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import columns

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a gram; a template of fewer words is one gram.
GRAM = 4

# Opening passages of public license notices.
NOTICES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
             "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
            "You can obtain one at"),
]


def words(text: Column) -> Column:
    """The words of a text, cut at what is none: far quicker than finding each by a pattern."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_grams(spark, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """(template, label, base, size, k, place, gram): the places of all templates' grams."""
    rows = []
    for no, (label, text, base) in enumerate([(n, t, True) for n, t in phrases] + [(n, t, False) for n, t in notices]):
        own = template_words(text)
        if not own:
            raise ValueError(f"a template of {label} has no words")
        k = min(2 if base else GRAM, len(own))
        rows += [(no, label, base, len(own), k, at, " ".join(own[at:at + k])) for at in range(len(own) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, size int, k int, t int, gram string")


def _rows(own: Column, key: Column, sizes: list[int]) -> Column:
    """Of a text's words: their number at place -1, then the places of all grams of the sizes; each with the text's key."""
    row = lambda at, gram, n: F.struct(at.alias("at"), gram.alias("gram"), n.alias("n"), key.alias("text_hash"))
    none = F.lit(None).cast("int")
    each = lambda k: F.when(F.size(own) >= k, F.transform(F.sequence(F.lit(0), F.size(own) - k), lambda i: row(
        i, F.array_join(F.slice(own, i + 1, k), " "), none))).otherwise(F.array().cast("array<struct<at: int, gram: string, n: int, text_hash: bigint>>"))
    return F.concat(F.array(row(F.lit(-1), F.lit(None).cast("string"), F.size(own))), *map(each, sizes))


def spans(docs: DataFrame, phrases: list[tuple[str, str]], notices: list[tuple[str, str]] = NOTICES, shift: int = 8, gap: int = 8) -> DataFrame:
    """Spans (doc_id, text_hash, n_words, copies, label, base, first, last, similarity) of documents(doc_id, text).

    Each distinct (doc_id, text_hash) has a row without a label as well, which counts its copies. Diagonals `shift`
    apart at most are merged where the second begins `gap` words behind the first at most. first and last: its words."""
    places = template_grams(docs.sparkSession, phrases, notices)
    sizes = sorted({r.k for r in places.select("k").distinct().collect()})  # k-values of the fixed templates
    # words and key are bound once, in a lambda: a column beside the grams, the text too, would be copied to each row
    text = F.array(F.struct(words(F.col("text")).alias("own"), F.xxhash64("text", F.char_length("text")).alias("key")))
    each = columns(docs, "doc_id", "text").select("doc_id", F.explode(F.flatten(F.transform(text, lambda x: _rows(x["own"], x["key"], sizes)))).alias("g"))
    each = each.select("doc_id", "g.text_hash", "g.n", "g.at", "g.gram", F.xxhash64("g.gram").alias("hash"))
    right = F.broadcast(places.withColumn("hash", F.xxhash64("gram")).withColumnRenamed("gram", "template_gram"))  # bounded by the templates
    hits = each.join(right, "hash", "left").where("at = -1 or gram = template_gram")  # one long as key: the quickest table

    votes = hits.groupBy("doc_id", "text_hash", "template", (F.col("at") - F.col("t")).alias("diagonal")).agg(
        F.max("n").alias("n_words"), F.count_if(F.col("at") == -1).alias("copies"), F.max("label").alias("label"), F.max("base").alias("base"),
        F.max("size").alias("size"), F.max("k").alias("k"), F.collect_set("t").alias("t"), F.min("at").alias("first"), F.max("at").alias("last"))

    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("first", "diagonal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.col("base") | (F.col("first") - F.max("last").over(before) - F.col("k") > gap) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > shift)
    placed = votes.withColumn("new", F.when(F.coalesce(apart, F.lit(False)), 1).otherwise(0)).withColumn("span", F.sum("new").over(order))
    merged = placed.groupBy("doc_id", "text_hash", "template", "span").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.max("label").alias("label"), F.max("base").alias("base"), F.max("size").alias("size"),
        F.max("k").alias("k"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"), F.min("first").alias("first"), F.max("last").alias("last"))
    # words of the template that a gram of the span covers, over the longer of the two
    found = F.size(F.array_distinct(F.flatten(F.transform("t", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    long = F.greatest(F.col("size"), F.col("last") + F.col("k") - F.col("first"))
    return merged.select("doc_id", "text_hash", "n_words", "copies", "label", "base", "first", (F.col("last") + F.col("k") - 1).alias("last"),
                         F.when(F.col("label").isNotNull(), found / long).alias("similarity"))


def scan(docs: DataFrame, phrases: list[tuple[str, str]], notices: list[tuple[str, str]] = NOTICES, least: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each document.

    Base labels stand where all words of a phrase follow one another; a notice adds its label from a similarity of
    `least`, where none that overlaps it is more similar. Score: the best similarity of a span, 1 where a base phrase stands."""
    notice = F.coalesce(~F.col("base") & (F.col("similarity") >= least), F.lit(False))
    order = Window.partitionBy("doc_id", "text_hash", "notice").orderBy("first", "last", "label")
    apart = F.when(F.col("first") > F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    found = spans(docs, phrases, notices).withColumn("notice", notice).withColumn("apart", apart).withColumn("island", F.sum("apart").over(order))
    found = found.withColumn("best", F.max("similarity").over(Window.partitionBy("doc_id", "text_hash", "notice", "island")))
    exact = F.col("base") & (F.col("similarity") == 1.0)
    named = exact | (F.col("notice") & (F.col("similarity") == F.col("best")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    rows = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("copies").alias("copies"), F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(exact, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(exact, F.col("label"))).alias("base_labels"), joined(F.when(named, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(exact | ~F.col("base"), F.col("similarity"))), F.lit(0.0)).alias("score"))
    # a row for each copy, in steps: no list grows with their number beyond a step
    steps = rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(65536).cast("long"))))
    return steps.withColumn("copy", F.explode(F.sequence("step", F.least(F.col("step") + 65535, F.col("copies") - 1)))).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
