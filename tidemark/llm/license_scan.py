"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, let, materialize, table

#: Everything that parts words: all of ASCII but 0-9 and a-z, on lower-cased text.
SEPARATOR = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label and wording of public license notices; one block holds a notice.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0."),
]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(f"[{SEPARATOR}]+", text.lower()) if w]


def _spaced(text: Column) -> Column:
    """Each word between two spaces of its own; empty without words."""
    core = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), f"[{SEPARATOR}]+", "  "))
    return F.when(core == "", F.lit("")).otherwise(F.concat(F.lit(" "), core, F.lit(" ")))


def _n_words(spaced: Column) -> Column:
    return ((F.char_length(spaced) - F.char_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _base(s: Column) -> Column:
    """Struct of the base values of a spaced text."""
    needles = {p: " " + "  ".join(p.split()) + " " for p in PHRASES}
    places = lambda n: ((F.char_length(s) - F.char_length(F.replace(s, F.lit(n), F.lit("")))) / len(n)).cast("long")
    has = lambda n: F.contains(s, F.lit(n))
    first = lambda n: F.when(has(n), _n_words(F.substring_index(s, n, 1)))
    last = lambda p, n: F.when(has(n), _n_words(s) - _n_words(F.substring_index(s, n, -1)) - len(p.split()))
    total = sum((F.when(has(n), places(n)).otherwise(F.lit(0).cast("long")) for n in needles.values()), F.lit(0).cast("long"))
    return F.struct(
        _n_words(s).alias("n_words"), total.alias("n_base"),
        F.least(*[first(n) for n in needles.values()]).alias("first_word"),
        F.greatest(*[last(p, n) for p, n in needles.items()]).alias("last_word"),
        F.filter(F.array(*[F.when(has(n), F.lit(PHRASES[p])) for p, n in needles.items()]), lambda x: x.isNotNull()).alias("base"),
    )


def _met_by_runs(parsed: DataFrame, templates: list[tuple]) -> DataFrame:
    """row, label, share of the templates (label, words, prefix, least, longest) that a run of at most longest words meets.

    The best run starts at a template word, so a run is tried from each one, as the template words that follow in it.
    """
    strings = lambda ws: F.array(*[F.lit(w) for w in ws]).cast("array<string>")
    known = [F.struct(F.lit(label).alias("label"), strings(ws).alias("t_words"), strings(prefix).alias("prefix"), F.lit(least).alias("least"), F.lit(longest).alias("longest")) for label, ws, prefix, least, longest in templates]
    texts = parsed.where("text_words IS NOT NULL").select("row", "vocabulary", "text_words")
    pairs = texts.select("row", "text_words", F.explode(F.filter(F.array(*known), lambda t: F.size(F.array_intersect("vocabulary", t.t_words)) >= t.least)).alias("t")).select("row", "text_words", "t.*")
    placed = F.filter(F.transform("text_words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(F.col("t_words"), x.word))
    run = lambda at, x, i: F.filter(F.slice(at, i + 1, F.col("longest")), lambda y: y["at"] < x["at"] + F.col("longest"))
    able = lambda r: (F.size(r) >= F.col("least")) & F.exists(r, lambda y: F.array_contains(F.col("prefix"), y.word))
    most = let(placed, lambda at: F.array_max(F.transform(at, lambda x, i: let(run(at, x, i), lambda r: F.when(able(r), F.size(F.array_distinct(F.transform(r, lambda y: y.word))))))))
    return pairs.select("row", "label", "least", "t_words", most.alias("n")).where("n >= least").select("row", "label", (F.col("n") / F.size("t_words")).alias("share"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, across_lines: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    Blocks are the \\n-split lines of a text, taken as sets of words; across_lines adds, for each template, all runs of
    consecutive words of the whole text that are at most 1 / threshold times as long as the template, so that a notice
    may be wrapped. A block meets a template if it holds at least
    threshold of the template's distinct words; score is the largest share that any template reaches in a meeting
    block, 1 for a base phrase, else 0. The join is exact: words of all templates are ordered by the number of
    documents that hold them, rarest first (template words only, a set that the templates bound); a block can only
    meet a template of n words, needing c = ceil(threshold n), if it holds c template words at all (length filter),
    one of the template's n - c + 1 rarest (prefix filter), and enough words from its first shared one on in both
    orders (positional filter); what passes is verified on the whole sets. Runs are looked at only in texts that hold c
    of the template's words at all, from one template word on, and only with a word of the prefix in them. Only prefix
    words leave a block, and they meet the templates' prefixes where they are: these are broadcast, a table that the
    templates bound whatever the documents, so that a common word's blocks needn't meet in one task. Null texts are
    empty: no words, no labels. Rows that repeat a doc_id are scanned each; further columns are not looked at.
    """
    sets = [(label, list(dict.fromkeys(words_of(text)))) for label, text in templates]
    need = lambda ws: -int(-threshold * len(ws) // 1)
    vocabulary, least = sorted({w for _, ws in sets for w in ws}), min((need(ws) for _, ws in sets), default=1)
    known = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    lines = F.split(F.regexp_replace(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), f"[{SEPARATOR}&&[^\\n]]+", " "), "\n")
    blocks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.array_intersect(known, F.split(x, " ")).alias("words"))), lambda b: F.size(b.words) >= least)
    strings = lambda ws: F.array(*[F.lit(w) for w in ws]).cast("array<string>")
    holds = lambda v, ws: F.size(F.array_intersect(v, strings(ws))) >= need(ws)
    may_meet = lambda v: F.exists(F.array(F.lit(False), *[holds(v, ws) for _, ws in sets]), lambda x: x) if across_lines else F.lit(False)
    of_text = lambda s, ws: let(F.array_intersect(known, ws), lambda v: F.struct(_base(s).alias("b"), v.alias("v"), F.when(may_meet(v), ws).alias("words")))
    parsed = docs.select("doc_id", let(_spaced(F.col("text")), lambda s: let(F.split(s, " +"), lambda ws: of_text(s, ws))).alias("x"), blocks.alias("blocks"))
    parsed = materialize(parsed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "x.b.*", F.col("x.v").alias("vocabulary"), F.col("x.words").alias("text_words"), "blocks"), "license-blocks")

    seen = {r["w"]: r["n"] for r in parsed.select(F.explode("vocabulary").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    ordered = [(k, label, sorted(ws, key=rank.get)) for k, (label, ws) in enumerate(sets)]
    prefixes = [(k, label, ws, w, p, need(ws)) for k, label, ws in ordered for p, w in enumerate(ws[: len(ws) - need(ws) + 1])]
    wanted = docs.sparkSession.createDataFrame(prefixes, "template int, label string, t_words array<string>, word string, t_pos int, least int")
    by_rank = F.array(*[F.lit(w) for w in order]).cast("array<string>")
    held = parsed.select("row", F.explode("blocks").alias("b")).select("row", "b.line", F.array_intersect(by_rank, F.col("b.words")).alias("words"))
    first = [w for w in order if any(w == p[3] for p in prefixes)]
    placed = held.select("row", "words", F.posexplode("words").alias("pos", "word")).where(F.col("word").isin(first) if first else F.lit(False))
    near = placed.join(F.broadcast(wanted), "word").where(
        (F.size("words") >= F.col("least")) & (F.least(F.size("t_words") - F.col("t_pos"), F.size("words") - F.col("pos")) >= F.col("least"))
    )
    share = F.size(F.array_intersect("words", "t_words")) / F.size("t_words")
    met = near.where(F.size(F.array_intersect("words", "t_words")) >= F.col("least")).select("row", "label", share.alias("share"))
    if across_lines:
        longest = [-int(-len(words_of(text)) / threshold // 1) for _, text in templates]
        met = met.union(_met_by_runs(parsed, [(label, ws, ws[: len(ws) - need(ws) + 1], need(ws), longest[k]) for k, label, ws in ordered]))
    met = met.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    return parsed.join(met, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), across_lines=True)


def _sql(templates=TEMPLATES, threshold: float = 0.8) -> str:
    """The scan of op5_license_scan in DuckDB's SQL: every line and every run of words with every template, unfiltered but
    for texts that don't hold enough of its words at all."""
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    words = f"'[^{SEPARATOR}]+'"
    known = ", ".join(f"('{label}', {listed(dict.fromkeys(words_of(text)))}, {-int(-threshold * len(set(words_of(text))) // 1)}, {-int(-len(words_of(text)) / threshold // 1)})" for label, text in templates)
    phrases = ", ".join(f"('{label}', {listed(p.split())})" for p, label in PHRASES.items())
    return f"""
WITH tpl(label, x, need, longest) AS (VALUES {known}), ph(label, p) AS (VALUES {phrases}),
dw AS (SELECT row_number() OVER () AS r, doc_id, t, regexp_extract_all(t, {words}) AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
pl AS (SELECT r, label, i - 1 AS place FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM dw), ph WHERE w[i] = p[1] AND list_slice(w, i, i + len(p) - 1) = p),
ba AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM pl GROUP BY r),
ca AS (SELECT r, t, w, label, x, need, longest FROM dw, tpl WHERE len(list_intersect(list_distinct(w), x)) >= need),
bl AS (SELECT r, label, x, need, regexp_extract_all(l, {words}) AS b FROM (SELECT r, label, x, need, unnest(string_split(t, chr(10))) AS l FROM ca)
  UNION ALL SELECT r, label, x, need, list_slice(w, i, i + longest - 1) FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ca)),
mt AS (SELECT r, list(DISTINCT label) AS found, max(k / m) AS share FROM (SELECT r, label, need, len(list_intersect(list_distinct(b), x)) AS k, len(x) AS m FROM bl) WHERE k >= need GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base, found))), ','), '') AS labels,
  CASE WHEN base IS NOT NULL THEN 1e0 ELSE coalesce(share, 0e0) END AS score
FROM dw LEFT JOIN ba USING (r) LEFT JOIN mt USING (r)"""


OP5_SQL = _sql()
