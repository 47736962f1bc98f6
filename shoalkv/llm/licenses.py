"""Operator 4: licence scans with a positional rare-token index, in DataFrame functions only.

Each file is cut into words once; of these only licence words (those of the templates) are kept, with their positions.
Counting files per licence word gives each word's inverse document frequency (IDF). The index has two tables, whose size is that of the
templates: the word of highest IDF of each key phrase, with the template; and the postings, word by word, with template and position.

A file looks up its rarest licence words in the first table, which names the templates whose key phrase it may hold (the
phrase's second rarest word must be there too). For these alone its positions meet the postings: a word of the file
less its position in the template is where the template would start, and counting by (file, template, start) intersects
all postings at once. Mandatory is the key phrase: only where all of its words are in place does the label hold, so a phrase that is
there is always found. The score is the best share of a template's words that stand in their places around it.

What a file costs follows from the rare words it holds, not from the number of templates. Starts are rows, so a file
with any number of them is counted over tasks, with partial sums first. The driver gets a count for each licence word.

Defined cases: null text counts as empty and has no words, no places and null positions; repeated rows give repeated
results; ties in IDF go to the first word by name; very long texts are one row of words, and their starts many rows; an empty table gives no
rows; further columns, whatever their names, are passed over.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import document, sent, written

#: Rows (some 100 bytes each) of files with a phrase that are sent to every scan; more are joined.
BROADCAST = 200_000

#: Fixed values of the query: the base phrases, their labels, and the line that each is usually part of.
BASE = {
    "under the mit license": ("mit", "released under the mit license"),
    "apache license version 2": ("apache-2", "licensed under the apache license version 2 0"),
    "cc by nc": ("cc-by-nc", "licensed under cc by nc 4 0"),
}

#: Licence texts, by the words that the scan takes.
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following
conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software
is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose
and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract
tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this
software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential
damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of
or in connection with the use or performance of this software"""
ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the
use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it
freely subject to the following restrictions"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"""
UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""
APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at http www apache org licenses license 2 0"""
BOOST = """boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization
obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"""

#: The method's templates: label, key phrase (mandatory), whole text or line around it.
TEMPLATES = [
    ("mit", "released under the mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", MIT),
    ("apache-2", "licensed under the apache license version 2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license", APACHE),
    ("cc-by-nc", "licensed under cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    ("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("agpl-3", "gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"),
    ("lgpl-3", "gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2", "mozilla public license version 2", "subject to the terms of the mozilla public license version 2 0"),
    ("epl-2", "eclipse public license version 2", "made available under the eclipse public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms", BSD),
    ("isc", "permission to use copy modify and or distribute this software", ISC),
    ("zlib", "to alter it and redistribute it freely", ZLIB),
    ("unlicense", "free and unencumbered software released into the public domain", UNLICENSE),
    ("boost", "boost software license version 1", "distributed under the boost software license version 1 0"),
    ("boost", "software and accompanying documentation covered by this license", BOOST),
]

#: Between words: ASCII that is neither digit nor letter.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    key: tuple[str, ...]
    words: tuple[str, ...]

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)

    @property
    def is_base(self) -> bool:
        return self.name.startswith("b")


ALL = [Template(f"b{k}", label, tuple(p.split()), tuple(line.split())) for k, (p, (label, line)) in enumerate(BASE.items())]
ALL += [Template(f"t{k}", label, tuple(p.split()), tuple(line.split())) for k, (label, p, line) in enumerate(TEMPLATES)]
VOCABULARY = sorted({w for t in ALL for w in t.words})


def hits(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per file: row (a number), n_words, and the licence words with their positions (``found``), and these words once (``own``)."""
    cut = document(df, text, key).select("doc_id", F.filter(F.split("text", BETWEEN, -1), lambda w: w != "").alias("words"))
    known = lambda w: F.lower(w).isin(VOCABULARY) & (F.length(w) == F.octet_length(w))  # noqa: E731  only A-Z is lower-cased
    found = F.filter(F.transform("words", lambda w, i: F.when(known(w), F.struct(i.alias("at"), F.lower(w).alias("word")))), lambda x: x.isNotNull())
    rows = cut.select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "*", F.array_distinct(F.col("found.word")).alias("own"))


def idf(files: DataFrame) -> dict[str, float]:
    """Of each licence word; at most ``len(VOCABULARY)`` rows come to the driver."""
    total = files.count()
    counts = dict(files.select(F.explode("own").alias("word")).groupBy("word").count().collect())
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in VOCABULARY}


def index(spark: SparkSession, rarity: dict[str, float]) -> tuple[list[str], DataFrame, DataFrame]:
    """The words under which templates stand; word, template and the second rarest word; and the postings: template, word, position, is_key, key_at, key_length, length."""
    rare = {t.name: sorted(set(t.key), key=lambda w: (-rarity[w], w)) for t in ALL}
    first = [(r[0], name, r[min(1, len(r) - 1)]) for name, r in rare.items()]
    postings = [(t.name, w, j, int(t.key_at <= j < t.key_at + len(t.key)), t.key_at, len(t.key), len(t.words)) for t in ALL for j, w in enumerate(t.words)]
    looked = spark.createDataFrame(first, "word string, template string, second string")
    return sorted({w for w, *_ in first}), looked, spark.createDataFrame(postings, "template string, word string, j int, is_key int, key_at int, n_key int, n_words int")


def places(files: DataFrame, rarity: dict[str, float]) -> DataFrame:
    """Where key phrases stand: row, template, place (of the phrase's first word), share (of the template's words in their places)."""
    words, first, postings = index(files.sparkSession, rarity)
    rare = files.select("row", "found", "own", F.explode(F.filter("own", lambda w: w.isin(words))).alias("word"))
    asked = rare.join(F.broadcast(first), "word").where(F.expr("array_contains(own, second)")).select("row", "template", F.explode("found").alias("x"))
    met = asked.select("row", "template", "x.at", "x.word").join(F.broadcast(postings), ["template", "word"])
    counted = met.groupBy("row", "template", (F.col("at") - F.col("j")).alias("start"), "key_at", "n_key", "n_words").agg(F.sum("is_key").alias("k"), F.count(F.lit(1)).alias("n"))
    return counted.where("k = n_key").select("row", "template", (F.col("start") + F.col("key_at")).alias("place"), (F.col("n") / F.col("n_words")).alias("share"))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    files = written(hits(df, text, key), "hits")
    found = places(files, idf(files))
    named = F.create_map(*[x for t in ALL for x in (F.lit(t.name), F.lit(t.label))])
    is_base = F.col("template").startswith("b")
    listed = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")  # noqa: E731  of labels, of which there are few
    found = found.withColumn("label", named[F.col("template")])
    told = found.groupBy("row").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("place"))).alias("first_word"),
        F.max(F.when(is_base, F.col("place"))).alias("last_word"),
        listed(F.when(is_base, F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    told = sent(written(told, "told"), BROADCAST)
    return files.select("row", "doc_id", "n_words").join(told, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )


def scan_sql() -> str:
    """The query's result in SQL: words of phrases and lines joined by position."""
    words = [(t.name, j, w, t.key_at <= j < t.key_at + len(t.key)) for t in ALL for j, w in enumerate(t.words)]
    lines = [(t.name, t.label, t.key_at, len(t.key), len(t.words)) for t in ALL]
    rows = lambda x: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in x)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), e AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
w AS (SELECT * FROM (VALUES {rows(words)}) t(tid, j, word, is_key)), t AS (SELECT * FROM (VALUES {rows(lines)}) t(tid, label, key_at, key_len, n_line)),
m AS (SELECT rid, tid, i - j AS start, count(*) FILTER (is_key) AS k, count(*) AS n FROM e JOIN w USING (word) GROUP BY ALL),
v AS (SELECT rid, tid, label, start + key_at AS place, tid LIKE 'b%' AS is_base, CAST(n AS DOUBLE) / n_line AS share FROM m JOIN t USING (tid) WHERE k = key_len),
a AS (
  SELECT rid, count(*) FILTER (is_base) AS n_base, min(place) FILTER (is_base) AS first_word, max(place) FILTER (is_base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM v GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (rid)
"""
