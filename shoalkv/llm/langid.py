"""Operator 10: language identification by rank-order profiles.

The n-grams (one to three characters) of a language's words, each word between
blanks, are counted over all its training texts; the ``SIZE`` most frequent, in order,
are its profile. A text's own most frequent n-grams are compared to each profile
by the out-of-place distance: the sum of the differences in rank, and ``SIZE`` for an
n-gram the profile lacks. The least distance wins.

N-grams are made and counted as vectors, all of a text at once, and summed per Python worker and
language, so training shuffles a few n-gram counts a partition and no text. An n-gram is one integer (three
code points of 21 bits), which also breaks ties in frequency, so results don't
depend on how rows are dealt. A profile has ``SIZE`` entries; profiles are sent to the workers, and
more than ``LANGUAGES`` learned languages raise ``ValueError``.

Defined cases: null text, or text without a letter, is ``und`` with score 0, as is any
text if nothing was learned; ties in distance go to the first language by name; a null
id counts as the empty text in the fold; repeated rows give repeated results; very long texts are counted
in pieces of ``PIECE`` characters, cut at white space; an empty table gives no rows; further columns, whatever their names, are passed over.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import document, fold, slices

SIZE = 400
LANGUAGES = 1000
#: N-grams a worker holds before it sums them.
HELD = 2_000_000
#: Characters of a text that are counted at once, or more if there is no white space among them.
PIECE = 1 << 18

_BETWEEN = re.compile(r"[\W\d_]+")
_SPACE = re.compile(r"\s")


def pieces(text: str) -> Iterator[str]:
    """The text, cut at white space (which no rule of upper and lower case looks beyond)."""
    at = 0
    while len(text) - at > PIECE:
        found = _SPACE.search(text, at + PIECE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def spaced(text: str) -> str:
    """The lower-case runs of letters with one blank before, between and after them; empty if there are none."""
    words = _BETWEEN.sub(" ", text.lower()).strip(" ")
    if not words.isascii() and not words.replace(" ", "").isalpha():  # numerals that are no digits
        words = " ".join(w for w in words.split(" ") if any(map(str.isalpha, w)))
    return f" {words} " if words else ""


def grams_of(spaced_text: str) -> np.ndarray:
    """The n-grams of each word between its blanks, repeats included: up to three code points of 21 bits, the first highest.

    Two words share the blank between them, and no n-gram has it in the middle."""
    c = np.frombuffer(spaced_text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(c):
        return c
    high = c << 42
    two = high[:-1] | (c[1:] << 21)
    three = two[:-1] | c[2:]
    return np.concatenate([high[c != 32], two, three[c[1:-1] != 32]])


def counted(spaced_text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and their counts."""
    return np.unique(grams_of(spaced_text), return_counts=True)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The same for a text of any length."""
    if len(text) <= PIECE:
        return counted(spaced(text))
    total: list[tuple[np.ndarray, np.ndarray]] = []
    for piece in pieces(text):
        total = [_summed([*total, counted(spaced(piece))])]
    return total[0]


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent of ascending n-grams in order: by count, then by n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])
        held.clear()

    for batch in slices(batches, 1 << 20):
        texts: dict[str, list[str]] = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts[lang].append(text)
        for lang, own in texts.items():
            held[lang].append(counts_of(" ".join(own)))
        if sum(len(g) for parts in held.values() for g, _ in parts) > HELD:
            for lang, parts in held.items():
                held[lang] = [_summed(parts)]
            if sum(len(g) for parts in held.values() for g, _ in parts) > HELD // 2:
                yield from out()
    yield from out()


def train(df: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> dict[str, np.ndarray]:
    """The profile of each language that ``df`` names, from all its rows."""
    rows = df.select(df[f"`{lang}`"].cast("string").alias("lang"), df[f"`{text}`"].cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    best = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("all"))
    found = best.select("lang", "all.gram").limit(LANGUAGES + 1).collect()  # size * LANGUAGES numbers at most
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {r.lang: np.array(r.gram, np.int64) for r in found}


class Profiles:
    """All profiles as one table: the n-grams of any of them, ascending, and their ranks by language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = SIZE):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        ranks = self.ranks[np.where(self.grams[at] == own, at, len(self.grams))] if len(self.grams) else self.ranks[np.zeros(len(own), int)]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(own))


def predict(df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", key: str = "doc_id", size: int = SIZE, folds: int = 3, test: int = 1) -> DataFrame:
    """Per row: doc_id, held_out (whether its fold is ``test``), lang_pred, score."""
    shared = df.sparkSession.sparkContext.broadcast(Profiles(profiles, size))
    rows = document(df, text, key)
    rows = rows.select("doc_id", (fold(F.col("doc_id"), folds) == test).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches):
            made = [table.nearest(ranked(*counts_of(x), size)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", folds: int = 3, test: int = 1) -> DataFrame:
    """Learn from the rows whose fold isn't ``test``; predict all rows."""
    held = fold(df[f"`{key}`"].cast("long"), folds) == test
    return predict(df, train(df.where(~held), text, lang), text, key, SIZE, folds, test)


def identify_sql(size: int = SIZE, folds: int = 3, test: int = 1) -> str:
    """The query's result in SQL: n-grams as text, whose order is that of the integers."""
    step = "lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    crc = f"xor(list_reduce(list_prepend(4294967295, own), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {step})), 4294967295)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, lang, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS own FROM documents
), h AS (SELECT rid, doc_id, lang, lower(coalesce(text, '')) AS text, text IS NULL AS no_text, {crc} % {folds} = {test} AS held_out FROM d),
w AS (SELECT rid, ' ' || unnest(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{Nl}}\p{{No}}]+'), lambda x: regexp_matches(x, '\p{{L}}'))) || ' ' AS word FROM h),
v AS (SELECT word, count(*) AS n, rid FROM w GROUP BY rid, word),
g AS (SELECT rid, n, unnest(list_concat(list_transform(range(2, length(word)), lambda i: substr(word, i, 1)), list_transform(range(1, length(word)), lambda i: substr(word, i, 2)), list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3)))) AS gram FROM v),
c AS (SELECT rid, gram, sum(n) AS n FROM g GROUP BY ALL),
r AS (SELECT * FROM (SELECT rid, gram, row_number() OVER (PARTITION BY rid ORDER BY n DESC, gram) - 1 AS rank FROM c) WHERE rank < {size}),
t AS (SELECT lang, gram, sum(n) AS n FROM c JOIN h USING (rid) WHERE NOT held_out AND lang IS NOT NULL AND NOT no_text GROUP BY ALL),
p AS (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS place FROM t) WHERE place < {size}),
k AS (SELECT rid, count(*) AS n FROM r GROUP BY rid),
m AS (SELECT rid, p.lang, sum(abs(place - rank)) AS apart, count(*) AS met FROM r JOIN p USING (gram) GROUP BY ALL),
a AS (SELECT k.rid, l.lang, k.n, coalesce(m.apart, 0) + {size} * (k.n - coalesce(m.met, 0)) AS apart FROM k CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN m ON m.rid = k.rid AND m.lang = l.lang),
b AS (SELECT rid, lang, 1.0::DOUBLE - CAST(apart AS DOUBLE) / CAST({size} * n AS DOUBLE) AS score FROM a QUALIFY row_number() OVER (PARTITION BY rid ORDER BY apart, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(b.score, 0) AS score FROM h LEFT JOIN b USING (rid)
"""
