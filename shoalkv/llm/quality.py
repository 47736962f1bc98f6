"""Operator 5: quality rules by repetition coverage.

Each text is taken whole. Its words get exact ids (a dictionary per text); an
n-gram's rolling hash follows from that of the first n-1 words by one multiply and
add over the vector of ids, so all lengths are had in one sweep in numpy. An n-gram
is duplicated if its hash stands elsewhere in the text; the characters of words
inside any duplicated n-gram, over those of all words, are the text's coverage at
that length. Lines (with a word) that equal an earlier line count in the same way.

Runs of three words are counted exactly (three ids packed into one integer), as
the fixed rules of the query need; other lengths use 64-bit hashes, where a false
match needs a collision within one text.

A map over partitions: no shuffle, and memory is bounded by the slice and the
longest text. Defined cases: null or blank text has no words, all counts 0, and
is rejected; repeated rows give repeated results; an empty table gives no rows;
further columns are passed over by ``measure`` and kept by ``accepted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import document, slices

#: The highest share, in percent, of word characters inside duplicated n-grams,
#: by n, and of duplicated lines and their characters, as published with the Gopher rules.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 30
LINE_CHARS_LIMIT = 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SYMBOLS = re.compile(rb"[#*$%&|<>]")


def _again(keys: np.ndarray) -> np.ndarray:
    """Where a key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return np.zeros(len(keys), bool)
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the n-grams that start where ``starts`` says."""
    edge = np.zeros(words + 1, np.int32)
    edge[: len(starts)] += starts
    edge[n : n + len(starts)] -= starts
    return np.cumsum(edge[:words]) > 0


def code_points(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.decode("utf-8", "replace"))


def profile(text: bytes, limits: dict[int, int] = NGRAM_LIMITS) -> tuple[int, int, int, int, int, int, dict[int, int], int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with words,
    characters inside duplicated n-grams by length, characters of words in duplicated lines."""
    words = text.split()
    n = len(words)
    n_symbols = len(SYMBOLS.findall(text))
    if not n:
        return 0, 0, n_symbols, 0, 0, 0, dict.fromkeys(limits, 0), 0
    ids_of: dict[bytes, int] = {}
    ids = np.fromiter((ids_of.setdefault(w, len(ids_of)) for w in words), np.int64, n)
    lengths = np.fromiter(map(code_points, ids_of), np.int64, len(ids_of))[ids]
    word_chars = int(lengths.sum())

    seen: set[bytes] = set()
    n_lines = n_dup = dup_chars = 0
    for line in text.split(b"\n"):
        if inner := line.split():
            n_lines += 1
            if line in seen:
                n_dup += 1
                dup_chars += sum(map(code_points, inner))
            else:
                seen.add(line)

    n_repeat = 0
    if n >= 3:
        if len(ids_of) < 1 << 21:
            three = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:
            _, two = np.unique(ids[:-1] * len(ids_of) + ids[1:], return_inverse=True)
            three = two[:-1] * len(ids_of) + ids[2:]
        n_repeat = int(_covered(_again(three), 3, n).sum())

    inside = dict.fromkeys(limits, 0)
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    spread ^= spread >> np.uint64(32)
    rolled, length = spread.copy(), 1
    for k in sorted(limits):
        if k > n or not n_repeat and k >= 3:
            break  # an n-gram of three or more words that stands twice repeats its first three words
        while length < k:
            rolled = rolled[:-1] * BASE + spread[length:]
            length += 1
        if not (twice := _again(rolled)).any():
            break  # nor can a longer one stand twice
        inside[k] = int(lengths[_covered(twice, k, n)].sum())
    return n, word_chars, n_symbols, n_dup, n_repeat, n_lines, inside, dup_chars


def verdict(text: bytes, limits: dict[int, int] = NGRAM_LIMITS) -> tuple:
    n, chars, symbols, dup_lines, repeat, lines, inside, dup_chars = profile(text, limits)
    base_failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    reasons = [f"{k}-grams" for k in sorted(limits) if 100 * inside[k] > limits[k] * chars]
    reasons += ["lines"] * (100 * dup_lines > LINE_LIMIT * lines) + ["line characters"] * (100 * dup_chars > LINE_CHARS_LIMIT * chars)
    worst = max([inside[k] for k in limits], default=0)
    return n, chars, symbols, dup_lines, repeat, base_failed, not base_failed and not reasons, worst, dup_chars, ",".join(reasons)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_ngram_chars long, dup_line_chars long, reasons string"
_TYPES = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]


def _measured(columns: list[tuple], batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    made = [pa.array(c, t) for c, t in zip(zip(*columns, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)


def measure(df: DataFrame, text: str = "text", key: str = "doc_id", limits: dict[int, int] | None = None) -> DataFrame:
    """One row per row of ``df``: the counts, the base verdict, the whole verdict and its reasons."""
    limits = dict(limits or NGRAM_LIMITS)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = document(df, text, key)
    rows = rows.select("doc_id", rows.text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _measured([verdict(x, limits) for x in batch.column(1).to_pylist()], batch, names)

    return rows.mapInArrow(run, COLUMNS)


def accepted(df: DataFrame, text: str = "text", limits: dict[int, int] | None = None) -> DataFrame:
    """The rows of ``df``, with all their columns, that pass every rule."""
    limits = dict(limits or NGRAM_LIMITS)
    at = [f.name for f in df.schema.fields].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([verdict(("" if x is None else str(x)).encode(), limits)[6] for x in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def measure_sql(limits: dict[int, int] = NGRAM_LIMITS) -> str:
    """The query's result in SQL, over n-grams as text."""
    space = r"[\x20\x09-\x0D]"
    most = max(limits)
    leads = ", ".join(f"lead(w, {j}) OVER o AS w{j}" for j in range(1, most))
    gram = lambda k: " || ' ' || ".join(["w", *(f"w{j}" for j in range(1, k))])
    sizes = sorted({3, *limits})
    keys = ", ".join(f"{gram(k)} AS g{k}" for k in sizes)
    flags = ", ".join(f"CASE WHEN g{k} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{k}) > 1 THEN i END AS f{k}" for k in sizes)
    covers = ", ".join(f"coalesce(max(f{k}) OVER o >= i - {k - 1}, false) AS c{k}" for k in sizes)
    sums = ", ".join(f"coalesce(sum(length(w)) FILTER (c{k}), 0) AS s{k}" for k in sorted(limits))
    over = [f"CASE WHEN 100 * s{k} > {limits[k]} * word_chars THEN '{k}-grams' END" for k in sorted(limits)]
    over += [f"CASE WHEN 100 * n_dup_lines > {LINE_LIMIT} * n_lines THEN 'lines' END", f"CASE WHEN 100 * dup_line_chars > {LINE_CHARS_LIMIT} * word_chars THEN 'line characters' END"]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT rid, regexp_extract_all(t, '[^{space[1:]}+') AS ws FROM d)),
l AS (SELECT *, {leads} FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, w, {keys} FROM l), f AS (SELECT rid, i, w, {flags} FROM g),
c AS (SELECT rid, w, {covers} FROM f WINDOW o AS (PARTITION BY rid ORDER BY i)),
a AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {sums} FROM c GROUP BY rid),
n AS (SELECT rid, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM d)),
x AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS again FROM n WHERE regexp_matches(line, '[^{space[1:]}')),
y AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '{space}+', '', 'g'))) FILTER (again), 0) AS dup_line_chars FROM x GROUP BY rid),
z AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(s{k}, 0) AS s{k}" for k in sorted(limits))}
  FROM d LEFT JOIN a USING (rid) LEFT JOIN y USING (rid)
), r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, array_to_string(list_filter([{", ".join(over)}], lambda x: x IS NOT NULL), ',') AS reasons FROM z)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND reasons = '' AS kept,
       CAST(greatest({", ".join(f"s{k}" for k in sorted(limits))}) AS BIGINT) AS dup_ngram_chars, CAST(dup_line_chars AS BIGINT) AS dup_line_chars, reasons FROM r
"""
