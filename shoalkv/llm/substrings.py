"""Operator 6: substring dedup by relative Lempel-Ziv parsing.

Every document is parsed greedily into factors (first word, words, source document, place in it) against all documents
with smaller ids, and literals between them. Reference blocks are cut where the content says so: of each window of 50 words the k-gram with
the least hash is its anchor, and consecutive windows with one anchor make up a block (50 to 50 + SPAN - 1 words). The index has each
distinct block once, with the first document that holds it and its place there. Equal text is cut alike wherever it stands, so an equality
join of a document's blocks with the index gives its inner matches, block by block.

At the two boundaries of a match the text diverges within a block: such a block shares its anchor with another that differs, and only
there the windows themselves are looked up, one by one, which extends the match to its last word. Blocks and windows that continue each
other in one source are chained into runs, the longest matches with that source. The parse goes from left to right: of the runs that reach over a
place it takes the one that ends last as the next factor. Runs of 50 words or more (there are no shorter ones) are the duplicate
spans, and the words in factors are exactly the words in spans.

Only the first document of each distinct block enters the check at the boundaries (for all
others the block as a whole has matched), so thousands of copies cost what one does, and no
pairs of documents are formed. Blocks and windows are compared by 128 bits, of which either half comes from a
word hash of its own. Aggregations combine before the shuffle; the joins are inner or left equality joins that AQE can split. Texts
stay in their scans as long as what is to be sent to them has at most ``SENT`` entries, and are joined beyond that.

Defined cases: null text has no words; a row with a null id is kept whole and is no reference;
rows with one id don't remove each other's words (a source is named by its id, so of texts that share one the factor may stand in any);
repeated rows give repeated results; very long texts are cut in pieces of ``PIECE`` words, whose edges count as boundaries; an
empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document, filtered_joins, slices, written

WINDOW = 50
GRAM = 16
#: Windows one anchor can serve.
SPAN = WINDOW - GRAM + 1

#: Words of a text that are hashed at once.
PIECE = 1 << 19
#: Entries (eight bytes each, and as many rows) that are sent to every scan of the texts.
SENT = 1_000_000

#: Odd: they have inverses modulo 2**64.
_POWERS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_INVERSES = tuple(pow(p, -1, 1 << 64) for p in _POWERS)
_PLACE = 24
_CHUNK = 1 << 22
MEMO = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two hashes a word."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)


class Hashed:
    """Word hashes of a run of words, with the hashes of any of its stretches."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.n = n
        self._sums, self._back = [], []
        for which, (p, q) in enumerate(zip(_POWERS, _INVERSES, strict=True)):
            up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
            up[1:] = np.cumprod(np.full(n, p, np.uint64))
            down[1:] = np.cumprod(np.full(n, q, np.uint64))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(x[:, which] * up[:-1], out=sums[1:])
            self._sums.append(sums)
            self._back.append(down)

    def of(self, starts: np.ndarray, length, which: int) -> np.ndarray:
        h = (self._sums[which][starts + length] - self._sums[which][starts]) * self._back[which][starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (n - size)], v[n - size :]) if n > size else v


def blocks(hashed: Hashed, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, two block hashes, first window and windows of each block; ``valid``: window starts within one document."""
    found = [_blocks(hashed, valid, at) for at in range(0, len(valid), _CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64))


def _blocks(hashed: Hashed, valid: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
    own = valid[at : at + _CHUNK]
    grams = hashed.of(np.arange(at, at + len(own) + SPAN - 1), GRAM, 0)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << _PLACE) - 1)
    least = _sliding_min((grams & ~low) | place, SPAN)
    starts = np.flatnonzero(own)
    anchor = (least[starts] & low).astype(np.int64)
    if not len(starts):
        return grams[:0], grams[:0], grams[:0], starts, starts
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    count = np.diff(np.append(new, len(starts)))
    first = starts[new] + at
    return grams[anchor[new]], hashed.of(first, count + WINDOW - 1, 0), hashed.of(first, count + WINDOW - 1, 1), first, count


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Row, place of the first word, and words, of some pieces at a time: texts, or parts of long ones that overlap by a window less a word."""
    some, size = [], 0
    for row, text in enumerate(texts):
        words = text.split()
        for s in range(0, max(1, len(words) - WINDOW + 1), PIECE):
            part = words[s : s + PIECE + WINDOW - 1] if len(words) > PIECE else words
            some.append((row, s, part))
            size += len(part)
            if size >= PIECE:
                yield some
                some, size = [], 0
    if some:
        yield some


def _joined(pieces: list[tuple[int, int, list[bytes]]], memo: _Hashes) -> tuple[Hashed, np.ndarray, np.ndarray]:
    """All words of the pieces as one run, its offsets by piece, and which windows lie within one piece."""
    sizes = np.fromiter((len(w) for _, _, w in pieces), np.int64, len(pieces))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    x = np.concatenate([memo.of(w) for _, _, w in pieces])
    valid = np.zeros(max(0, len(x) - WINDOW + 1), bool)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if e - s >= WINDOW:
            valid[s : e - WINDOW + 1] = True
    return Hashed(x), offsets, valid


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Hashes()
    for batch in slices(batches):
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
        stamps = batch.column(1).to_numpy()
        for pieces in _pieces(texts):
            hashed, offsets, valid = _joined(pieces, memo)
            anchor, b1, b2, first, count = blocks(hashed, valid)
            piece = np.searchsorted(offsets, first, side="right") - 1
            row, base = (np.array([p[i] for p in pieces], np.int64)[piece] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [_signed(ids[row]), _signed(stamps[row]), _signed(anchor), _signed(b1), _signed(b2), pa.array((first - offsets[piece] + base).astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["doc_id", "stamp", "anchor", "b1", "b2", "first", "count"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the blocks that a row names."""
    memo = _Hashes()
    for batch in slices(batches, 1 << 20):
        ids, stamps, texts, open_ = (batch.column(i) for i in range(4))
        ids, stamps, own = ids.to_numpy(zero_copy_only=False), stamps.to_numpy(), [np.array(x, np.int64) for x in open_.to_pylist()]
        for pieces in _pieces(texts.to_pylist()):
            hashed, offsets, _ = _joined(pieces, memo)
            for (row, base, words), offset in zip(pieces, offsets.tolist(), strict=False):
                first, count = own[row] >> 8, own[row] & 255
                starts = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                starts = starts[(starts >= base) & (starts < base + min(PIECE, len(words) - WINDOW + 1))]
                at = starts - base + offset
                for s in range(0, len(at), 1 << 17):
                    e, n = slice(s, s + (1 << 17)), len(at[s : s + (1 << 17)])
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.full(n, ids[row])), _signed(np.full(n, stamps[row])), pa.array(starts[e].astype(np.int32)), _signed(hashed.of(at[e], WINDOW, 0)), _signed(hashed.of(at[e], WINDOW, 1))],
                        names=["doc_id", "stamp", "first", "w1", "w2"],
                    )


def parse(units: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``units``: (first window, windows, source, place in it) of matches. The factors (first word, words, source, place), from left to right."""
    runs: dict[tuple[int, int], list[list[int]]] = {}  # by source and shift, [first word, end]
    for first, count, source, at in sorted(units):
        own, end = runs.setdefault((source, at - first), []), first + count + WINDOW - 1
        if own and first <= own[-1][1] - WINDOW + 1:  # the next window, or one met before
            own[-1][1] = max(own[-1][1], end)
        else:
            own.append([first, end])
    ordered = sorted((first, -end, source, shift) for (source, shift), own in runs.items() for first, end in own)
    out, place, k, open_ = [], 0, 0, []  # open_: runs that have begun, by where they end
    while k < len(ordered) or open_:
        if not open_:
            place = max(place, ordered[k][0])
        while k < len(ordered) and ordered[k][0] <= place:
            heappush(open_, (ordered[k][1], ordered[k][2], ordered[k][3]))
            k += 1
        if not open_:
            continue
        back, source, shift = open_[0]
        if -back <= place:  # all that have begun have ended
            open_.clear()
            continue
        out.append((place, -back - place, source, place + shift))
        place = -back
    return out


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of two columns of lists of (first, count, owner, at): row, first, count, owner and at, with what continues in one source joined."""
    found = []
    for lists in (batch.column(2), batch.column(3)):
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        found.append([np.repeat(np.arange(batch.num_rows), sizes), *(pc.struct_field(lists.flatten(), [i]).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))])
    row, first, count, owner, at = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((first, at - first, owner, row))
    row, first, count, owner, at = (x[by] for x in (row, first, count, owner, at))
    if not len(row):
        return row, first, count, owner, at
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | ((at - first)[1:] != (at - first)[:-1]) | (first[1:] > (first + count)[:-1])])
    begin = np.flatnonzero(new)
    end = np.maximum.reduceat(first + count, begin)
    return row[begin], first[begin], end - first[begin], owner[begin], at[begin]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("at", pa.int32())]))
    for batch in slices(batches):
        row, *runs = _runs(batch)
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        units = list(zip(*(x.tolist() for x in runs), strict=True))
        made = [[dict(zip(("first", "words", "source", "at"), f, strict=True)) for f in parse(units[s:e])] for s, e in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, kind)], names=["doc_id", "stamp", "factors"])


def _stamped(df: DataFrame, text: str, key: str) -> DataFrame:
    rows = document(df, text, key)
    return rows.select("doc_id", F.xxhash64("text").alias("stamp"), rows.text.cast("binary").alias("text"))


def _sent(table: DataFrame, entries: str) -> DataFrame:
    """A written table, marked to be sent to the scans of the texts if it is small."""
    rows, all_ = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(entries)), F.lit(0))).first()
    return F.broadcast(table) if rows + all_ <= SENT else table


def factors(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document that has any: doc_id, stamp (a hash of its text) and ``factors``: array of (first, words, source, at), in order; what lies between is literal."""
    docs = _stamped(df, text, key).where("doc_id is not null")
    ranges = written(docs.mapInArrow(_cut, "doc_id long, stamp long, anchor long, b1 long, b2 long, first int, count int"), "ranges")
    index = ranges.groupBy("anchor", "b1", "b2").agg(F.min("doc_id").alias("owner"), F.min_by("first", "doc_id").alias("at"), F.max("doc_id").alias("last"))
    forked = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", F.lit(True).alias("forked"))
    useful = index.join(forked, "anchor", "left").where("last > owner or forked").select("anchor", "b1", "b2", "owner", "at", F.coalesce("forked", F.lit(False)).alias("forked"))
    matched = ranges.join(useful, ["anchor", "b1", "b2"]).select("doc_id", "stamp", "first", "count", "owner", "at", (F.col("doc_id") > F.col("owner")).alias("whole"), "forked").where("whole or forked")
    listed = matched.groupBy("doc_id", "stamp").agg(
        F.collect_list(F.when(F.col("whole"), F.struct("first", "count", "owner", "at"))).alias("whole"),
        F.collect_list(F.when(~F.col("whole"), F.shiftleft(F.col("first").cast("long"), 8) + F.col("count"))).alias("open"),
    )
    listed = written(listed, "listed")
    with filtered_joins(df.sparkSession):
        texts = docs.join(_sent(listed.where(F.size("open") > 0).select("doc_id", "stamp", "open"), "open"), ["doc_id", "stamp"]).select("doc_id", "stamp", "text", "open")
        windows = written(texts.mapInArrow(_windows, "doc_id long, stamp long, first int, w1 long, w2 long"), "windows")
    shared = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.min_by("first", "doc_id").alias("at"), F.max("doc_id").alias("last")).where("last > owner").select("w1", "w2", "owner", "at")
    ends = windows.join(shared, ["w1", "w2"]).where("doc_id > owner").groupBy("doc_id", "stamp").agg(F.collect_list(F.struct("first", F.lit(1).alias("count"), "owner", "at")).alias("ends"))
    units = listed.join(ends, ["doc_id", "stamp"], "left").where(F.col("ends").isNotNull() | (F.size("whole") > 0)).select("doc_id", "stamp", "whole", "ends")
    return units.mapInArrow(_parsed, "doc_id long, stamp long, factors array<struct<first:int,words:int,source:long,at:int>>")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        n_words, n_removed, kept = [], [], []
        for data, own in zip(texts, found, strict=True):
            words = data.split()
            n_words.append(len(words))
            if own:
                left, place = [], 0
                for f in own:  # in order, and apart
                    left += words[place : f >> 32]
                    place = (f >> 32) + (f & 0xFFFFFFFF)
                words = left + words[place:]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def removed(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, ``kept`` (binary: the words that stay, joined by one space)."""
    packed = F.transform("factors", lambda f: F.shiftleft(f["first"].cast("long"), 32) + f["words"])
    gone = _sent(written(factors(df, text, key).select("doc_id", "stamp", packed.alias("gone")), "factors"), "gone")
    rows = _stamped(df, text, key).join(gone, ["doc_id", "stamp"], "left").select("doc_id", "text", "gone")
    return rows.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept binary")


def digest(kept: bytes) -> str:
    return sha256(kept).hexdigest()


#: The query's result in SQL: every window's words compared as text.
REMOVED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT rid, doc_id, len(ws) AS n, ws, unnest(range(1, len(ws) + 1)) AS i FROM d
), g AS (
  SELECT rid, doc_id, i, ws[i] AS w, CASE WHEN i + 49 <= n THEN array_to_string(ws[i:i + 49], ' ') END AS win FROM p
), o AS (
  SELECT win, min(doc_id) AS owner FROM g WHERE win IS NOT NULL GROUP BY win
), f AS (
  SELECT g.rid, g.i, g.w, max(CASE WHEN g.doc_id > o.owner THEN g.i END) OVER (PARTITION BY g.rid ORDER BY g.i) AS last
  FROM g LEFT JOIN o ON g.win = o.win
), k AS (
  SELECT rid, count(*) FILTER (last IS NOT NULL AND last >= i - 49) AS n_removed,
         coalesce(string_agg(w, ' ' ORDER BY i) FILTER (last IS NULL OR last < i - 49), '') AS kept
  FROM f GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
