"""Operator 3: language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of all training
texts (a text: its lower-cased words joined by one space, and a line feed as its end). A byte
is coded in the longest context there is: with escape estimate C a context of n occurrences
and t successors gives a successor (count) / (n + t) and the escape t / (n + t); after an
escape the next shorter context leaves out the symbols of the longer one (symbol exclusion);
below the empty context the bytes not yet seen share evenly. The score is the sum of log10 of these probabilities
over the bytes and the end: the code length of the text under the pretrained model.

All counts come from all training texts: workers count (ORDER + 1)-grams, Spark sums them, and shorter
contexts follow from the sums. The model is all of them: no successor is left out, however rare. What is sent to the
workers has a bound that doesn't depend on the corpus: the costs of the most frequent n-grams, 1 / SHARE at most. All
others that a text has are looked up by a join: the sums are dealt by the two bytes before the coded one, so that a worker
has every context of two bytes and more whole, builds the trie of some such contexts at a time (the shorter ones,
65,792 successors at most, are sent), and costs the n-grams asked for. A context with more than ``SPLIT`` n-grams is dealt by
three bytes, and its own successors, 256 at most, are sent too; so no worker needs more than what follows three bytes at once. Successors of a longer context
are successors of every shorter one, so exclusion needs no search: a node knows its suffix and
what its own successors take away there.

The base score needs exact counts of words, whose number has no bound. Words of at least ``WORD_SHARE`` of all
tokens (at most 1 / WORD_SHARE of them) are sent to the workers; all others are joined with the table of counts.

Defined cases: null text counts as empty, and is one token (the end); a null id counts as the empty text
in the fold; an empty training set leaves every byte at 1/256 and every count at 0; repeated rows give
repeated results; n-grams of very long texts are made ``PART`` bytes at a time; an empty table gives no rows; further columns, whatever their names, are passed over.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document, fold, slices, written

ORDER = 5
SHARE = 1e-6
WORD_SHARE = 1e-6
#: Distinct n-grams or words a worker holds before it passes its sums on.
HELD = 3_000_000
HELD_WORDS = 400_000
#: Bytes of context by which the sums are dealt to workers, and the n-grams of whole such contexts that one trie holds.
DEALT = 2
PIECE = 500_000
#: N-grams of one dealt context, beyond which it is dealt by a byte more.
SPLIT = 1_000_000
#: Slots of a worker's table of n-grams it has scored already; their number changes no result.
SLOTS = 20

#: Bytes of text whose n-grams are made at once.
PART = 1 << 21

_SLICE = 1 << 21
APART = np.uint64((1 << 64) - 1)


def rendered(text: bytes) -> tuple[list[bytes], bytes]:
    """The words, and the bytes that the model codes."""
    words = text.lower().split()
    return words, b" ".join(words) + b"\n"


def parts(texts: list[bytes], order: int) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Text's number, the ``order`` bytes before, and the bytes, of some parts of texts at a time; a text begins after line feeds."""
    some, size = [], 0
    for row, text in enumerate(texts):
        for s in range(0, len(text), PART):
            some.append((row, text[s - order : s] if s else b"\n" * order, text[s : s + PART]))
            size += len(some[-1][2])
            if size >= PART:
                yield some
                some, size = [], 0
    if some:
        yield some


def grams(some: list[tuple[int, bytes, bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram that ends at each byte of the parts, and where each part begins, with the bytes before it.

    The bytes before a part have the gram ``APART``, which no byte of a text has."""
    data = np.frombuffer(b"".join(x for _, before, part in some for x in (before, part)), np.uint8)
    sizes = np.fromiter((len(part) for _, _, part in some), np.int64, len(some)) + order
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = np.zeros(len(data), np.uint64)
    wide = data.astype(np.uint64)
    for j in range(order + 1):
        out[j:] |= wide[: len(wide) - j] << np.uint64(8 * j)
    out[(begins[:, None] + np.arange(order)).ravel()] = APART
    return out, begins


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([p[1] for p in parts])[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = _summed(held)
            for s in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + (1 << 18)].view(np.int64)), pa.array(counts[s : s + (1 << 18)])], names=["gram", "n"])

        for batch in slices(batches, _SLICE):
            for some in parts([rendered(x)[1] for x in batch.column(0).to_pylist()], order):
                found, counts = np.unique(grams(some, order)[0], return_counts=True)
                keep = found != APART
                held.append((found[keep], counts[keep].astype(np.int64)))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_summed(held)]
                    if (size := len(held[0][0])) > HELD // 2:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    ends = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*held, None], pa.binary()), pa.array([*held.values(), ends], pa.int64())], names=["word", "n"])

    for batch in slices(batches, _SLICE):
        for x in batch.column(0).to_pylist():
            held.update(x.lower().split())
            ends += 1
        if len(held) > HELD_WORDS:
            yield out()
            held.clear()
            ends = 0
    yield out()


class Trie:
    """Nodes and successors by order, as sorted arrays, with all logarithms that scoring needs."""

    def __init__(self, order: int, kept: dict[int, tuple[np.ndarray, np.ndarray]], totals: dict[int, tuple[np.ndarray, np.ndarray]]):
        """``kept``: by order j the (j+1)-byte strings that stay and their counts; ``totals``: the j-byte contexts' counts."""
        self.order = order
        self.keys, self.log_count, self.context, self.levels = [], [], [], []
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        before = None
        for j in range(order + 1):
            keys, counts = kept[j]
            by = np.argsort(keys)
            keys, counts = keys[by], counts[by].astype(np.float64)
            nodes, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            t = np.bincount(at, minlength=len(nodes)).astype(np.float64)
            seen = np.bincount(at, weights=counts, minlength=len(nodes))
            known, sums = totals[j]
            by = np.argsort(known)
            known, sums = known[by], sums[by].astype(np.float64)
            n = sums[np.searchsorted(known, nodes)] if len(nodes) else seen
            rest = n - seen
            level = {"escape": log(t + rest) - log(n + t), "all": log(n + t), "t": t, "n": n, "rest": rest, "keys": keys, "counts": counts}
            if j and len(nodes):
                low = np.uint64((1 << 8 * j) - 1)
                taken = before["counts"][np.searchsorted(before["keys"], keys & low)]
                taken = np.bincount(at, weights=taken, minlength=len(nodes))
                up = np.searchsorted(self.context[j - 1], nodes & np.uint64((1 << 8 * (j - 1)) - 1))
                left, open_t = before["n"][up] - taken, before["t"][up] - t
                level |= {"up": up, "up_all": np.where(left + open_t > 0, log(left + open_t), 0), "up_escape": np.where(left + open_t > 0, log(open_t + before["rest"][up]) - log(left + open_t), 0)}
            self.keys.append(keys)
            self.log_count.append(log(counts))
            self.context.append(nodes)
            self.levels.append(level)
            before = level
        for level in self.levels:
            for name in ("t", "n", "rest", "keys", "counts"):
                if name != "t" or level is not self.levels[0]:
                    level.pop(name)
        t = self.levels[0].pop("t")
        unseen = 256 - (int(t[0]) if len(t) else 0)
        self.floor = -math.log10(unseen) if unseen else 0.0

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        total = np.zeros(len(grams))
        open_ = np.arange(len(grams))  # not yet coded
        node = np.full(len(grams), -1)  # the node of the order above, or -1
        for j in range(self.order, -1, -1):
            if not len(open_) or not len(self.context[j]):
                continue
            g, came = grams[open_], node[open_]
            level, above = self.levels[j], self.levels[j + 1] if j < self.order else None
            context = (g >> np.uint64(8)) & np.uint64((1 << 8 * j) - 1)
            here = np.searchsorted(self.context[j], context)
            here[here == len(self.context[j])] = 0
            here = np.where(self.context[j][here] == context, here, -1)
            string = g & np.uint64((1 << 8 * (j + 1)) - 1)
            at = np.searchsorted(self.keys[j], string)
            at[at == len(self.keys[j])] = 0
            found = (self.keys[j][at] == string) & (here >= 0)
            both = level["all"][here], level["escape"][here]
            if above is not None and "up_all" in above and (came >= 0).any():
                both = tuple(np.where(came >= 0, above[name][came], x) for name, x in zip(("up_all", "up_escape"), both, strict=True))
            total[open_] += np.where(here < 0, 0.0, np.where(found, self.log_count[j][at] - both[0], both[1]))
            node[open_] = here
            open_ = open_[~found]
        total[open_] += self.floor
        return total


class Sent:
    """The costs of the most frequent n-grams; those of others are NaN."""

    def __init__(self, order: int, keys: np.ndarray, costs: np.ndarray):
        by = np.argsort(keys)
        self.order, self.keys, self.costs = order, keys[by], costs[by]

    def cost(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(grams), np.nan)
        at = np.searchsorted(self.keys, grams)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == grams, self.costs[at], np.nan)


class Scorer:
    """Scores texts; keeps the cost of n-grams it has met in a direct-mapped table."""

    def __init__(self, trie: Trie | Sent):
        self.trie = trie
        self.seen = np.full(1 << SLOTS, APART)
        self.value = np.zeros(1 << SLOTS)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, pa.ListArray]:
        """Each text's sum over the n-grams of known cost, and the others with their numbers."""
        total, rows, lost, times = np.zeros(len(texts)), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for some in parts(texts, self.trie.order):
            keys, begins = grams(some, self.trie.order)
            own = np.array([r for r, _, _ in some], np.int64)
            slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
            cost = self.value[slot]
            miss = np.flatnonzero(self.seen[slot] != keys)
            if len(miss):
                new, at = np.unique(keys[miss], return_inverse=True)
                cost[miss] = self.trie.cost(new)[at]
                self.seen[slot[miss]] = keys[miss]
                self.value[slot[miss]] = cost[miss]
            cost[keys == APART] = 0
            gone = np.flatnonzero(np.isnan(cost))
            cost[gone] = 0
            np.add.at(total, own, np.add.reduceat(cost, begins))
            for x, y in zip((rows, lost, times), _distinct(own[np.searchsorted(begins, gone, "right") - 1], keys[gone], np.ones(len(gone), np.int64)), strict=True):
                x.append(y)
        row, gram, n = _distinct(np.concatenate(rows), np.concatenate(lost), np.concatenate(times))  # a text's parts may share some
        open_ = pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int32))], names=["gram", "times"])
        return total, pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)), open_)


def _distinct(row: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and their sums."""
    by = np.lexsort((gram, row))
    row, gram, n = row[by], gram[by], n[by]
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[at], gram[at], np.add.reduceat(n, at) if len(at) else n


def _by_order(table: pa.Table, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    j, gram, n = (table.column(name).to_numpy() for name in ("j", "gram", "n"))
    return {k: (gram[j == k].astype(np.uint64), n[j == k].astype(np.int64)) for k in range(order + 1)}


def _contexts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of strings and their counts."""
    return _summed([(keys >> np.uint64(8), counts)])


def _costs(order: int, low: dict[int, tuple[np.ndarray, np.ndarray]], split: tuple[np.ndarray, np.ndarray]):
    """Over rows (context, gram, n) sorted by context, n 0 for an n-gram asked for: the costs of those. ``low``: the strings below the
    dealt contexts; ``split``: those of contexts that are dealt in parts, and so not whole here."""

    def costed(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        asked, kept = gram[n == 0], dict(low)
        if not len(asked):
            return
        keys, counts = gram[n > 0], n[n > 0]
        for j in range(order, len(low) - 1, -1):
            kept[j] = keys, counts = _summed([(keys & np.uint64((1 << 8 * (j + 1)) - 1), counts)])
        mine = np.isin(split[0] >> np.uint64(8), np.unique((gram >> np.uint64(8)) & np.uint64((1 << 8 * DEALT) - 1)))
        if mine.any():
            strings, sums = split[0][mine], split[1][mine]
            keys, counts = kept[DEALT]
            whole = ~np.isin(keys >> np.uint64(8), strings >> np.uint64(8))
            kept[DEALT] = np.concatenate([keys[whole], strings]), np.concatenate([counts[whole], sums])
        trie = Trie(order, kept, {j: _contexts(*k) for j, k in kept.items()})
        for s in range(0, len(asked), 1 << 18):
            part = asked[s : s + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(trie.cost(part))], names=["gram", "cost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy() for i in range(3)]))
            size += batch.num_rows
            if size > PIECE and held[-1].shape[1] and held[-1][0, -1] != held[0][0, 0]:
                rows = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(rows[0], rows[0, -1]))
                yield from costed(rows[1, :whole].astype(np.uint64), rows[2, :whole])
                held = [rows[:, whole:]]
                size = len(held[0][0])
        if size:
            rows = np.concatenate(held, axis=1)
            yield from costed(rows[1].astype(np.uint64), rows[2])

    return run


def _split(dealt: DataFrame, order: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """``dealt`` (context, gram, n), with crowded contexts dealt by a byte more; second: the strings of these contexts and their counts."""
    if order <= DEALT:
        return dealt, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    wide = 1 << 8 * (DEALT + 1)
    crowded = dealt.groupBy("context").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > SPLIT)
    crowded = written(crowded.select(F.col("context").alias("crowded")), "crowded")  # 65,536 rows at most
    marked = dealt.join(F.broadcast(crowded), F.col("context") == F.col("crowded"), "left")
    strings = marked.where("crowded is not null and n > 0").groupBy(F.col("gram").bitwiseAND(F.lit(wide - 1)).alias("string")).agg(F.sum("n").alias("n")).toArrow()
    longer = F.shiftright("gram", 8).bitwiseAND(F.lit(wide - 1)) + F.lit(wide)  # beyond the numbers of contexts that aren't split
    parts_ = marked.select(F.when(F.col("crowded").isNull(), F.col("context")).otherwise(longer).alias("context"), "gram", "n")
    return parts_, (strings.column("string").to_numpy().astype(np.uint64), strings.column("n").to_numpy().astype(np.int64))


def _counted(df: DataFrame, text: str, order: int) -> DataFrame:
    rows = df.select(F.coalesce(df[f"`{text}`"].cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_count_grams(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _sent(counted: DataFrame, order: int) -> Sent:
    """The costs of as many of the most frequent n-grams as 1 / SHARE has room for: all in their longest context."""
    size = F.floor(F.log2("n") * 8)
    room, least = 1 / SHARE, None
    for r in sorted(counted.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("kinds")).collect(), key=lambda r: -r["size"]):  # at most 8 * 63 rows
        if (room := room - r.kinds) < 0:
            break
        least = r["size"]
    if least is None:
        return Sent(order, np.zeros(0, np.uint64), np.zeros(0))
    context = F.shiftright("gram", 8).alias("context")
    sums = counted.groupBy(context).agg((F.sum("n") + F.count(F.lit(1))).alias("all"))
    kept = counted.where(size >= least).select("gram", "n", context).join(sums, "context").select("gram", "n", "all").toArrow()
    gram, n, whole = (kept.column(name).to_numpy() for name in ("gram", "n", "all"))
    return Sent(order, gram.astype(np.uint64), np.log10(n) - np.log10(whole))


def _low(counted: DataFrame, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The strings of the orders below the dealt contexts, and their counts."""
    level = [F.struct(F.lit(j).alias("j"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("gram")) for j in range(min(order, DEALT))]
    if not level:
        return {}
    return _by_order(counted.select(F.explode(F.array(*level)).alias("k"), "n").groupBy("k.j", "k.gram").agg(F.sum("n").alias("n")).toArrow(), len(level) - 1)


def train(df: DataFrame, text: str = "text", order: int = ORDER, share: float = SHARE) -> Trie:
    """One trie of all rows of ``df``, less the successors below ``share`` of all bytes, which count as escapes. ``score`` needs none: it leaves nothing out."""
    counted = _counted(df, text, order)
    total, level = F.sum("n"), [F.struct(F.lit(j).alias("j"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("gram")) for j in range(order + 1)]
    counted = written(counted, "grams")
    counts = written(counted.select(F.explode(F.array(*level)).alias("k"), "n").groupBy("k.j", "k.gram").agg(F.sum("n").alias("n")), "orders")
    bytes_ = counted.agg(F.coalesce(total, F.lit(0))).first()[0]
    least = max(1, math.ceil(bytes_ * share))
    stay = F.lit(least)
    kept = counts.where((F.col("n") >= stay) | (F.col("j") == 0)).toArrow()  # at most (order + 1) / share rows
    sums = counts.groupBy("j", F.shiftright("gram", 8).alias("gram")).agg(F.sum("n").alias("n")).where((F.col("n") >= stay) | (F.col("j") == 0)).toArrow()
    return Trie(order, _by_order(kept, order), _by_order(sums, order))


def score(df: DataFrame, training: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 7, test: int = 2, order: int = ORDER) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    learn = training.select(F.coalesce(training[f"`{text}`"].cast("string"), F.lit("")).cast("binary").alias("text"))
    words = written(learn.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    tokens, kinds, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    least = max(1, math.ceil(tokens * WORD_SHARE))
    common = words.where((F.col("n") >= least) & F.col("word").isNotNull())  # at most 1 / WORD_SHARE rows
    table = common.toArrow()
    logs = dict(zip(table.column("word").to_pylist(), np.log10(table.column("n").to_numpy() + 1.0).tolist(), strict=True))
    counted = written(_counted(training, text, order), "grams")
    shared = spark.sparkContext.broadcast((logs, _sent(counted, order)))
    end = math.log10(ends + 1)
    each = math.log10(tokens + kinds + 1)
    known_end = int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, sent = shared.value
        scorer, get, nothing = Scorer(sent), logs.get, math.nan
        number = TaskContext.get().partitionId() << 36
        for batch in slices(batches, _SLICE):
            n = batch.num_rows
            texts, n_tokens, n_known, base, rare = [], [], [], [], []
            for x in batch.column(2).to_pylist():
                own, data = rendered(x)
                texts.append(data)
                found = np.fromiter((get(w, nothing) for w in own), np.float64, len(own))
                gone = np.isnan(found)
                n_tokens.append(len(own) + 1)
                n_known.append(len(own) - int(gone.sum()) + known_end)
                base.append(float(np.where(gone, 0.0, found).sum()) + end)
                rare.append(list(Counter([own[i] for i in np.flatnonzero(gone).tolist()]).items()))
            ids = pa.array(np.arange(number, number + n))
            number += n
            scores, open_ = scorer.scores(texts)
            made = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), open_, pa.array([[{"word": w, "times": k} for w, k in r] for r in rare], _RARE)]
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), batch.column(1), *made], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "open", "rare"])

    rows = document(df, text, key)
    rows = rows.select("doc_id", (fold(F.col("doc_id"), folds) == test).alias("held_out"), rows.text.cast("binary").alias("text"))
    first = written(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, open array<struct<gram:long,times:int>>, rare array<struct<word:binary,times:int>>"), "first")
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    met = rare.join(words.where((F.col("n") < least) & F.col("word").isNotNull()), "word")
    more = met.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("logs"))
    lost = first.select("row", F.explode("open").alias("o")).select("row", "o.gram", "o.times")
    context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * min(order, DEALT)) - 1)).alias("context")
    asked = written(lost.select("gram").distinct().withColumn("n", F.lit(0).cast("long")), "asked")
    dealt, split = _split(counted.union(asked).select(context, "gram", "n"), order)
    costs = dealt.repartition("context").sortWithinPartitions("context").mapInArrow(_costs(order, _low(counted, order), split), "gram long, cost double")
    paid = lost.join(written(costs, "costs"), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("paid"))
    return first.join(more, "row", "left").join(paid, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("score") + F.coalesce("paid", F.lit(0.0))).alias("score"),
    )


_RARE = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))


def evaluate(df: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 7, test: int = 2) -> DataFrame:
    """Learn from the rows whose fold isn't ``test``; score all rows."""
    held = fold(df[f"`{key}`"].cast("long"), folds) == test
    return score(df, df.where(~held), text, key, folds, test)
