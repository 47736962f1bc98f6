"""Near copies by the similarity of their five-word shingles: the pipeline's form of operator 8.

One fingerprint of all shingles is too far off at a similarity of 0.8 (some ten bits of 64), so a set has ``PRINTS``
weighted ones. In each a shingle weighs ``max(t, 2) ** -1.5``, with t a hash of the shingle and the fingerprint's number, from 0 to the
size of the set: a few shingles make up most of a fingerprint, others in each, and no single one does, however common it is. Two sets of similarity 0.8
agree in one segment of a fingerprint, but for a bit at most, in some 0.38 of cases, wherever the edits are; unrelated sets hardly ever. Weights are whole numbers, so that sums are exact in any order.

Candidates are found as in ``simhash``: a fingerprint has two segments of 32 bits, each of which is indexed once for each of its bits with that bit left
out, and equal signatures meet. Rows are dealt by the half of the segment that has no bit left out, and the sixteen
signatures over the other half are made and compared where they meet, so four rows a fingerprint are shuffled and not 64. Of the values of that half, those
joined by signatures form one bucket of candidates. Up to ``HELD`` rows that share a half are held by one worker; of more, the distinct values alone (65,536 at most).

Each candidate pair is verified by counting differing bits of a finer sketch: the hashes
are dealt to 1,024 bins, and of each bin the sketch has whether it is empty and one bit of its least hash. The share of
bins that agree estimates the similarity, to about 0.01 for texts of a few hundred words. A pair counts from ``SLACK`` below the limit
on, so that the error costs few pairs above it.

All links count, at any size of a bucket. Documents with one set of shingles are one node throughout, and signatures with the same members
are one bucket. A bucket of up to ``BUCKET`` nodes is held by one worker and searched breadth first: a node found is compared with
those not yet found, so near copies of one text cost a look or two each. A larger bucket is dealt into blocks by the nodes'
hash, over tasks; each block sends a spanning forest. What is left is to compare nodes of different components: all nodes outside of
the bucket's largest component with all of the bucket, block pair by block pair, over tasks. No task holds more than two blocks,
no pairs are formed, and the result doesn't depend on the order of rows.

Defined cases: null text counts as empty; a text with fewer words than a shingle has one, its whole sequence; texts without
words are one node; a group's first document is the one with the smallest id, null ids last, then by the hash of its text; rows
with one id and one text are one document and stay or go together; very long texts are one row of work each, some
fifty bytes of memory a word; an empty table gives no rows; further columns, whatever their names, are passed over by ``groups`` and kept by ``survivors``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components
from .common import document, sent, slices, written
from .simhash import buckets, masks

SEED = 42
SHINGLE, PRINTS = 5, 16
#: Shingles weighed at once.
STRETCH = 192
#: Rows of one half of a segment (sixteen bytes each) that a worker holds.
HELD = 1 << 20
#: Bins of a sketch, a power of two, and how far below the limit an estimate may lie.
BINS, SLACK = 1024, 0.01
#: Nodes that one task holds of a bucket.
BUCKET = 2048
#: Rows (two longs each) that are sent to every scan; more are joined.
BROADCAST = 500_000
MEMO = 300_000

_WORDS = BINS // 64
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, PRINTS), np.uint64) | np.uint64(1)
_MASKS = np.array(masks(0), np.int64).view(np.uint64)
_PLACE = np.random.default_rng(SEED + 1).integers(0, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingled(text: bytes, memo: dict, k: int = SHINGLE) -> np.ndarray:
    """The hashes of the set of shingles, ascending."""
    words = text.lower().split()
    x = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(k, len(x))
    if not n:
        return x
    h = np.full(len(x) - n + 1, n, np.uint64)
    for j in range(n):
        h += _mixed(x[j : len(x) - n + 1 + j] * _PLACE[j])
    return np.unique(_mixed(h))


def fingerprints(h: np.ndarray) -> np.ndarray:
    """Of the set with these hashes, bit by bit, whether it is set in shingles of more than half of the weight; zero without shingles."""
    ones, total = np.zeros((PRINTS, 64)), np.zeros((PRINTS, 1))
    for s in range(0, len(h), STRETCH):
        part = h[s : s + STRETCH]
        u = (((part[None, :] ^ _MIX[0][:, None]) * _MIX[1][:, None]) >> np.uint64(32)).astype(np.float64)
        t = np.maximum(u * (len(h) / 2.0**32), 2)
        weight = np.floor(2.0**40 / (t * np.sqrt(t)))
        ones += weight @ np.unpackbits(_mixed(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        total += weight.sum(axis=1, keepdims=True)
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view(np.uint64)[:, 0]


def bands(h: np.ndarray) -> list[int]:
    """The signatures of the set with these hashes: sets with the same one in the same place are candidates."""
    return (fingerprints(h)[:, None] & _MASKS).ravel().tolist()


def sketch(h: np.ndarray) -> bytes:
    """For each bin of the ascending hashes a bit whether it has any, then for each bin a bit of its least."""
    place = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(h) else place
    bits = np.zeros((2, BINS), np.uint8)
    bits[0, place[first]] = 1
    bits[1, place[first]] = _mixed(h[first]) & np.uint64(1)
    return np.packbits(bits, bitorder="little").tobytes()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimates of two sketches' similarity reach ``least``; rows of words, or arrays that go together."""
    both, differ = a[..., :_WORDS] & b[..., :_WORDS], a[..., _WORDS:] ^ b[..., _WORDS:]
    shared = np.bitwise_count(both).sum(axis=-1, dtype=np.int32) - 2 * np.bitwise_count(differ & both).sum(axis=-1, dtype=np.int32)
    return shared >= least * np.bitwise_count(a[..., :_WORDS] | b[..., :_WORDS]).sum(axis=-1, dtype=np.int32)


def searched(prints: np.ndarray, least: float) -> np.ndarray:
    """For each sketch, the position of one of its component, the same for all of it."""
    label, open_ = np.full(len(prints), -1), np.arange(len(prints))
    while len(open_):
        root, open_ = open_[0], open_[1:]
        label[root], queue = root, [root]
        while queue and len(open_):
            near = similar(prints[open_], prints[queue.pop()], least)
            found = open_[near]
            label[found] = root
            queue += found.tolist()
            open_ = open_[~near]
    return label


def _values(key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over rows sorted by key: for each a number and a signature, the same for rows of a key whose ``rest`` (16 bits) are joined by values that agree but for a bit."""
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    code, at = np.unique(group << 16 | rest, return_inverse=True)
    a, b = [], []
    for bit in range(16):
        left = code & ~(1 << bit)
        order = np.argsort(left, kind="stable")
        same = np.flatnonzero(left[order[1:]] == left[order[:-1]])
        a.append(order[same])
        b.append(order[same + 1])
    a, b, label = np.concatenate(a), np.concatenate(b), np.arange(len(code))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
    label = label[at]
    first = (code[label] & 0xFFFF).astype(np.uint64)
    return label, _mixed(_mixed(key.view(np.uint64)) + first).view(np.int64)


def _met(held: int):
    """Over rows (key, node, rest) sorted by key: rows (sig, node) of candidates, and rows of large keys as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, large = None, False  # the last key, and whether it came in parts
        for key, node, rest in buckets(batches, held):
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(at, len(key)))
            over = sizes > held
            over[0] |= large and key[0] == before
            before, large = key[-1], bool(over[-1])
            rows = np.repeat(over, sizes)
            if over.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(node[rows]), pa.array(rest[rows])], names=["sig", "node", "rest"])
            rows = np.repeat(~over & (sizes > 1), sizes)
            if not rows.any():
                continue
            label, sig = _values(key[rows], rest[rows])
            several = np.bincount(label)[label] > 1
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[several]), pa.array(node[rows][several]), pa.nulls(int(several.sum()), pa.int32())], names=["sig", "node", "rest"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over distinct rows (key, rest) sorted by key: the same with their signatures."""
    for key, rest in buckets(batches, float("inf")):
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rest), pa.array(_values(key, rest)[1])], names=["key", "rest", "sig"])


def candidates(nodes: DataFrame) -> DataFrame:
    """``nodes`` has ``node`` and ``prints`` (fingerprints as signed longs), each node once; returns ``sig``, ``node``: nodes with one ``sig`` are candidates."""
    part = [F.shiftrightunsigned("print", 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    rows = F.array(*[F.struct(F.xxhash64("at", F.lit(q), part[q]).alias("key"), part[q ^ 1].cast("int").alias("rest")) for q in range(4)])
    each = nodes.select("node", F.posexplode("prints").alias("at", "print")).select("node", F.explode(rows).alias("x")).select("x.key", "node", "x.rest")
    met = written(each.repartition("key").sortWithinPartitions("key").mapInArrow(_met(HELD), "sig long, node long, rest int"), "met")
    found = met.where("rest is null").select("sig", "node")
    large = met.where("rest is not null").select(F.col("sig").alias("key"), "node", "rest")
    if large.isEmpty():
        return found
    values = large.select("key", "rest").distinct().repartition("key").sortWithinPartitions("key")
    named = written(values.mapInArrow(_named, "key long, rest int, sig long"), "values")
    return found.union(written(large.join(named, ["key", "rest"]).select("sig", "node"), "met"))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables of whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # where the last group begins
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _prints(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2 * _WORDS)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _forests(least: float):
    """Over rows (sig, node, sketch) sorted by sig, groups small enough to hold: links that span each group's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _held(batches):
            sig, node, prints = rows.column(0).to_numpy(), rows.column(1).to_numpy(), _prints(rows.column(2))
            at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            sizes = np.diff(np.append(at, len(sig)))
            first = np.repeat(at, sizes)
            near = np.zeros(len(sig), bool)
            for s in range(0, len(sig), 1 << 13):
                near[s : s + (1 << 13)] = similar(prints[s : s + (1 << 13)], prints[first[s : s + (1 << 13)]], least)
            near[at] = False
            a, b = [node[first[near]]], [node[near]]
            left = np.add.reduceat(~near, at)  # with the first itself
            for s, n in zip(at[(left > 1) & (sizes > 2)].tolist(), sizes[(left > 1) & (sizes > 2)].tolist(), strict=True):
                label = searched(prints[s : s + n], least)
                a.append(node[s + label])
                b.append(node[s : s + n])
            a, b = np.concatenate(a), np.concatenate(b)
            if (a != b).any():
                yield _links(a[a != b], b[a != b])

    return run


def _crossed(least: float):
    """Over rows (sig, side, node, root, sketch) sorted by sig: links of roots, between side 0 (one block) and side 1 (another)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _held(batches):
            sig, side, root = (rows.column(i).to_numpy() for i in (0, 1, 3))
            prints = _prints(rows.column(4))
            edges = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(sig)], strict=True):
                mine, theirs = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                others = prints[theirs]
                up: dict[int, int] = {}

                def top(x: int, up=up) -> int:
                    while up.get(x, x) != x:
                        x = up[x]
                    return x

                for i in mine.tolist():
                    near = theirs[similar(others, prints[i], least)]
                    for other in np.unique(root[near]).tolist():
                        x, y = top(int(root[i])), top(other)
                        if x != y:
                            up[max(x, y)] = min(x, y)
                if up:
                    yield _links(np.array(list(up.values()), np.int64), np.array(list(up), np.int64))

    return run


def _blocks(rows: Column, size: int) -> Column:
    return F.ceil(rows / F.lit(size / 2)).cast("int")  # half full, as hashes fill them unevenly


def linked(nodes: DataFrame, similarity: float) -> DataFrame:
    """``nodes`` has ``node``, ``bands`` (keys of buckets by place) and ``sketch``, each node once; returns links ``a``, ``b`` that keep the components."""
    each = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    return verified(each.select(F.xxhash64("band", "key").alias("sig"), "node"), nodes.select("node", "sketch"), similarity)


def verified(keyed: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The links ``a``, ``b``, enough to keep the components, of nodes with one ``sig`` in ``keyed`` (sig, node) whose ``sketches`` (node, sketch) are similar."""
    least = similarity - SLACK
    members = F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1L))").alias("y"), F.count(F.lit(1)).alias("n")
    buckets = keyed.groupBy("sig").agg(*members).where("n > 1").groupBy("x", "y", "n").agg(F.min("sig").alias("sig"))
    buckets = written(buckets.select("sig", "n"), "buckets")

    def forests(rows: DataFrame, name: str) -> DataFrame:
        ready = rows.join(sketches, "node").select("sig", "node", "sketch").repartition("sig").sortWithinPartitions("sig")
        return written(ready.mapInArrow(_forests(least), "a long, b long"), name)

    found = forests(keyed.join(buckets.where(F.col("n") <= BUCKET).select("sig"), "sig"), "links")
    large = written(buckets.where(F.col("n") > BUCKET).withColumn("blocks", _blocks(F.col("n"), BUCKET)), "large")
    if large.isEmpty():
        return found
    large = keyed.join(sent(large, BROADCAST), "sig")
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks"))
    found = found.union(forests(large.select(F.xxhash64("sig", own).alias("sig"), "node"), "blocks"))
    rooted = large.join(components.roots(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted.select("sig", "node", "root", "blocks"), "rooted")
    kinds = rooted.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"))
    usual = kinds.groupBy("sig").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    usual = usual.select("sig", F.col("most.root").alias("usual"), _blocks(F.col("n") - F.col("most.n"), BUCKET).alias("others")).where("others > 0")
    left = rooted.join(sent(written(usual, "usual"), BROADCAST), "sig").join(sketches, "node")
    mine = left.where("root != usual").select(
        "sig", F.lit(0).alias("side"), "node", "root", "sketch", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("others")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    )
    theirs = left.select("sig", F.lit(1).alias("side"), "node", "root", "sketch", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), own.alias("j"))
    pairs = mine.union(theirs).select(F.xxhash64("sig", "i", "j").alias("sig"), "side", "node", "root", "sketch")
    crossed = pairs.repartition("sig").sortWithinPartitions("sig").mapInArrow(_crossed(least), "a long, b long")
    return found.union(written(crossed, "crossed"))


def _sketched(df: DataFrame, text: str, key: str) -> DataFrame:
    """Per row of ``df``: doc_id, stamp (a hash of its text), node (a hash of its set of shingles), prints, sketch."""
    rows = document(df, text, key)
    rows = rows.select("doc_id", F.xxhash64("text").alias("stamp"), rows.text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in slices(batches):
            sets = [shingled(x, memo) for x in batch.column(2).to_pylist()]
            made = [
                pa.array([xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) for h in sets], pa.int64()),
                pa.array([fingerprints(h).view(np.int64) for h in sets], pa.list_(pa.int64())),
                pa.array([sketch(h) for h in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "stamp", "node", "prints", "sketch"])

    return rows.mapInArrow(run, "doc_id long, stamp long, node long, prints array<long>, sketch binary")


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = 0.8) -> DataFrame:
    """One row per row of ``df``: doc_id, stamp, component_id (the smallest id among its near copies), first (whether it is its group's first document)."""
    rows = written(_sketched(df, text, key), "sketches")
    nodes = written(rows.groupBy("node").agg(F.first("prints").alias("prints"), F.first("sketch").alias("sketch")), "nodes")
    roots = components.roots(verified(candidates(nodes), nodes.select("node", "sketch"), similarity))
    named = rows.select("doc_id", "stamp", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named.select("doc_id", "stamp", "root"), "rooted")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "stamp")
    several = named.groupBy("root").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "least")
    rows = named.join(sent(written(several, "several"), BROADCAST), "root", "left")
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return rows.select("doc_id", "stamp", component.alias("component_id"), F.coalesce(order.eqNullSafe(F.col("least")) | F.col("least").isNull(), F.lit(True)).alias("first"))


def survivors(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = 0.8) -> DataFrame:
    """The rows of ``df``, with all their columns, of which of each group of near copies the first document stays."""
    gone = sent(written(groups(df, text, key, similarity).where("not first").select("doc_id", "stamp").distinct(), "gone"), BROADCAST)
    stamp = F.xxhash64(F.coalesce(df[f"`{text}`"].cast("string"), F.lit("")))
    return df.join(gone, (stamp == gone["stamp"]) & df[f"`{key}`"].cast("long").eqNullSafe(gone["doc_id"]), "left_anti")
