"""Operator 8: SimHash near-dedup over deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments. Of two fingerprints that differ
in three bits or fewer, one segment differs in at most one; so each segment is
indexed once for each of its 32 bits with that bit left out, and an equality on
(segment, left-out bit, rest) finds every such pair. Candidates are verified by
counting the differing bits.

The equality is a shuffle by signature followed by one sorted sweep: the rows of a
signature come in a row, and what leaves the sweep is a forest (each fingerprint to
the smallest of its local component), so a bucket of m fingerprints sends m - 1 links and
not m * m. A bucket larger than ``BUCKET`` isn't held: its members go on to be
indexed again within the bucket, over another cut into two halves (even and odd
bits, then pairs of bits). After three cuts at most 8 + 3 bits are free, so no bucket
can hold more than 2,048 distinct fingerprints: all links are found at any skew, in
bounded memory, with no cap. Equal fingerprints are one node throughout.

Near copies by the similarity of their shingles, which one fingerprint can't find at 0.8, are in ``near``: several
fingerprints by this method, and a check.

Defined cases: null text counts as empty; a text with fewer words than a shingle
has one shingle, its whole sequence; one without words has fingerprint zero, linked
like any other; rows with a null id are linked, but give no component its id, which is
null only if all its ids are; repeated rows are separate rows of one component; very long
texts are hashed a stretch of shingles at a time, some thirty bytes of memory a word; an empty table gives no rows;
further columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components
from .common import document, sent, slices, written

SEED = 42
BUCKET = 2048
#: The cuts into two halves of 32 bits: high and low, even and odd, pairs of bits.
CUTS = [
    (0x00000000FFFFFFFF, 0xFFFFFFFF00000000),
    (0x5555555555555555, 0xAAAAAAAAAAAAAAAA),
    (0x3333333333333333, 0xCCCCCCCCCCCCCCCC),
]
#: Rows (two longs each) of linked fingerprints that are sent to every scan; more are joined.
BROADCAST = 500_000
#: Shingles hashed at once.
STRETCH = 1 << 16
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def masks(cut: int) -> list[int]:
    """The 64 signatures' masks of a cut: one half less one of its bits, as signed longs."""
    out = [half & ~(1 << bit) for half in CUTS[cut] for bit in range(64) if half >> bit & 1]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _single(text: bytes) -> np.ndarray:
    """The bytes with A-Z in lower case and one space between words, none around them."""
    data = np.frombuffer(text.lower(), np.uint8)
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    out = np.where(space, np.uint8(32), data)[keep]
    return out[:-1] if len(out) and out[-1] == 32 else out


def shingle_hashes(text: bytes, k: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the k-word shingles, repeats included, some at a time; of fewer words, of the whole sequence."""
    data = _single(text)
    if not len(data):
        return
    line, gaps = data.tobytes(), np.flatnonzero(data == 32)
    n = len(gaps) + 1
    if n <= k:
        yield np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
        return
    for s in range(0, n - k + 1, STRETCH):
        e = min(s + STRETCH, n - k + 1)
        starts = (gaps[s - 1 : e - 1] + 1).tolist() if s else [0, *(gaps[: e - 1] + 1).tolist()]
        ends = gaps[s + k - 1 : e + k - 1].tolist()
        ends += [len(line)] * (e - s - len(ends))
        yield np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, e - s)


def fingerprint(text: bytes, k: int = 3, seed: int = SEED) -> int:
    """Bit by bit, whether it is set in more than half of the shingles' hashes; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k, seed):
        ones += np.concatenate([np.bincount(c, minlength=256) @ _BITS for c in h.view(np.uint8).reshape(-1, 8).T])
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0]) if n else 0


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = 3) -> DataFrame:
    """Per row: doc_id and fp0 as a signed long. A map over partitions."""
    rows = document(df, text, key)
    rows = rows.select("doc_id", rows.text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = pa.array([fingerprint(x, k) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "fp0"])

    return rows.mapInArrow(run, "doc_id long, fp0 long")


def local_forest(prints: np.ndarray, bits: int) -> np.ndarray:
    """For each of a bucket's fingerprints, the position of the first of its local component."""
    n = len(prints)
    same = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
    label = np.arange(n)
    while True:
        least = np.where(same, label[None, :], n).min(axis=1)
        if (least == label).all():
            return label
        label = least


def buckets(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of rows sorted by the first, in whole buckets of it; a bucket over ``limit`` comes in parts, of more than ``limit`` in all."""
    held: list[tuple[np.ndarray, ...]] = []  # of the last bucket so far
    size, over = 0, None

    def out() -> tuple[np.ndarray, ...]:
        nonlocal size
        parts, size = held.copy(), 0
        held.clear()
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [x.to_numpy() for x in batch.columns]
        sig = rows[0]
        if held and held[0][0][0] != sig[0]:
            yield out()
        at = int(np.searchsorted(sig, sig[-1]))
        if at:
            held.append(tuple(x[:at] for x in rows))
            yield out()
        held.append(tuple(x[at:] for x in rows))
        size += len(sig) - at
        if size > limit or over == sig[-1]:
            over = sig[-1]
            yield out()
    if held:
        yield out()


def _sweep(bits: int, last: bool):
    """Over rows (sig, node) sorted by sig: links of fingerprints, or the members of large buckets with their sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, large = None, False  # the last bucket, and whether it came in parts
        for sig, node in buckets(batches, math.inf if last else BUCKET):
            at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            sizes = np.diff(np.append(at, len(sig)))
            over = np.zeros(len(at), bool) if last else sizes > BUCKET
            over[0] |= large and sig[0] == before
            before, large = sig[-1], bool(over[-1])
            prints, links = node.view(np.uint64), []
            pairs = at[(sizes == 2) & ~over]
            pairs = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= bits] if len(pairs) else pairs
            links.append((node[pairs], node[pairs + 1]))
            for s, n in zip(at[(sizes > 2) & ~over].tolist(), sizes[(sizes > 2) & ~over].tolist(), strict=True):
                label = local_forest(prints[s : s + n], bits)
                moved = np.flatnonzero(label != np.arange(n))
                links.append((node[s + label[moved]], node[s + moved]))
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "sig"])
            if over.any():
                rows = np.repeat(over, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.nulls(int(rows.sum()), pa.int64()), pa.array(sig[rows])], names=["a", "b", "sig"])

    return run


def _signed(members: DataFrame, cut: int) -> DataFrame:
    """A row for each signature of each member: sig, node."""
    each = members.select("node", "sig", F.posexplode(F.array(*map(F.lit, masks(cut)))).alias("bit", "mask"))
    return each.select(F.xxhash64("sig", "bit", F.col("node").bitwiseAND(F.col("mask"))).alias("sig"), "node")


def links(nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes`` has ``node``: fingerprints as signed longs, each once; returns links ``a``, ``b`` that keep the components."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments find fingerprints of at most three differing bits")
    found, members = [], nodes.select("node", F.lit(None).cast("long").alias("sig"))
    for cut in range(len(CUTS)):
        sorted_ = _signed(members, cut).repartition("sig").sortWithinPartitions("sig", "node")
        swept = written(sorted_.mapInArrow(_sweep(bits, cut == len(CUTS) - 1), "a long, b long, sig long"), f"swept{cut}")
        found.append(swept.where("sig is null").select("a", "b"))
        members = swept.where("sig is not null").select(F.col("a").alias("node"), "sig")
        if members.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = 3, bits: int = 2) -> DataFrame:
    """One row per row of ``df``: doc_id, fp0 (of its k-word shingles), component_id (the smallest id of its component)."""
    rows = written(fingerprints(df, text, key, k), "fingerprints")
    nodes = written(rows.groupBy(F.col("fp0").alias("node")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    rooted = nodes.join(components.roots(links(nodes, bits)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")).where("n > 1").select("root", "component_id")
    named = written(rooted.join(several, "root").select("node", "component_id"), "named")
    found = rows.join(sent(named, BROADCAST), rows["fp0"] == named["node"], "left")
    return found.select("doc_id", "fp0", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def hex_of(fingerprint: str) -> F.Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
