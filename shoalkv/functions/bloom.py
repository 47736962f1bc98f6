"""Split-block bloom filters over keys, with a murmur3 key hash.

Hashing is done for all keys of a batch at once in numpy, grouped by length. A filter that is
missing or malformed never rules a key out.
"""

from __future__ import annotations

import base64
import binascii
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The eight salts of split-block filters as the catalog's writers use them (Parquet's own sixth ends in 4B).
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424C, 0x9EFC4947, 0x5C6BFB31], np.uint32)
#: The seeds of the two halves of the key hash.
HIGH_SEED, LOW_SEED = 0, 0x9747B28C
BLOCK_BYTES = 32


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _scrambled(k: np.ndarray) -> np.ndarray:
    return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def _murmur_equal(keys: np.ndarray, seed: int) -> np.ndarray:
    """murmur3 (x86, 32 bits) of the rows of a byte matrix."""
    n, length = keys.shape
    whole = length // 4
    h = np.full(n, seed, np.uint32)
    if whole:
        for k in np.ascontiguousarray(keys[:, : whole * 4]).view("<u4").T:
            h = _rotated(h ^ _scrambled(k.astype(np.uint32)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    if tail := length % 4:
        k = np.zeros(n, np.uint32)
        for i in range(tail):
            k |= keys[:, whole * 4 + i].astype(np.uint32) << np.uint32(8 * i)
        h ^= _scrambled(k)
    h ^= np.uint32(length)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def murmur3(keys: list[bytes], seed: int) -> np.ndarray:
    out = np.zeros(len(keys), np.uint32)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        matrix = np.frombuffer(b"".join(keys[i] for i in at.tolist()), np.uint8).reshape(len(at), size)
        out[at] = _murmur_equal(matrix, seed)
    return out


def key_hash(keys: list[bytes]) -> np.ndarray:
    return (murmur3(keys, HIGH_SEED).astype(np.uint64) << np.uint64(32)) | murmur3(keys, LOW_SEED).astype(np.uint64)


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's block and the eight words' masks."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = hashes.astype(np.uint32)
    return block.astype(np.int64), np.uint32(1) << ((low[:, None] * SALTS) >> np.uint32(27))


def blocks_for(keys: int, fpp: float = 0.01) -> int:
    """Blocks for so many distinct keys: eight bits set per key, one in each word of its block."""
    bits = -8.0 * keys / math.log(1.0 - fpp ** 0.125)
    return max(1, math.ceil(bits / 256))


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words = words.reshape(-1, 8)

    @classmethod
    def empty(cls, blocks: int) -> Bloom:
        return cls(np.zeros((blocks, 8), np.uint32))

    @classmethod
    def build(cls, keys: list[bytes], fpp: float = 0.01) -> Bloom:
        made = cls.empty(blocks_for(len(keys), fpp))
        made.add(keys)
        return made

    @classmethod
    def parse(cls, data: bytes | None) -> Bloom | None:
        """None if there is none, or it isn't a whole number of blocks."""
        if not data or len(data) % BLOCK_BYTES:
            return None
        return cls(np.frombuffer(data, "<u4").astype(np.uint32))

    @classmethod
    def from_base64(cls, text: str | None) -> Bloom | None:
        try:
            return cls.parse(base64.b64decode(text, validate=True)) if text else None
        except (binascii.Error, ValueError):
            return None

    def add(self, keys: list[bytes]) -> None:
        block, masks = _places(key_hash(keys), len(self.words))
        np.bitwise_or.at(self.words, block, masks)

    def might_contain(self, keys: list[bytes]) -> np.ndarray:
        block, masks = _places(key_hash(keys), len(self.words))
        return ((self.words[block] & masks) == masks).all(axis=1)

    def tobytes(self) -> bytes:
        return self.words.astype("<u4").tobytes()


def may_contain(bloom: bytes | None, key: bytes) -> bool:
    parsed = Bloom.parse(bloom)
    return parsed is None or bool(parsed.might_contain([key])[0])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (file, share, side, pk, words) sorted by the first three: a file's filter comes before the keys it is asked for."""
    file, bloom = None, None
    for batch in batches:
        files, side = batch.column(0), batch.column(2).to_numpy()
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (side[1:] == 0) | (side[:-1] == 0)) + 1
        keep = np.zeros(batch.num_rows, bool)
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            own = files[s].as_py()
            if own != file:
                file, bloom = own, None
            if side[s] == 0:
                bloom = Bloom.parse(batch.column(4)[s].as_py())
            else:
                keep[s:e] = bloom.might_contain(batch.column(3).slice(s, e - s).to_pylist()) if bloom else True
        kept = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(3)], names=["file", "pk"])


#: Shares that the keys asked of one file are dealt into, over tasks.
SHARES = 8


def bloom_pruned(pairs: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows (``file``, ``pk``) of ``pairs`` that the file's filter doesn't rule out. ``filters`` has ``file`` and ``words``, a row per
    file at most; a file without one keeps its rows. Files are text. A filter travels once to each share of its file's keys, never beside each key."""
    share = F.pmod(F.xxhash64("pk"), F.lit(SHARES)).cast("int")
    asked = pairs.select("file", share.alias("share"), F.lit(1).alias("side"), "pk", F.lit(None).cast("binary").alias("words"))
    each = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    told = filters.select("file", each, F.lit(0).alias("side"), F.lit(None).cast("binary").alias("pk"), "words")
    ready = told.union(asked).repartition("file", "share").sortWithinPartitions("file", "share", "side")
    return ready.mapInArrow(_probe, "file string, pk binary")


def partial_blooms(keys: DataFrame, blocks: dict[str, int]) -> DataFrame:
    """``keys`` has ``file`` and ``pk``; a row per file and task: file, words. Rows of one file are OR-ed by ``merged``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Bloom] = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            at, own = codes.indices.to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, file in enumerate(codes.dictionary.to_pylist()):
                bloom = made.setdefault(file, Bloom.empty(blocks[file]))
                bloom.add([own[r] for r in np.flatnonzero(at == i).tolist()])
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array([b.tobytes() for b in made.values()], pa.binary())], names=["file", "words"])

    return keys.select("file", "pk").mapInArrow(run, "file string, words binary")


def united(parts: DataFrame) -> DataFrame:
    """The same, a row per file: parts of a file meet on one executor, a pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, b""
        for batch in batches:
            for file, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != last and last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([words], pa.binary())], names=["file", "words"])
                words = merged([words, part]) if file == last else part
                last = file
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([words], pa.binary())], names=["file", "words"])

    return parts.repartition("file").sortWithinPartitions("file").mapInArrow(run, "file string, words binary")


def merged(parts: list[bytes]) -> bytes:
    return np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in parts]).tobytes()
