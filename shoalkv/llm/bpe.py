"""Operator 1: byte-level BPE encoding and decoding.

Two tiers. Tier one is a minimal perfect hash over the vocabulary: every
distinct pre-token of a slice is hashed once and the whole vector of hashes is
resolved in numpy; a slot that holds the same bytes is the pre-token's id. Tier
two takes the misses: the piece becomes a doubly linked list of bytes, and a heap
of adjacent pairs by (rank, position) merges the lowest rank first until no pair
is in the vocabulary.

The vocabulary has a fixed size (some 50,000 entries), so its tables are
broadcast. No shuffle: encoding and decoding are maps over partitions.

Defined cases: a null text encodes to no ids; a null or empty id list decodes to
no bytes; repeated rows give repeated results; an empty table gives no rows; other
columns are passed through, and one that has the name of an output column is
replaced by it. An id outside the vocabulary raises ``ValueError`` on decoding.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Bytes, about, of pre-tokens and ids remembered by a Python worker between texts; forgetting them changes no result.
MEMO = 48 << 20
#: Bytes that an entry takes besides its characters and ids.
ENTRY = 200
#: Pre-tokens of one text taken at a time.
CHUNK = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a ``.tiktoken`` file (base64 token, space, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, displace, verify.

    Keys fall into buckets by their hash; buckets of two or more are placed, the
    largest first, by the smallest displacement under which all their slots are
    free. Buckets of one take the slots left over directly (negative entries).
    """

    MIX = 0x9E3779B97F4A7C15
    MASK = (1 << 64) - 1

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = n // 3 + 1
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        self.displacement = np.zeros(self.buckets, np.int64)
        self.slot_of = np.full(n, -1, np.int64)
        taken = bytearray(n)
        ordered = sorted(groups.items(), key=lambda x: -len(x[1]))
        free = 0
        for bucket, members in ordered:
            if len(members) == 1:
                while taken[free]:
                    free += 1
                self.displacement[bucket] = -1 - free
                slots = [free]
            else:
                d = 0
                while True:
                    slots = [self._slot(h, d) for h, _ in members]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.displacement[bucket] = d
            for slot, (_, i) in zip(slots, members, strict=True):
                taken[slot] = 1
                self.slot_of[slot] = i
        self.keys = [keys[i] if i >= 0 else None for i in self.slot_of]

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * self.MIX & self.MASK)) * self.MIX) & self.MASK
        return (x >> 29) % self.n

    def find(self, keys: list[bytes]) -> list[int]:
        """The index of each key, or -1; all slots are computed as one vector."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        d = self.displacement[(h % np.uint64(self.buckets)).astype(np.int64)]
        mix = np.uint64(self.MIX)
        x = (h ^ (np.maximum(d, 0).astype(np.uint64) * mix)) * mix
        slots = np.where(d < 0, -1 - d, ((x >> np.uint64(29)) % np.uint64(self.n)).astype(np.int64))
        mine = self.keys
        return [i if mine[s] == key else -1 for key, s, i in zip(keys, slots.tolist(), self.slot_of[slots].tolist(), strict=True)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece that isn't itself in the vocabulary."""
    n = len(piece)
    after = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n))  # where the part before starts
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, end = pop(heap)
        j = after[i]
        if j <= 0 or j >= n or after[j] != end:  # one of the two parts has changed or is gone
            continue
        after[i] = end
        after[j] = 0
        if end < n:
            before[end] = i
            far = after[end]
            if (r := get(piece[i:far])) is not None:
                push(heap, (r, i, far))
        if i:
            k = before[i]
            if (r := get(piece[k:end])) is not None:
                push(heap, (r, k, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        keys = list(ranks)
        self.table = PerfectHash(keys)
        self.ids = [ranks[k] for k in keys]
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for key, i in ranks.items():
            self.tokens[i] = key
        self._memo: dict[str, bytes] = {}
        self._held = 0
        self._compiled = None

    def __getstate__(self):
        return {**self.__dict__, "_memo": {}, "_held": 0, "_compiled": None}

    def _learn(self, new: list[str]) -> None:
        pieces = [x.encode("utf-8", "surrogatepass") for x in new]
        ids, ranks, memo = self.ids, self.ranks, self._memo
        for text, piece, at in zip(new, pieces, self.table.find(pieces), strict=True):
            memo[text] = packed = ids[at].to_bytes(4, "little") if at >= 0 else np.array(merge_bytes(piece, ranks), "<u4").tobytes()
            self._held += len(piece) + len(packed) + ENTRY

    def encode(self, text: str) -> bytes:
        if self._compiled is None:
            self._compiled = regex.compile(self.pattern)
        if len(text) < CHUNK:
            return self._pack(self._compiled.findall(text))
        found, parts = (m.group() for m in self._compiled.finditer(text)), []
        while part := list(islice(found, CHUNK)):
            parts.append(self._pack(part))
        return b"".join(parts)

    def _pack(self, pieces: list[str]) -> bytes:
        if self._held > MEMO:
            self._memo.clear()
            self._held = 0
        if new := set(pieces).difference(self._memo):
            self._learn(list(new))
        return b"".join(map(self._memo.__getitem__, pieces))

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        try:
            return b"".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        except (IndexError, TypeError):
            raise ValueError("an id is not in the vocabulary") from None


def _mapped(df: DataFrame, source: str, targets: list[str], make) -> DataFrame:
    """``df`` with the binary ``targets`` made from the values of ``source``, slice by slice."""
    made_of = {t.lower() for t in targets}
    kept = [f for f in df.schema.fields if f.name.lower() not in made_of]
    schema = T.StructType(kept + [T.StructField(t, T.BinaryType()) for t in targets])
    keep = [f.name for f in kept]
    cols = [df[f"`{c}`"] for c in keep] + [df[f"`{source}`"].alias("_" * (1 + max(map(len, schema.names))))]  # a name that no column has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in slices(batches):
            made = zip(*[one(x) for x in batch.column(batch.num_columns - 1).to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x, pa.binary()) for x in made]], names=schema.names)

    return df.select(cols).mapInArrow(run, schema)


def encode(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the packed ids of the column ``text`` in the binary column ``ids``."""
    shared = df.sparkSession.sparkContext.broadcast(codec)
    return _mapped(df, text, [ids], lambda: lambda x, c=shared.value: (c.encode(x) if x else b"",))


def decode(df: DataFrame, codec: Codec, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the packed ids in the binary column ``data``."""
    shared = df.sparkSession.sparkContext.broadcast(codec)
    return _mapped(df, ids, [data], lambda: lambda x, c=shared.value: (c.decode(x) if x else b"",))


def coded(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``df`` encoded and decoded again, in one pass and one worker a task."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def make():
        codec = shared.value

        def one(x: str | None) -> tuple[bytes, bytes]:
            packed = codec.encode(x) if x else b""
            return packed, codec.decode(packed)

        return one

    return _mapped(df, text, [ids, data], make)


def id_list(packed: str) -> F.Column:
    """The packed ids as an array of longs, on the JVM side."""
    raw = F.col(packed)
    byte = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("long")
    places = F.filter(F.sequence(F.lit(1), F.octet_length(raw) + 1, F.lit(4)), lambda at: at < F.octet_length(raw))
    return F.transform(places, lambda at: byte(at) + byte(at + 1) * 256 + byte(at + 2) * 65536 + byte(at + 3) * 16777216)


def digests(df: DataFrame, codec: Codec, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, and the SHA-256 of the packed ids and of the decoded bytes."""
    rows = df.select(df[f"`{key}`"].alias("doc_id"), df[f"`{text}`"].cast("string").alias("text"))
    return coded(rows, codec).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
