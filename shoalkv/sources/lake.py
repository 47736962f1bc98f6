"""The lake: published Parquet files and the manifests that say which of them are live.

Each attempt to publish writes a folder of its own, ``data/wm=<watermark>-<attempt>/``: files sorted by key in small row groups, with bloom filters
for the key. ``manifest/<number>.json`` describes them; numbers are consecutive, and a manifest is created exclusively and whole: that is the commit.
Whoever publishes or compacts has read up to some number and competes for the next one, so of all that run at a time one
succeeds, and the others start anew. A data folder without a manifest is an orphan, which ``vacuum`` deletes. The
published watermark stands in the last manifest; nothing else stores it.
"""

from __future__ import annotations

import base64
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom as blooms
from ..schema import FILE_INDEX, MUTATION, PublishConflict, StoreError, identified, verify_columns
from .objects import Client

ROW_GROUP_ROWS = 8192


@dataclass(frozen=True)
class FileEntry:
    location: str
    watermark: int
    pk_min: bytes
    pk_max: bytes
    file_size: int
    record_count: int
    bloom: bytes | None

    def may_contain(self, key: bytes) -> bool:
        """By the interval, inclusive at both ends."""
        return self.pk_min <= key <= self.pk_max

    def bloom_may_contain(self, key: bytes) -> bool:
        return blooms.may_contain(self.bloom, key)

    def as_json(self) -> dict:
        return {
            "location": self.location, "watermark": self.watermark, "pk_min": self.pk_min.hex(), "pk_max": self.pk_max.hex(),
            "file_size": self.file_size, "record_count": self.record_count, "bloom": base64.b64encode(self.bloom).decode() if self.bloom else None,
        }

    @classmethod
    def from_json(cls, x: dict) -> FileEntry:
        try:
            ends = bytes.fromhex(x["pk_min"]), bytes.fromhex(x["pk_max"])
        except ValueError as e:
            raise StoreError(f"{x['location']}: {e}") from e
        parsed = blooms.Bloom.from_base64(x.get("bloom"))
        return cls(x["location"], x["watermark"], *ends, x["file_size"], x["record_count"], parsed.tobytes() if parsed else None)


class FileIndex:
    """Live files, the highest watermark first."""

    def __init__(self, entries: list[FileEntry]):
        self.entries = sorted(entries, key=lambda e: -e.watermark)

    def candidates(self, key: bytes) -> list[FileEntry]:
        return [e for e in self.entries if e.may_contain(key)]

    @property
    def watermark(self) -> int:
        return self.entries[0].watermark if self.entries else 0

    def __len__(self) -> int:
        return len(self.entries)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e.location, e.watermark, e.pk_min, e.pk_max, e.file_size, e.record_count, e.bloom) for e in self.entries]
        return spark.createDataFrame(rows, FILE_INDEX)


class Lake:
    def __init__(self, spark: SparkSession, root: str, row_group_rows: int = ROW_GROUP_ROWS, bloom_filters: bool = True, client: Client | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.row_group_rows, self.bloom_filters = row_group_rows, bloom_filters
        self.client = client or Client(spark)
        self._manifests: dict[int, dict] = {}  # what was read once: a manifest never changes

    def bootstrap(self) -> None:
        """Idempotent: an empty lake has no files and watermark 0."""
        self._fs().mkdirs(self._path("manifest"))
        self._fs().mkdirs(self._path("data"))

    @property
    def exists(self) -> bool:
        return self._fs().exists(self._path("manifest"))

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _file(self, *parts: str) -> str:
        """A full path: the scheme is the file system's if the root names none."""
        return self._fs().makeQualified(self._path(*parts)).toString()

    def versions(self) -> list[int]:
        """The numbers of the manifests."""
        names = [name for name, _ in self.client.list(self._file("manifest"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _manifest(self, version: int) -> dict:
        if version not in self._manifests:
            self._manifests[version] = json.loads(self.client.get(self._file("manifest", f"{version:020d}.json")))
        return self._manifests[version]

    def state(self) -> tuple[int, int]:
        """The last manifest's number, and the watermark."""
        last = max(self.versions(), default=0)
        return last, self._manifest(last)["watermark"] if last else 0

    def watermark(self) -> int:
        return self.state()[1]

    def index(self, as_of: int | None = None) -> FileIndex:
        """The live files; as of a watermark: those that publishes up to it have made, whatever a compaction replaced later."""
        entries: dict[str, FileEntry] = {}
        gone: set[str] = set()
        for told in map(self._manifest, self.versions()):
            if as_of is None or told["watermark"] <= as_of and not told["replaced"]:
                gone |= set(told["replaced"])
                entries |= {e.location: e for e in map(FileEntry.from_json, told["files"])}
        return FileIndex([e for at, e in entries.items() if at not in gone])

    def files(self, entries: list[FileEntry]) -> DataFrame:
        """The rows of some files; no files, no rows."""
        if not entries:
            return self.spark.createDataFrame([], MUTATION)
        return self.spark.read.schema(MUTATION).parquet(*[e.location for e in entries])

    def rows(self, as_of: int | None = None) -> DataFrame:
        return self.files(self.index(as_of).entries)

    def write(self, rows: DataFrame, watermark: int, files: int = 1) -> list[FileEntry]:
        """Stage collapsed rows in a folder of this attempt alone. Not yet visible. More files than one are disjoint ranges of keys."""
        verify_columns(rows)
        target = f"{self.root}/data/wm={watermark:020d}-{uuid.uuid4().hex}"
        rows = identified(rows)
        ordered = rows.repartition(1) if files == 1 else rows.repartitionByRange(files, "pk")
        writer = ordered.sortWithinPartitions("pk").write.option("parquet.block.row.count.limit", self.row_group_rows)
        if self.bloom_filters:
            writer = writer.option("parquet.bloom.filter.enabled#pk", "true").option("parquet.bloom.filter.expected.ndv#pk", self.row_group_rows).option("parquet.bloom.filter.fpp#pk", "0.01")
        writer.parquet(target)
        made = self._described(target, watermark)
        for entry in made:  # Spark has written them
            self.client.charge("put", entry.location)
        return made

    def _described(self, folder: str, watermark: int) -> list[FileEntry]:
        """Exact bounds and counts of each file, and a bloom filter of its keys; the driver gets a row per file and task."""
        rows = self.spark.read.schema(MUTATION).parquet(folder)
        file, length = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size")
        stats = rows.select("pk", file, length).groupBy("file", "file_size").agg(F.min("pk").alias("low"), F.max("pk").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        words: dict[str, list[bytes]] = {}
        if self.bloom_filters and stats:
            blocks = {r.file: blooms.blocks_for(r.n) for r in stats}
            for r in blooms.partial_blooms(rows.select(file, "pk"), blocks).collect():
                words.setdefault(r.file, []).append(bytes(r.words))
        return [FileEntry(r.file, watermark, bytes(r.low), bytes(r.high), r.file_size, r.n, blooms.merged(words[r.file]) if r.file in words else None) for r in stats]

    def commit(self, watermark: int, entries: list[FileEntry], after: int | None = None, replaced: list[FileEntry] | None = None) -> None:
        """The commit point: the manifest behind number ``after`` (the last there is, if None), exclusively. Of those that
        commit behind one number one succeeds. A publish at or below the published watermark is refused."""
        last, published = self.state()
        if replaced is None and watermark <= published:
            raise PublishConflict(f"{watermark} isn't above the published {published}")
        if after is not None and after != last:
            raise PublishConflict(f"manifest {after + 1} exists")
        told = {"watermark": max(watermark, published), "files": [e.as_json() for e in entries], "replaced": [e.location for e in replaced or []]}
        self.client.put(self._file("manifest", f"{last + 1:020d}.json"), json.dumps(told, sort_keys=True).encode(), exclusive=True)

    def compact(self, files: int = 1) -> FileIndex:
        """Merge all live files into ``files`` disjoint ones; tombstones go, as no older file is left for them to hide."""
        from ..operators.memtable import collapsed

        last, _ = self.state()
        old = self.index()
        if len(old) < 2:
            return old
        live = collapsed(self.files(old.entries)).where("op = 0").select(*MUTATION.names)
        self.commit(old.watermark, self.write(live, old.watermark, files), last, old.entries)
        return self.index()

    def orphans(self) -> list[str]:
        """Data folders that no manifest names: attempts that failed, or that still run."""
        named = {e["location"].rsplit("/", 2)[-2] for v in self.versions() for e in self._manifest(v)["files"]}
        return [f"{self.root}/data/{name}" for name, _ in self.client.list(self._file("data")) if name not in named]

    def vacuum(self, older_than_ms: int) -> int:
        """Delete orphans last modified before that time; how many went."""
        gone = [at for at in self.orphans() if self._fs().getFileStatus(self._path(*at.removeprefix(self.root + "/").split("/"))).getModificationTime() < older_than_ms]
        return sum(self.client.delete(self._file(*at.removeprefix(self.root + "/").split("/"))) for at in gone)
