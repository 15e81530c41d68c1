"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Shards of similar size (a tier:
sizes within a factor of `fan_in`) are merged into files of about the target size, by tasks
that each stream the shards of one merge; nothing is shuffled. What a table holds is said by
its newest manifest, a versioned file that is created by a rename which fails if that version
exists already, so a reader sees all of a commit or none of it, and of two writers one has to
try again. Shards of at least half the target size, which are not merged again, go into pages of
PAGE entries, immutable files that manifests name, so that neither a commit nor a plan grows with
them. Shards that no manifest names (left by a lost or repeated task) are never read.

Defined results: all rows and columns are kept as they are, repeated rows, nulls and empty or
very long texts included; a row larger than a shard's size has a shard of its own. An empty
arrival commits a version without new shards; reading a table without rows gives its schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_arrow, scratch_path, slices

#: Uncompressed bytes of an arrival's shard, and bytes on disk of a compacted file.
SHARD_BYTES = 16 << 20
TARGET_BYTES = 64 << 20
FAN_IN = 4
SMALLEST = 64 << 10
#: Seconds for which shards that no manifest names may still be in use.
GRACE = 86_400.0
#: Finished shards of a page.
PAGE = 10_000
_ENTRY = "name string, rows long, bytes long"


@dataclass
class Manifest:
    version: int = 0
    schema: str = ""
    shards: list[dict] = field(default_factory=list)  # name, rows, bytes of those in no page, in arrival order
    pages: list[str] = field(default_factory=list)


class Conflict(Exception):
    """Another writer committed this version first."""


def plan_merges(shards: list[dict], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[dict]]:
    """Groups of shards to merge: of one tier, at least fan_in of them or enough for a target file.

    Files of at least half the target size are left alone.
    """
    tiers: dict[int, list[dict]] = {}
    for s in shards:
        if s["bytes"] < target / 2:
            tiers.setdefault(int(math.log(max(s["bytes"], SMALLEST) / SMALLEST, fan_in)), []).append(s)
    merges = []
    for tier in sorted(tiers):
        now, size = [], 0
        for s in tiers[tier]:
            if now and size + s["bytes"] > target:
                merges.append(now)
                now, size = [], 0
            now.append(s)
            size += s["bytes"]
        if len(now) >= fan_in:
            merges.append(now)
    return [m for m in merges if len(m) > 1]


class ShardTable:
    """A table of immutable shards below folder, described by versioned manifests."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        for d in ("manifests", "shards"):
            self._fs.mkdirs(self._path(d))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
            version = max((int(n[1:21]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)
        if version == 0:
            return Manifest()
        return Manifest(**json.loads(self._text(f"manifests/v{version:020d}.json")))

    def commit(self, new: Manifest) -> Manifest:
        """Makes new the next version, or raises Conflict if that exists already."""
        temp = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(temp, self._path(f"manifests/v{new.version:020d}.json"), options)
        except Exception as e:
            self._fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(str(new.version)) from e
            raise
        return new

    def _paged(self, new: Manifest, target: int) -> Manifest:
        """new with its finished shards moved to pages, as far as they fill them."""
        done = [s for s in new.shards if s["bytes"] >= target / 2]
        pages = list(new.pages)
        for at in range(0, len(done) // PAGE * PAGE, PAGE):
            pages.append(f"p{uuid.uuid4().hex}.json")
            out = self._fs.create(self._path(f"manifests/{pages[-1]}"), False)
            out.write(bytearray(json.dumps(done[at : at + PAGE]).encode()))
            out.close()
        gone = {s["name"] for s in done[: len(done) // PAGE * PAGE]}
        return Manifest(new.version, new.schema, [s for s in new.shards if s["name"] not in gone], pages)

    def shards(self, now: Manifest) -> Iterator[dict]:
        """All shards of a version, page by page."""
        for p in now.pages:
            yield from json.loads(self._text(f"manifests/{p}"))
        yield from now.shards

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def append(self, arrivals: DataFrame, shard_bytes: int = SHARD_BYTES, tries: int = 10) -> Manifest:
        """Writes arrivals as small shards and commits them."""
        folder, wanted = f"{self.folder}/shards", arrow_schema(_ENTRY)

        def write(batches):
            import pyarrow.parquet as pq
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(folder)
            held, size, made = [], 0, []

            def flush():
                name = f"{uuid.uuid4().hex}.parquet"
                table = pa.Table.from_batches(held, schema=held[0].schema)
                with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                    pq.write_table(table, out, compression="zstd")
                made.append((name, table.num_rows, store.get_file_info(f"{path}/{name}").size))

            for b in slices(batches, 64):
                held.append(b)
                size += b.nbytes
                if size >= shard_bytes:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), wanted, strict=True)], schema=wanted)

        new = [r.asDict() for r in map_arrow(arrivals, write, _ENTRY).collect()]  # one row a shard: metadata
        for _ in range(tries):
            now = self.manifest()
            if now.version and now.schema != arrivals.schema.json():
                raise ValueError("arrivals have another schema than the table")
            try:
                return self.commit(Manifest(now.version + 1, arrivals.schema.json(), now.shards + new, now.pages))
            except Conflict:
                continue
        raise Conflict("too many writers")

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> Manifest:
        """Merges tiers until none can be merged; each round is one job and one commit."""
        while True:
            now = self.manifest()
            merges = plan_merges(now.shards, target, fan_in)
            if not merges:
                paged = self._paged(Manifest(now.version + 1, now.schema, now.shards, now.pages), target)
                if paged.pages == now.pages:
                    return now
                try:
                    return self.commit(paged)
                except Conflict:
                    continue
            made = self._merge([[s["name"] for s in m] for m in merges])
            for _ in range(10):
                gone = {s["name"]: k for k, m in enumerate(merges) for s in m}
                if not gone.keys() <= {s["name"] for s in now.shards}:
                    break  # another compaction took some of them: plan anew
                shards, placed = [], set()
                for s in now.shards:
                    k = gone.get(s["name"])
                    if k is None:
                        shards.append(s)
                    elif k not in placed:
                        placed.add(k)
                        shards.append(made[k])
                try:
                    self.commit(self._paged(Manifest(now.version + 1, now.schema, shards, now.pages), target))
                    break
                except Conflict:
                    now = self.manifest()

    def _merge(self, groups: list[list[str]]) -> dict[int, dict]:
        folder, ddl = f"{self.folder}/shards", "k int, " + _ENTRY
        wanted, shared = arrow_schema(ddl), self.spark.sparkContext.broadcast(groups)  # names of shards only

        def merge(batches):
            import pyarrow.parquet as pq
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(folder)
            for b in batches:
                for k in b.column(0).to_pylist():
                    name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
                    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                        for shard in shared.value[k]:
                            with store.open_input_file(f"{path}/{shard}") as f:
                                source = pq.ParquetFile(f)
                                writer = writer or pq.ParquetWriter(out, source.schema_arrow, compression="zstd")
                                for g in range(source.num_row_groups):
                                    part = source.read_row_group(g)
                                    rows += part.num_rows
                                    writer.write_table(part)
                        writer.close()
                    made = [[k], [name], [rows], [store.get_file_info(f"{path}/{name}").size]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, wanted, strict=True)], schema=wanted)

        tasks = self.spark.range(0, len(groups), 1, len(groups))
        return {r.k: {"name": r.name, "rows": r.rows, "bytes": r.bytes} for r in map_arrow(tasks, merge, ddl).collect()}

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        if not now.version:
            raise ValueError("the table has no version yet")
        schema = T.StructType.fromJson(json.loads(now.schema))
        names = [f"{self.folder}/shards/{s['name']}" for s in self.shards(now)]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def vacuum(self, grace: float = GRACE) -> int:
        """Deletes shards that the newest manifest doesn't name and that are older than `grace` seconds.

        Writers commit shards after writing them, and readers may read older versions: grace must be
        longer than any of them takes. It is 0 only where there is no other user of the table.
        """
        before = time.time() * 1000 - grace * 1000
        # Listed first: what is committed after that isn't in the list.
        listed = [(s.getPath(), s.getModificationTime()) for s in self._fs.listStatus(self._path("shards"))]
        named, n = {s["name"] for s in self.shards(self.manifest())}, 0
        for at, written in listed:
            if written <= before and at.getName() not in named:
                self._fs.delete(at, False)
                n += 1
        return n


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, read back through the manifest after arrival in shards and compaction."""
    table = ShardTable(spark, scratch_path(spark, "shards"))
    table.append(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    table.compact()
    table.vacuum(grace=0)  # nobody else knows the table
    return table.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {"op4_sharding": op4_sharding}
ORACLES = {"op4_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"}
