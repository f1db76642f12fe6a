"""Tables kept in buckets of a key's hash, with one manifest per version.

A change rewrites only the buckets that its keys fall into and then adds a manifest, in one step that fails if
another writer was first. The manifest also holds the last batch number of every stream that
wrote: a batch that is sent again changes nothing. Readers take the newest manifest; a job that fails half-way leaves
files nobody refers to, which `vacuum` takes away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from vacanta.session import settle

BUCKETS = 64
_BUCKET = "vacanta_bucket"


class BucketTable:
    """A table below `root`, in `buckets` parts by the hash of `key` (fixed when the table is first written)."""

    def __init__(self, spark: SparkSession, root: str, key: list[str] | str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.key = [key] if isinstance(key, str) else list(key)
        self.buckets = buckets

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest: version, folder of every bucket that has rows, last batch of every stream, schema."""
        path, fs = self._fs(f"{self.root}/manifests")
        versions = sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []
        return self._manifest(versions[-1]) if versions else {"version": 0, "folders": {}, "ledger": {}, "schema": None, "buckets": self.buckets}

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/manifests/{version}").first()[0])

    def read(self, only: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None before the first write."""
        held = manifest or self.manifest()
        if held["schema"] is None:
            return None
        schema = StructType.fromJson(held["schema"])
        wanted = held["folders"] if only is None else {str(b): held["folders"][str(b)] for b in only if str(b) in held["folders"]}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{folder}/{_BUCKET}={b}" for b, folder in wanted.items()])

    def bucket(self, manifest: dict | None = None) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.key]), F.lit((manifest or self.manifest())["buckets"])).cast("int")

    def done(self, stream: str, number: int | None) -> bool:
        """Whether a batch of a stream is in the table already."""
        return number is not None and self.manifest()["ledger"].get(stream, -1) >= number

    def merge(self, rows: DataFrame, step: Callable[[DataFrame | None, DataFrame], DataFrame], stream: str = "batch", number: int | None = None) -> int:
        """Next version: `step(known, rows)` over the buckets that `rows` fall into, all others as they are.

        `known` holds the table's rows of those buckets (None before the first write), and what the step returns
        takes their place. Keys stay in their buckets. Returns the version, the old one if the batch was there or brings nothing.
        """
        held = self.manifest()
        if number is not None and held["ledger"].get(stream, -1) >= number:
            return held["version"]
        rows = settle(rows)
        # One number per bucket reaches the driver.
        touched = sorted(r[0] for r in rows.select(self.bucket(held)).distinct().collect())
        folders, schema = dict(held["folders"]), held["schema"]
        if touched:
            after = step(self.read(touched, held), rows)
            folder = f"parts/{uuid.uuid4().hex}"
            dealt = after.withColumn(_BUCKET, self.bucket(held)).repartition(min(len(touched), 1_000), _BUCKET)
            dealt.write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
            path, fs = self._fs(f"{self.root}/{folder}")
            filled = {s.getPath().getName().split("=")[1] for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{_BUCKET}=")}
            if not filled <= {str(b) for b in touched}:
                raise ValueError("a step must not change the keys of its rows")
            for b in map(str, touched):
                folders.pop(b, None)
                if b in filled:
                    folders[b] = folder
            schema = json.loads(after.schema.json())
        ledger = held["ledger"] | ({stream: number} if number is not None else {})
        if not touched and ledger == held["ledger"]:
            return held["version"]
        return self._commit({"version": held["version"] + 1, "folders": folders, "ledger": ledger, "schema": schema, "buckets": held["buckets"]})

    def _commit(self, manifest: dict) -> int:
        """Adds a manifest; fails if its version is there, so of two writers one has to start again."""
        path, fs = self._fs(f"{self.root}/manifests/{manifest['version']}")
        half, _ = self._fs(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(half, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(half, path):
            fs.delete(half, False)
            raise RuntimeError(f"version {manifest['version']} of {self.root} was written by another job")
        return manifest["version"]

    def vacuum(self, keep: int = 2) -> int:
        """Takes away what the newest `keep` manifests do not refer to; how many folders went."""
        path, fs = self._fs(f"{self.root}/manifests")
        versions = sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []
        used = {folder for v in versions[-keep:] for folder in self._manifest(v)["folders"].values()}
        for v in versions[:-keep]:
            fs.delete(self._fs(f"{self.root}/manifests/{v}")[0], False)
        parts, _ = self._fs(f"{self.root}/parts")
        gone = [s.getPath() for s in fs.listStatus(parts) if f"parts/{s.getPath().getName()}" not in used] if fs.exists(parts) else []
        for folder in gone:
            fs.delete(folder, True)
        return len(gone)
