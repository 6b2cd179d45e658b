"""A store of tables with versions: a commit changes several tables at once or none, and readers keep the version they began with."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table that is replaced by key.
BUCKETS = 32
_BUCKET = "_bucket"


class ConcurrentCommitError(RuntimeError):
    """Another commit was published since this one began; nothing of this one is visible."""


class Store:
    """Tables under one folder. Data files never change; a manifest (JSON) names those of every table.

    ``_manifests/<version>.json`` is written under another name and then renamed, which fails if the version is there:
    so a commit is visible as a whole or not at all, and of two commits on one version one is refused. All access is
    through Hadoop's file system, so the folder may be in any store that Spark reads.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _context(self):
        return self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        place = self._path(f"{self.root}/_manifests")
        names = [f.getPath().getName() for f in self._fs().listStatus(place)] if self._fs().exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The latest version, 0 before the first commit."""
        return max(self._versions(), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {}
        stream = self._fs().open(self._path(f"{self.root}/_manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def at(self, version: int | None = None) -> Snapshot:
        """What ``version`` (the latest) holds, whatever is committed meanwhile."""
        number = self.version() if version is None else version
        return Snapshot(self, number, self._manifest(number))

    def begin(self) -> Commit:
        return Commit(self, self.at())

    def _publish(self, version: int, manifest: dict) -> None:
        fs, target = self._fs(), self._path(f"{self.root}/_manifests/{version:012d}.json")
        draft = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
            stream.hsync()
        finally:
            stream.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context().rename(draft, target, none)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConcurrentCommitError(f"version {version} was published meanwhile") from None
            raise

    def vacuum(self, keep: int = 5) -> int:
        """Delete manifests but for the last ``keep`` and data that those do not name; (folders deleted). Readers of older versions,
        and commits under way, must be over."""
        versions, fs = self._versions(), self._fs()
        held = {p for v in versions[-keep:] for t in self._manifest(v).values() for p in t["parts"].values()}
        for v in versions[:-keep]:
            fs.delete(self._path(f"{self.root}/_manifests/{v:012d}.json"), False)
        gone = 0
        for table in fs.listStatus(self._path(self.root)):
            if table.getPath().getName() == "_manifests":
                continue
            for write in fs.listStatus(table.getPath()):
                relative = f"{table.getPath().getName()}/{write.getPath().getName()}"
                if not any(p == relative or p.startswith(relative + "/") for p in held):
                    fs.delete(write.getPath(), True)
                    gone += 1
        return gone


class Snapshot:
    """A pinned version."""

    def __init__(self, store: Store, version: int, manifest: dict) -> None:
        self.store, self.version, self.manifest = store, version, manifest

    def tables(self) -> list[str]:
        return sorted(self.manifest)

    def files(self, table: str) -> dict[str, str]:
        """Folders of a table by bucket, relative to the store."""
        return dict(self.manifest[table]["parts"])

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or those of its buckets alone."""
        if table not in self.manifest:
            raise AnalysisException(f"version {self.version} has no table {table}")
        spark, entry = self.store.spark, self.manifest[table]
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.store.root}/{p}" for b, p in sorted(entry["parts"].items()) if buckets is None or int(b) in buckets]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def bucket(self, table: str) -> Column:
        """The bucket of a row of a keyed table."""
        entry = self.manifest[table]
        return F.pmod(F.xxhash64(*entry["keys"]), F.lit(entry["buckets"])).cast("int")

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """Buckets of the rows that ``keys`` (the table's key columns) names: at most as many numbers as buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(table)).distinct().collect())


class Commit:
    """Changes of several tables that are published together when the block ends well; used as ``with store.begin() as c``."""

    def __init__(self, store: Store, base: Snapshot) -> None:
        self.store, self.base, self.manifest, self.version = store, base, dict(base.manifest), None

    def __enter__(self) -> Commit:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.store._publish(self.base.version + 1, self.manifest)
            self.version = self.base.version + 1

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table as this commit has it so far."""
        return Snapshot(self.store, self.base.version, self.manifest).read(table, buckets)

    def write(self, table: str, rows: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS) -> None:
        """Replace a table; with ``keys`` it is dealt into buckets, which replace() can change one by one."""
        place, schema = f"{table}/{uuid.uuid4().hex}", json.loads(rows.schema.json())
        if keys is None:
            rows.write.parquet(f"{self.store.root}/{place}")
            self.manifest[table] = {"schema": schema, "parts": {"0": place}, "keys": None, "buckets": 1}
            return
        entry = {"schema": schema, "parts": {}, "keys": keys, "buckets": buckets}
        self.manifest[table] = entry | {"parts": self._deal(table, entry, rows, place)}

    def replace(self, table: str, rows: DataFrame, buckets: list[int]) -> None:
        """Put ``rows`` in the place of all rows of ``buckets``; the files of other buckets stay as they are."""
        entry = self.manifest[table]
        kept = {b: p for b, p in entry["parts"].items() if int(b) not in buckets}
        rows = rows.select(*StructType.fromJson(entry["schema"]).names)
        self.manifest[table] = entry | {"parts": kept | self._deal(table, entry, rows, f"{table}/{uuid.uuid4().hex}", buckets)}

    def _deal(self, table: str, entry: dict, rows: DataFrame, place: str, only: list[int] | None = None) -> dict[str, str]:
        bucket = F.pmod(F.xxhash64(*entry["keys"]), F.lit(entry["buckets"])).cast("int")
        rows.withColumn(_BUCKET, bucket).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.store.root}/{place}")
        fs = self.store._fs()
        names = [f.getPath().getName() for f in fs.listStatus(self.store._path(f"{self.store.root}/{place}"))]
        found = [int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}=")]
        if only is not None and set(found) - set(only):
            raise ValueError(f"rows for buckets of {table} that are not replaced: {sorted(set(found) - set(only))}")
        return {str(b): f"{place}/{_BUCKET}={b}" for b in found}

    def upsert(self, table: str, rows: DataFrame, update: bool = True) -> None:
        """New rows by the table's key: they win over old ones, or lose without ``update``. Repeated keys in ``rows`` are an error.
        Only the buckets that the keys fall into are read and written."""
        entry = self.manifest[table]
        if not rows.groupBy(*entry["keys"]).count().where("count > 1").isEmpty():
            raise ValueError(f"repeated keys {entry['keys']} in rows for {table}")
        here = Snapshot(self.store, self.base.version, self.manifest)
        buckets = here.touched(table, rows)
        old = here.read(table, buckets)
        first, second = (rows, old) if update else (old, rows)
        self.replace(table, first.unionByName(second.join(first.select(*entry["keys"]), entry["keys"], "left_anti"), allowMissingColumns=True), buckets)
