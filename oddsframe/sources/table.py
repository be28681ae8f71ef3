"""Parquet tables that are replaced, added to or merged into while others read them.

Rows lie in folders that are written once. A version of a table is a manifest, a small file that names the folders it consists of; it appears by one rename that
never overwrites. So a reader has the version it found, whole, whatever writers do or however they die, and of two writers that started from the same version one
is told and tries again. Folders that no manifest names are never read; `vacuum` removes them. The renames need a file system with atomic ones, such as HDFS.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from datetime import timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts that the rows of a keyed table are dealt to, by a hash of the key.
BUCKETS = 32
#: Folders' names: those of what is written at once, and the end of those of its buckets.
_BATCH, _BUCKET = "__batch", "__bucket"
#: In a manifest, the bucket of folders that aren't dealt to buckets.
_LOOSE = ""


class Table:
    """A table at a path. With a key, rows lie in buckets by its hash, sorted by it; a merge rewrites only buckets that new rows fall into, and what is added is written beside the
    rest. So a write makes as many files as there are buckets and tasks to fill them, however many keys there are. schema: what is read, else that of the first rows."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, buckets: int = BUCKETS, schema: str | None = None):
        self.spark, self.path, self.key, self.buckets, self.schema = spark, path.rstrip("/"), key, buckets if key else 0, schema
        self.column = f"{key}{_BUCKET}"
        self.jpath = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def _manifests(self) -> list[tuple[int, object]]:
        """(version, status) of all versions, the newest last."""
        found = self.fs.globStatus(self.jpath(f"{self.path}/_manifests/*.json")) or []
        return sorted(((int(x.getPath().getName().removesuffix(".json")), x) for x in found), key=lambda v: v[0])

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return max((v for v, _ in self._manifests()), default=0)

    def manifest(self, version: int) -> dict:
        """{schema, buckets, lists of folders by bucket} of a version. A plain folder of Parquet files counts as version 0."""
        if version == 0:
            plain = any(not x.getPath().getName().startswith(("_", ".")) for x in self.fs.globStatus(self.jpath(f"{self.path}/*")) or [])
            return {"schema": None, "buckets": 0, "folders": {_LOOSE: [""]} if plain else {}}
        stream = self.fs.open(self._manifest_path(version))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        folders = {b: [f] if isinstance(f, str) else f for b, f in found["folders"].items()}  # a bucket had one folder once
        return found | {"folders": folders if found["buckets"] else {_LOOSE: [f for fs in folders.values() for f in fs]} if folders else {}}

    def _manifest_path(self, version: int):
        return self.jpath(f"{self.path}/_manifests/{version:012d}.json")

    def exists(self) -> bool:
        return self.version() > 0 or bool(self.manifest(0)["folders"])

    def _commit(self, version: int, manifest: dict) -> bool:
        """Make a manifest the version's; False if another writer was first."""
        jvm = self.spark._jvm
        beside = self.jpath(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(beside, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, self._manifest_path(version), no_options)
        except Py4JJavaError as e:
            self.fs.delete(beside, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # rows

    def read(self, version: int | None = None, keys: Iterable[str] | DataFrame | None = None) -> DataFrame:
        """The rows of a version, the newest by default, as they were when this was called. keys: only the rows of these, from their buckets alone."""
        version = self.version() if version is None else version
        return self._rows(self.manifest(version), keys=keys)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _chosen(self, df: DataFrame, keys: Iterable[str] | DataFrame | None, dealt: bool) -> DataFrame:
        """The rows of the keys. Folders are told by their bucket where rows are dealt to as many buckets as this table's."""
        if keys is None:
            return df
        kind = df.schema[self.key].dataType
        if isinstance(keys, DataFrame):
            keys = keys.select(F.col(self.key).cast(kind)).distinct()
            return df.join(keys.withColumn(self.column, self._bucket(F.col(self.key))) if dealt else keys, [self.key, self.column] if dealt else self.key, "left_semi")
        keys = list(keys)
        found = df.where(F.col(self.key).isin(keys))
        return found.where(F.col(self.column).isin([self._bucket(F.lit(k).cast(kind)) for k in keys])) if dealt else found

    def _rows(self, manifest: dict, folders: list[str] | None = None, keys: Iterable[str] | DataFrame | None = None) -> DataFrame:
        folders = [f for fs in manifest["folders"].values() for f in fs] if folders is None else folders
        schema = self.schema or manifest["schema"] and StructType.fromJson(manifest["schema"])
        if not folders:
            if schema is None:
                raise FileNotFoundError(f"no table at {self.path}")
            return self.spark.createDataFrame([], schema)
        reader = lambda: self.spark.read.schema(schema) if schema else self.spark.read
        paths = lambda fs: [f"{self.path}/{f}" if f else self.path for f in fs]
        batches = [f for f in folders if f.startswith(f"_data/{_BATCH}=")]
        others = [f for f in folders if f not in set(batches)]
        parts = []
        if batches:
            df = reader().option("basePath", f"{self.path}/_data").parquet(*paths(batches))
            parts.append(self._chosen(df, keys, manifest["buckets"] == self.buckets).drop(_BATCH, self.column))
        if others:
            parts.append(self._chosen(reader().parquet(*paths(others)), keys, False))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _write(self, df: DataFrame) -> dict[str, list[str]]:
        """Write rows to a folder of their own; the folders by bucket. Small buckets share a task, large ones are dealt to several."""
        if not self.key:
            folder = f"_data/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            return {_LOOSE: [folder]}
        folder = f"_data/{_BATCH}={uuid.uuid4().hex}"
        dealt = df.withColumn(self.column, self._bucket(F.col(self.key))).hint("rebalance", F.col(self.column))
        dealt.sortWithinPartitions(self.column, self.key).write.partitionBy(self.column).parquet(f"{self.path}/{folder}")
        names = [x.getPath().getName() for x in self.fs.globStatus(self.jpath(f"{self.path}/{folder}/{self.column}=*")) or []]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in names}

    def _forget(self, folders: dict[str, list[str]]) -> None:
        for folder in {"/".join(f.split("/")[:2]) for fs in folders.values() for f in fs}:
            self.fs.delete(self.jpath(f"{self.path}/{folder}"), True)

    def replace(self, df: DataFrame) -> None:
        """Make the table's rows those of df; of several writers the last to finish stays. Readers of the version before keep it."""
        manifest = {"schema": df.schema.jsonValue(), "buckets": self.buckets, "folders": self._write(df)}
        while not self._commit(self.version() + 1, manifest):
            pass

    def add(self, new: DataFrame, replace: bool = False, attempts: int = 10) -> None:
        """Store new rows beside the others; new is run once. replace: the rows that their keys had before go, in the same step, and only buckets that hold such
        rows are written anew. A writer that finds another one's version adds to that."""
        if not self.key:
            raise ValueError("a table without a key can't be added to")
        staged, schema, done = self._write(new), new.schema.jsonValue(), False
        try:
            for _ in range(attempts):
                at = self.version()
                was = self.manifest(at)
                alike, again = was["buckets"] in (0, self.buckets), replace and bool(staged)
                stale = was["folders"] if not alike else self._holding(was, staged) if again else {}
                kept = {}
                if stale:
                    old = self._rows(was, [f for fs in stale.values() for f in fs])
                    kept = self._write(old.join(self._keys(staged), self._same(), "left_anti") if again else old)
                folders = {b: fs for b, fs in was["folders"].items() if b not in stale}
                for b, fs in [*kept.items(), *staged.items()]:
                    folders = folders | {b: [*folders.get(b, []), *fs]}
                done = self._commit(at + 1, {"schema": was["schema"] or schema, "buckets": self.buckets, "folders": folders})
                if done:
                    return
                self._forget(kept)
            raise OSError(f"other writers were first {attempts} times at {self.path}")
        finally:
            if not done:
                self._forget(staged)

    def _keys(self, folders: dict[str, list[str]]) -> DataFrame:
        """(__key) of the rows in folders, each once."""
        return self.spark.read.parquet(*[f"{self.path}/{f}" for fs in folders.values() for f in fs]).select(F.col(f"`{self.key}`").alias("__key")).distinct()

    def _same(self) -> Column:
        return F.col(f"`{self.key}`").eqNullSafe(F.col("__key"))

    def _holding(self, was: dict, staged: dict[str, list[str]]) -> dict[str, list[str]]:
        """The buckets of a version that hold rows of staged keys, with their folders. Of old rows only keys are read, and only in buckets that new ones fall into."""
        keys = self._keys(staged)
        held = lambda fs: self._rows(was, fs).select(f"`{self.key}`").join(keys, self._same(), "left_semi")
        dealt = {b: fs for b, fs in was["folders"].items() if b in staged}
        found = {str(r[0]) for r in held([f for fs in dealt.values() for f in fs]).select(self._bucket(F.col(f"`{self.key}`"))).distinct().collect()} if dealt else set()  # numbers of buckets
        loose = was["folders"].get(_LOOSE)
        return {b: fs for b, fs in dealt.items() if b in found} | ({_LOOSE: loose} if loose and held(loose).limit(1).count() else {})

    def merge(self, new: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame], attempts: int = 10) -> None:
        """Merge new rows in: combine makes one row a key of old rows (None: there are none) and new ones. Only buckets that new rows fall into are read and
        written. new is run once. A column keeps its first type; one that is new is null in old rows. A writer that finds another one's version merges into that."""
        if not self.key:
            raise ValueError("a table without a key can't be merged into")
        fresh = combine(None, new)
        schema, staged, ours = fresh.schema, self._write(fresh), False
        try:
            for _ in range(attempts):
                if not self.exists():  # the first rows are the table
                    ours = self._commit(1, {"schema": schema.jsonValue(), "buckets": self.buckets, "folders": staged})
                if ours or self._merge_into(self.version(), schema, staged, combine):
                    return
            raise OSError(f"other writers were first {attempts} times at {self.path}")
        finally:
            if not ours:
                self._forget(staged)

    def _merge_into(self, at: int, schema: StructType, staged: dict[str, str], combine: Callable) -> bool:
        was = self.manifest(at)
        alike = was["buckets"] == self.buckets
        stale = {b: f for b, f in was["folders"].items() if b in staged or b == _LOOSE or not alike}
        rows = self._rows({"schema": schema.jsonValue(), "buckets": self.buckets}, [f for fs in staged.values() for f in fs])
        old = self._rows(was, [f for fs in stale.values() for f in fs]) if stale else None
        known = StructType.fromJson(was["schema"]) if was["schema"] else old.schema if old else StructType()
        types = {f.name: f.dataType for f in known}
        rows = rows.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in rows.columns])
        merged = combine(old, rows)
        added = [f for f in merged.schema if f.name not in types]
        written = self._write(merged) if staged or not alike else {}
        folders = {b: f for b, f in was["folders"].items() if b not in stale} | written
        if self._commit(at + 1, {"schema": StructType([*known, *added]).jsonValue(), "buckets": self.buckets, "folders": folders}):
            return True
        self._forget(written)
        return False

    def vacuum(self, keep: timedelta = timedelta(days=7)) -> int:
        """Remove versions that were replaced longer than `keep` ago, and folders as old that no other version names, such as those of writers that died; how many
        folders went. No reader or writer may take longer than `keep`."""
        since = self.spark._jvm.System.currentTimeMillis() - int(keep.total_seconds() * 1000)
        versions = self._manifests()
        ends = [x.getModificationTime() for _, x in versions[1:]]
        gone = [v for (v, _), end in zip(versions, ends, strict=False) if end < since]
        named = {f for v, _ in versions if v not in gone for fs in self.manifest(v)["folders"].values() for f in fs}
        whole = {"/".join(f.split("/")[:2]) for f in named}
        for v in gone:
            self.fs.delete(self._manifest_path(v), False)
        n = 0
        for x in [*(self.fs.globStatus(self.jpath(f"{self.path}/_data/*")) or []), *(self.fs.globStatus(self.jpath(f"{self.path}/_data/*/*{_BUCKET}=*")) or [])]:
            folder = x.getPath().toString().partition("/_data/")[2]
            if x.getModificationTime() < since and f"_data/{folder}" not in (named if "/" in folder else whole | named):
                n += self.fs.delete(x.getPath(), True)
        return n
