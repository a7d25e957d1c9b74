"""A store as versioned snapshots: tables of a base and layers of changes, and one manifest for each version.

A commit writes new folders only: a base for a table that was replaced, a layer for rows that were put or
dropped, and nothing for a table that stayed as it was. Then it puts the next version's manifest in
place by a rename that fails if that version is there, so readers see a whole version or the one
before, a crash at any moment leaves the last version as it was, and of two writers one is refused.
No file is ever written again. Layers are merged once there are many of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.model import SCHEMAS, StoreError

KEYS = {"memories": ["id"], "events": ["id"], "levels": ["id"], "memory_links": ["from_id", "to_id"], "event_links": ["from_id", "to_id"], "tombstones": ["seq"]}
MAX_LAYERS = 8
BASE_SHARE = 0.25  # layers that come to this share of their base become part of it
SMALL_BYTES = 1 << 20  # a table of no more is written whole, which costs less than reading it in layers
BROADCAST_BYTES = 32 << 20


def layered(base: DataFrame, layers: list[tuple[str, DataFrame]], keys: list[str], few: bool = False) -> DataFrame:
    """base after layers of ("put", rows) and ("drop", keys), the last word on a key counting.

    few: the layers' counted size allows a broadcast.
    """
    if not layers:
        return base
    columns = [c for c in base.columns if c not in keys]
    parts = []
    for i, (kind, rows) in enumerate(layers):
        held = F.struct(*columns) if kind == "put" else F.lit(None).cast(base.select(F.struct(*columns).alias("r")).schema[0].dataType)
        parts.append(rows.select(*keys, held.alias("r"), F.lit(i).alias("layer")))
    told = parts[0]
    for part in parts[1:]:
        told = told.unionAll(part)
    if len(parts) > 1:
        last = told.groupBy(*keys).agg(F.max_by(F.struct("r"), "layer").alias("last"))
        told = last.select(*keys, F.col("last.r").alias("r"))
    named = told.select(*keys)
    kept = base.join(F.broadcast(named) if few else named, keys, "left_anti")
    fresh = told.where(F.col("r").isNotNull()).select(*keys, *(F.col(f"r.{c}").alias(c) for c in columns))
    return kept.select(*base.columns).unionAll(fresh.select(*base.columns))


class Tables(dict):
    """Tables by name, each made when it is first asked for, since most calls touch one or two."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]], made: dict[str, DataFrame] | None = None):
        super().__init__(made or {})
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.makers[name]()
        return self[name]

    def __contains__(self, name: object) -> bool:
        return name in self.makers or super().__contains__(name)

    def having(self, **tables: DataFrame) -> Tables:
        return Tables(self.makers, {**dict(self.items()), **tables})


@dataclass
class Snapshot:
    """The tables of one version, and what has been done to them since it was read."""

    tables: Tables
    version: int = 0
    read_only: bool = False
    layers: dict[str, list[tuple[str, DataFrame]]] = field(default_factory=dict)
    replaced: frozenset[str] = frozenset()

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    def replace(self, **tables: DataFrame) -> Snapshot:
        """With whole tables in place of those that are there."""
        layers = {k: v for k, v in self.layers.items() if k not in tables}
        return Snapshot(self.tables.having(**tables), self.version, self.read_only, layers, self.replaced | set(tables))

    def _with(self, name: str, kind: str, rows: DataFrame) -> Snapshot:
        table = layered(self.tables[name], [(kind, rows)], KEYS[name])
        layers = {**self.layers, name: [*self.layers.get(name, []), (kind, rows)]}
        return Snapshot(self.tables.having(**{name: table}), self.version, self.read_only, layers, self.replaced)

    def put(self, name: str, rows: DataFrame) -> Snapshot:
        """With rows, in place of those with the same keys. A key comes once."""
        return self._with(name, "put", rows.select(*self.tables[name].columns))

    def drop(self, name: str, keys: DataFrame) -> Snapshot:
        """Without the rows of these keys."""
        return self._with(name, "drop", keys.select(*KEYS[name]))


def empty(spark: SparkSession) -> Snapshot:
    return Snapshot(Tables({name: partial(spark.createDataFrame, [], schema) for name, schema in SCHEMAS.items()}), replaced=frozenset(SCHEMAS))


@dataclass
class Store:
    """Snapshots under a path of any file system that Spark reads."""

    spark: SparkSession
    path: str
    read_only: bool = False

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, folder: str) -> str:
        """A manifest names folders of its own store by their place in it, and those of the store it was forked from in full."""
        return folder if folder.startswith("/") or ":" in folder else f"{self.path}/{folder}"

    def fork(self, path: str) -> Store:
        """A store of its own that begins with this one's tables, none of them copied; this one mustn't be vacuumed while it lives."""
        other = Store(self.spark, path)
        at = lambda f: f and self._at(f)
        held = self.manifest(self.version())
        other._publish(1, {name: {"base": at(x["base"]), "layers": [[k, at(f)] for k, f in x["layers"]]} for name, x in held.items()})
        return other

    def _bytes(self, folder: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(folder))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength()

    def version(self) -> int:
        """The highest version that has a manifest."""
        path, fs = self._file("versions")
        if not fs.exists(path):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int) -> dict[str, dict]:
        """Each table's base folder and layers [kind, folder], oldest first."""
        if not version:
            return {name: {"base": None, "layers": []} for name in SCHEMAS}
        path, fs = self._file(f"versions/{version}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _table(self, name: str, held: dict) -> DataFrame:
        read = lambda folder, schema: self.spark.read.schema(schema).parquet(self._at(folder))
        base = read(held["base"], SCHEMAS[name]) if held["base"] else self.spark.createDataFrame([], SCHEMAS[name])
        kinds = dict(c.split() for c in SCHEMAS[name].split(", "))
        keys = ", ".join(f"{k} {kinds[k]}" for k in KEYS[name])
        layers = [(kind, read(folder, SCHEMAS[name] if kind == "put" else keys)) for kind, folder in held["layers"]]
        few = bool(layers) and sum(self._bytes(folder) for _, folder in held["layers"]) <= BROADCAST_BYTES
        return layered(base, layers, KEYS[name], few)

    def read(self, version: int | None = None) -> Snapshot:
        """A version's tables; columns that an older version lacks are null."""
        version = self.version() if version is None else version
        if not version:
            return Snapshot(empty(self.spark).tables, 0, self.read_only)
        return self._snapshot(self.manifest(version), version)

    def _snapshot(self, held: dict[str, dict], version: int) -> Snapshot:
        return Snapshot(Tables({name: partial(self._table, name, held.get(name, {"base": None, "layers": []})) for name in SCHEMAS}), version, self.read_only)

    def commit(self, snapshot: Snapshot) -> Snapshot:
        """Write what changed as the next version."""
        if self.read_only or snapshot.read_only:
            raise StoreError("the store is open for reading only")
        current = self.version()
        if snapshot.version != current:
            raise StoreError(f"version {current} has been committed since version {snapshot.version} was read")
        folder = f"data/{uuid.uuid4().hex}"
        held = self.manifest(current)
        for name in SCHEMAS:
            held[name] = self._written(name, held.get(name, {"base": None, "layers": []}), snapshot, f"{folder}/{name}")
        self._publish(current + 1, held)
        return self._snapshot(held, current + 1)

    def _written(self, name: str, held: dict, snapshot: Snapshot, folder: str) -> dict:
        done = snapshot.layers.get(name, [])
        if name in snapshot.replaced or done and sum(self._bytes(f) for f in (held["base"], *(x for _, x in held["layers"])) if f) <= SMALL_BYTES:
            snapshot.tables[name].write.parquet(f"{self.path}/{folder}/base")
            return {"base": f"{folder}/base", "layers": []}
        layers = list(held["layers"])
        for i, (kind, rows) in enumerate(done):
            rows.write.parquet(f"{self.path}/{folder}/{i}")
            layers.append([kind, f"{folder}/{i}"])
        held = {"base": held["base"], "layers": layers}
        return self._compacted(name, held, folder) if len(layers) > MAX_LAYERS else held

    def _compacted(self, name: str, held: dict, folder: str) -> dict:
        """Layers merged into two, or with their base where they come to a good share of it."""
        size = sum(self._bytes(f) for _, f in held["layers"])
        if not held["base"] or size >= BASE_SHARE * self._bytes(held["base"]):
            self._table(name, held).write.parquet(f"{self.path}/{folder}/merged")
            return {"base": f"{folder}/merged", "layers": []}
        puts = self._table(name, {"base": None, "layers": held["layers"]})
        puts.write.parquet(f"{self.path}/{folder}/puts")
        named = None
        for _, f in held["layers"]:
            rows = self.spark.read.parquet(self._at(f)).select(*KEYS[name])
            named = rows if named is None else named.unionAll(rows)
        kept = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{folder}/puts")
        named.distinct().join(kept.select(*KEYS[name]), KEYS[name], "left_anti").write.parquet(f"{self.path}/{folder}/drops")
        return {"base": held["base"], "layers": [["put", f"{folder}/puts"], ["drop", f"{folder}/drops"]]}

    def _publish(self, version: int, held: dict) -> None:
        """Put a version's manifest in place, whole, unless the version is there."""
        fresh, fs = self._file(f"versions/.{version}-{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        final, _ = self._file(f"versions/{version}.json")
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        no_options = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), hadoop).rename(fresh, final, no_options)
        except Exception as e:
            if not fs.exists(final):
                raise
            raise StoreError(f"another writer has committed version {version}") from e

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests and folders that the last ``keep`` versions don't name; returns how many folders went. No writer may run."""
        current = self.version()
        named = {f.split("/")[1] for v in range(max(1, current - keep + 1), current + 1) for held in self.manifest(v).values() for f in (held["base"], *(x for _, x in held["layers"])) if f and self._at(f) != f}
        path, fs = self._file("data")
        gone = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName() not in named] if fs.exists(path) else []
        for folder in gone:
            fs.delete(folder, True)
        path, _ = self._file("versions")
        for f in fs.listStatus(path) if fs.exists(path) else []:
            stem = f.getPath().getName().removesuffix(".json")
            if not stem.isdigit() or int(stem) <= current - keep:
                fs.delete(f.getPath(), False)
        return len(gone)

    def purge(self) -> Snapshot:
        """A new version without rows."""
        return self.commit(Snapshot(empty(self.spark).tables, self.version(), replaced=frozenset(SCHEMAS)))


def from_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a server database, for import."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
