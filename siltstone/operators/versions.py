"""A table of rows by key that changes: versions are added, readers merge them, and compaction rewrites what was touched.

    store/_version=7/_bucket=3/*.parquet    rows written by version 7 whose key falls into bucket 3
    store/_log/7.json                       version 7 counts; without this file nothing of it does

A version holds new rows and marks of keys that are gone. A reader takes each key's latest row, and only merges buckets that several
versions have touched. A writer that dies leaves no log entry; the next one takes the same number and writes over what it left.
Compaction is a version that stands for all before it in its buckets. One writer at a time: a second one of the same number is refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
#: Names that rows of a store can't use.
VERSION, BUCKET, LIVE = "_version", "_bucket", "_live"


class Conflict(Exception):
    """Another writer has written this version."""


@dataclass(frozen=True)
class Entry:
    """A version: its kind (delta, reset, compact), the buckets that it stands for alone, those that it has rows in, and what a writer calls it."""

    version: int
    kind: str
    alone: tuple[int, ...]
    touched: tuple[int, ...]
    rows: int
    gone: int
    schema: str
    token: str | None = None


@dataclass
class Versions:
    """A versioned table at a path that all executors reach. `key` names its key, `buckets` the parts that are merged and compacted alone."""

    spark: SparkSession
    path: str
    key: str = "id"
    buckets: int = BUCKETS
    _fs: object = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        self._fs = self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    # --- the log

    def log(self) -> list[Entry]:
        """The versions that count, in order. The log is small: a file a version, and vacuum drops those of the past."""
        if not self._fs.exists(self._at("_log")):
            return []
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(self._at("_log"))), key=lambda n: int(n.split(".")[0]) if n[0].isdigit() else -1)
        return [self._entry(n) for n in names if n.endswith(".json") and n[0].isdigit()]

    def _entry(self, name: str) -> Entry:
        stream = self._fs.open(self._at("_log", name))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        row = json.loads(text)
        return Entry(**{**row, "alone": tuple(row["alone"]), "touched": tuple(row["touched"])})

    def _commit(self, entry: Entry) -> None:
        """All at once: the entry is written aside and gets its name by a rename that fails if the name is taken."""
        aside, name = self._at("_log", f".{entry.version}.tmp"), self._at("_log", f"{entry.version}.json")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(entry.__dict__).encode()))
        finally:
            stream.close()
        if self._fs.exists(name) or not self._fs.rename(aside, name):
            raise Conflict(f"version {entry.version} of {self.path} is there already")

    # --- reading

    @staticmethod
    def _schema(entries: list[Entry]) -> T.StructType | None:
        """The columns of all versions, in the order in which they came; the latest type counts."""
        fields: dict[str, T.StructField] = {}
        for e in entries:
            fields |= {f.name: f for f in T.StructType.fromJson(json.loads(e.schema)).fields}
        return T.StructType(list(fields.values())) if fields else None

    def _bases(self, entries: list[Entry]) -> dict[int, int]:
        """Per bucket the version that it begins with."""
        base = dict.fromkeys(range(self.buckets), 0)
        for e in entries:
            base |= dict.fromkeys(e.alone, e.version)
        return base

    def live(self, version: int | None = None) -> dict[int, list[int]]:
        """Per bucket the versions that a reader needs."""
        entries = [e for e in self.log() if version is None or e.version <= version]
        base = self._bases(entries)
        return {b: [e.version for e in entries if e.version >= base[b] and b in e.touched] for b in base}

    def _rows(self, entries: list[Entry], wanted: dict[int, list[int]]) -> DataFrame:
        """Stored rows of the given versions of each bucket, marks too: only their files are read."""
        schema = T.StructType([*self._schema(entries).fields, *T._parse_datatype_string(f"{LIVE} boolean, {VERSION} int, {BUCKET} int").fields])
        by_versions: dict[tuple[int, ...], list[int]] = {}
        for b, versions in wanted.items():
            by_versions.setdefault(tuple(versions), []).append(b)
        paths = [f"{self.path}/{VERSION}={v}" for v in sorted({v for versions in wanted.values() for v in versions})]
        if not paths:
            return self.spark.createDataFrame([], schema)
        needed = reduce(Column.__or__, [F.col(VERSION).isin(*versions) & F.col(BUCKET).isin(*own) for versions, own in by_versions.items() if versions])
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths).where(needed)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Each key's latest row, marks too; of one version's rows a row counts before a mark, and the greatest row."""
        payload = F.struct(*[c for c in rows.columns if c not in (VERSION, BUCKET, LIVE)])
        last = rows.groupBy(BUCKET, self.key).agg(F.max(F.struct(VERSION, LIVE, payload.alias("row"))).alias("last"))
        return last.select("last.row.*", f"last.{LIVE}", f"last.{VERSION}", BUCKET)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of now, or as of a version that isn't vacuumed. Buckets that one version alone has touched aren't shuffled."""
        entries = [e for e in self.log() if version is None or e.version <= version]
        if not entries:
            raise FileNotFoundError(f"{self.path} has no version{'' if version is None else f' up to {version}'}")
        live = self.live(version)
        single, several = ({b: v for b, v in live.items() if keep(len(v))} for keep in (lambda n: n == 1, lambda n: n > 1))
        rows = self._rows(entries, single)
        if several:
            rows = rows.unionByName(self._latest(self._rows(entries, several)))
        return rows.where(LIVE).select(*[f.name for f in self._schema(entries).fields])

    def exists(self) -> bool:
        return bool(self.log())

    # --- writing

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, alone: tuple[int, ...], schema: T.StructType, token: str | None) -> int:
        entries = self.log()
        version = entries[-1].version + 1 if entries else 1
        target = f"{self.path}/{VERSION}={version}"
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        stored = T.StructType([*schema.fields, T.StructField(LIVE, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])
        counts = self.spark.read.schema(stored).parquet(target).groupBy(BUCKET).agg(F.count_if(LIVE).alias("rows"), F.count_if(~F.col(LIVE)).alias("gone")).collect()
        self._commit(Entry(version, kind, alone, tuple(sorted(r[BUCKET] for r in counts)), sum(r["rows"] for r in counts), sum(r["gone"] for r in counts), schema.json(), token))
        return version

    def _done(self, token: str | None) -> int | None:
        return next((e.version for e in self.log() if e.token == token), None) if token is not None else None

    def _delta(self, rows: DataFrame, gone: DataFrame | None) -> DataFrame:
        clash = {VERSION, BUCKET, LIVE} & set(rows.columns)
        if clash:
            raise ValueError(f"a store's rows can't have columns {', '.join(sorted(clash))}")
        out = rows.where(F.col(self.key).isNotNull()).withColumn(LIVE, F.lit(True))
        if gone is not None:
            marks = gone.select(F.col(self.key).cast(rows.schema[self.key].dataType)).where(F.col(self.key).isNotNull()).distinct().withColumn(LIVE, F.lit(False))
            out = out.unionByName(marks, allowMissingColumns=True)
        out = out.withColumn(BUCKET, self.bucket_of(F.col(self.key))).withColumn(VERSION, F.lit(0))
        return self._latest(out).select(*rows.columns, LIVE, BUCKET)

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None, token: str | None = None) -> int:
        """Put rows in the place of those of their keys, and take out the keys of `gone`, as one version; returns its number.

        Of rows of one key the greatest counts; rows without a key don't. A key in both stays. A writer that may run twice gives a token:
        a version of that token isn't written again.
        """
        done = self._done(token)
        return self._write(self._delta(rows, gone), "delta", (), rows.schema, token) if done is None else done

    def replace(self, rows: DataFrame, token: str | None = None) -> int:
        """A version that stands for itself alone: what was there before is gone."""
        done = self._done(token)
        return self._write(self._delta(rows, None), "reset", tuple(range(self.buckets)), rows.schema, token) if done is None else done

    def compact(self, least: int = 2) -> int | None:
        """Rewrite the buckets that at least so many versions have touched as one version, without marks; None if there are none."""
        live = {b: v for b, v in self.live().items() if len(v) >= least}
        if not live:
            return None
        entries = self.log()
        rows = self._latest(self._rows(entries, live)).where(LIVE).drop(VERSION)
        schema = self._schema(entries)
        return self._write(rows.select(*[f.name for f in schema.fields], LIVE, BUCKET), "compact", tuple(sorted(live)), schema, None)

    def vacuum(self) -> list[int]:
        """Remove the files of versions that no reader of now needs, and of writers that died; returns the versions that are removed.

        Log entries stay as long as a bucket begins before or with them, or a token might come again, which is while their files are there.
        """
        entries, needed = self.log(), {v for versions in self.live().values() for v in versions}
        oldest, known, removed = min(self._bases(entries).values(), default=0), {e.version for e in entries}, []
        for status in self._fs.listStatus(self._at()):
            name = status.getPath().getName()
            if name.startswith(VERSION + "=") and (version := int(name.split("=")[1])) not in needed:
                self._fs.delete(status.getPath(), True)
                removed.append(version)
        for e in entries[:-1]:
            if e.version < oldest and e.version in known:
                self._fs.delete(self._at("_log", f"{e.version}.json"), False)
        return sorted(removed)
