"""Tables by key in hash buckets, of which a change rewrites those that differ, and one version pointer for all tables of a store.

    <store>/data/<table>/<write>/_bucket=<b>/...   Parquet
    <store>/versions/<n>.json                      tables: schema, keys, number of buckets; each bucket's folder, rows and digest

Readers take the last version, whose buckets may lie in the folders of many writes. A change of several tables writes its buckets first and its
version last, so a stop in between leaves the version before as it was, and a reader that has begun goes on with its own.

Defined cases: a table that no version names is empty; nulls in keys are values like others; of rows that repeat a key one stays (`latest`); an empty
change makes no version; of two writers that begin with the same version the second fails, if the first has put its version.
"""

from __future__ import annotations

import json
import uuid
from types import TracebackType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.operators.relational import latest, upsert

#: Rows of a bucket, about: a table with twice as many is dealt over more buckets. FEWEST: buckets of a new table.
BUCKET_ROWS, FEWEST, MOST = 200_000, 16, 16_384


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """The versions that are there, the oldest first."""
        fs, p = self._fs(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def version(self, n: int | None = None) -> dict:
        """The tables of version n, or of the last one."""
        there = self.versions()
        if not there:
            return {}
        fs, p = self._fs(f"{self.path}/versions/{n or there[-1]:010d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, schema: str | None = None, version: int | None = None) -> DataFrame:
        """A table; without one, no rows of `schema`."""
        t = self.version(version).get(name)
        if t is None:
            if schema is None:
                raise KeyError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        return self._rows(t, t["buckets"])

    def _rows(self, t: dict, which) -> DataFrame:
        kind = T.StructType.fromJson(t["schema"])
        paths = [f"{self.path}/data/{t['buckets'][b][0]}/_bucket={b}" for b in which if b in t["buckets"]]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def change(self) -> Change:
        """`with store.change() as c:` puts the changes of c in one version, if the block doesn't fail."""
        return Change(self)

    def tidy(self, keep: int = 2) -> None:
        """Delete versions but the last `keep`, and data that none of these names."""
        there = self.versions()
        used = {entry[0] for n in there[-keep:] for t in self.version(n).values() for entry in t["buckets"].values()}
        for n in there[:-keep]:
            fs, p = self._fs(f"{self.path}/versions/{n:010d}.json")
            fs.delete(p, False)
        fs, data = self._fs(f"{self.path}/data")
        for table in fs.listStatus(data) if fs.exists(data) else []:
            for write in fs.listStatus(table.getPath()):
                if f"{table.getPath().getName()}/{write.getPath().getName()}" not in used:
                    fs.delete(write.getPath(), True)


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


class Change:
    """Changes of a store's tables that become its next version together."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        there = store.versions()
        self.base, self.tables, self.rewritten, self.work = (there[-1] if there else 0), store.version(), {}, []

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind: type | None, value: BaseException | None, trace: TracebackType | None) -> None:
        for path in self.work:
            fs, p = self.store._fs(path)
            fs.delete(p, True)
        if kind is None and self.rewritten:
            fs, p = self.store._fs(f"{self.store.path}/versions/{self.base + 1:010d}.json")
            _, early = self.store._fs(f"{self.store.path}/versions/{uuid.uuid4().hex}.tmp")
            stream = fs.create(early, False)
            stream.write(bytearray(json.dumps(self.tables).encode()))
            stream.close()
            if fs.exists(p) or not fs.rename(early, p):
                fs.delete(early, False)
                raise RuntimeError(f"version {self.base + 1} of {self.store.path} was put by another writer")

    def _once(self, rows: DataFrame) -> DataFrame:
        """rows worked out once, in the store's work folder until the change ends."""
        self.work.append(f"{self.store.path}/work/{uuid.uuid4().hex}")
        rows.write.parquet(self.work[-1])
        return self.spark.read.schema(rows.schema).parquet(self.work[-1])

    def _table(self, name: str, schema: T.StructType, keys: list[str], rows: int) -> dict:
        """The table's entry; one with too many rows for its buckets, or another schema or key, is begun anew with all of them."""
        old = self.tables.get(name)
        n = min(MOST, max(FEWEST, -(-rows // BUCKET_ROWS)))
        kind = json.loads(schema.json())
        if old and old["keys"] == keys and old["n"] * 2 > n and [f["name"] for f in old["schema"]["fields"]] == schema.names:
            return {**old, "buckets": dict(old["buckets"])}
        return {"schema": kind, "keys": keys, "n": n, "buckets": {}}

    def _write(self, name: str, t: dict, rows: DataFrame, digests: dict, which: set) -> None:
        """Buckets `which` of the table get these rows (with _bucket)."""
        folder = f"{name}/{uuid.uuid4().hex}"
        if any(b in digests for b in which):
            some = rows if which >= digests.keys() else rows.where(F.col("_bucket").isin(*(int(b) for b in which)))
            some.repartition(len(which), "_bucket").sortWithinPartitions("_bucket", *t["keys"]).write.partitionBy("_bucket").parquet(f"{self.store.path}/data/{folder}")
        for b in which:
            t["buckets"].pop(b, None)
            if b in digests:
                t["buckets"][b] = [folder, *digests[b]]
        self.tables = {**self.tables, name: t}
        self.rewritten[name] = len(which)

    def _digests(self, rows: DataFrame) -> dict:
        """Rows and two sums of hashes of each bucket, which don't depend on the order of rows."""
        values = [c for c in rows.columns if c != "_bucket"]
        total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(20,0)")).cast("string")
        return {str(r[0]): [r[1], r[2], r[3]] for r in rows.groupBy("_bucket").agg(F.count("*"), total(1), total(2)).collect()}

    def put(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Make the table these rows (one for each key); buckets whose rows are as they were aren't written."""
        rows = self._once(latest(rows, *keys))
        t = self._table(name, rows.schema, keys, rows.count())
        dealt = rows.withColumn("_bucket", _bucket(keys, t["n"]))
        digests = self._digests(dealt)
        which = {b for b in digests.keys() | t["buckets"].keys() if digests.get(b) != t["buckets"].get(b, [None])[1:]}
        if which or name not in self.tables:
            self._write(name, t, dealt, digests, which)

    def merge(self, name: str, new: DataFrame, keys: list[str], version: str) -> None:
        """Put in new rows by key: of a key's rows that with the largest version stays, the new one among equals. Buckets without new rows are neither read nor written."""
        new = self._once(latest(new, *keys, version=version))
        known = sum(entry[1] for entry in self.tables.get(name, {"buckets": {}})["buckets"].values())
        t = self._table(name, new.schema, keys, known + new.count())
        fresh = name in self.tables and not t["buckets"]  # dealt anew
        dealt = new.withColumn("_bucket", _bucket(keys, t["n"]))
        which = {str(r[0]) for r in dealt.select("_bucket").distinct().collect()}  # MOST at most
        if not which:
            return
        old = self.store._rows(self.tables[name], self.tables[name]["buckets"] if fresh else which) if name in self.tables else new.limit(0)
        merged = upsert(old.select(*new.columns), new, keys, version).withColumn("_bucket", _bucket(keys, t["n"]))
        digests = self._digests(merged)
        self._write(name, t, merged, digests, which | digests.keys())
