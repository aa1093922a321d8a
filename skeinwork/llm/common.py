"""What the corpus operators share: table reading, the shared work folder, byte views of text columns.

Text is handled as UTF-8 bytes taken straight from Arrow buffers, so a batch is
never decoded into Python strings unless an operator needs code points.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that an executor-side function works on at a time.
SLICE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset and has a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark, "_skeinwork_tmp", None) or tempfile.mkdtemp(prefix="skeinwork-")
        spark._skeinwork_tmp = base
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/skeinwork/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work folder through Hadoop's file system, wherever it is."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a work folder when the driver ends: what a lazy result reads can't go earlier."""
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """df after a round trip through Parquet in the shared folder; later stages don't recompute what led to it. The folder goes when the driver ends."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Work:
    """Tables written for the steps of one operator; they go when the block ends, whether it fails or not."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def __enter__(self) -> Work:
        return self

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(work_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def buckets(self, df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
        """As put(), in n buckets by keys and sorted in each, so that joins on the keys don't move it."""
        path = work_path(self.spark, name)
        table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
        self.paths.append(path)
        self.tables.append(table)
        df.repartition(n, *keys).write.format("parquet").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
        return self.spark.table(table)

    def drop_first(self, n: int) -> None:
        """Drop the n oldest tables that are still there."""
        for path in self.paths[:n]:
            drop_path(self.spark, path)
        del self.paths[:n]

    def __exit__(self, *_) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.drop_first(len(self.paths))


#: A key is hot if it is among the MOST_HOT most frequent ones and has more rows than a task may always hold.
MOST_HOT, FEW_ROWS = 512, 512
#: Parts into which a hot key's rows are dealt.
PARTS = 64


def spread_join(big: DataFrame, small: DataFrame, key: str, salt: str, how: str = "inner") -> DataFrame:
    """big joined to small (few rows for each key) on their column `key`, by sort and merge at every size; rows of hot keys are dealt over PARTS tasks by `salt`.

    Of N rows a key that isn't hot has N / MOST_HOT at most. Hot keys are MOST_HOT at most, so they may be collected and broadcast; small's rows of
    these are copied to every part. big is read once more, to count, so it should be on disk or cheap.
    """
    hot = [r[0] for r in big.groupBy(key).count().where(F.col("count") > FEW_ROWS).orderBy(F.desc("count")).limit(MOST_HOT).collect()]
    if not hot:
        return big.join(small.hint("merge"), key, how)
    marks = F.broadcast(big.sparkSession.createDataFrame([(k,) for k in hot], big.select(key).schema).withColumn("_hot", F.lit(True)))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt), F.lit(PARTS))).otherwise(F.lit(0))
    dealt = big.join(marks, key, "left").withColumn("_part", part.cast("int")).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    copied = small.join(marks, key, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return dealt.join(copied.hint("merge"), [key, "_part"], how).drop("_part")


def only(df: DataFrame, *kinds: tuple[str, T.DataType]) -> DataFrame:
    """The named columns in the given types. Other columns, whatever their names, go."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds))


def docs_of(df: DataFrame) -> DataFrame:
    """doc_id and text; null texts become empty."""
    d = only(df, ("doc_id", T.LongType()), ("text", T.StringType()))
    return d.withColumn("text", F.coalesce("text", F.lit("")))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null: empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def text_slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch so that each part has about `limit` bytes of text, or one row."""
    col = batch.column(column)
    view = col.cast(pa.large_binary())
    sizes = [0 if v is None else v for v in pc.binary_length(view).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            part = batch.slice(start, i - start)
            yield part, utf8(part.column(column))
            start, total = i, 0
        total += n
    if start < len(sizes):
        part = batch.slice(start)
        yield part, utf8(part.column(column))


class Memo(dict):
    """A bounded memo of two generations: entries that are used again outlive the older generation."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set) -> list:
        """The keys that have to be worked out; those of the older generation are taken over."""
        new = [k for k in keys if k not in self]
        if not self.old:
            return new
        old, out = self.old.get, []
        for k in new:
            v = old(k)
            if v is None:
                out.append(k)
            else:
                self[k] = v
        return out

    def look(self, keys: list, work: Callable[[list], list]) -> list:
        """The values of keys, which are all different. work gives the values of those that neither generation has."""
        found = list(map(self.get, keys))
        gaps = [i for i, v in enumerate(found) if v is None]
        if gaps and self.old:
            old, still = self.old.get, []
            for i in gaps:
                v = found[i] = old(keys[i])
                if v is None:
                    still.append(i)
                else:
                    self[keys[i]] = v
            gaps = still
        if gaps:
            new = [keys[i] for i in gaps]
            for i, k, v in zip(gaps, new, work(new)):
                found[i] = self[k] = v
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return found

    def room(self, keys: set) -> None:
        """Start a generation if the keys of one slice wouldn't fit beside those held."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
