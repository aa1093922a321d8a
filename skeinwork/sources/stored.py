"""The graph written once for many traversals: edges bucketed and sorted by each end, symbols by key.

A join of a frontier to the copy that is bucketed by the frontier's end moves the frontier alone, and a look-up of one symbol reads one
bucket. Edges are partitioned by relation, so a traversal of calls reads calls alone.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skeinwork.session import shared_dir
from skeinwork.sources import tables

#: Rows of a bucket, about, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 200_000, 16_384


def put(df: DataFrame, key: str, n: int, *parts: str, deal: list[str] | None = None, once: bool = False, number: tuple[str, str] | None = None) -> DataFrame:
    """df as a table in n buckets, sorted by their key, in the shared folder; it goes when the driver ends. deal: what rows are dealt over tasks by, if a key's rows are too many for one.
    once: copies of a row go, in the task of their bucket. number: a column for the places of a key's rows from zero, and the column that orders them."""
    spark = df.sparkSession
    name = f"skeinwork_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/skeinwork/{name}"
    dealt = df.repartition(n, *(deal or [key]))
    dealt = dealt.distinct() if once else dealt
    if number:
        dealt = dealt.withColumn(number[0], F.row_number().over(W.partitionBy(key).orderBy(number[1])) - 1)
    writer = dealt.sortWithinPartitions(*parts, key).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key)
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.table(name)


def buckets(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


class StoredGraph:
    """Symbols (key, ...) and edges (src, dst, relation), each table written when it is first asked for; edges are worked out once.

    n_nodes and n_edges are about how many there are, which gives the numbers of buckets. Edges may have copies, which aren't stored.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, n_nodes: int, n_edges: int):
        self._nodes, self._edges, self._n_nodes, self._n_edges = nodes, edges, n_nodes, n_edges

    @cached_property
    def nodes(self) -> DataFrame:
        """Bucketed by key."""
        return put(self._nodes, "key", buckets(self._n_nodes))

    @cached_property
    def outgoing(self) -> DataFrame:
        """All edges, bucketed by src."""
        return put(self._edges, "src", buckets(self._n_edges), "relation", once=True)

    @cached_property
    def incoming(self) -> DataFrame:
        """All edges, bucketed by dst."""
        return put(self.outgoing, "dst", buckets(self._n_edges), "relation")


_stores: dict[tuple, StoredGraph] = {}


def stamp(spark: SparkSession, path: str) -> tuple:
    """Length and time of a table's files, so that a changed table is stored anew."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listFiles(p, True) if fs.getFileStatus(p).isDirectory() else None
    if found is None:
        s = fs.getFileStatus(p)
        return s.getLen(), s.getModificationTime()
    length = last = 0
    while found.hasNext():
        s = found.next()
        length, last = length + s.getLen(), max(last, s.getModificationTime())
    return length, last


def graph(spark: SparkSession, sf_dir: str) -> StoredGraph:
    """The bundled tables' graph, stored as a session needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, *(stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem")))
    if key not in _stores:
        parts, lines = (tables.table(spark, sf_dir, t).count() for t in ("part", "lineitem"))
        _stores[key] = StoredGraph(tables.nodes(spark, sf_dir), tables.edge_rows(spark, sf_dir, buckets(lines)), parts, 2 * lines)
    return _stores[key]
