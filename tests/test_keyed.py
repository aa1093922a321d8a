"""Tables by key: what a change rewrites, versions, crashes."""

import pytest
from pyspark.sql import functions as F

from skeinwork.sources import keyed
from skeinwork.sources.keyed import Store

KIND = "id long, v string, version int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    with s.change() as c:
        c.put("a", spark.range(1000).selectExpr("id", "CONCAT('v', id) AS v", "1 AS version"), ["id"])
    return s


def test_a_merge_rewrites_touched_buckets(spark, store):
    before = store.version()["a"]["buckets"]
    new = spark.createDataFrame([(5, "x", 2), (5, "y", 3), (7, "old", 0), (2000, "z", 1), (None, "n", 1)], KIND)
    with store.change() as c:
        c.merge("a", new, ["id"], "version")
    after = store.version()["a"]["buckets"]
    assert sum(before[b] != after[b] for b in before) <= 4 < len(after) == keyed.FEWEST
    got = {r["id"]: r["v"] for r in store.read("a").collect()}
    assert len(got) == 1002 and (got[5], got[7], got[2000], got[None]) == ("y", "v7", "z", "n")
    assert store.read("a", version=1).count() == 1000


def test_a_put_rewrites_what_differs(spark, store):
    rows = store.read("a")
    with store.change() as c:
        c.put("a", rows.repartition(3), ["id"])
    assert store.versions() == [1] and c.rewritten == {}
    with store.change() as c:
        c.put("a", rows.where("id <> 3").withColumn("v", F.when(F.col("id") == 4, "w").otherwise(F.col("v"))), ["id"])
    assert 1 <= c.rewritten["a"] <= 2
    got = {r["id"]: r["v"] for r in store.read("a").collect()}
    assert len(got) == 999 and 3 not in got and got[4] == "w"
    with store.change() as c:
        c.put("a", rows.limit(0), ["id"])
    assert store.read("a").count() == 0


def test_a_stop_between_two_tables_leaves_the_version_before(spark, store):
    was = rows_of(store.read("a"))
    with pytest.raises(ZeroDivisionError), store.change() as c:
        c.merge("a", spark.createDataFrame([(5, "x", 2)], KIND), ["id"], "version")
        1 / 0
    assert rows_of(store.read("a")) == was and store.versions() == [1]
    store.tidy()  # what the stopped change wrote goes, what versions name stays
    assert rows_of(store.read("a")) == was


def test_two_writers_of_one_version(spark, store):
    one = spark.createDataFrame([(5, "x", 2)], KIND)
    first, second = store.change(), store.change()
    with first as c:
        c.merge("a", one, ["id"], "version")
    with pytest.raises(RuntimeError, match="another writer"), second as c:
        c.merge("a", one.withColumn("v", F.lit("lost")), ["id"], "version")
    assert store.read("a").where("id = 5").first()["v"] == "x"


def test_more_rows_are_dealt_over_more_buckets(spark, store, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 20)
    with store.change() as c:
        c.merge("a", spark.createDataFrame([(5, "x", 2)], KIND), ["id"], "version")
    assert store.version()["a"]["n"] == 51
    got = {r["id"]: r["v"] for r in store.read("a").collect()}
    assert len(got) == 1000 and got[5] == "x" and got[6] == "v6"


def test_empty_and_absent_tables(spark, store):
    assert store.read("b", KIND).count() == 0
    with pytest.raises(KeyError):
        store.read("b")
    with store.change() as c:
        c.merge("a", spark.createDataFrame([], KIND), ["id"], "version")
    assert store.versions() == [1]
    with store.change() as c:
        c.put("b", spark.createDataFrame([], KIND), ["id"])
    assert store.read("b").columns == ["id", "v", "version"] and store.read("b").count() == 0
