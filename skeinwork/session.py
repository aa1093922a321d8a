"""Sessions with the settings that the package is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.master(master).config(map=base | conf).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in spark.checkpoint.dir. Only a local master may leave that unset and has a temporary folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="skeinwork-"))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset and has a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = getattr(spark, "_skeinwork_graph", None) or tempfile.mkdtemp(prefix="skeinwork-")
        spark._skeinwork_graph = base
    return base.rstrip("/")


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder that is there when the driver ends: what a lazy result reads can't go earlier."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
