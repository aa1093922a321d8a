"""Source trees, JSON folders, logs and diffs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension and language of the parsers; other files are dropped by the join.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp",
    ".kt": "kotlin", ".kts": "kotlin", ".rb": "ruby", ".php": "php", ".swift": "swift", ".c": "cpp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp",
}
SKIPPED = ("__pycache__", "node_modules", "vendor")


def language(path: Column) -> Column:
    """The language of a path's extension, in lower case; null for others."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return table[F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))]


def source_files(spark: SparkSession, root: str, languages: tuple[str, ...] = ()) -> DataFrame:
    """filepath (below root), language, source and sha256 of every source file; folders that start with a dot or are in SKIPPED are left out.

    Bytes that aren't UTF-8 become U+FFFD.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^/*" + root.strip("/").replace(".", r"\.") + "/", "")
    found = files.select(path.alias("filepath"), "content", "length").withColumn("language", language(F.col("filepath")))
    found = found.where(F.col("language").isNotNull() & ~F.col("filepath").rlike(r"(^|/)(\.[^/]*|" + "|".join(SKIPPED) + r")/"))
    if languages:
        found = found.where(F.col("language").isin(*languages))
    return found.select("filepath", "language", F.expr("make_valid_utf8(CAST(content AS STRING))").alias("source"), F.sha2("content", 256).alias("sha256"), "length")


def git_changes(spark: SparkSession, root: str) -> DataFrame:
    """Paths below a git work tree that differ from its last commit or aren't tracked. Git runs on the driver; a folder that git doesn't know gives none."""
    import subprocess

    def run(*arguments: str) -> list[tuple[str]]:
        try:
            done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, timeout=60, check=False)
        except OSError:
            return []
        return [(x,) for x in done.stdout.splitlines()] if done.returncode == 0 else []

    a, b = (spark.createDataFrame(run(*x), "path string") for x in (("diff", "--name-only", "HEAD"), ("ls-files", "--others", "--exclude-standard")))
    from skeinwork.operators.catalog import changed_files

    return changed_files(a, b)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a folder of JSON files, one object each; files that can't be read as such are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED", multiLine=True)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """date (from the file's name) and value of every line of daily logs."""
    return spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1).alias("date"), "value")


def diff_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind (file or added) and value of the lines of unified diffs that name a file or are added."""
    line = diffs.select(key, F.explode(F.split(text, "\n")).alias("line"))
    files = line.where(F.col("line").startswith("+++ b/")).select(key, F.lit("file").alias("kind"), F.expr("substring(line, 7)").alias("value"))
    added = line.where(F.col("line").startswith("+") & ~F.col("line").startswith("+++")).select(key, F.lit("added").alias("kind"), F.expr("substring(line, 2)").alias("value"))
    return files.unionByName(added)


# -- sinks


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_cold(rows: DataFrame, kind: str, path: str) -> None:
    """JSON lines of a type's rows without columns that begin with an underscore, in a folder of the type's name."""
    rows.select(*(c for c in rows.columns if not c.startswith("_"))).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{kind}")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files of a table with the columns part and line, whose parts follow each other."""
    lines.repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(path)
