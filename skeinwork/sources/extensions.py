"""Extension points that Spark knows: source trees as a data source, batch and stream, and parsers as a table function for SQL."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.functions import udtf

from skeinwork.functions.parsers import Registry, default_registry
from skeinwork.schema import RECORDS
from skeinwork.sources.files import LANGUAGES

FILES = "filepath string, language string, size long, status string, source string"
#: Files of a task, about.
TASK_FILES = 64


def listed(root: str) -> dict[str, tuple[int, int]]:
    """Size and time of every source file below a folder, by its path from there; hidden folders are left out."""
    out = {}
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith("."))
        for name in names:
            if os.path.splitext(name)[1].lower() in LANGUAGES:
                path = os.path.join(folder, name)
                try:
                    s = os.stat(path)
                except FileNotFoundError:  # gone since it was listed
                    continue
                out[os.path.relpath(path, root)] = (s.st_size, s.st_mtime_ns)
    return out


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int, str]]


def _parts(files: list[tuple[str, int, str]]) -> list[_Files]:
    files = sorted(files)
    return [_Files(files[i : i + TASK_FILES]) for i in range(0, len(files), TASK_FILES)]


def _rows(root: str, part: _Files) -> Iterator[tuple]:
    for path, size, status in part.files:
        text = None
        if status != "deleted":
            try:
                with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                    text = f.read()
            except FileNotFoundError:
                status = "deleted"
        yield path, LANGUAGES[os.path.splitext(path)[1].lower()], size, status, text


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Files]:
        return _parts([(p, size, "new") for p, (size, _) in listed(self.root).items()])

    def read(self, partition: _Files) -> Iterator[tuple]:
        return _rows(self.root, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are numbers of snapshots, which lie beside the checkpoint; a batch is the difference of two."""

    def __init__(self, root: str, snapshots: str):
        self.root, self.snapshots = root, snapshots
        os.makedirs(snapshots, exist_ok=True)

    def _snapshot(self, n: int) -> dict[str, list[int]]:
        if n == 0:
            return {}
        with open(f"{self.snapshots}/{n}.json") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        last = max((int(x.removesuffix(".json")) for x in os.listdir(self.snapshots) if x.endswith(".json")), default=0)
        now = {p: list(v) for p, v in listed(self.root).items()}
        if now != self._snapshot(last):
            last += 1
            with open(f"{self.snapshots}/{last}.part", "w") as f:
                json.dump(now, f)
            os.replace(f"{self.snapshots}/{last}.part", f"{self.snapshots}/{last}.json")
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        a, b = self._snapshot(start["snapshot"]), self._snapshot(end["snapshot"])
        there = [(p, size, "changed" if p in a else "new") for p, (size, at) in b.items() if a.get(p) != [size, at]]
        return _parts(there + [(p, size, "deleted") for p, (size, _) in a.items() if p not in b])

    def read(self, partition: _Files) -> Iterator[tuple]:
        return _rows(self.root, partition)

    def commit(self, end: dict) -> None:
        for x in os.listdir(self.snapshots):
            if x.endswith(".json") and int(x.removesuffix(".json")) < end["snapshot"]:
                os.remove(f"{self.snapshots}/{x}")


class SourceTree(DataSource):
    """spark.read.format("source_tree").load(folder), spark.readStream.format("source_tree").option("snapshots", folder).load(folder).

    Rows: filepath, language, size, status (new, changed, deleted), source (null if deleted). The folders must be ones that driver and executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _Stream:
        if "snapshots" not in self.options:
            raise ValueError("a stream of a source tree needs the option snapshots, a folder beside its checkpoint")
        return _Stream(self.options["path"], self.options["snapshots"])


def register(spark: SparkSession, registry: Registry | None = None) -> None:
    """Make the data source source_tree and the table function parse_source known to a session.

    SELECT * FROM parse_source(TABLE(files), 'repository'): records of files (filepath, source, ...), by the parser of their extension; files of other languages have none.
    """
    parsers = registry or default_registry()
    names = [c.split()[0] for c in RECORDS.split(", ")]

    @udtf(returnType=RECORDS)
    class ParseSource:
        def eval(self, row, repo: str):
            parse = parsers.parser(row["filepath"] or "")
            for found in parse(row["filepath"], row["source"] or "", repo) if parse else ():
                yield tuple(found.get(n) for n in names)

    spark.udtf.register("parse_source", ParseSource)
    spark.dataSource.register(SourceTree)
