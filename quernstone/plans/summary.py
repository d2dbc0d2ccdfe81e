"""Summaries: aggregates kept by key as mergeable states, queried again at coarser keys, and merged incrementally.

A summary is a folder: manifests/N.json names the folder of generation N's data, which no other writer uses, with the states' kinds and
the ids of all parts applied so far. A generation exists once its manifest does; that is written aside and given its name in one
step that fails if the name is there, so two writers can't both make one generation, the slower one's data are removed, and a crash leaves
the one before in force. After a commit the last two generations stay, for readers that have begun; older ones go. Parts
whose id has been applied are skipped, so a merge can be repeated.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import truncate_time
from ..operators import distinct as d

VERSION = 2
# Stores with such a step.
ONE_STEP = ("file", "hdfs", "viewfs", "abfs", "abfss")
#: Generations that stay after a commit.
KEPT = 2
#: How states are made of rows and of states, and read. Kinds: count (of rows), sum (of a column), min, max, distinct (a sketch).
KINDS = ("count", "sum", "min", "max", "distinct")


@dataclass(frozen=True)
class State:
    name: str
    kind: str
    column: str | None = None

    def made(self) -> Column:
        if self.kind not in KINDS:
            raise ValueError(f"no kind of state: {self.kind}")
        if self.kind == "count":
            return F.count("*").alias(self.name)
        column = F.col(self.column or self.name)
        return {"sum": F.sum, "min": F.min, "max": F.max, "distinct": d.sketch}[self.kind](column).alias(self.name)

    def merged(self) -> Column:
        f = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "distinct": d.merge}[self.kind]
        return f(self.name).alias(self.name)

    def read(self) -> Column:
        return (d.estimate(F.col(self.name)) if self.kind == "distinct" else F.col(self.name)).alias(self.name)


def build(df: DataFrame, keys: dict[str, str], states: list[State], where: str | None = None) -> DataFrame:
    """States by key, as a DataFrame."""
    rows = (df.filter(where) if where else df).withColumns({n: F.expr(e) for n, e in keys.items()})
    return rows.groupBy(*keys).agg(*(s.made() for s in states))


def merge(parts: list[DataFrame], keys: list[str], states: list[State]) -> DataFrame:
    """States of all parts; a key that a part doesn't have is null there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    for key in keys:
        if key not in whole.columns:
            whole = whole.withColumn(key, F.lit(None))
    return whole.groupBy(*keys).agg(*(s.merged() for s in states))


def requery(summary: DataFrame, keys: dict[str, str], states: list[State], where: str | None = None) -> DataFrame:
    """A summary at coarser keys (expressions over its keys), with states read. Only what is asked for is scanned."""
    rows = (summary.filter(where) if where else summary).select(*(F.expr(e).alias(n) for n, e in keys.items()), *(s.name for s in states))
    return rows.groupBy(*keys).agg(*(s.merged() for s in states)).select(*keys, *(s.read() for s in states))


def part_id(argument: str) -> tuple[str, str]:
    """(id, path) of "id:path", or of a path alone: its base name up to the first _ or . there."""
    m = re.match(r"([^:/]+):(?!//)(.*)$", argument)
    if m:
        return m[1], m[2]
    base = posixpath.basename(argument.rstrip("/"))
    return re.split(r"[_.]", base, maxsplit=1)[0] or base, argument


class Folder:
    """Files of a folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, of: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.at(of))] if self.fs.exists(self.at(of)) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write aside, then give it its name, unless that is there: by a hard link on local disks, by a rename on stores whose rename is one step and keeps what is there. Others are refused."""
        scheme = self.fs.getUri().getScheme()
        if scheme not in ONE_STEP:
            raise ValueError(f"a summary can't be committed safely in {scheme}:, which has no step that fails if a name is there")
        aside, target = self.at(f"_{posixpath.basename(name)}.{uuid.uuid4().hex}.tmp"), self.at(name)
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        try:
            if scheme == "file":
                local = lambda path: self.jvm.java.io.File(path.toUri().getPath()).toPath()
                try:
                    self.jvm.java.nio.file.Files.createLink(local(target), local(aside))
                except Py4JJavaError as error:
                    if "FileAlreadyExists" not in str(error.java_exception):
                        raise
                    raise RuntimeError(f"{name} is there already: another writer was faster") from None
            elif not self.fs.rename(aside, target):
                raise RuntimeError(f"{name} is there already: another writer was faster")
        finally:
            if self.fs.exists(aside):
                self.fs.delete(aside, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Summary:
    """A stored summary."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def manifest(self) -> dict | None:
        """Of the latest generation; version 1 had no generation and is taken as the first."""
        names = sorted(n for n in self.folder.names("manifests") if re.fullmatch(r"\d{10}\.json", n))
        if not names:
            return None
        found = json.loads(self.folder.text(f"manifests/{names[-1]}"))
        if found["version"] not in (1, VERSION):
            raise ValueError(f"a summary of version {found['version']} can't be read")
        return {"generation": 1, **found}

    def states(self) -> list[State]:
        return [State(**s) for s in (self.manifest() or {"states": []})["states"]]

    def read(self) -> DataFrame:
        found = self.manifest()
        if found is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{found['data']}")

    def _commit(self, rows: DataFrame, keys: list[str], states: list[State], parts: list[str], before: dict | None, empty: bool = True) -> dict | None:
        """Write the next generation; None, and nothing written, if there are no rows and they may not be empty."""
        generation = (before["generation"] if before else 0) + 1
        data = f"gen={generation}-{uuid.uuid4().hex}"
        try:
            rows.sort(*keys).write.parquet(f"{self.path}/{data}")
            if not empty and self.spark.read.parquet(f"{self.path}/{data}").isEmpty():
                self.folder.delete(data)
                return None
            manifest = {"version": VERSION, "generation": generation, "data": data, "keys": keys, "states": [s.__dict__ for s in states], "parts": sorted(parts)}
            self.folder.publish(f"manifests/{generation:010d}.json", json.dumps(manifest))
        except Exception:
            self.folder.delete(data)
            raise
        for name in sorted(self.folder.names("manifests")):
            if re.fullmatch(r"\d{10}\.json", name) and int(name[:10]) <= generation - KEPT:
                self.folder.delete(json.loads(self.folder.text(f"manifests/{name}"))["data"])
                self.folder.delete(f"manifests/{name}")
        return manifest

    def create(self, rows: DataFrame, keys: list[str], states: list[State], parts: list[str] | None = None) -> dict:
        """The first generation. Without any row nothing is written, and the manifest returned is empty."""
        if self.manifest() is not None:
            raise FileExistsError(self.path)
        return self._commit(rows, keys, states, parts or [], None, empty=False) or {}

    def merge(self, arguments: list[str], keys: list[str] | None = None, states: list[State] | None = None, strict_compat: bool = False, delete_inputs: bool = False) -> dict:
        """Merge parts ("id:path" or path, Parquet of states) into the next generation.

        An id twice in one call is an error; ids applied before are skipped; if nothing is left, the generation stays. A part that
        isn't there is skipped and its id stays open (strict_compat: its id counts as applied). Keys are those of the
        summary, or those given; parts that lack one have null there. delete_inputs removes merged parts after the commit.
        """
        parts = sorted(map(part_id, arguments))
        ids = [i for i, _ in parts]
        if len(set(ids)) < len(ids):
            raise ValueError("a part's id is given twice")
        before = self.manifest()
        states = states or self.states()
        keys = keys or (before["keys"] if before else None)
        if not states or keys is None:
            raise ValueError("a new summary needs keys and states")
        applied = set(before["parts"]) if before else set()
        inputs, done, used = [], [], []
        for i, path in parts:
            if i in applied:
                continue
            try:
                inputs.append(self.spark.read.parquet(path))
            except AnalysisException as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                done += [i] * strict_compat
                continue
            done.append(i)
            used.append(path)
        if not done:
            return before or {}
        old = [self.read()] if before else []
        if not old + inputs:
            return before or {}
        manifest = self._commit(merge(old + inputs, keys, states), keys, states, [*applied, *done], before)
        for path in used if delete_inputs else []:
            whole = self.folder.jvm.org.apache.hadoop.fs.Path(path)
            whole.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(whole, True)
        return manifest

    def query(self, keys: dict[str, str], names: list[str], where: str | None = None) -> DataFrame:
        chosen = [s for s in self.states() if s.name in names]
        return requery(self.read(), keys, chosen, where)


def write_by_hour(rows: DataFrame, ts: str, path: str) -> None:
    """States in Parquet, a folder for each UTC hour; a query for some hours reads their folders only."""
    hour = F.date_format(truncate_time(F.col(ts), "H"), "yyyy-MM-dd-HH")
    # A number is given so that small hours aren't gathered in one task, which would then write all their files in turn.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.withColumn("hour", hour).repartition(tasks, "hour").sortWithinPartitions("hour", *(c for c in rows.columns if c == ts)).write.partitionBy("hour").parquet(path)


def read_hours(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """What write_by_hour wrote for start <= hour < end. Only these hours' folders are looked for, so the rest isn't even listed, unless there are none of these."""
    first = start.replace(minute=0, second=0, microsecond=0)
    names = [f"hour={first + timedelta(hours=i):%Y-%m-%d-%H}" for i in range(-(-int((end - first).total_seconds()) // 3600))]
    folder = Folder(spark, path)
    there = [f"{path}/{n}" for n in names if folder.fs.exists(folder.at(n))]
    if not there:  # an empty table, as a filter would give
        return spark.read.option("basePath", path).parquet(path).limit(0)
    return spark.read.option("basePath", path).parquet(*there)
