"""Stages of a job: gates checked while a stage is written, commits by a manifest, and reruns that do only what is left.

A stage is a table in slices (the values of one column). Each run writes the slices that it does in a folder of its own; a version of the manifest then
names the folder of every slice. Versions appear whole or not at all, and readers only open what the last one names, so a run that dies half-way is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.quality import GateError


@dataclass(frozen=True)
class Gate:
    """A figure of all written rows (an aggregate without distinct) and the value it has to have."""

    name: str
    figure: Column
    wanted: int = 0


@dataclass(frozen=True)
class Written:
    """What a run did: the figures of its gates, the slices that it wrote, and those that were as they had to be."""

    version: int
    figures: dict[str, int] = field(default_factory=dict)
    done: tuple[str, ...] = ()
    kept: tuple[str, ...] = ()


class StageConflict(RuntimeError):
    """Another run committed the same version first."""


def enforce_figures(gates: Sequence[Gate], figures: Mapping[str, int]) -> None:
    wrong = [f"{g.name}: {figures[g.name]}, not {g.wanted}" for g in gates if figures[g.name] != g.wanted]
    if wrong:
        raise GateError("; ".join(wrong))


def observed_write(df: DataFrame, write: Callable[[DataFrame], None], gates: Sequence[Gate]) -> dict[str, int]:
    """Write df and return the gates' figures of what was written. They are gathered by the writing tasks, so nothing is scanned twice."""
    if not gates:
        write(df)
        return {}
    seen = Observation(f"gates-{uuid.uuid4().hex}")
    write(df.observe(seen, *[F.coalesce(g.figure, F.lit(0)).cast("long").alias(g.name) for g in gates]))
    return dict(seen.get)


def fingerprints(df: DataFrame, by: str) -> dict[str, str]:
    """A digest of the rows of each value of ``by``, whatever their order: a rerun compares it to know which slices have other inputs.

    One aggregate; a row for each slice reaches the driver.
    """
    digest = F.xxhash64(F.to_json(F.struct(*[df[c] for c in df.columns]), {"ignoreNullFields": "false"}))
    per = df.select(df[by].cast("string").alias("slice"), digest.alias("d")).groupBy("slice").agg(F.count("*").alias("n"), F.bit_xor("d").alias("x"), F.sum(F.col("d").bitwiseAND(F.lit((1 << 40) - 1))).alias("s"))
    return {_name(r["slice"]): f"{r['n']}-{r['x'] & (1 << 64) - 1:016x}-{r['s']:x}" for r in per.collect()}


def _name(value: str | None) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if value is None or value == "" else str(value)


class Stage:
    """A stage's table below ``root``, in slices by the column ``by``."""

    def __init__(self, spark: SparkSession, root: str, by: str) -> None:
        self.spark, self.root, self.by = spark, root.rstrip("/"), by
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _list(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(x[:8]) for x in self._list(f"{self.root}/_manifest") if x.endswith(".json") and x[:8].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """Of a version (the last one): version, schema, and the folder, fingerprint and rows of each slice."""
        version = version or max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "slices": {}}
        stream = self._fs.open(self._path(f"{self.root}/_manifest/{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Give the finished manifest its version's name, which fails if that is taken."""
        jvm, folder = self.spark._jvm, f"{self.root}/_manifest"
        draft, final = self._path(f"{folder}/draft-{uuid.uuid4().hex}"), self._path(f"{folder}/{manifest['version']:08d}.json")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, how)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise StageConflict(f"version {manifest['version']} is taken") from error
            raise

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of the slices that a version (the last one) names; a filter on ``by`` opens only the folders of its slices."""
        known = self.manifest(version)
        if not known["version"]:
            raise FileNotFoundError(f"nothing is committed in {self.root}")
        schema = StructType.fromJson(known["schema"])
        folders = [f"{self.root}/{s['folder']}" for s in known["slices"].values() if s["folder"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema.fields, *[f for f in self.spark.createDataFrame([], "__run string").schema.fields]])
        return self.spark.read.schema(whole).option("basePath", self.root).parquet(*folders).select(*[F.col(f"`{c}`") for c in schema.names])

    def write(self, inputs: Mapping[str | None, str], build: Callable[[list[str]], DataFrame], *, gates: Sequence[Gate] = (), checks: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, at_once: int = 0) -> Written:
        """Bring the stage up to date.

        ``inputs`` has the fingerprint of each slice's inputs; ``build(slices)`` gives the rows of slices, with the column ``by``. Slices whose fingerprint is that of the last
        version stay as they are; slices that inputs no longer has leave. The others are built, ``at_once`` of them (0: all) for each version, so a run
        that dies leaves the versions before it, and the next run does the rest. ``gates`` are observed while rows are written; ``checks`` give violations in what was
        written. If either finds any, :class:`GateError` is raised and the version isn't committed. Rows that belong to no slice asked for count as a violation.
        """
        wanted = {_name(k): v for k, v in inputs.items()}
        known = self.manifest()
        todo = sorted(k for k, v in wanted.items() if known["slices"].get(k, {}).get("fingerprint") != v)
        kept = tuple(sorted(set(wanted) - set(todo)))
        gone = set(known["slices"]) - set(wanted)
        figures: dict[str, int] = {}
        version = known["version"]
        steps = [todo[k : k + (at_once or len(todo))] for k in range(0, len(todo), at_once or len(todo))] if todo else [[]] if gone else []
        for step in steps:
            slices = {k: v for k, v in known["slices"].items() if k in wanted and k not in step}
            schema = known["schema"]
            if step:
                found, schema, made = self._attempt(step, build(step), gates, checks or {})
                figures = {k: figures.get(k, 0) + v for k, v in found.items()}
                slices |= {k: {"folder": made[k][0] if k in made else None, "rows": made[k][1] if k in made else 0, "fingerprint": wanted[k]} for k in step}
            version += 1
            known = {"version": version, "schema": schema, "slices": slices}
            self._commit(known)
        return Written(version, figures, tuple(todo), kept)

    def _attempt(self, step: list[str], df: DataFrame, gates: Sequence[Gate], checks: Mapping[str, Callable[[DataFrame], DataFrame]]) -> tuple[dict[str, int], dict, dict[str, tuple[str, int]]]:
        """Write rows in a new folder and hold them to the gates: figures, schema, and folder and rows of each slice."""
        if "__run" in df.columns:
            raise ValueError("a column is named __run, as the folders of runs are")
        run = f"__run={uuid.uuid4().hex}"
        named = F.coalesce(F.when(F.col(self.by).cast("string") != "", F.col(self.by).cast("string")), F.lit(_name(None)))
        stray = Gate("rows_of_other_slices", F.count_if(~named.isin(*step)))
        every = (*gates, stray)
        dealt = df.hint("rebalance", self.by)
        figures = observed_write(dealt, lambda x: x.write.partitionBy(self.by).parquet(f"{self.root}/{run}"), every)
        enforce_figures(every, figures)
        kind = StructType([f for f in df.schema.fields if f.name != self.by] + [f for f in df.schema.fields if f.name == self.by])
        stored = self.spark.read.schema(kind).parquet(f"{self.root}/{run}")
        for name, violations in checks.items():
            n = violations(stored).count()
            if n:
                raise GateError(f"{name}: {n}")
        # Footers only: no column is read.
        rows = {_name(r["slice"]): r["n"] for r in stored.groupBy(F.col(self.by).cast("string").alias("slice")).agg(F.count("*").alias("n")).collect()}
        folders = {unquote(x.partition("=")[2]): f"{run}/{x}" for x in self._list(f"{self.root}/{run}") if x.startswith(f"{self.by}=")}
        figures.pop(stray.name)
        return figures, json.loads(kind.json()), {k: (folder, rows.get(k, 0)) for k, folder in folders.items()}

    def fingerprints(self) -> dict[str, str]:
        """Fingerprints for a stage that this one feeds: of a slice, the folder that its rows are in, which changes with them. Nothing is scanned."""
        return {k: f"{s['folder']}:{s['rows']}" for k, s in self.manifest()["slices"].items()}

    def vacuum(self) -> list[str]:
        """Remove folders that the last version doesn't name, those of failed runs among them, and return their names. Not beside a run that is writing."""
        named = {s["folder"] for s in self.manifest()["slices"].values() if s["folder"]}
        removed = []
        for run in [x for x in self._list(self.root) if x.startswith("__run=")]:
            slices = [f"{run}/{x}" for x in self._list(f"{self.root}/{run}") if x.startswith(f"{self.by}=")]
            old = [x for x in slices if x not in named]
            for x in old if len(old) < len(slices) else [run]:
                self._fs.delete(self._path(f"{self.root}/{x}"), True)
            removed += old
        for x in self._list(f"{self.root}/_manifest"):
            if x.startswith("draft-"):
                self._fs.delete(self._path(f"{self.root}/_manifest/{x}"), False)
        return removed
