"""A results folder that holds every station and every run.

A save writes its tables to folders of their own and then publishes them all at once: one
manifest file, whose appearance is the only thing readers look for.  Tables of stations
with different columns lie side by side under their column set; reports with fixed columns
read as one table over all sets of a run.  Nothing is ever replaced.

    data/<run>/<save>/<set number>/<table>/   rows, by station
    manifest/<save>/                          one file: what the save holds
"""

from __future__ import annotations

import hashlib
import json
import platform
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.session import side_by_side
from colweave.sources import artefacts

MANIFEST_SCHEMA = ("run string, save string, saved_at timestamp, column_set string, columns array<string>, "
                   "name string, path string, format string")
# Characters that may stand in a folder name; the rest becomes an underscore.
_PLAIN = r"[^A-Za-z0-9_.\-]+"


def plain_name(name: str) -> str:
    """A station or run name as a folder name; different names stay different."""
    plain = re.sub(_PLAIN, "_", name)
    if plain == name and plain not in ("", ".", "..") and not plain.startswith("_"):
        return plain
    # Equal after the exchange, so a mark of the whole name follows.
    return f"{plain.strip('_.') or 'x'}-{hashlib.sha256(name.encode()).hexdigest()[:8]}"


def column_set(columns: Iterable[str]) -> str:
    """The key of a set of columns, whatever their order."""
    return hashlib.sha256("\u0001".join(sorted(columns)).encode()).hexdigest()[:16]


@dataclass
class ResultStore:
    """Saved runs below a folder."""

    spark: SparkSession
    folder: str

    def save(self, run: str, sets: list[tuple[list[str], dict[str, DataFrame]]], common: dict[str, DataFrame] | None = None) -> str:
        """Write the tables of each column set, and ``common`` ones of the whole run; then publish them together.

        A run may be saved more than once; its newest save is the one that is read.
        Until the manifest file is there, none of the tables can be seen.
        """
        save = uuid.uuid4().hex
        root = f"{self.folder.rstrip('/')}/data/{plain_name(run)}/{save}"
        rows, writes = [], []
        for number, (columns, tables) in enumerate([*sets, ([], common or {})]):
            for name, df in tables.items():
                path = f"{root}/{number}/{plain_name(name)}"
                nested = any(f.dataType.simpleString().startswith(("array", "struct", "map")) for f in df.schema.fields)
                writer = df.write.format("parquet")
                by_station = "station" in df.columns and not nested and len(df.columns) > 1
                writes.append(partial((writer.partitionBy("station") if by_station else writer).save, path))
                rows.append((run, save, column_set(columns) if columns else "", sorted(columns), name, path, "parquet"))
        side_by_side(writes)
        listed = self.spark.createDataFrame(rows, "run string, save string, column_set string, columns array<string>, name string, path string, format string")
        # One task, so one file: it is either there as a whole or not at all.
        (listed.withColumn("saved_at", F.current_timestamp()).select(*[c.split()[0] for c in MANIFEST_SCHEMA.split(", ")])
         .coalesce(1).write.parquet(f"{self.folder.rstrip('/')}/manifest/{save}"))
        return save

    def manifest(self) -> DataFrame:
        """Every published table of every save."""
        base = f"{self.folder.rstrip('/')}/manifest"
        if not artefacts._exists(self.spark, base):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", "true").parquet(base)

    def runs(self) -> DataFrame:
        """``(run, save, saved_at)``: the newest save of each run."""
        saves = self.manifest().select("run", "save", "saved_at").distinct()
        newest = Window.partitionBy("run").orderBy(F.desc("saved_at"), F.desc("save"))
        return saves.withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at")

    def tables(self, run: str | None = None) -> DataFrame:
        """The manifest rows of a run's newest save; of the run saved last if none is named."""
        runs = self.runs()
        chosen = runs.where(F.col("run") == run) if run is not None else runs.orderBy(F.desc("saved_at"), F.desc("save")).limit(1)
        return self.manifest().join(chosen.select("save"), "save", "left_semi")

    def read(self, name: str, run: str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """A table of a run over all its column sets, or of the set of ``columns`` alone.

        Columns that a set lacks are NULL in its rows.
        """
        found = self.tables(run).where(F.col("name") == name)
        if columns is not None:
            found = found.where(F.col("column_set") == column_set(columns))
        # One row per table and column set, whatever the number of stations.
        parts = [self.spark.read.format(r["format"]).load(r["path"]) for r in found.orderBy("column_set").collect()]
        if not parts:
            raise KeyError(f"no table {name!r} in {self.folder}" + (f" for run {run!r}" if run else ""))
        parts = [p.withColumn("station", F.col("station").cast("string")) if "station" in p.columns else p for p in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def metadata(spark: SparkSession, run: str, settings: dict) -> DataFrame:
    """One row on how a run was made."""
    return spark.createDataFrame(
        [(run, settings.get("random_seed"), platform.system(), platform.python_version(), spark.version, json.dumps(settings, sort_keys=True))],
        "run string, random_seed long, platform string, python_version string, spark_version string, settings string")


def global_report(store: ResultStore, run: str | None = None) -> DataFrame:
    """One row per station of a run, whatever its columns: profile, densities and model distances side by side."""
    profile = store.read("comparison", run)
    density = store.read("density", run)
    distance = store.read("distance", run)
    named = density.select("station", *[F.col(c).alias(f"{c}_density") for c in density.columns if c != "station"])
    return profile.join(named, "station", "left").join(distance, "station", "left")
