"""A project's settings, the names it gives, its shapes, and a check of it all."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators import shacl
from quadloom.operators.store import QuadStore


def slugified(name: Column) -> Column:
    """Names as ids: lower case, runs of other than letters and digits as one hyphen, none at an end."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def slugify(name: str) -> str:
    return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", name.lower()))


@dataclass
class Settings:
    """Where a project's store lies, its main graph, further graphs by name, and its folder of shapes."""

    project: str
    graph: str
    store: str
    graphs: dict[str, str] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)
    shapes: str | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Settings:
        """From a JSON file, wherever Spark can read; ValueError tells what is wrong with it."""
        try:
            text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
            found = json.loads(text)
            return cls(**found)
        except AnalysisException as e:
            raise ValueError(f"no settings at {path}") from e
        except (json.JSONDecodeError, TypeError) as e:
            raise ValueError(f"settings at {path} can't be read: {e}") from e

    def opened(self, spark: SparkSession) -> QuadStore:
        return QuadStore.opened(spark, self.store, catalog=dict(self.graphs), prefixes=dict(self.prefixes))


def shape_texts(spark: SparkSession, folder: str) -> list[str]:
    """The Turtle files of a folder of shapes, by name; none if there is no such folder. Shapes are few and small."""
    try:
        rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.ttl").text(folder).select("value", F.col("_metadata.file_path").alias("path"))
        return [r.value for r in rows.orderBy("path").collect()]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


@dataclass
class Report:
    conforms: bool
    violations: DataFrame | None
    note: str | None = None


def checked(quads: DataFrame, texts: list[str]) -> Report:
    """Quads against the shapes of all these texts; without any it conforms, and the note says so."""
    if not texts:
        return Report(True, None, "no shapes found")
    found = shacl.validate(quads, texts)
    return Report(found.isEmpty(), found)


def doctor(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(check, ok, warn or fail, message): settings, store, graphs, shapes. Without settings nothing else is checked."""
    try:
        settings = Settings.load(spark, path)
    except ValueError as e:
        return [("settings", "fail", str(e))]
    out = [("settings", "ok", f"project {settings.project}")]
    try:
        store = settings.opened(spark)
        out.append(("store", "ok", f"{store.count(settings.graph)} triples in {settings.graph}"))
    except AnalysisException as e:
        return [*out, ("store", "fail", f"no store at {settings.store}: {e.getCondition()}")]
    missing = [name for name in ("context", "sessions") if name not in settings.graphs]
    out.append(("graphs", "warn", f"not set up: {', '.join(missing)}") if missing else ("graphs", "ok", ", ".join(sorted(settings.graphs))))
    texts = shape_texts(spark, settings.shapes) if settings.shapes else []
    if not texts:
        return [*out, ("shapes", "warn", "no shapes found")]
    report = checked(store.graph(settings.graph), texts)
    return [*out, ("shapes", "ok", f"{len(texts)} files, all conforms") if report.conforms else ("shapes", "fail", f"{report.violations.count()} violations")]
