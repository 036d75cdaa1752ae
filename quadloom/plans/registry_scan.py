"""Queries of whole scans of code bases that the given tables are turned into, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.operators import deep_scan, project, shacl
from quadloom.operators.store import QuadStore
from quadloom.plans.registry import _table, register
from quadloom.plans.registry_ops import _folder
from quadloom.sources.mapping import BASE, shop


def _written(text: str, **columns) -> F.Column:
    """A text with #name# replaced by columns."""
    out = F.lit(text)
    for name, column in columns.items():
        out = F.replace(out, F.lit(f"#{name}#"), column.cast("string"))
    return out


_NATION = "import sys\nclass Base:\n    def held(self): pass\n    def both(self): pass\ndef f(x):\n    return sys.exit(x)\n"
_CUSTOMER = """from src.n#n# import f as g, Base
import src.n#n# as mod
from . import util
class C#k#(Base):
    def both(self): return self.held()
    def go(self):
        self.both(); mod.f(1); Base.held(self); util.aid()
        return g(print(2))
def h():
    C#k#.go(None); nobody(3); mod.nothing()
"""
_GO = "package p\n\ntype S#k# struct {\n}\n\ntype I#k# interface {\n}\n\nfunc F#k#(a int) int {\n\treturn a\n}\n\nfunc (s *S#k#) M#k#() {}\n"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as Python modules, customers as Python modules that use them, suppliers as Go, parts as Ruby."""
    customers, nations, suppliers, parts = (_table(spark, sf_dir, x) for x in ("customer", "nation", "supplier", "part"))
    k = F.col("c_custkey")
    rows = customers.select(_written("src/c/c#k#.py", k=k).alias("path"), _written(_CUSTOMER, k=k, n=F.col("c_nationkey")).alias("text"))
    rows = rows.unionAll(nations.select(_written("src/n#k#.py", k=F.col("n_nationkey")), F.lit(_NATION)))
    rows = rows.unionAll(suppliers.select(_written("pkg/s#k#.go", k=F.col("s_suppkey")), _written(_GO, k=F.col("s_suppkey"))))
    rows = rows.unionAll(parts.select(_written("rb/p#k#.rb", k=F.col("p_partkey")), F.lit("x = 1")))
    return rows.unionAll(nations.filter("n_nationkey = 0").select(F.lit("src/c/util.py"), F.lit("def aid(): pass"))).unionAll(nations.select(_written("node_modules/m#k#.py", k=F.col("n_nationkey")), F.lit("def lost(): pass")))


@register(
    "scan_deep",
    """SELECT 'python' AS language, 'src/c/c' || c_custkey || '.py' AS path, kind, replace(name, '#', CAST(c_custkey AS VARCHAR)) AS name FROM customer, (VALUES ('Class', 'C#'), ('Method', 'both'), ('Method', 'go'), ('Function', 'h')) v(kind, name)
    UNION ALL SELECT 'python', 'src/n' || n_nationkey || '.py', kind, name FROM nation, (VALUES ('Class', 'Base'), ('Method', 'held'), ('Method', 'both'), ('Function', 'f')) v(kind, name)
    UNION ALL SELECT 'python', 'src/c/util.py', 'Function', 'aid'
    UNION ALL SELECT 'go', 'pkg/s' || s_suppkey || '.go', kind, name || s_suppkey FROM supplier, (VALUES ('Class', 'S'), ('Interface', 'I'), ('Function', 'F'), ('Method', 'M')) v(kind, name)""",
)
def scan_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols, without limits."""
    return deep_scan.scan(_files(spark, sf_dir), most_files=None, most_symbols=None).symbols.select("language", "path", "kind", "name")


@register(
    "scan_deep_capped",
    """WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM part) AS p)
    SELECT 'over' AS scan, c + n + s + 1 AS files, CAST(0 AS BIGINT) AS symbols, true AS capped, CAST(1 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS unsupported FROM n
    UNION ALL SELECT 'under', c + n + s + 1, CAST(60 + least(60, 4 * s) AS BIGINT), true, CAST(1 + CASE WHEN 4 * s > 60 THEN 1 ELSE 0 END AS BIGINT), p FROM n""",
)
def scan_deep_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the limit of files: empty, with the true total. Under it: so many symbols of each language."""
    files, rows = _files(spark, sf_dir), []
    for name, most in (("over", 10), ("under", 10**9)):
        found = deep_scan.scan(files, most_files=most, most_symbols=60)
        assert found.symbols.count() == found.symbol_count
        rows.append((name, found.file_count, found.symbol_count, found.capped, len(found.warnings), found.unsupported.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]))
    return spark.createDataFrame(rows, "scan string, files bigint, symbols bigint, capped boolean, warnings bigint, unsupported bigint")


@register(
    "scan_cross_file_calls",
    """SELECT 'src/c/c' || c_custkey || '.py' AS path, replace(caller, '#', CAST(c_custkey AS VARCHAR)) AS caller,
      CASE file WHEN 'nation' THEN 'src/n' || c_nationkey || '.py' WHEN 'util' THEN 'src/c/util.py' ELSE 'src/c/c' || c_custkey || '.py' END AS callee_path, replace(callee, '#', CAST(c_custkey AS VARCHAR)) AS callee
    FROM customer, (VALUES ('C#.both', 'nation', 'Base.held'), ('C#.go', 'own', 'C#.both'), ('C#.go', 'nation', 'f'), ('C#.go', 'nation', 'Base.held'), ('C#.go', 'util', 'aid'), ('h', 'own', 'C#.go')) v(caller, file, callee)""",
)
def scan_cross_file_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls through imports, aliases, a relative import, a class and a base class; built-ins and unknown names have no callee."""
    return deep_scan.scan(_files(spark, sf_dir), most_files=None, most_symbols=None, calls=True).calls


@register("scan_symbol_totals", "SELECT 'src/c/c' || c_custkey || '.py' AS path, CAST(4 AS BIGINT) AS symbols, CAST(2 AS BIGINT) AS methods FROM customer UNION ALL SELECT 'src/n' || n_nationkey || '.py', 4, 2 FROM nation UNION ALL SELECT 'src/c/util.py', 1, 0 UNION ALL SELECT 'pkg/s' || s_suppkey || '.go', 4, 1 FROM supplier")
def scan_symbol_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep_scan.symbol_totals(deep_scan.scan(_files(spark, sf_dir), most_files=None, most_symbols=None).symbols)


@register(
    "scan_tracked",
    """SELECT 'a' AS path UNION ALL SELECT DISTINCT 'a/n' || c_nationkey FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey <> 7
    UNION ALL SELECT 'a/n' || c_nationkey || '/c' || c_custkey || '.ts' FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey <> 7""",
)
def scan_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files in their nations' folders; every third is tracked, and one nation's folder is one of builds."""
    folder = F.when(F.col("c_nationkey") == 7, "a/build").otherwise(_written("a/n#n#", n=F.col("c_nationkey")))
    files = _table(spark, sf_dir, "customer").select(F.concat(folder, _written("/c#k#.ts", k=F.col("c_custkey"))).alias("path"), "c_custkey")
    every = files.select(F.explode(deep_scan.ancestors(F.col("path"))).alias("path")).distinct()
    return deep_scan.tracked(every, files.filter("c_custkey % 3 = 0").select("path"))


@register("scan_commit_probe", "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN count(*) = 1 THEN min(event_type) ELSE count(*) || ' commits' END AS title, bool_or(event_id % 4 = 0) AS changed FROM events WHERE strftime(ts, '%Y-%m-%d') > '2024-01-20' GROUP BY 1")
def scan_commit_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits, every fourth of a source file: the days after one, and whether each of them changed the sources."""
    events, day = _table(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd")
    days = deep_scan.days_since(events.select(F.concat_ws("|", day, "event_type").alias("value")).unionAll(events.limit(3).select(F.lit("no separator"))), "2024-01-20")
    commits = events.select(day.alias("day"), F.array(F.when(F.col("event_id") % 4 == 0, _written("src/x#k#.py", k=F.col("event_id"))).otherwise("docs/readme.md")).alias("files"))
    return days.select("day", "title").join(deep_scan.changes_by_day(commits), "day", "left").select("day", "title", F.coalesce("changed", F.lit(False)).alias("changed"))


@register(
    "project_doctor",
    f"""SELECT 'settings' AS "check", 'ok' AS status, 'project customers-of-the-shop' AS message
    UNION ALL SELECT 'store', 'ok', (2 * (SELECT count(*) FROM customer)) || ' triples in urn:g:main'
    UNION ALL SELECT 'graphs', 'warn', 'not set up: sessions'
    UNION ALL SELECT 'shapes', CASE WHEN n = 0 THEN 'ok' ELSE 'fail' END, CASE WHEN n = 0 THEN '2 files, all conforms' ELSE n || ' violations' END FROM (
      SELECT count(*) FILTER (c_acctbal < 0) + count(*) FILTER (c_acctbal > 9000) AS n FROM customer)""",
)
def project_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings, store and shapes of a project of the customers, written and read by Spark."""
    folder = _folder(spark)
    data = shop(spark, sf_dir, ["customer"], "urn:g:main").filter(F.col("p").isin(T.RDF + "type", BASE + "c_acctbal"))
    QuadStore(spark, data).save(f"{folder}/store")
    head = f"@prefix sh: <{shacl.SH}> . @prefix : <{BASE}> ."
    shapes = [(f"{head} _:s a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path :c_acctbal ; sh:{x} ] .",) for x in ("minInclusive 0", "maxInclusive 9000")]
    for k, row in enumerate(shapes):
        spark.createDataFrame([row], "value string").coalesce(1).write.text(f"{folder}/shapes/{k}")
    found = [r.value for k in range(2) for r in spark.read.option("wholetext", True).text(f"{folder}/shapes/{k}").collect()]
    settings = {"project": project.slugify("Customers of the shop!"), "graph": "urn:g:main", "store": f"{folder}/store", "graphs": {"context": "urn:g:main/context"}, "shapes": f"{folder}/none"}
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.text(f"{folder}/settings")
    rows = [x for x in project.doctor(spark, f"{folder}/settings") if x[0] != "shapes"]
    report = project.checked(project.Settings.load(spark, f"{folder}/settings").opened(spark).graph("urn:g:main"), found)
    rows.append(("shapes", "ok", f"{len(found)} files, all conforms") if report.conforms else ("shapes", "fail", f"{report.violations.count()} violations"))
    return spark.createDataFrame(rows, "check string, status string, message string")


@register("project_slugs", "SELECT p_partkey AS part, regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def project_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), project.slugified(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))
