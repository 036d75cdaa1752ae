"""Whole scans by hand: dispatch, caps, calls across files, tracked paths, the commit log."""

import pytest
from pyspark.sql import functions as F

from quadloom.operators import deep_scan

FILES = {
    "pkg/__init__.py": "",
    "pkg/a.py": "import pkg.b\nimport pkg.b as bee\nfrom .b import B, helper\nfrom . import b\nclass A(B):\n    def run(self):\n        self.step(); self.own(); cls.x()\n    def own(self): helper()\ndef main():\n    bee.helper(); b.helper(); B.step(None); A.run(None); nowhere(); len([])\n",
    "pkg/b.py": "class B:\n    def step(self): return helper()\ndef helper(): pass\n",
    "pkg/c.py": "import pkg.b as b\nfrom pkg import a as other\nclass C(b.B):\n    def go(self): self.step(); other.main()\n",
    "broken.py": "def f(:\n",
    "x/main.go": "type T struct {\n}\nfunc F() {}\n",
    "x/y.kt": "class K",
    "x/z.ts": "export class Z {}\n",
    "node_modules/q.py": "def q(): pass\n",
    "x/dist/w.py": "def w(): pass\n",
}


def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, text string")


def test_symbols_calls_and_hints(spark):
    found = deep_scan.scan(files(spark), calls=True)
    symbols = {(r.language, r.path, r.name) for r in found.symbols.collect()}
    assert {("go", "x/main.go", "T"), ("go", "x/main.go", "F"), ("typescript", "x/z.ts", "Z"), ("python", "pkg/b.py", "helper")} <= symbols and not any("q.py" in s[1] or "w.py" in s[1] for s in symbols)
    assert (found.file_count, found.symbol_count, found.capped, found.warnings) == (7, len(symbols), False, [])
    assert [(r.extension, r["count"]) for r in found.unsupported.collect()] == [(".kt", 1)]
    assert [h["language"] for h in found.hints if h["moduleScanApplicable"]] == ["typescript", "python", "rust"]
    calls = {(r.path, r.caller, r.callee_path, r.callee) for r in found.calls.collect()}
    assert calls == {
        ("pkg/a.py", "A.run", "pkg/b.py", "B.step"), ("pkg/a.py", "A.run", "pkg/a.py", "A.own"), ("pkg/a.py", "A.own", "pkg/b.py", "helper"), ("pkg/a.py", "main", "pkg/b.py", "helper"), ("pkg/a.py", "main", "pkg/b.py", "B.step"),
        ("pkg/a.py", "main", "pkg/a.py", "A.run"), ("pkg/b.py", "B.step", "pkg/b.py", "helper"), ("pkg/c.py", "C.go", "pkg/b.py", "B.step"), ("pkg/c.py", "C.go", "pkg/a.py", "main"),
    }


def test_caps(spark):
    over = deep_scan.scan(files(spark), most_files=6)
    assert over.symbols.isEmpty() and (over.file_count, over.symbol_count, over.capped) == (7, 0, True) and over.warnings == ["File count 7 exceeds maxFiles 6. Scan skipped."]
    under = deep_scan.scan(files(spark), most_symbols=2)
    assert under.capped and under.warnings == ["python: 9 symbols exceed maxSymbols 2."] and under.symbols.filter("language = 'python'").count() == 2 and under.symbol_count == under.symbols.count() == 5
    with pytest.raises(ValueError):
        deep_scan.scan(files(spark), languages=[])


def test_tracked_paths(spark):
    paths = spark.createDataFrame([("src",), ("src/a",), ("src/a/x.ts",), ("src/ab",), ("lost",), ("build/x.ts",)], "path string")
    manifest = spark.createDataFrame([("src/a/x.ts",), ("build/x.ts",)], "path string")
    rows = lambda m: sorted(r.path for r in deep_scan.tracked(paths, m).collect())
    assert rows(manifest) == ["src", "src/a", "src/a/x.ts"] and rows(None) == ["lost", "src", "src/a", "src/a/x.ts", "src/ab"] and rows(manifest.limit(0)) == []


def test_commit_log(spark):
    log = spark.createDataFrame([(x,) for x in ("2024-03-01| first | thing", "2024-03-02|second", "2024-03-02|third", "no separator", "2024-03-03|", None)], "value string")
    rows = lambda df: {r.day: (r.title, r.body) for r in df.collect()}
    assert rows(deep_scan.days_since(log, "2024-03-01")) == {"2024-03-02": ("2 commits", "second; third")}
    assert rows(deep_scan.days_since(log, None, F.lit("2024-03-08").cast("date"))) == {"2024-03-01": ("first | thing", "first | thing"), "2024-03-02": ("2 commits", "second; third")}
    commits = spark.createDataFrame([("2024-03-01", ["a.py"]), ("2024-03-02", ["a.md", "py"])], "day string, files array<string>")
    assert deep_scan.source_changed(commits, "2024-02-01") and not deep_scan.source_changed(commits, "2024-03-01") and deep_scan.source_changed(commits, None) and deep_scan.source_changed(None, "2024-03-01")
