"""Fixed cases of small operators, by hand; the registered queries run them over tables."""

from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.operators import app, extract, rdfs, scan, schema, shacl
from quadloom.operators.store import QuadStore, slug, slugs
from quadloom.sources import turtle
from quadloom.sources.mapping import BASE


def column(spark, make, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.x for r in rows.select("i", make(F.col("text")).alias("x")).orderBy("i").collect()]


def test_keywords(spark):
    found = column(spark, extract.keywords, "please show src/lib/store.ts and the parseQuery function", "persistGraph에서 에러가 났어요 Foo_bar FOO_BAR abc", "why? TypeError: x/y", "one two three four five sixx seven", None)
    assert found == [["src/lib/store", "parsequery", "function"], ["persistgraph", "에러가", "났어요", "foo_bar"], ["typeerror", "TypeError", "x/y"], ["three", "four", "five", "sixx", "seven"], None]


def test_error_keywords(spark):
    found = column(spark, extract.error_keywords, "TypeError: Cannot find module './x' (TS2307) in src/a.ts", "no sign of it in src/a.ts TS2307", "npm ERR! @scope/pkg and error ab, error lodash", "fatal: lib/a.b src/c.d src/e.f src/g.h", "FAILED src/x.y")
    assert found == [["TypeError", "TS2307", "./x", "src/a.ts"], [], ["@scope/pkg"], ["lib/a.b", "src/c.d", "src/e.f"], ["src/x.y"]]


def test_samples_and_groups(spark):
    files = [(f"src/{k}.rb", "\n".join(map(str, range(40)))) for k in range(3)] + [("src/main.rb", "m"), ("k.KT", ""), ("a.ts", "")] + [(f"{x}/{k}.{x}", x) for x in ("lua", "zig", "jl", "hs") for k in range(2)]
    rows = spark.createDataFrame(files, "path string, text string")
    languages = {".rb": "ruby", ".kt": "kotlin", ".lua": "lua", ".zig": "zig", ".jl": "julia", ".hs": "haskell"}
    found = {(r.extension, r.path): r.text for r in scan.samples(rows, languages).collect()}
    assert set(found) == {(".rb", "src/main.rb"), (".rb", "src/0.rb")} | {(f".{x}", f"{x}/{k}.{x}") for x in ("lua", "zig", "jl", "hs") for k in range(2)}
    assert found[".rb", "src/0.rb"] == "\n".join(map(str, range(30)))


def test_a_report_is_cut_only_as_far_as_needed():
    facts = {"entryPoints": [{"path": "a", "content": "x\n" * 400}], "readme": "r\n" * 200, "directoryTree": [{"path": f"a/b/{k}", "depth": 3} for k in range(10)] + [{"path": "a", "depth": 2}], "detectedImports": ["p"] * 5, "dependencyGraph": {"edges": []}}
    rows = []
    for most in (100_000, 1200, 500, 60):
        out = scan.snapshot(facts, most)
        rows.append((most, len(out["detectedImports"]), max(x["depth"] for x in out["directoryTree"]), out["dependencyGraph"] is not None))
    assert rows == [(100_000, 5, 3, True), (1200, 5, 3, True), (500, 5, 2, True), (60, 0, 2, False)]


def test_names(spark):
    iris = {
        "http://www.w3.org/2000/01/rdf-schema#Class": ("rdfs:Class", "Class", "http_www_w3_org_2000_01_rdf-schema_Class"), "http://schema.org/Person": ("schema:Person", "Person", "http_schema_org_Person"),
        "http://e.org/x#Foo": ("Foo", "Foo", "http_e_org_x_Foo"), "http://e.org/a/b": ("b", "b", "http_e_org_a_b"), "urn:x": ("urn:x", "urn:x", "urn_x"),
    }
    assert list(zip(column(spark, T.shorten, *iris), column(spark, T.local_name, *iris), column(spark, slugs, *iris))) == list(iris.values())
    assert [slug(x) for x in iris] == [x[2] for x in iris.values()]
    paths = {"src/a.ts": "urn:module:src/a", "src/a.jsx": "urn:module:src/a", "urn:module:src/a.tsx": "urn:module:src/a", "a.json": "urn:module:a.json", "a.md": "urn:module:a.md"}
    assert column(spark, scan.module_iri, *paths) == list(paths.values()) == [app.module_iri(p) for p in paths]


def test_turtle_texts(spark):
    assert turtle.validate("@prefix e: <http://e.org/> . e:a e:p e:b, e:c .")["tripleCount"] == 2 and turtle.validate("")["tripleCount"] == 0
    assert not turtle.validate("garbage here")["valid"] and not turtle.validate_file("/nowhere/none.ttl")["valid"]
    rows = spark.createDataFrame([("a", "<urn:a> <urn:p> _:x ."), ("b", "<urn:a> <urn:p> _:x ."), ("c", None), ("d", "")], "path string, text string")
    assert turtle.parsed(rows, "g").select("o").distinct().count() == 2  # blank nodes are those of their document
    assert sorted((r.path, r.valid, r.triple_count) for r in turtle.validated(rows).collect()) == [("a", True, 1), ("b", True, 1), ("c", True, 0), ("d", True, 0)]


def test_nothing_is_concluded_of_the_vocabularies(spark):
    text = f"@prefix rdfs: <{T.RDFS}> . @prefix : <{BASE}> . rdfs:label rdfs:domain :Thing . rdfs:Class rdfs:label \"x\" . :p rdfs:range :Thing . :a :p rdfs:Resource . rdfs:Class a :Customer . :Customer rdfs:subClassOf :Party ."
    assert rdfs.infer(turtle.quads(spark, text, "")).filter(rdfs.meta(F.col("s"))).isEmpty()


def test_languages_of_labels(spark):
    data = turtle.quads(spark, f'@prefix : <{BASE}> . <urn:a> a :T ; :l "x"@en, "y"@en, "z"@fr . <urn:b> a :T ; :l "x"@de . <urn:c> a :T ; :l "x"@en .', "")
    shapes = f'@prefix sh: <{shacl.SH}> . @prefix : <{BASE}> . :S a sh:NodeShape ; sh:targetClass :T ; sh:property [ sh:path :l ; sh:uniqueLang true ; sh:languageIn ( "en" "fr" ) ] .'
    assert sorted((r.focus_node, r.component) for r in shacl.validate(data, shapes).collect()) == [("urn:a", "UniqueLangConstraintComponent"), ("urn:b", "LanguageInConstraintComponent")]


def test_drawings(spark):
    data = turtle.quads(spark, f"@prefix : <{BASE}> . @prefix rdfs: <{T.RDFS}> . :placedBy a <{T.RDF}Property> ; rdfs:domain :Order ; rdfs:range :Customer .", "")
    nodes, edges = schema.schema_graph(data)
    assert schema.drawing(nodes.limit(0), edges, "dot").split("\n") == ["digraph G {", "  // Empty graph", "}"]
    assert schema.drawing(nodes.filter(~rdfs.meta(F.col("id"))), edges, most=2).split("\n")[1] == "  %% WARNING: Truncated to 2 of 3 nodes"


def test_pushing_over_a_limit_or_against_shapes(spark):
    for n in (1, 100, 101):
        store = QuadStore(spark)
        try:
            store.push(" ".join(f"<urn:s{i}> <urn:p> <urn:o> ." for i in range(n)), "g", limit=100, infer=False)
            assert n <= 100 and store.count("g") == n
        except ValueError as e:
            assert n > 100 and "101" in str(e) and store.count("g") == 0


def test_ways_to_a_value(spark):
    text = f"""@prefix : <{BASE}> . :c a :C ; :has :x , :y , :z ; :kept :x . :x :price 9 ; :next :y . :y :price 9 ; :next :x . :z :price 8 ."""
    data = turtle.quads(spark, text, "").unionByName(turtle.quads(spark, text, "another"))
    shapes = f"@prefix sh: <{shacl.SH}> . @prefix : <{BASE}> . :S sh:targetClass :C ; sh:property [ sh:path ( {{}} :price ) ; sh:maxInclusive 8 ; sh:maxCount 1 ] ."

    def found(step, each):
        return sorted(r.component[:6] for r in shacl.validate(data, shapes.format(step), each=each).collect())

    assert found(":has", False) == ["MaxCou", "MaxInc"] and found(":has", True) == ["MaxCou", "MaxInc", "MaxInc"]
    # x and y by :has, x by :kept; the closing paths give x and y from each of x, y and z's own node gives z
    assert found("[ sh:alternativePath ( :has :kept ) ]", True) == ["MaxCou"] + ["MaxInc"] * 3
    assert found(":has [ sh:zeroOrMorePath :next ]", True) == ["MaxCou"] + ["MaxInc"] * 4
    assert found(":has [ sh:oneOrMorePath :next ]", True) == ["MaxInc"] * 4
    assert found(":has [ sh:zeroOrOnePath :next ]", True) == ["MaxCou"] + ["MaxInc"] * 4
    assert found(":has [ sh:zeroOrMorePath :next ]", False) == ["MaxCou", "MaxInc"]


def test_each_order_of_a_price_is_told(spark, tmp_path):
    """Two orders of a customer over 400,000 at one price: the registered query gives the rows of its SQL."""
    import duckdb

    import __spark_entry__

    for name, sql in {
        "customer": "SELECT range AS c_custkey, 'n' AS c_name, CAST(range AS INTEGER) AS c_nationkey, 1.0::DOUBLE AS c_acctbal, 'm' AS c_mktsegment FROM range(3)",
        "orders": "SELECT range AS o_orderkey, range % 2 AS o_custkey, 'F' AS o_orderstatus, CASE WHEN range < 6 THEN 450000.5 ELSE 390000 + range END::DOUBLE AS o_totalprice, TIMESTAMP '1996-01-01' + INTERVAL 1 DAY * (range % 5) AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(27)",
        "nation": "SELECT * FROM '/root/testdata/sf0.001/nation.parquet'",
        "region": "SELECT * FROM '/root/testdata/sf0.001/region.parquet'",
    }.items():
        duckdb.sql(sql).write_parquet(f"{tmp_path}/{name}.parquet")
    duck = duckdb.connect()
    for name in ("customer", "orders", "nation", "region"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    wanted = duck.execute(__spark_entry__.oracle_sql()["shacl_paths"]).fetchall()
    found = [tuple(r) for r in __spark_entry__.queries()["shacl_paths"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(wanted) and sum("Inclusive" in r[2] for r in found) == 6
