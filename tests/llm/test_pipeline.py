"""Stages of the corpus pipeline on small inputs."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from quadloom.llm import hash_forest, mixing, packing, queries

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def brute(texts, n, num, den):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    return comp


def test_mixing_keeps_the_words_of_each_source(spark):
    rng = random.Random(6)
    sizes = [rng.choice([1, 5, 40, 300, 2000]) for _ in range(400)] + [0, 0]
    data = [(None if i % 50 == 0 else i, " ".join([f"d{i}"] * n), None if i % 7 == 0 else ("big", "mid", "small")[i % 3]) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(data, DOCS)
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    goal = {r.source_size: r.target for r in mixing.taken(docs, corpus_pipeline.MIX_BLOCK).collect()}
    assert len(goal) == 4
    for source in ("big", "mid", "small", None):
        own = sum(len(t.split()) for _, t, s in data if s == source)
        kept = sum(len(r.text.split()) for r in got if r.source == source)
        assert abs(kept - goal[own]) <= 2000 + corpus_pipeline.MIX_BLOCK
    assert {(r.doc_id, r.text, r.source) for r in got} <= set(data)
    assert any(r.doc_id is None for r in got)


def test_copies_round_up_or_down_and_bound_the_error(spark):
    rng = random.Random(7)
    rows = []
    for source, rate in (("a", 0.36), ("b", 1.9), ("c", 3.0)):
        for i in range(300):
            size = rng.choice([1, 30, 500, 9000])
            rows.append((i, source, size, min(3 * size, round(size * rate * rng.uniform(0.5, 1.2)))))
    found = {(r.doc_id, r.skey): r.copies for r in mixing.copies(spark.createDataFrame(rows, "doc_id long, skey string, size long, taken long")).collect()}
    for source in "abc":
        own = [(found.get((i, s), 0), n, t) for i, s, n, t in rows if s == source]
        assert all(t // n <= k <= t // n + 1 for k, n, t in own)
        assert abs(sum(k * n for k, n, t in own) - sum(t for _, _, t in own)) <= 9000


def test_registered_packing_and_its_ids(spark):
    got = {(r.doc_id, r.start): r for r in queries.op4_best_fit_packing(spark, SMALL).collect()}
    tok, pieces = packing.tokenizer(queries.tokenizer_path("word_bpe_49k.json")), 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").dropDuplicates(["doc_id"]).collect()
    for r in docs:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], np.uint32)
        at = 0
        while at < len(ids):
            piece = got[r.doc_id, at]
            assert zlib.crc32(ids[at : at + piece.length].tobytes()) == piece.ids_crc32
            at, pieces = at + piece.length, pieces + 1
    assert pieces == len(got)


def test_neighbours_at_production_parameters(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").limit(3000)
    found = hash_forest.nearest(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20).collect()
    held = rows.collect()
    ids, data = np.array([r.vec_id for r in held]), np.array([r.embedding for r in held], float)
    mine, hits, total = {}, 0, 0
    for r in found:
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    for i in np.flatnonzero(ids % 20 == 0):
        near = data @ data[i]
        near[i] = -np.inf
        best = set(ids[np.argsort(-near)[:20]].tolist())
        hits, total = hits + len(best & mine[int(ids[i])]), total + len(best)
    assert len(held) > 2 * hash_forest.PROBE_LEAST and hits / total >= 0.9


def test_near_duplicate_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").dropDuplicates(["doc_id"]).orderBy("doc_id")
    held = docs.collect()
    comp = brute([r.text for r in held], 5, 80, 100)
    kept = corpus_pipeline.ngram_jaccard(spark, docs.unionByName(docs.limit(3)), SMALL).collect()
    assert sorted(r.doc_id for r in kept) == [r.doc_id for i, r in enumerate(held) if comp[i] == i]


CLASHING = "doc_id long, text string, lang string, source string, score string, predicted string, _copies string, _copy string, _row string, kept string, n_words string, component_id string, held_out string"


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and names that operators use."""
    words = [f"word{k}" for k in range(400)]
    rng = random.Random(4)
    plain = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    texts = [None, "", " \n\t ", "one", "long " * 30_000, " ".join(words * 40), *plain, plain[0], plain[0]]
    rows = [(k, t, "en", f"s{k % 3}", "score", "predicted", "c", "d", "row", "kept", "n", "c", "h") for k, t in enumerate(texts)]
    rows += [rows[7], (None,) * 13, (None, plain[1], *[None] * 11)]
    return spark.createDataFrame(rows, CLASHING)


def test_stages_on_odd_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.schema.simpleString() == docs.schema.simpleString(), name
        assert set(kept.collect()) <= set(docs.collect())
        if name in ("quality_classifier", "toxicity"):  # nothing was learnt, so nothing goes
            assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, str(tmp_path)).filter("piece = 0").count() == docs.count()
    assert last(spark, docs.limit(0), str(tmp_path)).count() == 0


def labelled(spark, folder, n=600):
    """Toxic texts hold a bad word or its misspelling, poor ones are shouted; every third row has no label."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([20, 80, 300]))]
        toxic, poor = k % 5 == 0, k % 7 == 0
        if toxic:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgblat", "zorgblatt", "xzorgblat"]))
        text = " ".join(words)
        docs.append((k, text.upper() if poor else text, "en", "s", 0))
        if k % 3:
            labels.append((k, int(not poor), int(toxic)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_registered_classifiers_on_rows_held_out(spark, tmp_path):
    labelled(spark, tmp_path)
    for query, modulus, remainder, truth in ((queries.op2_toxicity, 4, 2, lambda k: k % 5 == 0), (queries.op3_quality, 5, 0, lambda k: k % 7 != 0)):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == 600 and rows[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
        unseen = [r for r in rows if r.held_out or r.doc_id % 3 == 0]
        for label in (True, False):
            assert np.mean([bool(r.predicted) == label for r in unseen if truth(r.doc_id) == label]) > 0.95
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stays in (("quality_classifier", lambda k: k % 7 != 0), ("toxicity", lambda k: k % 5 != 0)):
        kept = {r.doc_id for r in stages[name](spark, docs, str(tmp_path)).collect()}
        assert np.mean([(k in kept) == stays(k) for k in range(600)]) > 0.97


def test_null_ids_are_scored_and_not_held_out(spark, tmp_path):
    labelled(spark, tmp_path, 60)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/more/labels.parquet")
    for query in (queries.op2_toxicity, queries.op3_quality):
        (row,) = query(spark, f"{tmp_path}/more").filter("doc_id is null").collect()
        assert row.held_out is False and 0 <= row.score <= 1


def test_repetition_names_and_order(spark):
    docs = odd_documents(spark)
    from quadloom.llm import repetition

    out = repetition.judged(docs.select("doc_id", "text", "kept", "n_words", "lang"))
    assert out.columns == ["doc_id", "text", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"]
    for r in out.collect():
        words, lines = WORD.findall(r.text or ""), [x for x in (r.text or "").split("\n") if WORD.search(x)]
        windows = {}
        for i in range(len(words) - 4):
            windows.setdefault(tuple(words[i : i + 5]), []).append(i)
        again = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 10 or 100 * len(again) > 20 * len(words)) and (not r.kept or not r.base_failed)
    assert repetition.judged(docs.limit(0)).count() == 0
