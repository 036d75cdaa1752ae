"""One query opN_<name> for each operator, with production parameters, over whole tables."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import chat_tree, hash_forest, html_main, jaccard, mixing, packing, quality, repeats, repetition, token_tree, toxicity, variants
from quadloom.llm.common import crc_bucket, table


def tokenizer_path(name: str) -> str:
    """Where the box keeps the files of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.extracted(pages)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_bucket("doc_id", 4)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 2)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_bucket("doc_id", 5)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hash_forest.nearest(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


#: Words in a block: small, as even a source of a few thousand words has to come near its target.
MIX_BLOCK = 128


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), MIX_BLOCK)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents under three edits each: a deletion, an insertion and a replacement."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = "coalesce(char_length(text), 0)"
    edits = F.expr(f"""array(
        named_struct('at', cast({n} div 4 as int), 'remove', 7, 'insert', ''),
        named_struct('at', cast({n} div 2 as int), 'remove', 0, 'insert', ' [removed] '),
        named_struct('at', cast(3 * {n} div 4 as int), 'remove', 3, 'insert', 'e-mail'))""")
    return token_tree.counted(docs.withColumn("edits", edits), "edits", tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: A conversation that is made of control strings.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string"))
    rows, ranks = chat_tree.paths(turns), tokenizer_path("byte_bpe_50k.tiktoken")
    return chat_tree.digests(rows, chat_tree.read_back(chat_tree.packs(rows, ranks), ranks))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.judged(docs).drop("text")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op11_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_hash_forest": op5_hash_forest,
    "op6_source_mixing": op6_source_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_repetition": op9_repetition,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_run_length_dedup": op11_run_length_dedup,
    "op12_spelling_variants": op12_spelling_variants,
}

_ESCAPED_LENGTH = r"""length(regexp_replace(replace({0}, '\', '\\'), '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1+', 'g'))"""

OP8_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text) AS loss,
    CAST(sum(3 + {_ESCAPED_LENGTH.format("role")} + length(role) - length(replace(role, chr(10), '')) + 1 + {_ESCAPED_LENGTH.format("text")} + 4) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase

#: crc32 by its table, whose 256 entries follow from the polynomial; near words by wildcards and by one letter left out.
OP12_SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT id, run, count(*) AS k FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '{variants.RUN}')), '{_UPPER}', '{_LOWER}') AS run FROM documents
  ) WHERE length(run) >= 5 GROUP BY ALL
), bytes AS (
  SELECT run, k, list_transform(range(strlen(id || ':' || run)), lambda i: CAST(('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2)) AS BIGINT)) AS b FROM runs
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, steps
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), spots AS (
  SELECT word, n, pos, substr(word, 1, pos - 1) AS prefix, substr(word, pos + 1) AS suffix FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM spots a JOIN spots b ON a.pos = b.pos AND a.prefix = b.prefix AND a.suffix = b.suffix AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM spots s JOIN words w ON w.word = s.prefix || s.suffix
  UNION SELECT w.word, s.word, s.n FROM spots s JOIN words w ON w.word = s.prefix || s.suffix
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, n AS other_n, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS r FROM pairs
), forms AS (
  SELECT w.word, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.r = 1
), path AS (
  SELECT word, word AS pos FROM forms UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON f.word = p.pos WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.pos AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN path p ON p.word = f.word JOIN forms l ON l.word = p.pos AND l.form IS NULL
"""

#: Every string of 100 bytes, in hexadecimal; islands of those that start earlier; what lies between the islands.
OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d)
), firsts AS (
  SELECT w, min((doc_id, i)) AS f FROM windows GROUP BY w HAVING count(*) > 1
), marked AS (
  SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE (doc_id, i) > f
), islands AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k
    FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM marked)
  ) GROUP BY doc_id, k
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM islands
  UNION ALL SELECT d.doc_id, coalesce(max(i.b), 0), max(length(d.x) // 2) FROM d LEFT JOIN islands i ON i.doc_id = d.doc_id GROUP BY d.doc_id
), kept AS (
  SELECT g.doc_id, string_agg(substr(d.x, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS x FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id
), spans AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM islands GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(s.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN spans s ON s.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op8_chat_formatting": OP8_SQL, "op11_run_length_dedup": OP11_SQL, "op12_spelling_variants": OP12_SQL}
