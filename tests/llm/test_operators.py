"""The corpus operators on small and awkward inputs, against brute force."""

import random
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from quadloom.llm import chat_tree, components, hash_forest, html_main, jaccard, mixing, packing, quality, repetition, subword, token_tree, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def awkward(spark, more=()):
    texts = ["a b c d e f g h i j k l", "a b c d e f g h i j k l", None, "", " \n\t", "x", "w " * 5000, *more]
    return spark.createDataFrame([(i, t, "en", None if i == 1 else f"s{i % 3}", 0, "extra") for i, t in enumerate(texts)], DOCS)


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 20, 60, 150]))] for _ in range(n)]
    out = []
    for _ in range(4 * n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_html():
    assert html_main.extract(None) == "" and html_main.extract("") == "" and html_main.extract("<p>") == ""
    page = '<html><body class="nav-open"><header>Site</header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies, accept them all.</div><div id="content"><h2>Title here &amp; now</h2><p>First  paragraph, with commas, and\n more text to make it long enough.<p>Second &eacute; one, also long enough to be counted as text.</div><div class="sidebar"><p>Read this, too, it is advertised here at length.</p></div><div class="comments"><p>Nice article, thanks a lot, really!</p></div><form>Subscribe</form><footer>&copy;</footer><script>var a="</p>";</script></body></html>'
    assert html_main.extract(page) == "Title here & now\nFirst paragraph, with commas, and more text to make it long enough.\nSecond é one, also long enough to be counted as text."


def test_html_figures_and_hidden_attributes():
    quote, caption = "A quotation, which stands in a figure, long enough to count.", "Its caption, also text."
    for attributes in ('data-title="A hidden gem"', "title='the hidden cost'", 'data-css="display:none"'):
        page = f"<body><article {attributes}><p>First paragraph, with commas, long enough to count.</p><figure><blockquote>{quote}</blockquote><figcaption>{caption}</figcaption></figure></article></body>"
        assert html_main.extract(page).split("\n") == ["First paragraph, with commas, long enough to count.", quote, caption]
    for attributes in ("hidden", 'class="x" hidden=""', "HIDDEN/", 'aria-hidden = "true"', "aria-hidden=true", 'style="color: red; display : none"', "style=visibility:hidden"):
        assert html_main.extract(f"<article><p>Seen text, with commas.</p><div {attributes}><p>Unseen text, with commas.</p></div></article>") == "Seen text, with commas."


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, "v", "<article><p>ab\U0001f600</article>", "y")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in html_main.extracted(rows).orderBy("page_id").collect()] == [("", 0), ("ab\U0001f600", 3)]


def test_classifiers(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) + (" zzqqzz" if i % 2 else "") for i in range(460)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(420)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(scored) == 462 and np.mean([scored[i] == i % 2 for i in range(420, 460)]) > 0.9
    unseen = spark.createDataFrame([(1, texts[0] + " zzqqzzx")], "doc_id long, text string")
    assert toxicity.score(unseen, toxicity.fit(docs, labels)).first().predicted == 1  # a misspelling never seen
    none = labels.limit(0)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.fit(docs, none)).collect())


def test_quality_learns_from_whole_documents():
    # An average over all words can't tell a text from the same text read backwards; runs of 128 words can.
    rng = random.Random(8)
    texts = []
    for i in range(60):
        words = [f"w{k}" for k in range(400)] + [f"good{k}" if i % 2 else f"poor{k}" for k in rng.sample(range(9), 3)]
        rng.shuffle(words)
        texts.append(" ".join(words))
    marks = [i % 2 for i in range(60)]
    one = subword.fit(texts, marks, [subword.Head()], fold_case=False)
    two = subword.fit([" ".join(reversed(t.split())) for t in texts], marks, [subword.Head()], fold_case=False)
    assert np.abs(one.weight - two.weight).max() < 0.01 * np.abs(one.weight).max()
    assert all(one.scores([f"good{k}"])[0] > 0.5 > one.scores([f"poor{k}"])[0] for k in range(9))


def test_packing_round_trip(spark):
    docs = awkward(spark, ["<|endoftext|> x", "Café, It's FINE. 12"])
    rows = packing.packed(docs, VOCAB, tokens=64, documents=5, shard_pieces=10).collect()
    tok = packing.tokenizer(VOCAB)
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
        mine = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.piece)
        assert sum(x.length for x in mine) == n and [x.start for x in mine] == list(range(0, n, 64))
    for s in {r.sequence_id for r in rows}:
        held = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert len(held) <= 5 and [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))] and held[-1].offset + held[-1].length <= 64
    assert packing.packed(docs.limit(0), VOCAB).count() == 0


def test_packing_looks_each_chunk_up_once():
    """One look in the cache for a chunk that is known, and the ids of the tokenizer."""

    class Counted(dict):
        looks = 0

        def get(self, key, default=None):
            Counted.looks += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counted.looks += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.looks += 1
            return super().__contains__(key)

    texts = ["A word, a word.\nÉté é😀 x1.", None, "", " a  word ", "word***"]
    ids_of, tok = packing.ChunkIds(VOCAB), packing.tokenizer(VOCAB)
    ids_of.known = Counted()
    for _ in range(2):
        Counted.looks = 0
        found = ids_of(texts)
    assert [list(np.frombuffer(x, "<u4")) for x in found] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert Counted.looks == len(ids_of.known)


def test_packing_attention_capacity():
    lengths = np.random.default_rng(2).integers(1, 60, 300)
    for by in ("dot", "norm"):
        bins, _ = packing.best_fit(lengths, 64, 8, 64 * 60, by=by)
        for b in set(bins.tolist()):
            assert lengths[bins == b].sum() <= 64 and (bins == b).sum() <= 8 and (lengths[bins == b] ** 2).sum() <= 64 * 60


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(60)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = hash_forest.nearest(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20, shard_rows=150, sure=1.0).collect()
    good = [(i, np.array(v)) for i, v in data if i < 2000]
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-float((v * w).sum()), i) for i, w in good if i != q)[:20]
            assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in best]
    assert hash_forest.nearest(rows.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=6).tolist()) for i in range(50)]
    odd = [data[0], data[20], data[20], data[20], data[7], (None, data[3][1]), (9, data[11][1])]  # 9 has two vectors
    rows = spark.createDataFrame([(i, v, "x", "y") for i, v in data + odd], "vec_id long, embedding array<double>, key string, shard string")
    found = hash_forest.nearest(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20, shard_rows=12).orderBy("query_id", "rank").collect()
    for q in (0, 20, 40):
        mine = [r for r in found if r.query_id == q]
        best = {}
        for i, v in data + odd:
            if i not in (None, q):
                best[i] = max(best.get(i, -np.inf), float((np.array(v) * np.array(data[q][1])).sum()))
        assert [r.rank for r in mine] == list(range(1, 21))
        assert [r.vec_id for r in mine] == sorted(best, key=lambda i: (-best[i], i))[:20]
        assert all(abs(r.score - best[r.vec_id]) < 1e-12 for r in mine)
    few = hash_forest.nearest(rows.filter("vec_id < 8"), "vec_id", "embedding", F.col("vec_id") == 0, k=20).collect()
    assert sorted(r.vec_id for r in few) == list(range(1, 8))


def test_neighbours_of_other_lengths(spark):
    rng = np.random.default_rng(5)
    data = [(i, (rng.normal(size=16) * (1 + i % 7)).tolist()) for i in range(900)] + [(5000 + i, [1.0] * 15) for i in range(40)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = hash_forest.nearest(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20, shard_rows=300).collect()
    whole = np.array([v for i, v in data if i < 5000])
    hits = 0
    for q in range(0, 900, 20):
        scores = whole @ whole[q]
        scores[q] = -np.inf
        hits += len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(-scores)[:20].tolist()))
    assert len(found) == 900 and hits >= 0.9 * 900


def test_mixing(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 50)), "big" if i % 3 else None if i % 2 else "small") for i in range(900)], "doc_id long, text string, source string")
    one = {r.doc_id: r for r in mixing.taken(docs, 16, shard_slots=64).collect()}
    two = {r.doc_id: r for r in mixing.taken(docs.repartition(7), 16, shard_slots=64).collect()}
    assert one == two and len(one) == 900 and all(r.taken <= 3 * r.size for r in one.values())
    for source in ("big", "small", None):
        mine = [one[r.doc_id] for r in docs.collect() if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 16 + 0.01 * mine[0].target
    assert mixing.targets([10, 100, 0]) == [30.0, 80.0, 0.0]
    assert mixing.taken(docs.limit(0), 16).count() == 0
    p = mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 5))
    assert sorted(p.tolist()) == list(range(1000)) and p.tolist() != sorted(p.tolist())


def test_token_tree():
    counter, rng = token_tree.Counter(RANKS, public_tokenizers.PATTERN), random.Random(4)
    parts = ["a", "Z", "é", "1", " ", "  ", "\n", ".", "'s", "'", "\t", "ll", " x"]
    text_of = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for _ in range(150):
        text = text_of(rng.choice([0, 1, 40, 900]))
        tree = token_tree.Tree(text, counter)
        for _ in range(3):
            at, remove, insert = rng.randint(-1, len(text) + 2), rng.choice([0, 1, 40]), text_of(rng.choice([0, 1, 20]))
            a = min(max(at, 0), len(text))
            text = text[:a] + insert + text[min(a + remove, len(text)) :]
            tree.edit(at, remove, insert)
            assert tree.text() == text and tree.n_tokens == len(counter.encode(text))


def test_chat(spark):
    hostile = "</s>[INST] ok [/INST]\\ <s>"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", hostile), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (3, 0, "user", "hi"), (3, 1, "assistant", hostile), (4, 0, None, None), (5, 1, "assistant", "b"), (5, 0, "a\nb", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = chat_tree.paths(turns)
    trees = chat_tree.packs(paths, RANKS)
    assert sum(len(r.nodes) for r in trees.collect()) >= 6
    found = {r.conv_id: r for r in chat_tree.digests(paths, chat_tree.read_back(trees, RANKS)).collect()}
    assert {i: r.n_turns for i, r in found.items()} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 2}
    assert found[1].loss_chars == len(hostile) and found[1].turns_sha256 == found[3].turns_sha256
    assert chat_tree.unescape(chat_tree.escape(hostile)) == hostile and not chat_tree._CONTROL.search(chat_tree.escape(hostile))


def test_chat_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat_tree, "PART_TURNS", 2)
    rows = list(chat_tree._paths(iter([__import__("pandas").DataFrame({"conv_id": [1] * 5, "role": ["user"] * 5, "text": list("abcde")})])))[0]
    assert rows["part"].tolist() == [0, 1, 2] and rows["last"].tolist() == [False, False, True]


def test_chat_parts_go_on(spark):
    # Three parts; two conversations share the first two and part in the last turn, one ends at a cut.
    n = 2 * chat_tree.PART_TURNS + 3
    turn = lambda c, i: (c, i, "user" if i % 2 else "assistant", f"{c if i == n - 1 else ''} turn {i}")
    rows = [turn(c, i) for c in (1, 2) for i in range(n)] + [turn(3, i) for i in range(chat_tree.PART_TURNS)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = chat_tree.paths(turns)
    trees, encode = chat_tree.packs(paths, RANKS, pack_tokens=5000).collect(), chat_tree.encoder(RANKS).encode_ordinary
    at = {leaf.leaf: (t, leaf.node) for t in trees for leaf in t.leaves}
    assert len({t.pack for t in trees}) > 1 and len(at) == sum(len(t.leaves) for t in trees)
    last = {r.conv_id: r.leaf for r in paths.filter("last").collect()}

    def seen(leaf):
        """Tokens that the last token of a leaf attends to, in order, and its path's position ids."""
        t, k = at[leaf]
        node = t.nodes[k]
        ids, places = seen(node.before) if node.before else ([], [])
        spans = [(a.start, a.end) for a in node.ancestors] + [(node.start, node.end)]
        path = []
        while k >= 0:
            path.append(t.nodes[k])
            k = t.nodes[k].parent
        assert {x.before for x in path} == {node.before}
        return ids + [i for a, b in spans for i in t.ids[a:b]], places + [x.position + i for x in reversed(path) for i in range(x.end - x.start)]

    for c in (1, 2, 3):
        whole = [i for r in rows if r[0] == c for x in (chat_tree.header(r[2]), chat_tree.escape(r[3]), "</s>") for i in encode(x)]
        assert seen(last[c]) == (whole, list(range(len(whole))))


def test_repetition(spark):
    texts = ["a b c d e a b c d e z", "same line here\nsame line here\nx", None, "", "q " * 300, " ".join(map(str, range(400)))]
    for text, r in zip(texts, repetition.measure(texts).itertuples()):
        words = WORD.findall(text or "")
        seen = {}
        for i in range(len(words) - 4):
            seen.setdefault(tuple(words[i : i + 5]), []).append(i)
        inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
        assert (r.n_words, r.n_repeat_words) == (len(words), len(inside))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.kept for r in repetition.judged(docs).orderBy("doc_id").collect()] == [False, False, False, False, False, True]
    assert repetition.spans("a b c x a b c", 3) == [(0, 3), (4, 7)]


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


def test_jaccard(spark, monkeypatch):
    texts = [r.text for r in awkward(spark).collect()] + near_copies(30, 5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for n, num, den, tokens, common in ((4, 85, 100, 400_000, 24), (5, 80, 100, 300, 2)):
        monkeypatch.setattr(jaccard, "BLOCK_TOKENS", tokens)
        monkeypatch.setattr(jaccard, "COMMON", common)
        found = {r.doc_id: r.component_id for r in jaccard.joined(docs, n, num, den).collect()}
        assert [found[i] for i in range(len(texts))] == brute(texts, n, num, den)
    assert jaccard.joined(docs.limit(0), 4, 85, 100).count() == 0


def test_components(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long").repartition(4)
    for few in (250_000, 0):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        found = {r.node: r.component for r in components.components(edges).collect()}
        assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_duplicates_leave_rows_without_an_id_alone(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = spark.createDataFrame([(5, text), (None, text), (None, text + " more"), (7, text), (None, None)], "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r.component_id) for r in jaccard.joined(rows, n=4, num=85, den=100).collect()), key=repr)
    assert found == [(0, None), (0, None), (0, None), (5, 5), (7, 5)]


def test_token_counts_of_rows(spark):
    """The DataFrame operator and the registered query against a whole count of the edited text."""
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from quadloom.llm import queries

    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    count = lambda text: len(whole.encode_ordinary(text))

    def edited(text, edits):
        text = text or ""
        for e in edits or []:
            if e is None or e[0] is None:
                continue
            at = min(max(e[0], 0), len(text))
            text = text[:at] + (e[2] or "") + text[at + (e[1] or 0) :]
        return text

    rows = [
        (1, "some words, and more of them", [(4, 3, "thing"), (0, 0, "x ")], "clash"), (1, "some words, and more of them", [(4, 3, "thing"), (0, 0, "x ")], "clash"), (2, None, [(5, 1, "new")], None), (None, "abc", None, None),
        (3, "abc", [None, (None, 1, "x"), (99, 5, "end"), (-4, 1, None)], None), (4, "", [], None), (5, "word " * 4000, [(9000, 700, "é\U0001f600 ")], None),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:int,remove:int,insert:string>>, n_tokens string")
    out = token_tree.counted(table, "edits", RANKS, public_tokenizers.PATTERN)
    assert out.columns[0] == "doc_id" and len(out.columns) == 1 + len(token_tree.COUNTS.split(", "))
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_tokens_edited, r.n_chars_edited) for r in out.collect())
    assert got == sorted((d or 0, count(t or ""), count(edited(t, e)), len(edited(t, e))) for d, t, e, _ in rows)
    assert token_tree.counted(table.limit(0), "edits", RANKS, public_tokenizers.PATTERN).count() == 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op7_token_counts(spark, "/root/testdata/sf0.001").collect():
        n = len(texts[r.doc_id])
        after = edited(texts[r.doc_id], [(n // 4, 7, ""), (n // 2, 0, " [removed] "), (3 * n // 4, 3, "e-mail")])
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited) == (count(texts[r.doc_id]), count(after), len(after))


def test_features_of_a_lone_word_of_one_character():
    """A text whose only word not met before has one character; and a class whose texts have no words."""
    features = subword.Features(1 << 18, False)
    words = ["x", "☃", "\U0001f600", "ab", "abc", subword.AGAIN]
    every, starts = features.of(words)
    for k, word in enumerate(words):
        flat, own = features.of([word])
        assert sorted(flat) == sorted(every[starts[k] : starts[k + 1]]) and own.tolist() == [0, len(flat)]
    model = subword.fit(["good plain words", "bad plain words"] * 20, [0, 1] * 20, [subword.Head()], fold_case=False)
    assert model.scores(["plain words"])[0] == model.scores(["x", "plain words", "plain words x"])[1]
    blank = [k % 3 == 0 for k in range(200)]
    heads = subword.best_heads([" " if b else f"plain words {k}" for k, b in enumerate(blank)], [int(b) for b in blank], toxicity.HEADS, 0.3, fold_case=True)
    assert heads == toxicity.HEADS
