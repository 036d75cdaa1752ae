"""Main text of pages: cases by hand, and random trees against a scorer written down from the definition."""

import html
import random
import time

from quadloom.llm import html_main

P = "First paragraph, with commas, and long enough to be counted as text."


def test_short_article_with_many_comments():
    comments = "".join(f'<div class="comment"><p>Reader {i} says, at some length, that this is so.</p></div>' for i in range(30))
    for words in (1, 8, 200):
        text = ("word " * words).strip() + "."
        for tag in ("div", "section", "ol"):
            assert html_main.extract(f'<body><article><p>{text}</p><{tag} class="comments">{comments}</{tag}></article></body>') == text
            assert html_main.extract(f'<body><article><p>{text}</p></article><{tag} id="reader-comments">{comments}</{tag}></body>') == text
    assert html_main.extract(f'<main><p>{P}</p><ol><li><article class="comment"><p>Other, as long as the text, and written by a reader.</p></article></ol></main>') == P


def test_parts_of_articles_that_are_named_like_other_parts():
    discussion, work = "We find, in all cases, that these results hold over time.", "Others have shown, in earlier work, the same thing twice."
    page = f'<article><p>{P}</p><section id="discussion"><h2>Discussion</h2><p>{discussion}</p></section><div class="related-work"><p>{work}</p></div><figure><pre>x =\n 1</pre><figcaption>Listing 1.</figcaption></figure><p>So <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p></article>'
    assert html_main.extract(page).split("\n") == [P, "Discussion", discussion, work, "x = 1", "Listing 1.", "So E=m holds."]
    links = '<div class="related"><ul><li><a href="a">Another, quite other story</a></li><li><a href="b">One more story</a></li></ul></div>'
    share = '<div class="share">Tell a friend</div>'
    assert html_main.extract(f"<article><p>{P}</p>{links}{share}<p>{P}</p></article>") == f"{P}\n{P}"


def test_parts_that_go():
    parts = [
        "<header><p>{0}</p></header>", "<footer><p>{0}</p></footer>", "<aside><p>{0}</p></aside>", "<form><p>{0}</p></form>", '<div role="alert"><p>{0}</p></div>',
        '<div class="sidebar"><p>{0}</p></div>', '<div class="cookie-notice"><p>{0}</p></div>', '<div id="ad-12"><p>{0}</p></div>', '<div class="notice"><p>{0}</p></div>', "<nav><p>{0}</p></nav>",
    ]
    for part in parts:
        other = part.format("Something else, said at length, which is no part of the article.")
        assert html_main.extract(f'<body>{other}<div class="post"><p>{P}</p><p>{P}</p></div>{other}</body>') == f"{P}\n{P}"
        assert html_main.extract(f"<body>{other}<article><p>{P}</p></article>{other}</body>") == P


def test_wrappers_and_pages_made_of_named_parts():
    assert html_main.extract(f'<body class="comments-open"><div class="has-sidebar"><div id="sidebar-layout"><article><p>{P}</p></article></div></div></body>') == P
    assert html_main.extract(f'<body><div class="overlay"><p>{P}</p></div></body>') == P
    assert html_main.extract(f'<body><div class="comments"><p>{P}</p></div></body>') == ""


def test_pages_of_sidebars_only():
    for name in ("sidebar", "ads", "newsletter", "site-footer", "main-nav", "cookie-overlay"):
        assert html_main.extract(f'<body><div class="{name}"><p>Cheap ads here</p><div><p>{P}</p></div></div></body>') == ""


def test_deep_nesting_takes_linear_time():
    n = 100_000
    pages = ["<div>some text, here " * n, "<div>some text, here " + "<div>" * n + "</span>" * n, "<b>" * n + "</i>" * n + "some text, here", "<article>" * n + "some text, here", "<div>" * n + "</section></p></td>" * n, "<title>x" * n, "<svg>" + "<div>" * n + "x"]
    for page in pages:
        began = time.process_time()
        html_main.extract(page)
        assert time.process_time() - began < 20
    assert html_main.extract(pages[0]).count("some text, here") >= 1 and html_main.extract(pages[3]) == "some text, here"


def test_broken_pages():
    assert html_main.extract(f"<html><head><title>Unclosed<body><article><p>{P}</article>") == P
    assert html_main.extract(f'<article><p>{P}<svg><path d="x"/><text>No</text><p>{P}</article>') == f"{P}\n{P}"
    assert html_main.extract(f"<article><svg/><p>{P}</article>") == P
    assert html_main.extract("<article><p>a&lt;b &amp<b>lt; &#x41;&nbsp; c</b></article>") == "a<b &lt; A c"
    long = " ".join(f"word{i}" for i in range(300_000))
    assert html_main.extract(f"<article><p>{long}</p></article>") == long


# --- a second scorer, from the tree itself


class E:
    def __init__(self, tag, name="", children=()):
        self.tag, self.name, self.children = tag, name, list(children)

    def html(self):
        return f"<{self.tag}{f' class={chr(34)}{self.name}{chr(34)}' if self.name else ''}>" + "".join(x.html() if isinstance(x, E) else html.escape(x) for x in self.children) + f"</{self.tag}>"


def sentence(rng):
    return (" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) + rng.choice(["", "", "", ","]) for _ in range(rng.choice([1, 4, 12, 60])))).strip(",") + rng.choice([".", ""])


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        if rng.random() < 0.2:
            return E("p", "", [E("a", "", [sentence(rng)])])
        return E(rng.choice(["p", "p", "h2", "blockquote"]), "", [sentence(rng)])
    return E(rng.choice(["div", "div", "section"]), rng.choice(["", "", "", "x", "related", "ads", "comments"]), [tree(rng, depth - 1) for _ in range(rng.randint(1, 4))])


def plain(body):
    """Text of the blocks that belong, by the definition: no parsing, everything computed anew for each element."""
    up, blocks = {}, []

    def walk(e, above, linked):
        up[id(e)] = above
        for x in e.children:
            if isinstance(x, E):
                walk(x, [e, *above], linked or x.tag == "a")
            else:
                owner = e if e.tag != "a" else above[0]
                blocks.append((owner, x, len(x) if linked else 0))

    walk(body, [], False)
    path = lambda e: [e, *up[id(e)]]
    blocks = [b for b in blocks if not any(x.name == "comments" for x in path(b[0]))]
    holds = lambda e: any(x.tag == "article" and e in up[id(x)] for x in every)
    every = [e for b in blocks for e in path(b[0])]
    blocks = [b for b in blocks if not any(x.name == "ads" and not holds(x) for x in path(b[0]))]
    doubted = lambda e: e.name == "related" and not holds(e)
    points = lambda text: text.count(",") + min(len(text) / 100, 3)
    under = lambda e: [b for b in blocks if e in path(b[0])]
    density = lambda e: sum(b[2] for b in under(e)) / max(1, sum(len(b[1]) for b in under(e)))

    def raw(e):
        total = 0.0
        for owner, text, _ in blocks:
            line = path(owner)[1:] if owner.tag in ("p", "h2", "blockquote") else path(owner)
            if e in line and not any(map(doubted, line[: line.index(e)])):
                level = line.index(e)
                total += points(text) * (1 if level == 0 else 1 / 2 if level == 1 else 1 / (3 * level))
        return total

    seen = []
    for owner, _, _ in blocks:
        line = path(owner)[1:] if owner.tag in ("p", "h2", "blockquote") else path(owner)
        if not any(map(doubted, line)):
            seen += [e for e in reversed(line) if e not in seen]
    if not seen:
        return "\n".join(b[1] for b in blocks)
    best = max(seen, key=lambda e: raw(e) * (1 - density(e)))
    best = next((e for e in path(best) if e.tag == "article" and density(e) < 0.5), best)

    def goes(e):
        mine, all_ = under(e), under(best)
        rest = [b for b in all_ if b not in mine]
        mean = lambda some: sum(points(b[1]) for b in some) / len(some)
        return density(e) >= 1 / 3 or bool(rest) and mean(mine) < 0.5 * mean(rest)

    out = []
    for b in blocks:
        line = path(b[0])
        if best in line:
            if not any(doubted(x) and goes(x) for x in line[: line.index(best)]):
                out.append(b[1])
            continue
        sibling = next((x for x in line if up[id(x)][:1] == up[id(best)][:1] and up[id(x)]), None)
        if sibling is None or doubted(sibling) or best.tag == "article" and sibling.tag != "article":
            continue
        d, text = density(sibling), b[1]
        ends = text.endswith(".")
        if raw(sibling) * (1 - d) >= 0.2 * raw(best) or sibling.tag == "p" and (len(text) > 80 and d < 0.25 or d == 0 and ends):
            out.append(text)
    return "\n".join(out)


def test_random_trees():
    rng = random.Random(5)
    for k in range(300):
        parts = [tree(rng, 3) for _ in range(rng.randint(1, 4))]
        if k % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), E("article", "", [tree(rng, 2) for _ in range(2)]))
        body = E("body", "", parts)
        assert html_main.extract(body.html()) == plain(body), body.html()


def test_html_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = f"<article><p>{P}</article>"
    rows = spark.createDataFrame([(1, "u", None, "x", "y"), (1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (None, None, page, None, None)], schema)
    out = html_main.extracted(rows)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, P, len(P)), (1, "", 0), (1, P, len(P)), (1, P, len(P))]
    assert html_main.extracted(rows.limit(0)).count() == 0
