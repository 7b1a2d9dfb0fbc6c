"""Wrapper induction: matching against brute force, templates of planted hosts, broken and deep markup."""

import random
import time
from itertools import combinations

import pytest

from clientela.llm import html_extraction as H

SAMPLE = "/root/testdata/sf0.1"


def tree(rng, depth=3):
    """A tree whose neighbours have different labels, so that every child is a slot of its own."""
    node = H.Node("div", "div", False)
    last = None
    for _ in range(rng.randrange(4) if depth else 0):
        tag = rng.choice([t for t in ("ul", "p", "h1", "section") if t != last])
        child = tree(rng, depth - 1)
        child.tag = child.label = last = tag
        node.children.append(child)
    return node


def best(a, b):
    """Simple tree matching by trying every alignment of the children."""
    x, y = a.children, b.children
    most = 0
    for k in range(min(len(x), len(y)) + 1):
        for left in combinations(x, k):
            for right in combinations(y, k):
                if all(m.label == n.label for m, n in zip(left, right)):
                    most = max(most, sum(best(m, n) for m, n in zip(left, right)))
    return 1 + most


def test_matching_is_the_best_alignment():
    rng = random.Random(7)
    for _ in range(200):
        a, b = tree(rng), tree(rng)
        H.group(a), H.group(b)
        size, pairs = H.match(a, b)
        assert size == best(a, b) == len(pairs)
        assert all(m.label == n.label for m, n in pairs)
        assert len({id(m) for m, _ in pairs}) == len({id(n) for _, n in pairs}) == size


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: (r.text, r.n_template) for r in H.extract(df).collect()}


def prose(i, n=3):
    rng = random.Random(i)
    return [" ".join(f"word{rng.randrange(10**6)}" for _ in range(40)) + "." for _ in range(n)]


def test_menu_without_telling_names_goes(spark):
    def page(i):
        body = "".join(f"<p>{p}</p>" for p in prose(i))
        return f"<body><div class=x1><ul><li>Home</li><li>Our shops</li></ul></div><div class=x2><h1>Story {i}</h1>{body}</div><div class=x3><p>All rights kept by us</p></div></body>"

    found = texts(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(8)] + [(99, "http://b.org/1", page(99))])
    for i in range(8):
        assert found[i] == ("\n\n".join([f"Story {i}", *prose(i)]), 3)
    assert "Home" in found[99][0] and found[99][1] == 0  # one page says nothing about its host


def test_sections_without_classes(spark):
    def page(i):
        body = "".join(f"<p>{p}</p>" for p in prose(i))
        return f"<div><ul><li>Home</li></ul></div><div>{body}</div><div><p>All rights kept by us</p></div>"

    found = texts(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(6)])
    assert all(found[i][0] == "\n\n".join(prose(i)) for i in range(6))


@pytest.mark.parametrize("wrapped", [True, False])
def test_near_copies_keep_their_paragraphs(spark, wrapped):
    """Three common paragraphs and a date that differs: copies of an article, not a template."""
    common = "".join(f"<p>{p}</p>" for p in prose(0))

    def page(i):
        inner = f"{common}<p>Day {i}</p>"
        return f"<body><nav>menu</nav>{f'<article>{inner}</article>' if wrapped else f'<div>{inner}</div>'}</body>"

    found = texts(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(40)])
    for i in range(40):
        assert found[i][0] == "\n\n".join([*prose(0), f"Day {i}"])


def test_line_under_every_article_is_template(spark):
    def page(i):
        return f"<article>{''.join(f'<p>{p}</p>' for p in prose(i))}<p>Reported by our staff</p></article>"

    found = texts(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(8)])
    assert all(found[i] == ("\n\n".join(prose(i)), 1) for i in range(8))
    few = texts(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(2)])
    assert all(few[i][0].endswith("our staff") for i in range(2))


def test_main_beside_teaser_cards():
    def content(source):
        placed = H.placed_blocks(source, None)
        return [b.text for b, v in zip(placed, H.verdicts(placed, set())) if v == "content"]

    story = prose(1)
    cards = "<article>read on</article><article>more of it</article>"
    assert content(f"<main>{''.join(f'<p>{p}</p>' for p in story)}{cards}</main><footer>f</footer>")[:3] == story
    assert content(f"<body><p>teaser</p><article><p>{story[0]}</p></article></body>") == [story[0]]


def test_deep_and_broken_markup(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    branching = "<div><p>x</p>" * 900 + "end" + "</div>" * 900
    unclosed = "<a " * 350_000
    quotes = '<a "' * 250_000
    bang = "<!" * 500_000
    closings = "<div>" * 3000 + "</b>" * 200_000 + "text"
    raw = "İ" * 10 + "<SCRIPT>var a = '<p>no</p>'</script><p>yes</p>"
    pages = [deep, branching, unclosed, quotes, bang, closings, raw, None, "", "<", "<p", "a < b"]
    start = time.perf_counter()
    found = texts(spark, [(i, "http://a.org/1", p) for i, p in enumerate(pages)])
    assert time.perf_counter() - start < 60
    assert found[0][0] == "deep text" and found[1][0].endswith("end") and found[5][0] == "text"
    assert found[6][0] == "İ" * 10 + "\n\nyes" and found[7][0] == found[8][0] == "" and found[11][0] == "a < b"


def test_time_grows_with_the_page():
    def seconds(n):
        start = time.process_time()
        H.placed_blocks("<a " * n, None)
        return time.process_time() - start

    seconds(1000)
    assert seconds(80_000) < 40 * max(seconds(10_000), 0.02)


def test_given_pages_share_no_chrome(spark):
    """Menus and footers differ from page to page there, so that induction finds no template and takes no article's text."""
    pages = spark.read.parquet(f"{SAMPLE}/pages.parquet")
    found = H.extract(pages).collect()
    plain = {}
    for p in pages.select("page_id", "html").collect():
        placed = H.placed_blocks(p.html or "", None)
        plain[p.page_id] = "\n\n".join(b.text for b, v in zip(placed, H.verdicts(placed, set())) if v == "content")
    assert all(r.text == plain[r.page_id] for r in found)
    assert sum(r.n_template for r in found) == 0


def test_repeated_rows_and_clashing_columns(spark):
    html = "<article><p>one &amp; two\n three</p></article>"
    df = spark.createDataFrame([(1, "http://a.org/1", html, 1, 2)] * 3 + [(None, None, html, 1, 2)], "page_id long, url string, html string, node int, text int")
    rows = H.extract(df).collect()
    assert [r.text for r in rows] == ["one & two three"] * 4 and rows[0].n_template == 0
