import random
import time

import pytest

from tidemark.llm import dom, pages

SCHEMA = "page_id long, url string, html string, host string, text string, reference string, run int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", 1) for i, u, h in rows], SCHEMA)


def texts(spark, rows):
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extract(frame(spark, rows)).collect()}


def article(i, body=None):
    body = body or f"<p>First {i} &amp; <b>bold</b>er<p>Second\n  {i}&eacute;<br>line"
    return (
        f"<html><head><title>T {i}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><a href=x>go {i}</a></nav>"
        f"<div class='ad'>buy {i}</div><article><h1>Head {i}</h1>{body}<p>Share this page</p></article>"
        f"<div id=comments><article class=comment><p>me too {i}</p></article></div><form><p>mail {i}</p></form><footer>&copy; {i}</footer></body></html>"
    )


def test_article_text(spark):
    rows = [(i, "http://a.example/x", article(i)) for i in range(12)]
    found = texts(spark, rows)
    for i in range(12):
        want = f"Head {i} First {i} & bolder Second {i}é line"
        # The line that every page repeats in place is the template's.
        assert found[i] == (want, len(want))


def test_few_pages_have_no_template(spark):
    found = texts(spark, [(1, "http://b.example/", article(1)), (2, "http://b.example/", article(2))])
    assert found[1][0].endswith("line Share this page")


def test_copies_do_not_become_template(spark):
    rows = [(i, "http://c.example/", article(0)) for i in range(20)]
    assert len({t for t, _ in texts(spark, rows).values()}) == 1
    assert texts(spark, rows)[3][0].startswith("Head 0 First 0")


def test_body_without_article(spark):
    def page(i):
        return f"<div class=menu>m{i}</div><div id=wrap class='with-sidebar'><h2>t {i}</h2><p>some {i} text</p><p>All rights reserved</p></div><div class='sidebar'>s{i}</div>"

    found = texts(spark, [(i, "https://USER@D.example:80/p?q", page(i)) for i in range(8)])
    assert found[5][0] == "t 5 some 5 text"


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("   ", ""), ("<", "<"), ("a < b &lt; c", "a < b < c"), ("<p>x<p>y", "x y"),
    ("<article><p>cut off <b>here", "cut off here"), ("<!-- a <p>b</p>", ""), ("<article><p>a&#x41;&#66;&nbsp;b</p></article", "aAB b"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>end", "deep end"), ("<b><i>x</b>y</i>z", "xyz"),
    ("<article><header><h1>h</h1></header><p>p</article><header>site</header>", "h p"),
    ("<p>one</p><script>if (a</b) x</script><p>two<style>q{}</style></p>", "one two"),
])
def test_odd_markup(spark, html, want):
    found = texts(spark, [(1, None, html), (1, None, html), (None, "odd", html)])
    assert found[1] == found[None] == (want, len(want))


def test_empty_table(spark):
    assert pages.extract(frame(spark, [])).count() == 0


def brute_score(a, b):
    if isinstance(a, str) or isinstance(b, str):
        return int(isinstance(a, str) and isinstance(b, str))
    if a.label != b.label:
        return 0
    m, n = len(a.items), len(b.items)
    table = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + brute_score(a.items[i], b.items[j]))
    return 1 + table[m][n]


def test_matching_is_the_largest():
    rng = random.Random(0)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return "t"
        return f"<{(t := rng.choice(['div', 'section', 'ul']))}>" + "".join(make(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{t}>"

    for _ in range(150):
        a, b = dom.Leaves("".join(make(3) for _ in range(3))), dom.Leaves("".join(make(3) for _ in range(3)))
        assert dom._Matcher().score(a.root, b.root) == brute_score(a.root, b.root)
        places = dom.align(a, b)
        assert len(set(places.values())) == len(places)
        pairs = sorted(places.items())
        assert [r for _, r in pairs] == sorted(r for _, r in pairs)


def test_two_layouts_of_a_host(spark):
    def post(i):
        return f"<div class=post><p>brand line</p><h2>Post {i}</h2><p>post text {i} long</p><p>post fine print</p></div>"

    def shop(i):
        return f"<section class='item-{i}'><table><tr><td>shop strapline</td></tr></table><p>item text {i} wide</p><p>shop fine print</p></section>"

    rows = [(i, "http://two.example/", (post if i % 2 else shop)(i)) for i in range(20)]
    # A layout that few pages have is aligned with the host's most frequent one.
    rows.append((20, "http://two.example/", "<div class=post><p>brand line</p><div class=odd><p>alone</p></div></div>"))
    found = texts(spark, rows)
    for i in range(20):
        assert found[i][0] == (f"Post {i} post text {i} long" if i % 2 else f"item text {i} wide")
    assert found[20][0] == "alone"


@pytest.mark.parametrize("html,want", [
    ("<div class='side-by-side'>left and right</div>", "left and right"),
    ("<div class='social-policy'>on policy</div><div class='social-links'><a href=x>a</a></div>", "on policy"),
    ("<div class='promo-codes-x'><a href=x>all of it</a></div><p>kept</p>", "kept"),
    ("<div class='cookie-notice'>we use</div><div id='adBox1'>buy</div><div class='comment-list'>hi</div><p>kept</p>", "kept"),
    ("<div class=story><h1>Head</h1><p>A story that is much longer than its card</p></div><article><a href=x>Read on</a></article>",
     "Head A story that is much longer than its card"),
    ("<main><p>short</p></main><div><p>a long strip beside the main element</p></div>", "short"),
    ("<article><p>An article of some length</p></article><div><p>unmarked</p></div>", "An article of some length"),
    ("<article></article><p>outside</p>", "outside"),
])
def test_names_and_teasers(spark, html, want):
    assert texts(spark, [(1, "http://n.example/", html)])[1][0] == want


def test_long_rows_of_unlike_siblings():
    def page(seed):
        rng = random.Random(seed)
        rows = ("<li>" + "<div>x</div>" * rng.randint(0, 9) + f"<p>{seed} {k}</p></li>" for k in range(20_000))
        return dom.Leaves(f"<p>top</p><ul>{''.join(rows)}</ul><p>end</p>")

    a, b = page(1), page(2)
    begin = time.monotonic()
    places = dom.align(a, b)
    assert time.monotonic() - begin < 30
    assert places[0] == 0 and places[len(b.texts) - 1] == len(a.texts) - 1
    assert len(set(places.values())) == len(places) > 20_000


def test_few_cells_keep_order():
    rng = random.Random(3)
    for _ in range(50):
        a, b = (dom.Leaves("".join(f"<{t}>x<p>y</p></{t}>" for t in rng.choices(["div", "ul", "h2"], k=12))) for _ in range(2))
        pairs = sorted(dom.align(a, b, cells=20).items())
        assert [r for _, r in pairs] == sorted({r for _, r in pairs})


def test_whole_operator_against_known_wrappers(spark):
    """Hosts of several random layouts, whose template and content are known by construction."""
    rng = random.Random(11)
    rows, want = [], {}
    for host in range(3):
        for layout in range(3):
            fixed = [f"template {host} {layout} {k}" for k in range(4)]
            tags = [rng.choice(["p", "h2", "blockquote"]) for _ in range(4)]
            chrome = rng.choice(["<nav>m {i}</nav>", "<div class=sidebar>s {i}</div>", "<footer>f {i}</footer>", "<form>q {i}</form>"])
            for _ in range(9):
                i = len(rows)
                content = [f"content {i} {k} &amp; more" for k in range(rng.randint(1, 5))]
                blocks = "".join(f"<{t}>{x}</{t}>" for t, x in zip(tags[:2], fixed[:2]))
                blocks += "<section>" + "".join(f"<p>{c}</p>" for c in content) + "</section>" + chrome.replace("{i}", str(i))
                blocks += "".join(f"<{t}>{x}</{t}>" for t, x in zip(tags[2:], fixed[2:]))
                rows.append((i, f"http://h{host}.example/{i}", f"<div class=l{'abc'[layout]}>{blocks}</div>"))
                want[i] = " ".join(content).replace("&amp;", "&")
    rng.shuffle(rows)
    assert {i: t for i, (t, _) in texts(spark, rows).items()} == want


def test_alignment_does_not_depend_on_room():
    """The same largest match whether tables are filled whole or in part, remembered or not."""
    rng = random.Random(5)
    for _ in range(20):
        a, b = (dom.Leaves("".join(f"<{t}>x<p>y</p></{t}>" for t in rng.choices(["div", "ul", "h2"], k=30))) for _ in range(2))
        assert dom.align(a, b, cells=20) == dom.align(a, b)
        assert dom._Matcher(20).score(a.root, b.root) == dom._Matcher().score(a.root, b.root)
