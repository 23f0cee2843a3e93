"""Extraction: held-out accuracy on pages and layouts, hand-written pages, the tree's rules."""

from __future__ import annotations

import random
import re
import time
import unicodedata

import numpy as np
import pytest

from verity.llm import dom, extract
from verity.llm.boosting import Boosted

PAGES = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{PAGES}/pages.parquet").orderBy("page_id").limit(500).collect()]


@pytest.fixture(scope="module")
def extractor(pages):
    return extract.Extractor.fit([p[:extract.SAMPLE_CHARS] for p in pages[:200]])


def wanted(tree):
    return "\n\n".join(t for t, tag, y in zip(tree.text, tree.tag, tree.labels()) if y and tag == dom.RUN)


def test_held_out_pages(pages, extractor):
    right = 0
    for p in pages[200:]:
        right += extractor.text(p) == wanted(dom.Tree(re.sub(r"<article\b", f'<article {dom.LABEL}="1"', p)))
    assert right >= 0.99 * len(pages[200:])


def test_held_out_layouts(pages, extractor):
    trees = extract.training_trees(pages[300:400], layouts=200, seed=5)[-200:]
    exact = false = missed = total = 0
    for tree in trees:
        y, k = tree.labels() == 1, extractor.keep(tree)
        run, chars = np.array([t == dom.RUN for t in tree.tag]), np.array([len(t) for t in tree.text])
        exact += (y[run] == k[run]).all()
        false, missed, total = false + chars[run & k & ~y].sum(), missed + chars[run & ~k & y].sum(), total + chars[run & y].sum()
    assert exact >= 0.85 * len(trees) and false < 0.02 * total and missed < 0.02 * total


BODY = [f"This is paragraph number {i} of the story, and it goes on for a while, so that it reads like prose. It ends here." for i in range(5)]
HAND = [
    '<body><div id="cookie-banner"><p>We use cookies, and you accept them by reading on.</p></div><div class="main-nav"><a href=1>Home</a> <a href=2>News</a></div>'
    '<div class="post-content">{p}</div><div class="comments"><h3>2 comments</h3><div class="comment"><p>What a fine story this is, I must say, really.</p></div></div>'
    '<div class="site-footer">&copy; 2020 Somebody</div></body>',
    '<html><body><header class="site-header"><a href="/">The Site</a><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav></header><main><article>{p}'
    '<aside class="advert"><p>Buy this thing now, it is very good, they say.</p></aside></article></main><aside class="sidebar"><h3>Popular</h3>'
    '<ul><li><a href=3>Another story</a></li><li><a href=4>And another</a></li></ul></aside><form class="search"><label>Search</label><input><button>Go</button></form>'
    '<footer><p>Copyright notice of the site</p></footer></body></html>',
]


def test_hand_written_pages(extractor):
    for page in HAND:
        got = extractor.text(page.format(p="".join(f"<p>{b}</p>" for b in BODY)))
        assert got == "\n\n".join(BODY)


MENU = "<div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div>"
FOOT = "<div>&copy; 2020 Somebody. All rights reserved.</div>"
TITLE, LINKED = "The title of this story", "A paragraph that is one link to another page of the site"


@pytest.mark.parametrize("page, also", [
    (f"<body>{MENU}<div><h1>{TITLE}</h1>{{p}}</div>{FOOT}</body>", [TITLE]),
    (f'<body><div class="c1">{MENU}</div><div class="c7"><h1>{TITLE}</h1><div class="c9">{{p}}</div></div><div class="c3">{FOOT}</div></body>', [TITLE]),
    (f"<body>{MENU}<h1>{TITLE}</h1>{{p}}{FOOT}</body>", [TITLE]),
    (f'<body><nav>{MENU}</nav><article>{{p}}<p><a href="/x">{LINKED}</a></p></article><footer>{FOOT}</footer></body>', [LINKED]),
    (f'<body><nav>{MENU}</nav><article><h1>{TITLE}</h1><p><a href="/x">{LINKED}</a></p>{{p}}</article></body>', [TITLE, LINKED]),
])
def test_titles_without_names_and_paragraphs_of_one_link(extractor, page, also):
    got = extractor.text(page.format(p="".join(f"<p>{b}</p>" for b in BODY))).split("\n\n")
    assert set(BODY) | set(also) == set(got)


def test_character_counts():
    texts = ["", "A b, C.", "x" * 900 + "ÀÉ 12", "", "漢字 ½ ² ٣?", "© ∑|!"]
    got = dom.character_counts(texts)
    for i, t in enumerate(texts):
        marks = sum(c in ".,;:!?" for c in t)
        assert got[:, i].tolist() == [t.count(" "), marks, sum(map(str.isdigit, t)), sum(map(str.isupper, t)), sum(unicodedata.category(c)[0] == "S" for c in t)]
    assert dom.character_counts([]).shape == (5, 0)


def steps(page):
    """Lines of Python executed while the page is parsed, a measure without a clock."""
    import sys

    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += 1
        return count if frame.f_code.co_filename == dom.__file__ else None

    old = sys.gettrace()
    sys.settrace(count)
    try:
        dom.Tree(page)
    finally:
        sys.settrace(old)
    return n


@pytest.mark.parametrize("page", [
    lambda n: "<div>" * n + "<p>x" * n,
    lambda n: "<p><button>" + "<div>" * n + "<div>x</div>" * n,
    lambda n: "<li>" * n + "<ul>" * n + "<li>x" * n,
    lambda n: "<video>" + "<div>" * n + "</b><p>" * n,
])
def test_nesting_takes_linear_time(page):
    assert steps(page(2000)) < 2.2 * steps(page(1000))
    started = time.process_time()
    dom.features(dom.Tree(page(30_000)), {})
    assert time.process_time() - started < 60


def test_first_split_is_the_best():
    """One tree of depth 1 against every threshold of every feature."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, size=(300, 4)).astype(np.float32)
    y = (x[:, 2] + rng.normal(size=300) > 4).astype(float)
    model = Boosted(trees=1, depth=1).fit(x, y, np.ones(300))
    p = y.mean()
    part = lambda m: ((y - p) * m).sum() ** 2 / (p * (1 - p) * m.sum() + model.ridge)
    gains = {(j, t): part(x[:, j] <= t) + part(x[:, j] > t) for j in range(4) for t in range(8)}
    assert (model.feature[0, 0], model.threshold[0, 0]) == max(gains, key=gains.get)


def test_decoding_is_consistent_and_best():
    """No kept node below a dropped one; equal to trying every labelling of small trees."""
    rng = random.Random(3)
    for _ in range(40):
        tree = dom.Tree("".join(rng.choice(["<div>", "</div>", "<p>", "x y z ", "<section>", "</section>"]) for _ in range(12)))
        n = len(tree.tag)
        if not 2 <= n <= 12:
            continue
        margins = np.array([rng.gauss(0, 2) for _ in range(n)])
        ex = extract.Extractor({}, type("Fixed", (), {"margin": lambda self, x: margins})())
        kept = ex.keep(tree)
        weight = 1.0 + dom.features(tree, {})[:, 11].astype(float)
        gain = lambda ks: sum(w * -np.logaddexp(0, -m if k else m) for k, m, w in zip(ks, margins, weight))
        ok = lambda ks: ks[0] and all(ks[tree.parent[i]] or not ks[i] for i in range(1, n))
        assert ok(kept)
        best = max(gain(ks) for b in range(2**n) if ok(ks := [b >> i & 1 for i in range(n)]))
        assert abs(gain(kept) - best) < 1e-9


def test_blocks_references_and_white_space():
    texts = lambda h: [t for t, tag in zip(dom.Tree(h).text, dom.Tree(h).tag) if tag == dom.RUN]
    assert texts("<p>a&amp;b&nbsp;&lt;c&gt;\n d<br>e<p>f<b>g</b>h") == ["a&b <c> d e", "fgh"]
    assert texts("<ul><li>one<li>two</ul>three<script>var a='<p>x'</script><!-- c --><style>p{}</style>") == ["one", "two", "three"]
    assert texts("<table><tr><td>a<td>b</tr><tr><td>c</table>") == ["a b", "c"]
    assert texts("plain &eacute; &#x6f22;&#23383;") == ["plain é 漢字"]
    assert texts("<title>t</title><noscript><p>x</p></noscript>") == []
    assert len(texts("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1


@pytest.mark.parametrize("html, runs", [
    ('<p>one <svg class="icon"/> two</p><p>three</p>', ["one two", "three"]),
    ("<p>one <svg><title/><path d='x'/><style/></svg> two</p>", ["one two"]),
    ("<p>one <svg><text>no</text></svg> two</p>", ["one two"]),
    *[(f"<div><p>one <{tag}> no</p><p>two</p></div><p>three</p>", ["one", "two", "three"])
      for tag in ("video", "audio", "object", "canvas", "noscript", "svg", "template")],
    ("<div>one <noscript><div>no</div> no</noscript> two</div>", ["one two"]),
    ("<div>one <video><p>no<p>no</video> two</div>", ["one two"]),
    ("<div>one <object><div>no</div></div><p>two</p>", ["one", "two"]),
    ("<div>one <script>'</div>'</script> two</div>", ["one two"]),
    ("<article><p>for <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn><annotation>no</annotation></math> all</p></article>", ["for x=2 all"]),
])
def test_unrendered_elements_end(html, runs):
    tree = dom.Tree(html)
    assert [t for tag, t in zip(tree.tag, tree.text) if tag == dom.RUN] == runs


def test_boosting_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = Boosted(trees=40).fit(x[:3000], y[:3000], np.ones(3000))
    assert ((model.margin(x[3000:]) > 0) == (y[3000:] == 1)).mean() > 0.95


def test_query_edge_cases(spark, tmp_path, pages):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>&amp;</p>" * 2000, "x"), (4, "w", pages[0], None), (4, "w", pages[0], None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "a/pages.parquet"))
    got = extract.op3_dom_boosting(spark, str(tmp_path / "a")).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert all(r.n_chars == len(r.text) for r in got)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "b/pages.parquet"))
    assert extract.op3_dom_boosting(spark, str(tmp_path / "b")).count() == 0
