"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every node of a page's block tree gets features (text and link density of its
subtree, learned odds of its tag and attribute tokens and of those above and
below it, depth, number, likeness and sizes of its siblings) and, from the trees,
the probability that it holds main text. Decoding is hierarchical: a dropped
node drops everything below it, and the labelling with the highest total
log probability is found bottom-up in one pass, so no block is kept under a
dropped ancestor and none is dropped with a kept descendant.

Training: the text of a bounded sample of pages (``SAMPLE_PAGES``, the smallest
hashes of their url) that mark their article is set anew into generated layouts
with known labels: menus, sidebars, notices, adverts, forms and comments,
semantic and meaningless names, inside and around the article. The sampled
pages themselves, labelled by their ``article`` element, are part of it.

Edge cases: a null or empty html gives the empty text; unclosed and stray tags
are read as browsers do; pages are read whole; repeated rows are each
extracted; without any page that marks an article the generated words stand
in; an empty table gives an empty result; input columns named like an output
column are replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, dom
from .boosting import Boosted

#: Bounds of the training sample: pages, characters read of each, generated layouts.
SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS = 200, 20_000, 1200
#: Weight of a node of a sampled page; one of a generated layout has 1.
REAL_WEIGHT = 4.0

# Names that sites give to parts of a page.
MAIN_NAMES = ["article", "post", "entry", "content", "story", "main", "article-body", "post-content", "entry-content", "story-body",
              "page-content", "main-content", "body-text", "prose", "text", "postBody", "articleBody", "single-post", "blog-post", "mainContent"]
MENU_NAMES = ["nav", "menu", "navbar", "navigation", "main-nav", "topnav", "breadcrumbs", "breadcrumb", "menu-primary", "pagination", "toc", "skip-links"]
HEADER_NAMES = ["header", "site-header", "masthead", "topbar", "banner", "page-header", "logo"]
FOOTER_NAMES = ["footer", "site-footer", "copyright", "bottom", "colophon", "page-footer", "legal"]
SIDE_NAMES = ["sidebar", "side", "aside", "widget", "widget-area", "right-column", "rail", "related", "related-posts", "recommended", "trending",
              "popular", "most-read", "tags", "share", "social", "author-box"]
NOTICE_NAMES = ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "newsletter", "announcement",
                "disclaimer", "message", "subscribe", "paywall"]
ADVERT_NAMES = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adsbygoogle", "banner-ad", "sponsor", "promotion"]
COMMENT_NAMES = ["comments", "comment-list", "comment", "discussion", "responses", "replies", "reply", "respond", "disqus", "user-comments", "feedback"]
FORM_NAMES = ["form", "search", "search-form", "signup", "login", "contact-form", "subscribe-form", "searchform"]
PLAIN_NAMES = ["row", "col", "container", "wrapper", "inner", "block", "section", "grid", "box", "module", "wrap", "outer", "layout", "col-md-8", "flex", "page"]


class Layout:
    """One generated page around given text; blocks carry their labels."""

    def __init__(self, rng: random.Random, title: str, paragraphs: list[str], words: list[str], sentences: list[str]):
        self.rng, self.words, self.sentences = rng, words or ["word"], sentences or ["A sentence."]
        self.named = rng.random() < 0.85  # else most names say nothing
        self.html = self.page(title, paragraphs)

    def name(self, names: list[str], always: bool = False) -> str:
        r = self.rng
        if not always and (not self.named and r.random() < 0.8 or r.random() < 0.12):
            names = [*PLAIN_NAMES, f"c{r.randint(0, 9999)}", f"css-{r.randint(0, 99999):x}"]
        chosen = " ".join(r.sample(names, min(len(names), r.choice([1, 1, 1, 2]))))
        if r.random() < 0.2:
            chosen += " " + r.choice(PLAIN_NAMES)
        return f'{r.choice(["class", "class", "class", "id"])}="{chosen}"'

    def inside(self, text: str) -> str:
        """Inline markup and references around some words."""
        r, out = self.rng, []
        for w in text.split():
            w = entities.escape(w)
            if r.random() < 0.03:
                tag = r.choice(["b", "i", "em", "strong", "a", "span", "code"])
                w = f'<a href="/{r.randint(0, 99)}">{w}</a>' if tag == "a" else f"<{tag}>{w}</{tag}>"
            out.append(w)
        return " ".join(out)

    def phrase(self, lo: int = 1, hi: int = 4) -> str:
        return entities.escape(" ".join(self.rng.choices(self.words, k=self.rng.randint(lo, hi))))

    def sentence(self, most: int = 3) -> str:
        return entities.escape(" ".join(self.rng.choices(self.sentences, k=self.rng.randint(1, most))))

    def links(self) -> str:
        r = self.rng
        items = [f'<a href="/{r.randint(0, 999)}">{self.phrase()}</a>' for _ in range(r.randint(2, 12))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}" + "</li>" * (r.random() < 0.9) for i in items) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(items)

    def part(self, tag: str, names: list[str], body: str, always: bool = False) -> str:
        r = self.rng
        tag = tag if r.random() < 0.5 else "div"
        bare = tag != "div" and r.random() < 0.4
        return f'<{tag} {"" if bare else self.name(names, always)} {dom.LABEL}="0">{body}</{tag}>'

    def menu(self):
        return self.part("nav", MENU_NAMES, self.links())

    def head(self):
        r = self.rng
        body = r.choice([f"<h1>{self.phrase()}</h1>", f"<p>{self.phrase()}</p>", f'<a href="/">{self.phrase()}</a>', ""]) + r.choice([self.links(), f"<p>{self.sentence(1)}</p>", ""])
        return self.part("header", HEADER_NAMES, body or self.phrase())

    def foot(self):
        body = f"&copy; {self.phrase()} &middot; {self.sentence(2)}"
        return self.part("footer", FOOTER_NAMES, self.rng.choice([body, f"<p>{body}</p>", self.links() + f"<p>{body}</p>"]))

    def side(self):
        r = self.rng
        body = r.choice([self.links(), f"<p>{self.sentence()}</p>", f"<h3>{self.phrase()}</h3><p>{self.sentence()}</p>", f"<h4>{self.phrase()}</h4>" + self.links(),
                         f"<h3>{self.phrase()}</h3><ul>" + "".join(f"<li>{self.phrase()}</li>" for _ in range(r.randint(2, 6))) + "</ul>"])
        return self.part("aside", SIDE_NAMES, body, always="<p>" in body)

    def notice(self):
        return self.part("div", NOTICE_NAMES, self.rng.choice([self.sentence(2), f"<p>{self.sentence(3)}</p>", f"<p>{self.sentence(2)}</p><button>{self.phrase(1, 2)}</button>"]), True)

    def advert(self):
        return self.part(self.rng.choice(["div", "aside"]), ADVERT_NAMES, self.rng.choice([self.sentence(2), f"<p>{self.sentence(2)}</p>", f'<a href="/x">{self.sentence(1)}</a>']), True)

    def form(self):
        r = self.rng
        fields = "".join(f'<label>{self.phrase(1, 2)}</label><input name="f{i}">' for i in range(r.randint(1, 3)))
        body = f"<form>{r.choice(['', f'<p>{self.sentence(1)}</p>'])}{fields}<button>{self.phrase(1, 2)}</button></form>"
        return f'<div {self.name(FORM_NAMES)} {dom.LABEL}="0">{body}</div>' if r.random() < 0.5 else body.replace("<form", f'<form {self.name(FORM_NAMES)} {dom.LABEL}="0"', 1)

    def comments(self):
        r = self.rng
        item = r.choice(["div", "li", "article", "section"])
        one = lambda: f'<{item} {self.name(COMMENT_NAMES)}>' + r.choice([f"<b>{self.phrase(1, 2)}</b> {r.randint(1, 28)}.{r.randint(1, 12)}.2020", f"<h4>{self.phrase(1, 2)}</h4>", ""]) + f"<p>{self.sentence(4)}</p></{item}>"
        body = r.choice([f"<h3>{self.phrase(1, 2)}</h3>", f"<h2>{r.randint(1, 40)} {self.phrase(1, 1)}</h2>", ""]) + "".join(one() for _ in range(r.randint(1, 6)))
        return self.part("section", COMMENT_NAMES, body, True)

    def noise(self, kinds: str) -> str:
        return {"m": self.menu, "h": self.head, "f": self.foot, "s": self.side, "n": self.notice, "a": self.advert, "o": self.form,
                "c": self.comments}[self.rng.choice(kinds)]()

    def main(self, title: str, paragraphs: list[str]) -> str:
        r = self.rng
        style = r.choice(["p", "p", "p", "open", "div", "br"])
        out = []
        if r.random() < 0.8:
            h = f'<{(t := r.choice(["h1", "h1", "h2"]))} {dom.LABEL}="1">{self.inside(title)}</{t}>'
            out.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        loose = []
        for p in paragraphs:
            text = self.inside(p)
            if r.random() < 0.05:  # a paragraph that is one link
                text = f'<a href="/{r.randint(0, 99)}">{entities.escape(p)}</a>'
            if style == "br":
                loose.append(text)
                continue
            tag = r.choices([style if style != "open" else "p", "blockquote", "ul", "pre", "h2", "table", "figure"], [12, 1, 1.5, 0.5, 1.5, 0.7, 0.5])[0]
            if tag == "ul":
                cut = max(1, len(p) // 4)
                out.append(f'<ul {dom.LABEL}="1">' + "".join(f"<li>{entities.escape(p[i:i + cut])}</li>" for i in range(0, len(p), cut)) + "</ul>")
            elif tag == "table":
                out.append(f'<table {dom.LABEL}="1">' + "".join(f"<tr><td>{self.phrase()}</td><td>{self.phrase()}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif tag == "h2":
                out.append(f'<h2 {dom.LABEL}="1">{self.phrase(2, 6)}</h2>')
            elif tag == "figure":
                out.append(f'<figure {dom.LABEL}="1"><img src="x.png"><figcaption>{self.phrase(3, 9)}</figcaption></figure>')
            else:
                out.append(f'<{tag} {dom.LABEL}="1">{text}' + f"</{tag}>" * (style != "open"))
            if r.random() < 0.06:
                out.append(self.noise("aaasnoc"))
        if loose:
            out.append(f'<div {dom.LABEL}="1">' + r.choice(["<br>", "<br><br>"]).join(loose) + "</div>")
        return "".join(out)

    def page(self, title: str, paragraphs: list[str]) -> str:
        r = self.rng
        main = self.main(title, paragraphs)
        after = "".join(self.noise("assooccm") for _ in range(r.choice([0, 0, 1, 2])))
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        names = "" if tag != "div" and r.random() < 0.5 else self.name(MAIN_NAMES)
        body = f"<{tag} {names}>{main}{after if r.random() < 0.4 else ''}</{tag}>"
        if r.random() < 0.1:  # nothing around the article
            body = main
        for _ in range(r.choice([0, 0, 1, 2])):
            tag = r.choice(["div", "div", "section", "main"])
            body = f"<{tag} {self.name(PLAIN_NAMES + MAIN_NAMES[:6])}>" + (self.noise("sa") if r.random() < 0.2 else "") + body + (self.noise("sacm") if r.random() < 0.3 else "") + f"</{tag}>"
        top = "".join(self.noise("mmhhnao") for _ in range(r.randint(0, 4)))
        end = "".join(self.noise("ffffscanom") for _ in range(r.randint(0, 4)))
        return f"<!DOCTYPE html><html><head><title>{entities.escape(title)}</title><script>var a='<p>';</script></head><body>{top}{body}{end}</body></html>"


def training_trees(pages: list[str], layouts: int = LAYOUTS, seed: int = 11) -> list[dom.Tree]:
    """The sampled pages that mark an article, and generated layouts of their text."""
    rng = random.Random(seed)
    trees, sources, words, sentences = [], [], set(), set()
    for page in pages:
        if not re.search(r"<article\b", page, re.I):
            continue
        tree = dom.Tree(re.sub(r"<article\b", f'<article {dom.LABEL}="1"', page, flags=re.I))
        kept = tree.labels()
        runs = [i for i, t in enumerate(tree.tag) if t == dom.RUN]
        inner = [tree.text[i] for i in runs if kept[i]]
        if not inner:
            continue
        trees.append(tree)
        sources.append(inner)
        words.update(w for i in runs if not kept[i] for w in tree.text[i].split()[:8])
        sentences.update(tree.text[i][:300] for i in runs if not kept[i] and len(tree.text[i]) > 20)
        sentences.update(s for t in inner[:6] for s in re.split(r"(?<=[.!?])\s", t)[:3] if 15 < len(s) < 300)
    if not sources:
        words = {f"word{i}" for i in range(50)}
        sentences = {" ".join(rng.choices(sorted(words), k=12)).capitalize() + "." for _ in range(50)}
        sources = [[" ".join(rng.choices(sorted(sentences), k=rng.randint(1, 8))) for _ in range(6)] for _ in range(20)]
    words, sentences = sorted(words), sorted(sentences)
    for _ in range(layouts):
        inner = rng.choice(sources)
        picked = [p[:1500] for p in rng.sample(inner, min(len(inner), rng.randint(1, 9)))]
        trees.append(dom.Tree(Layout(rng, picked[0][:90], picked, words, sentences).html, generated=True))
    return trees


class Extractor:
    """Token odds and boosted trees; ``text(html)`` is the page's main text."""

    def __init__(self, score: dict[str, float], trees: Boosted):
        self.score, self.trees = score, trees

    @classmethod
    def fit(cls, pages: list[str], layouts: int = LAYOUTS) -> Extractor:
        trees = training_trees(pages, layouts)
        counts: dict[str, list[int]] = {}
        labels = [t.labels() for t in trees]
        for tree, label in zip(trees, labels):
            for tag, tokens, y in zip(tree.tag, tree.tokens, label.tolist()):
                for token in ("<" + tag, *tokens):
                    counts.setdefault(token, [0, 0])[y] += 1
        score = {t: float(np.clip(np.log((b + 1) / (a + 1)), -4, 4)) for t, (a, b) in counts.items() if a + b >= 3 and t not in ("<" + dom.RUN, "<#root")}
        x = np.concatenate([dom.features(t, score) for t in trees])
        y = np.concatenate(labels).astype(float)
        weight = np.concatenate([np.full(len(t.tag), 1.0 if t.generated else REAL_WEIGHT) for t in trees])
        return cls(score, Boosted().fit(x, y, weight))

    def keep(self, tree: dom.Tree) -> np.ndarray:
        """The consistent labelling of highest log probability, weighted by text."""
        x = dom.features(tree, self.score)
        margin = self.trees.margin(x)
        weight = 1.0 + x[:, 11].astype(float)  # log characters of the subtree
        yes, no = (weight * -np.logaddexp(0, -margin)).tolist(), (weight * -np.logaddexp(0, margin)).tolist()
        parent = tree.parent
        for i in range(len(parent) - 1, 0, -1):
            no[parent[i]] += no[i]
        best = yes.copy()  # with the best choice of every child
        for i in range(len(parent) - 1, 0, -1):
            best[parent[i]] += max(best[i], no[i])
        kept = [True] * len(parent)
        for i in range(1, len(parent)):
            kept[i] = kept[parent[i]] and best[i] > no[i]
        return np.array(kept)

    def text(self, html: str | None) -> str:
        tree = dom.Tree(html or "")
        if len(tree.tag) == 1:
            return ""
        kept = self.keep(tree)
        return "\n\n".join(t for t, tag, k in zip(tree.text, tree.tag, kept) if k and tag == dom.RUN)


def learn(pages: DataFrame, url: str = "url", html: str = "html") -> Extractor:
    rows = pages.where(F.col(html).isNotNull()).select(F.xxhash64(F.col(url)).alias("h"), F.col(url).alias("u"), F.col(html).alias("t"))
    # The hashes first, without the pages: SAMPLE_PAGES rows.
    edge = rows.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h").alias("edge"))
    sample = rows.join(F.broadcast(edge), F.col("h") <= F.col("edge")).groupBy("h", "u") \
        .agg(F.min(F.substring("t", 1, SAMPLE_CHARS)).alias("t")).orderBy("h", "u").limit(SAMPLE_PAGES).collect()
    return Extractor.fit([r.t for r in sample])


def extract(df: DataFrame, html: str, extractor: Extractor, out: str = "text") -> DataFrame:
    """Add the column ``out``: the page's main text."""
    @F.pandas_udf(T.StringType())
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extractor.text(p) for p in pages], index=pages.index, dtype=object)

    return common.without(df, out).withColumn(out, main_text(F.col(html)))


def op3_dom_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, "html", learn(pages)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
