"""Site-relative line frequency against a dictionary count."""

from __future__ import annotations

import random
import re

from verity.llm import linededup

BLANK = re.compile(r"^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$")


def brute(rows, ratio=linededup.RATIO, least=linededup.MIN_PAGES):
    pages, count = {}, {}
    for host, text in {(h or "", t) for _, h, t in rows if t is not None}:
        pages[host] = pages.get(host, 0) + 1
        for line in {BLANK.sub("", x) for x in text.split("\n")} - {""}:
            count[host, line] = count.get((host, line), 0) + 1
    drop = {k for k, n in count.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, h, t in rows:
        lines = [] if t is None else t.split("\n")
        left = [x for x in lines if (h or "", BLANK.sub("", x)) not in drop]
        out.append((i, h, len(lines), len(lines) - len(left), None if t is None else "\n".join(left)))
    return out


def test_against_counts(rows_of):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        host = rng.choice(["hot"] * 6 + ["a", "b", None, "tiny"] if i % 50 else ["rare"])
        lines = [f"unique {i} {k}" for k in range(rng.randint(0, 4))] + [""] * rng.randint(0, 2)
        lines += [x for x, p in ((" Menu\t", 0.5), ("Menu", 0.2), ("Rights reserved", 0.08), ("漢字 menu", 0.15), ("  ", 0.3)) if rng.random() < p]
        rng.shuffle(lines)
        rows.append((i, host, "\n".join(lines)))
    rows += [(1000 + i, "hot", "copied line one\ncopied line two") for i in range(300)]  # copies are one page
    rows += [(2000, "a", None), (2001, "a", ""), (2002, "a", "Menu"), (2003, "a", "x" * 300_000 + "\nMenu"), (2003, "a", "x" * 300_000 + "\nMenu")]
    df = rows_of(("doc_id", "source", "text", "n_lines", "_host"), [(*r, "clash", "clash") for r in rows]).repartition(4)
    got = linededup.drop_lines(df, "source", "text").select("doc_id", "source", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    assert any(r.n_dropped for r in got) and all(not r.n_dropped for r in got if 1000 <= r.doc_id < 2000)


def test_empty_table(rows_of):
    assert linededup.drop_lines(rows_of(("doc_id", "source", "text"), []), "source", "text").count() == 0
