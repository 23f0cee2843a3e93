"""The prefix tree against a dictionary of prefixes, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest

from verity.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = "conv_id long, turn long, role string, text string, position string, tree string"


def conversations():
    rng = random.Random(8)
    turns = [("system", "be kind"), ("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", "a\nb"), ("tool\n\\<|", "<\\|x"),
             ("assistant", ""), (None, None), ("assistant", "long " * 3000), ("user", "漢 <|im_start|>user")]
    convs = {i: [rng.choice(turns[:rng.randint(2, 9)]) for _ in range(rng.randint(1, 7))] for i in range(120)}
    convs |= {200 + i: [("user", "hot"), ("assistant", "start"), ("user", str(i % 9))] for i in range(90)}
    return convs | {500: [("user", str(i)) for i in range(300)], None: [("user", "no id")]}


def rows(convs):
    return [(c, t, r, x, "clash", None) for c, ts in convs.items() for t, (r, x) in enumerate(ts)]


def test_escaping_round_trips_and_hides_markers():
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choices(["<", "|", "\\", ">", "im_end", "n", "\n", "<|im_end|>"], k=rng.randint(0, 12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        e = chat.escape_role(s)
        assert chat.unescape_role(e) == s and "<|" not in e and "\n" not in e


@pytest.mark.parametrize("block", [3, 1024])
def test_read_back(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    convs = conversations()
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows(convs), COLUMNS).repartition(4), PATH).collect()}
    assert got.keys() == convs.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, ts in convs.items():
        ts = [(r or "", t or "") for r, t in ts]
        loss = "".join(t for r, t in ts if r == "assistant")
        text = "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n" for r, t in ts)
        assert tuple(got[c])[1:] == (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), sha(loss), len(text))


@pytest.mark.parametrize("block", [3, 1024])
def test_tree_layout(spark, monkeypatch, block):
    """Shared tokens once, gapless and depth first; positions and intervals are the path's."""
    monkeypatch.setattr(chat, "BLOCK", block)
    convs = conversations()
    nodes, leaves = chat.prefix_tree(spark.createDataFrame(rows(convs), COLUMNS), PATH)
    nodes = nodes.collect()
    prefixes = {tuple((r or "", t or "") for r, t in ts[:i + 1]) for ts in convs.values() for i in range(len(ts))}
    assert len(nodes) == len(prefixes)
    by_tree = {}
    for n in nodes:
        by_tree.setdefault(n.tree, []).append(n)
    assert len(by_tree) == len({p for p in prefixes if len(p) == 1})
    at = {(n.tree, n.start): n for n in nodes}
    for tree in by_tree.values():
        tree.sort(key=lambda n: n.start)
        end, open_path = 0, []
        for n in tree:
            assert n.start == end and n.n_tokens == len(n.ids) // 4
            end += n.n_tokens
            while open_path and open_path[-1].position + open_path[-1].n_tokens > n.position:
                open_path.pop()
            assert n.position == sum(p.n_tokens for p in open_path)  # depth first: the ancestors are the open path
            seen = {i for r in n.ancestors for i in range(r["from"], r["to"])}
            assert seen == {i for p in open_path for i in range(p.start, p.start + p.n_tokens)}
            open_path.append(n)
    for leaf in leaves.collect():
        assert (leaf.tree, leaf.start) in at


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], COLUMNS), PATH).count() == 0


@pytest.mark.parametrize("turns", [[("user", "same")] * 3])
def test_repeated_rows_are_turns(spark, turns):
    df = spark.createDataFrame([(1, 0, r, t, None, None) for r, t in turns], COLUMNS)
    assert chat.formatted(df, PATH).first().n_turns == 3
