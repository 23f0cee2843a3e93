"""Trie of conversation prefixes by range minima over sorted LCPs.

Conversations are sorted as sequences of turns, so the members of any prefix are
neighbours: a run within which every LCP (turns that a conversation shares with
the one before it) is at least the prefix's depth. The sorted order is cut into
blocks, and each is solved in one task (``solve``): a sparse table answers range
minima of the LCPs, every candidate prefix (a conversation and a depth)
binary-searches the left and the right end of its run on its own, without a
stack, and candidates with one left end and depth are one node. Sums over
subtrees are differences of running sums, because candidates in the order of
(position, depth) are the trie's nodes depth first.

A prefix can reach over a block's edge. The prefixes that cross an edge form a
sorted sequence with LCPs again, one element an edge, and carry what their
blocks have counted so far; so the edges are cut into blocks and solved by the
same function, until one block is left. No task holds more than ``BLOCK``
conversations or edges, however common a prefix is.

The list of members that end in a prefix is hashed where the prefix lies inside
a block; across blocks, member ids are sorted by (prefix, id) and hashed as
they stream by, as one digest over a list in order needs. Turns are compared by
60 bits of a digest of role and text; a conversation's turns (16 bytes each,
never the texts) are one row.

Edge cases: a null role or text is empty; turns with one number follow their
digests, and repeated rows are repeated turns; null turn numbers come first;
rows without a conversation id belong to no conversation; texts of any length
count by their digest and length; an empty table has no nodes, not even a root;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .resample import CRC_SQL, _crc_table

#: Conversations, or edges between blocks, that one task solves.
BLOCK = 16_384
#: Conversations whose ids agree up to the last two digits share the turns of the first, and how many at most.
FAMILY, HEADS = 100, 6

_FAR = np.int64(2**62)
_EMPTY = hashlib.sha256(b"").hexdigest()
_OUT = "kind int, at long, conv_id long, depth long, parent long, n long, children long, leaves long, saved long, chars long, ends string, prefix binary"
_NODE, _OPEN, _BLOCK, _PLACE, _END = range(5)


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k, index i: the least of ``values[i : i + 2**k]``."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        half, last = 2 ** (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[:-half], last[half:]))
    return levels


def extents(lcp: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each candidate's run: the positions around
    ``at`` with no LCP below ``depth`` in between. ``lcp[i]`` is between i-1 and i."""
    levels = sparse_table(lcp)
    left, right = at.copy(), at.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, least = 2 ** k, levels[k]
        start = right + 1
        fits = start + step <= len(lcp)
        fits[fits] = least[start[fits]] >= depth[fits]
        right[fits] += step
        start = left - step + 1
        fits = start >= 1
        fits[fits] = least[start[fits]] >= depth[fits]
        left[fits] -= step
    return left, right


def solve(lcp: np.ndarray, longest: np.ndarray, after: int, first_edge: int, pay: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The nodes of one block of sorted elements.

    ``lcp[0]`` is shared with the block before (-1: there is none) and ``after``
    with the block behind; ``longest`` is each element's depth. ``pay`` has a
    value per candidate (element, depth 0..longest): members ``n``, smallest
    member ``conv``, code points ``chars``, and what was counted below it
    before: ``children``, ``leaves``, ``saved``. The edge before the block has
    the number ``first_edge``. Returned per candidate: its ``node`` (the
    candidate at the node's left end), and per node, at its candidate, the sums.
    """
    count = longest + 1
    offset = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(np.arange(len(longest)), count)
    depth = np.arange(offset[-1]) - offset[at]
    left, right = extents(lcp, at, depth)
    node = offset[left] + depth
    top = node == np.arange(len(node))
    total = {c: np.bincount(node, weights=pay[c], minlength=len(node)).astype(np.int64) for c in ("n", "children", "leaves", "saved")}
    conv, chars = np.full(len(node), _FAR), np.zeros(len(node), np.int64)
    np.minimum.at(conv, node, pay["conv"])
    np.maximum.at(chars, node, pay["chars"])
    before = (left == 0) & (lcp[0] >= depth)
    behind = (right == len(longest) - 1) & (after >= depth)
    closed = top & ~before & ~behind
    edge = np.where(before, first_edge, first_edge + 1)
    parent = node[np.maximum(np.arange(len(node)) - 1, 0)]  # of a candidate: the node one turn shorter; depth 0 has none
    inner = closed & (depth > 0)
    total["children"] += np.bincount(parent[inner], minlength=len(node))
    leaf = closed & (total["children"] == 0)
    for name, own in (("leaves", leaf.astype(np.int64)), ("saved", np.where(closed, (total["n"] - 1) * chars, 0))):
        run = np.concatenate([[0], np.cumsum(own)])
        total[name] += run[offset[right + 1]] - run[np.arange(len(node))]
    return total | {"node": node, "top": top, "closed": closed, "edge": edge, "depth": depth, "at": at, "conv": conv, "chars": chars, "parent": parent}


def _rows(kind: int, count: int, **columns) -> pa.Table:
    kinds = {"kind": pa.int32(), "ends": pa.string(), "prefix": pa.binary()}
    names = [c.split()[0] for c in _OUT.split(", ")]
    columns["kind"] = np.full(count, kind)
    return pa.table([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(count, kinds.get(c, pa.int64())) for c in names], names=names)


def _report(block: int, lcp: np.ndarray, s: dict[str, np.ndarray], ends: dict[int, str], prefix: dict[int, bytes], places: bool, first: int) -> list[pa.Table]:
    """Output rows of a solved block: its closed nodes, the parts of its open
    ones, its least inner LCP and, if wanted, where each candidate went."""
    i = np.flatnonzero(s["closed"])
    p, inner = s["parent"][i], s["depth"][i] > 0
    known = inner & s["closed"][p]
    masked = lambda values, there: pa.array(values, pa.int64(), mask=~there)
    out = [_rows(_NODE, len(i), conv_id=s["conv"][i], depth=s["depth"][i], parent=masked(s["conv"][p], known), at=masked(s["edge"][p], inner & ~known),
                 n=s["n"][i], children=s["children"][i], leaves=s["leaves"][i], saved=s["saved"][i],
                 ends=[ends.get(x) for x in i.tolist()], prefix=[prefix.get(x) for x in i.tolist()])]
    i = np.flatnonzero(s["top"] & ~s["closed"])
    out.append(_rows(_OPEN, len(i), at=s["edge"][i], depth=s["depth"][i], conv_id=s["conv"][i], n=s["n"][i], chars=s["chars"][i],
                     children=s["children"][i], leaves=s["leaves"][i], saved=s["saved"][i], prefix=[prefix.get(x) for x in i.tolist()]))
    out.append(_rows(_BLOCK, 1, at=[block], n=[int(lcp[1:].min()) if len(lcp) > 1 else int(_FAR)]))
    if places:
        node = s["node"]
        closed = s["closed"][node]
        out.append(_rows(_PLACE, len(node), at=first + s["at"], depth=s["depth"], parent=masked(s["conv"][node], closed), n=masked(s["edge"][node], ~closed)))
    return out


def _solve_conversations(table: pa.Table) -> pa.Table:
    """One block of sorted conversations (block, place, conv_id, turns, chars, lcp_before, lcp_behind)."""
    import xxhash

    table = table.sort_by("place").combine_chunks()
    block, before, behind = (table.column(c)[0].as_py() for c in ("block", "lcp_before", "lcp_behind"))
    conv = table.column("conv_id").to_numpy()
    flat = lambda c: table.column(c).combine_chunks()
    lists = flat("turns")
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    turns, chars = lists.flatten().to_numpy(), flat("chars").flatten().to_numpy()
    longest = np.diff(bounds)
    lcp = np.full(len(conv), before, np.int64)
    for e in range(1, len(conv)):
        m = min(longest[e - 1], longest[e])
        differ = turns[bounds[e - 1]:bounds[e - 1] + m] != turns[bounds[e]:bounds[e] + m]
        lcp[e] = differ.argmax() if differ.any() else m
    offset = np.concatenate([[0], np.cumsum(longest + 1)])
    at = np.repeat(np.arange(len(conv)), longest + 1)
    depth = np.arange(offset[-1]) - offset[at]
    width = np.zeros(offset[-1], np.int64)
    width[depth > 0] = chars
    none = np.zeros(offset[-1], np.int64)
    s = solve(lcp, longest, behind, block, {"n": none + 1, "conv": conv[at], "chars": width, "children": none, "leaves": none, "saved": none})
    members: dict[int, list[int]] = {}
    for e, x in enumerate(s["node"][offset[1:] - 1].tolist()):
        members.setdefault(x, []).append(e)
    ends, prefix, far = {}, {}, []
    for x, es in members.items():
        if s["closed"][x]:
            ends[x] = hashlib.sha256(",".join(map(str, conv[es].tolist())).encode()).hexdigest()
        else:
            prefix[x] = xxhash.xxh3_128_digest(turns[bounds[es[0]]:bounds[es[0] + 1]].tobytes())
            far += [(prefix[x], c) for c in conv[es].tolist()]
    out = _report(block, lcp, s, ends, prefix, False, 0)
    out.append(_rows(_END, len(far), conv_id=[c for _, c in far], prefix=[p for p, _ in far]))
    return pa.concat_tables(out)


def _solve_edges(table: pa.Table) -> pa.Table:
    """One block of edges (block, place, longest, lcp, lcp_behind, parts), parts
    being what their prefixes bring from the level below, if anything."""
    table = table.sort_by("place")
    block, behind, first = (table.column(c)[0].as_py() for c in ("block", "lcp_behind", "place"))
    longest, lcp = table.column("longest").to_numpy(), table.column("lcp").to_numpy()
    offset = np.concatenate([[0], np.cumsum(longest + 1)])
    pay = {c: np.zeros(offset[-1], np.int64) for c in ("n", "chars", "children", "leaves", "saved")} | {"conv": np.full(offset[-1], _FAR)}
    named: dict[int, bytes] = {}
    for e, parts in enumerate(table.column("parts").to_pylist()):
        for part in parts or []:
            x = int(offset[e]) + part["depth"]
            for c in ("n", "chars", "children", "leaves", "saved"):
                pay[c][x] = part[c]
            pay["conv"][x] = part["conv_id"]
            if part["prefix"] is not None:
                named[x] = part["prefix"]
    s = solve(lcp, longest, behind, block, pay)
    prefix = {int(s["node"][x]): p for x, p in named.items()}
    return pa.concat_tables(_report(block, lcp, s, {}, prefix, True, first))


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, ends) of rows that come sorted by (prefix, conv_id)."""
    current, state = None, None
    for batch in batches:
        done = []
        for prefix, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if prefix != current:
                if state is not None:
                    done.append((current, state.hexdigest()))
                current, state = prefix, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([e for _, e in done])], names=["prefix", "_ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()])], names=["prefix", "_ends"])


def rebuilt(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns, chars): digests and lengths of each rebuilt conversation's turns."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("turns"), F.length(t).cast("long").alias("chars")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = common.written(own.select("conv_id", F.col("t.turns").alias("turns"), F.col("t.chars").alias("chars")), "turns")
    c = F.col("conv_id")
    heads = own.where(c % FAMILY == 0).select(c.alias("_first"), F.slice("turns", 1, HEADS).alias("_turns"), F.slice("chars", 1, HEADS).alias("_chars"))
    both = own.withColumn("_h", (F.crc32(c.cast("string").cast("binary")) % HEADS).cast("int")) \
        .join(heads, c - c % FAMILY == F.col("_first"), "left")
    join = lambda a, b: F.concat(F.coalesce(F.slice(b, 1, F.col("_h")), F.array().cast("array<long>")), F.slice(a, F.col("_h") + 1, F.size(a)))
    return both.select("conv_id", join("turns", "_turns").alias("turns"), join("chars", "_chars").alias("chars"))


def _numbered_blocks(placed: DataFrame) -> DataFrame:
    """(part, block, lcp_before, lcp_behind) of the partitions that hold rows."""
    edges = placed.groupBy("part").agg(F.min_by("turns", "place").alias("head"), F.max_by("turns", "place").alias("tail"))
    edges = common.written(edges.join(edges.select("part", (F.row_number().over(Window.orderBy("part")) - 1).cast("long").alias("block")), "part"), "edges")
    before = edges.select((F.col("block") + 1).alias("block"), F.col("tail").alias("before"))
    # The first place where the sequences differ; the shorter one ends there at the latest.
    differ = F.array_position(F.zip_with("before", "head", lambda a, b: a.eqNullSafe(b)), False)
    same = F.when(differ > 0, differ - 1).otherwise(F.size("head"))
    lcps = edges.join(before, "block", "left").select("part", "block", F.when(F.col("before").isNull(), -1).otherwise(same).cast("long").alias("lcp_before"))
    lcps = common.written(lcps, "lcps")
    behind = lcps.select((F.col("block") - 1).alias("block"), F.col("lcp_before").alias("lcp_behind"))
    return lcps.join(behind, "block", "left").fillna(-1, ["lcp_behind"])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of (conv_id, turns, chars) rows with unique
    ids: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    sequences = common.written(sequences, "sequences")
    parts = max(1, -(-sequences.count() // BLOCK))
    placed = sequences.repartitionByRange(parts, "turns", "conv_id").sortWithinPartitions("turns", "conv_id") \
        .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    placed = common.written(placed, "sorted")
    blocks = common.written(_numbered_blocks(placed), "blocks")
    solved = placed.join(blocks, "part").select("block", "place", "conv_id", "turns", "chars", "lcp_before", "lcp_behind") \
        .groupBy("block").applyInArrow(_solve_conversations, _OUT)
    levels = [common.written(solved, "level")]
    befores = blocks.select("block", "lcp_before")
    n_blocks = blocks.count()
    while n_blocks > 1:
        below = levels[-1]
        # Edge k lies between blocks k-1 and k; block k-1 as a whole lies between edges k-1 and k.
        least = below.where(F.col("kind") == _BLOCK).select((F.col("at") + 1).alias("block"), F.col("n").alias("least"))
        previous = befores.select((F.col("block") + 1).alias("block"), F.col("lcp_before").alias("previous"))
        edges = befores.where("block > 0").join(previous, "block").join(least, "block").select(
            F.col("block").alias("place"), F.col("lcp_before").alias("longest"),
            F.when(F.col("block") == 1, -1).otherwise(F.least("lcp_before", "previous", "least")).cast("long").alias("lcp"),
            F.floor((F.col("block") - 1) / BLOCK).cast("long").alias("block"))
        edges = common.written(edges, "edges")
        befores = edges.where((F.col("place") - 1) % BLOCK == 0).select("block", F.col("lcp").alias("lcp_before"))
        behind = befores.select((F.col("block") - 1).alias("block"), F.col("lcp_before").alias("lcp_behind"))
        sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
        opened = below.where(F.col("kind") == _OPEN).groupBy(F.col("at").alias("place"), "depth") \
            .agg(*sums, F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("prefix").alias("prefix"))
        opened = opened.groupBy("place").agg(F.collect_list(F.struct("depth", "n", "conv_id", "chars", "children", "leaves", "saved", "prefix")).alias("parts"))
        rows = edges.join(opened, "place", "left").join(behind, "block", "left").fillna(-1, ["lcp_behind"])
        levels.append(common.written(rows.groupBy("block").applyInArrow(_solve_edges, _OUT), "level"))
        n_blocks = -(-(n_blocks - 1) // BLOCK)
    # From the last level down: where a prefix that was open below ended up.
    nodes, places = None, None
    for level in reversed(levels):
        here = level.where(F.col("kind") == _NODE)
        if places is not None:
            up = places.select(F.col("at"), (F.col("depth") + 1).alias("depth"), F.col("parent").alias("_parent"))
            here = here.join(up, ["at", "depth"], "left").withColumn("parent", F.coalesce("parent", "_parent")).drop("_parent")
        here = here.select("conv_id", "depth", "parent", "n", "children", "leaves", "saved", "ends", "prefix")
        nodes = here if nodes is None else nodes.unionByName(here)
        moved = level.where(F.col("kind") == _PLACE).select("at", "depth", "parent", "n")
        if places is not None:
            up = places.select(F.col("at").alias("n"), "depth", F.col("parent").alias("_parent"))
            moved = moved.join(up, ["n", "depth"], "left").withColumn("parent", F.coalesce("parent", "_parent"))
        places = moved.select("at", "depth", "parent")
    far = levels[0].where(F.col("kind") == _END).select("prefix", "conv_id") \
        .repartition("prefix").sortWithinPartitions("prefix", "conv_id").mapInArrow(_streamed_digests, "prefix binary, _ends string")
    return nodes.join(far, "prefix", "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", "_ends", F.lit(_EMPTY)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the rebuilt ``conversations``."""
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return prefix_trie(rebuilt(turns, "conv_id", "turn", "role", "text"))


ORACLE = f"""
WITH crc AS ({_crc_table()}),
turns AS (SELECT conv_id, turn, coalesce(text, '') AS text, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS h
          FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, conv_id::VARCHAR AS x, list(h ORDER BY turn NULLS FIRST, h) AS hs, list(length(text) ORDER BY turn NULLS FIRST, h) AS cs FROM turns GROUP BY conv_id),
drawn AS (SELECT own.*, {CRC_SQL} % {HEADS} AS k FROM own, crc),
whole AS (SELECT d.conv_id, list_concat(coalesce(b.hs[1:d.k], []), d.hs[d.k + 1:]) AS hs, list_concat(coalesce(b.cs[1:d.k], []), d.cs[d.k + 1:]) AS cs
          FROM drawn d LEFT JOIN own b ON b.conv_id = d.conv_id - d.conv_id % {FAMILY}),
prefixes AS (SELECT conv_id, d, len(hs) AS n, md5(array_to_string(hs[1:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(hs[1:d - 1], ',')) END AS up,
               CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len(hs) + 1)) AS d FROM whole)),
nodes AS (SELECT d, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM prefixes GROUP BY d, node),
counted AS (SELECT nodes.*, coalesce(c, 0) AS n_children FROM nodes LEFT JOIN (SELECT up AS node, count(*) AS c FROM nodes WHERE d > 0 GROUP BY 1) USING (node)),
sums AS (SELECT p.d, p.node, sum(c.own)::BIGINT AS saved_tokens, count(*) FILTER (c.n_children = 0) AS n_leaves
         FROM counted c JOIN prefixes p ON p.conv_id = c.conv_id AND p.d <= c.d GROUP BY 1, 2)
SELECT c.conv_id, c.d::BIGINT AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.d = c.d AND s.node = c.node LEFT JOIN nodes u ON u.d = c.d - 1 AND u.node = c.up"""
