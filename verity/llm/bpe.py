"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of documents is one small corpus: its distinct new words are laid out
as one sequence of byte symbols, an inverted index maps every adjacent pair
that can merge to the positions where it stands, and the merges are replayed in
rank order over all words at once. A merge touches only its own position and
the two neighbours, whose pairs leave and enter the index. A word's ids depend
on that word alone, so replaying block by block gives the ids of a replay over
the whole corpus without shuffling a word; a bounded memo carries words from
one block to the next.

Edge cases: a null text is the empty text (no ids, the digests of no bytes); a
word that is a token as a whole is that token, as in the tiktoken library;
invalid surrogates cannot occur in a Spark string. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words whose ids a task remembers between blocks; beyond it the memo starts anew.
MEMO_WORDS = 400_000

#: Ids are below it.
SHIFT = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """``left id * SHIFT + right id`` -> id of the merged token, which is also the merge's rank."""
    out = {}
    for token, r in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left * SHIFT + right] = r
    return out


class Merges:
    """A vocabulary's merges, by pair and as sorted arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of = merge_table(ranks)
        self.keys = np.array(sorted(self.of), np.int64)
        self.ids = np.array([self.of[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, -1 if it does not merge."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left * SHIFT + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], -1)


#: In place of the next position: the symbol has been merged into its left neighbour.
GONE = -2

#: Merges with fewer positions are replayed position by position.
WIDE = 100


class Corpus:
    """Words laid out as one sequence of symbols with links to the neighbours
    in the same word, and the inverted index from merge to positions."""

    def __init__(self, words: list[bytes], merges: Merges):
        self.merges = merges
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        self.starts = ends - sizes
        self.sym = merges.bytes[np.frombuffer(b"".join(words), np.uint8)]
        self.nxt, self.prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.nxt[ends - 1] = -1
        self.prv[self.starts] = -1
        self.pair = np.full(n, -1)  # merge that the pair at a position stands for
        self.index: dict[int, list[np.ndarray]] = {}
        self.mixed = np.zeros(n, bool)  # positions at which a lower merge arose midway
        inner = np.flatnonzero(self.nxt >= 0)
        self.enter(inner, merges.find(self.sym[inner], self.sym[inner + 1]))

    def enter(self, at: np.ndarray, merge: np.ndarray) -> list[int]:
        """Index the pairs at ``at``; returns the merges that were not indexed before."""
        self.pair[at] = merge
        order = np.argsort(merge, kind="stable")
        at, merge = at[order], merge[order]
        lo = int(np.searchsorted(merge, 0))
        new = []
        if lo < len(at):
            at, merge = at[lo:], merge[lo:]
            cuts = np.flatnonzero(np.diff(merge)) + 1
            for r, spots in zip(merge[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r not in self.index:
                    self.index[r] = []
                    new.append(r)
                self.index[r].append(spots)
        return new

    def apply(self, r: int, i: np.ndarray) -> list[int]:
        """Merge the pairs at ``i`` (sorted, not overlapping) into ``r``."""
        sym, nxt, prv, pair = self.sym, self.nxt, self.prv, self.pair
        j = nxt[i]
        after = nxt[j]
        # Next to another of these pairs, a lower merge may arise before that pair is merged.
        close = np.flatnonzero(after[:-1] == i[1:])
        if len(close):
            between = self.merges.find(np.full(len(close), r), sym[after[close]])
            self.mixed[i[close[(between >= 0) & (between <= r)]]] = True
        sym[i] = r
        pair[i] = pair[j] = -1
        nxt[i], nxt[j] = after, GONE
        inner = after >= 0
        prv[after[inner]] = i[inner]
        before = prv[i]
        left = _distinct(np.concatenate([i[inner], before[before >= 0]]))
        merge = self.merges.find(sym[left], sym[nxt[left]])
        self.mixed[left[(merge >= 0) & (merge <= r)]] = True
        return self.enter(left, merge)


def replay(words: list[bytes], ranks: dict[bytes, int], merges: Merges) -> list[list[int]]:
    """Ids of each word, by replaying the merges over all words in rank order.

    ``heap`` yields the lowest merge in the index; its positions are applied
    from left to right, so overlapping pairs (``aaa``) merge as the greedy rule
    has it. An entry is stale, and skipped, when its position no longer starts
    that pair. Merges with many positions are applied as arrays; once they have
    become narrow, the rest is applied position by position. A vocabulary may
    let a lower merge arise midway through another; words in which arrays met
    that are replayed anew position by position, where the lower goes first.
    """
    if not words:
        return []
    corpus = Corpus(words, merges)
    index, heap = corpus.index, list(corpus.index)
    heapq.heapify(heap)
    width = 4.0 * WIDE
    while heap and width > WIDE:
        r = heapq.heappop(heap)
        spots = np.concatenate(index.pop(r))
        spots = _distinct(spots[corpus.pair[spots] == r])
        if len(spots) > 1 and (corpus.nxt[spots[:-1]] == spots[1:]).any():
            spots = _apart(spots, corpus.nxt)
        if len(spots):
            for q in corpus.apply(r, spots):
                heapq.heappush(heap, q)
        width = 0.98 * width + 0.02 * len(spots)
    rest = {r: np.concatenate(index[r]).tolist() for r in index}
    sym, nxt = corpus.sym.tolist(), corpus.nxt.tolist()
    _one_by_one(rest, sym, nxt, corpus.prv.tolist(), corpus.pair.tolist(), merges.of)
    out = _read(corpus.starts, sym, nxt)
    if corpus.mixed.any():
        again = np.unique(np.searchsorted(corpus.starts, np.flatnonzero(corpus.mixed), side="right") - 1).tolist()
        for w in again:
            fresh = Corpus([words[w]], merges)
            sym, nxt = fresh.sym.tolist(), fresh.nxt.tolist()
            _one_by_one({r: np.concatenate(x).tolist() for r, x in fresh.index.items()}, sym, nxt,
                        fresh.prv.tolist(), fresh.pair.tolist(), merges.of)
            out[w] = _read(fresh.starts, sym, nxt)[0]
    return out


def _read(starts: np.ndarray, sym: list[int], nxt: list[int]) -> list[list[int]]:
    """The symbols that are left, by word."""
    left = np.array(nxt) != GONE
    ids = np.array(sym)[left].tolist()
    cuts = [0, *np.cumsum(np.add.reduceat(left.astype(np.int64), starts)).tolist()]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _apart(spots: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of overlapping pairs, every other one from the left."""
    kept, taken = [], -1
    for i, j in zip(spots.tolist(), nxt[spots].tolist()):
        if i != taken:
            kept.append(i)
            taken = j
    return np.array(kept)


def _one_by_one(index: dict[int, list[int]], sym: list[int], nxt: list[int], prv: list[int], pair: list[int],
                of: dict[int, int]) -> None:
    """Replay what is in ``index``, updating the lists in place."""
    heap = list(index)
    heapq.heapify(heap)
    push, get = heapq.heappush, of.get
    while heap:
        r = heapq.heappop(heap)
        spots = index.pop(r)
        spots.sort()
        held: list[int] = []
        for k, i in enumerate(spots):
            if pair[i] != r:
                continue
            lower = False
            j = nxt[i]
            sym[i] = r
            pair[i] = pair[j] = -1
            nxt[i] = a = nxt[j]
            nxt[j] = GONE
            if a >= 0:
                prv[a] = i
            p = prv[i]
            for left, right in ((i, a), (p, i)):
                if left < 0 or right < 0:
                    continue
                q = get(sym[left] * SHIFT + sym[right])
                if q is None:
                    pair[left] = -1
                    continue
                pair[left] = q
                if q in index:
                    index[q].append(left)
                elif q == r:
                    held.append(left)
                else:
                    index[q] = [left]
                    push(heap, q)
                    lower = lower or q < r
            if lower:  # a lower merge has arisen: it goes first, the rest of this one waits
                held.extend(spots[k + 1:])
                break
        if held:
            index[r] = held
            push(heap, r)


class Encoder:
    """Encodes blocks of texts, remembering the ids of at most ``memo_words`` words."""

    def __init__(self, path: str, pattern: str, memo_words: int = MEMO_WORDS):
        import regex

        self.ranks = load_ranks(path)
        self.merges = Merges(self.ranks)
        size = max(self.ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, i in self.ranks.items():
            self.tokens[i] = t
        self.names = [str(i) for i in range(size)]
        self.split = regex.compile(pattern).findall
        self.memo_words = memo_words
        self.memo: dict[str, list[int]] = {}

    def block(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        split, memo = self.split, self.memo
        words = [split(t) for t in texts]
        fresh = list(set().union(*words).difference(memo))
        whole = [w.encode() for w in fresh]
        parts = [i for i, w in enumerate(whole) if w not in self.ranks]
        for i, w in enumerate(whole):
            if w in self.ranks:
                memo[fresh[i]] = [self.ranks[w]]
        for i, ids in zip(parts, replay([whole[i] for i in parts], self.ranks, self.merges)):
            memo[fresh[i]] = ids
        out = [list(chain.from_iterable(map(memo.__getitem__, ws))) for ws in words]
        if len(memo) > self.memo_words:
            memo.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def listed(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.names.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder, built once."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > BLOCK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, text: str, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """Add the column ``out``: the ids of the whole ``text``."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern)
        for texts in batches:
            values = [t or "" for t in texts]
            rows: list[list[int]] = []
            for a, b in _blocks(values):
                rows.extend(enc.block(values[a:b]))
            yield pd.Series(rows, index=texts.index, dtype=object)

    return common.without(df, out).withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, ids: str, path: str, out: str = "text") -> DataFrame:
    """Add the binary column ``out``: the bytes of ``ids`` (null: none)."""
    @F.pandas_udf(T.BinaryType())
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = {i: t for t, i in load_ranks(path).items()}
        for rows in batches:
            yield pd.Series([b"".join(tokens[i] for i in (r if r is not None else ())) for r in rows],
                            index=rows.index, dtype=object)

    return common.without(df, out).withColumn(out, back(F.col(ids)))


def digests(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes every text, decodes
    its ids, and hashes both, so that no id leaves its task."""
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts, id_hashes, byte_hashes = [], [], []
            for start, end in _blocks(texts):
                for ids in enc.block(texts[start:end]):
                    counts.append(len(ids))
                    id_hashes.append(hashlib.sha256(enc.listed(ids).encode()).hexdigest())
                    byte_hashes.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()),
                                              pa.array(byte_hashes, pa.string())],
                                             names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken",
                 pattern: str | None = None) -> DataFrame:
    """Every document's token count and the digests of its ids and of the decoded bytes."""
    import public_tokenizers

    return digests(common.documents(spark, sf_dir), "doc_id", "text", public_tokenizers.path(vocabulary),
                   pattern or public_tokenizers.PATTERN)
