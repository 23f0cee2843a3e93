"""Packing by concatenation and fixed windows.

Pass 1 tokenises every text once and writes the ids with, per row, its input
partition and the tokens of that partition before it. Prefix sums over the
partitions' totals (one row per partition) turn both into a global offset.
Pass 2 cuts every document at the multiples of the window: a document that
crosses one leaves a boundary record on either side, so each sequence is full
and only the last one of the table is padded. No row is shuffled.

The partition number is a column of the written table, so retries and re-plans
cannot change an offset once it has been counted.

Edge cases: a null text is the empty text, which packs as its end id alone;
repeated rows are documents of their own; an empty table gives no piece; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Tokens of a sequence, and the id that ends a document.
WINDOW, END_ID = 2048, 1

_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """``encode(text) -> uint32 array`` by the byte-level BPE file at ``path``.

    The ids are those of the ``tokenizers`` library on that file without added
    special tokens; strings of added tokens inside a text are those tokens, as
    there. ``tiktoken`` finds the ids between them about four times as fast when
    built from the same vocabulary (``tests/llm`` compares the two over every
    code point); the library itself takes texts on which that fails.
    """
    if path not in _TOKENIZERS:
        import json
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        # Tokens that take blanks or word bounds with them are left to the library.
        plain = not any(t[flag] for t in spec.get("added_tokens", ()) for flag in ("single_word", "lstrip", "rstrip"))
        split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        to_byte = byte_alphabet()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            parts = split.split(text) if split else [text]
            if len(parts) == 1 or plain:
                try:
                    # Every other part is an added token.
                    each = [[added[part]] if n % 2 else fast.encode_ordinary(part) for n, part in enumerate(parts)]
                    return np.concatenate([np.array(ids, "<u4") for ids in each])
                except ValueError:
                    pass
                except BaseException as e:  # a panic of the Rust side is no Exception, and its type cannot be imported
                    if type(e).__name__ != "PanicException":
                        raise
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")

        _TOKENIZERS[path] = encode
    return _TOKENIZERS[path]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level BPE files: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def tokenised(df: DataFrame, key: str, text: str, path: str, end_id: int = END_ID) -> DataFrame:
    """(key, ids, doc_tokens, part, before), written: the ids as little-endian
    unsigned 32-bit binary, the row's partition, and that partition's tokens before the row."""
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("part", T.LongType()), T.StructField("before", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        part, total = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        for b in batches:
            ids, counts, before = [], [], []
            for t in b.column(1).to_pylist():
                x = np.concatenate([encode(t or ""), end])
                ids.append(x.tobytes())
                counts.append(len(x))
                before.append(total)
                total += len(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array([part] * len(ids), pa.int64()), pa.array(before, pa.int64())], names=schema.names)

    return common.written(df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema), "pack")


def pack(df: DataFrame, key: str, text: str, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    docs = tokenised(df, key, text, path, end_id)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = docs.groupBy("part").agg(F.sum("doc_tokens").alias("_n"))
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long").alias("_off"))
    # One row per partition of the input: 16 bytes each, whatever the partitions hold.
    rows = docs.join(F.broadcast(offsets), "part") \
        .select(F.col(key), "ids", "doc_tokens", (F.col("_off") + F.col("before")).alias("_at"))
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(3).to_numpy(zero_copy_only=False)
            n = b.column(2).to_numpy(zero_copy_only=False)
            pieces = (at + n - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = np.maximum(at[row], (at[row] // window + nth) * window)
            hi = np.minimum(at[row] + n[row], (at[row] // window + nth + 1) * window)
            start = lo - at[row]
            blobs = [b.column(1)[i].as_buffer() for i in range(len(n))]
            ids = [blobs[r].slice(4 * s, 4 * m).to_pybytes() for r, s, m in zip(row.tolist(), start.tolist(), (hi - lo).tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(ids, pa.binary()),
                 pa.array(n[row]), pa.array(lo // window), pa.array(lo % window)], names=schema.names)

    return rows.mapInArrow(cut, schema)


def op4_concat_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Every document's pieces with the CRC of their ids."""
    import public_tokenizers

    return digests(common.documents(spark, sf_dir), public_tokenizers.path(vocabulary))


def digests(docs: DataFrame, path: str) -> DataFrame:
    pieces = pack(docs, "doc_id", "text", path)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
