"""Token counts: whole texts encoded in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.llm.common import id_field, small_batches, texts

#: A single space between two characters that are neither spaces nor space marks. The encoder puts a mark before a text, so that
#: what follows the cut gets back the mark that the cut takes away; pieces of many marks may reach over one. See `cuts_are_safe`.
CUT = re.compile("(?<=[^ \u2581]) (?=[^ \u2581])")


@lru_cache(maxsize=4)
def encoder(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sp, cuts_are_safe(sp)


def cuts_are_safe(sp) -> bool:
    """True if no piece of the vocabulary reaches over a word's start, and space marks are put before a text and kept in it."""
    inner = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
    return not inner and sp.encode("a b") == sp.encode("a") + sp.encode("b") and sp.encode("a  b") != sp.encode("a b")


def split_text(text: str, at_most: int) -> list[str]:
    """Parts of about `at_most` characters, cut at safe boundaries only; a stretch without one stays whole."""
    parts, start = [], 0
    while len(text) - start > at_most:
        m = CUT.search(text, start + at_most)
        if m is None:
            break
        parts.append(text[start : m.start()])
        start = m.end()
    parts.append(text[start:])
    return parts


def size_of(part: str) -> int:
    return len(part) if part.isascii() else len(part.encode())


def lengths(rows: list[str], path: str, batch_bytes: int, part_chars: int) -> list[int]:
    """Token counts of the texts. Parts of all texts fill batches of about `batch_bytes`, whatever the texts' own sizes."""
    sp, safe = encoder(path)
    out, parts, owners, size = [0] * len(rows), [], [], 0

    def flush() -> None:
        for owner, ids in zip(owners, sp.encode(parts, num_threads=1), strict=True):
            out[owner] += len(ids)
        parts.clear()
        owners.clear()

    for i, text in enumerate(rows):
        for part in split_text(text, part_chars) if safe else [text]:
            parts.append(part)
            owners.append(i)
            size += size_of(part)
            if size >= batch_bytes:
                flush()
                size = 0
    if parts:
        flush()
    return out


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = 1 << 18, part_chars: int = 1 << 15) -> DataFrame:
    """One row per row of df: identifier, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Repeated rows each get a row. Other columns are ignored. An empty
    table gives an empty one. Special strings inside texts are what the library takes them for. `model` is a path that
    executors can read.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([id_field(df, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = lengths(b.column("text").to_pylist(), model, batch_bytes, part_chars)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column("n_bytes")], names=[id_col, "n_tokens", "n_bytes"])

    given = texts(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return given.mapInArrow(count, schema).select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
