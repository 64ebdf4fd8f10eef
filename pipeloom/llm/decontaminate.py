"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words. An item with a budget of k edits is split into k + 1 pieces: k edits leave
one of them whole, so every match holds an exact piece. An automaton of all pieces finds those in one pass over a text, and
Myers' bit-parallel distance verifies the stretch around each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.llm.common import id_field, small_batches, texts

OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def budget(n: int, rate: float, shortest_piece: int = 8) -> int:
    """Edits allowed in an item of n characters; pieces stay long enough to be telling."""
    return max(0, min(int(n * rate), n // shortest_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    n = len(item)
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(item_masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(edits, end) of the best match of the item anywhere in `text`, the first of equals; None beyond k edits."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = item_masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def match_length(reversed_masks: dict[str, int], m: int, text: str, edits: int) -> int:
    """The least length of a stretch at the end of `text` that is as many edits from the item, whose masks are those of it
    reversed."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for j, c in enumerate(reversed(text)):
        if score <= edits:
            return j
        eq = reversed_masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full  # the stretch begins here: each character before it costs
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return len(text)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.auto = [], ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for ident, text in items:
            t = normal(text)
            if not t:
                continue
            t = f" {t} "  # whole words only
            k = budget(len(t), rate)
            at = len(self.items)
            self.items.append((ident, t, k, masks(t)))
            for start, piece in pieces(t, k):
                held.setdefault(piece, []).append((at, start))
        for piece, where in held.items():
            self.auto.add_word(piece, (len(piece), where))
        if held:
            self.auto.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """By item: edits, start and end (characters of the normal form), of the best match."""
        if not self.items:
            return {}
        t = f" {normal(text)} "
        out: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        for end, (size, where) in self.auto.iter(t):
            for at, start in where:
                ident, item, k, item_masks = self.items[at]
                found = out.get(at)
                if found and found[0] == 0:
                    continue
                lo = end + 1 - size - start  # the item's start if no edit comes before the piece
                if lo >= 0 and t.startswith(item, lo):
                    out[at] = (0, lo, lo + len(item))
                    continue
                if k == 0:
                    continue
                done = tried.setdefault(at, set())
                if lo in done:
                    continue
                done.add(lo)
                a, b = max(0, lo - k), min(len(t), lo + len(item) + k)
                hit = best_match(item_masks, len(item), t[a:b], k)
                if hit and (found is None or hit[0] < found[0]):
                    out[at] = (hit[0], a, a + hit[1])
        best: dict[int, tuple[int, int, int]] = {}
        for at, (edits, a, end) in out.items():
            ident, item, _, _ = self.items[at]
            if edits:
                a = end - match_length(masks(item[::-1]), len(item), t[a:end], edits)
            if ident not in best or (edits, a, end) < best[ident]:  # of texts under one identifier, the nearest
                best[ident] = (edits, a, end)
        return best


#: The last block's matcher of a Python worker, by the block's key.
_matchers: dict[str, Matcher] = {}


def matcher(key: str, items: list[tuple[int, str]], rate: float) -> Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, rate)
    return _matchers[key]


def blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int) -> Iterator[tuple[str, Broadcast]]:
    """The items with an identifier and a text, dealt by hash to blocks of about `block_bytes` of text; each goes to the driver and
    to executors in turn, so that no more is held at once."""
    spark = benchmark.sparkSession
    items = texts(benchmark, item_col, item_text).where(F.col(item_col).isNotNull() & (F.length("text") > 0)).dropDuplicates([item_col, "text"])
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    dealt = items.withColumn("_b", F.pmod(F.xxhash64(item_col), F.lit(n)))  # texts under one identifier meet
    for b in range(n):
        rows = dealt.where(F.col("_b") == b).select(F.col(item_col).cast("long"), "text").orderBy(item_col, "text").collect()
        yield uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in rows])


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.08, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document and item that it holds: identifier, item_id, edits, start and end (in the normal form).

    An item matches if some stretch of the document is within `rate` of the item's characters in edits; the nearest stretch
    counts, and of several texts under one item_id the nearest. Items go to executors in blocks of about `block_bytes`, and the
    documents are read once a block. Null and empty texts and items match nothing; documents without a match have no row. Of
    repeated rows each gets its own. Extra columns are ignored.
    """
    small_batches(df.sparkSession)
    docs = texts(df, id_col, text_col)
    schema = T.StructType([id_field(df, id_col), T.StructField("item_id", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("edits", "start", "end"))])

    def one(key: str, held: Broadcast) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = matcher(key, held.value, rate)
            for batch in batches:
                ids, rows = batch.column(0), []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    rows += [(i, item, *v) for item, v in sorted(m.matches(text).items())]
                if rows:
                    at, item, edits, start, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), *(pa.array(c, pa.int32()) for c in (edits, start, end))], names=schema.names)

        return docs.mapInArrow(find, schema)

    return reduce(DataFrame.unionByName, [one(*b) for b in blocks(benchmark, item_col, item_text, block_bytes)])


def without_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.08, block_bytes: int = 4 << 20) -> DataFrame:
    """df's rows whose text holds no item, with all their columns, in one pass a block. Null texts stay."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)
    for key, held in blocks(benchmark, item_col, item_text, block_bytes):

        def keep(batches: Iterator[pa.RecordBatch], key=key, held=held) -> Iterator[pa.RecordBatch]:
            m = matcher(key, held.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not m.matches(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

        df = df.mapInArrow(keep, df.schema)
    return df
