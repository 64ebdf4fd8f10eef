"""Packing into windows: a least-squares plan over the histogram of lengths, then a greedy fill with cuts.

1. An Arrow pass encodes each text once and keeps its length, the checksums of its full windows, its tail's checksum and ids.
2. The histogram of the tails' lengths, in classes of `unit` ids, has window / unit rows at any input size. The driver
   enumerates all combinations of up to `depth` classes that fill a window, solves min |A x - h|, x >= 0 and rounds down.
3. A tail's number within its class follows from counts by class and group of documents (`per` tails a group), so that no
   task sorts a whole class. The number decides the tail's sequence and offset by the plan.
4. Tails beyond the plan are laid end to end, and cut where a window ends: of these sequences only the last has padding.

Placing moves numbers only. The ids themselves move once, and only to the tails that a window's end cuts.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.llm.common import id_field, salts, small_batches, texts, written

#: Entries in a Python worker's table of encoded words; it starts anew beyond this.
CACHE = 700_000
#: A run of marks between a letter and a word's end: the vocabulary encodes it apart from what stands before.
MARKS = r"(\pL)([.,!?;:%*&$#|]+)( |\z)"
#: How a vocabulary must prepare a text so that words may be encoded apart.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def words_stand_apart(spec: dict) -> bool:
    """Whether a tokenizer's file says that white space separates words whatever stands beside it, that a run of letters is
    encoded apart from the marks after it, and that case is dropped letter by letter."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZER and pre[0].get("pattern") == {"Regex": PATTERN} and pre[0].get("invert") is True
        and [x.get("type") for x in pre] == ["Split", "ByteLevel"] and not pre[-1].get("add_prefix_space") and bool(spec["model"].get("end_of_word_suffix"))
        and all(not t["lstrip"] and not t["rstrip"] and not t["normalized"] and t["content"].strip() == t["content"] for t in spec["added_tokens"])
    )


class WordEncoder:
    """Ids of texts as little-endian integers (`kind`: 16 bits, or 32 for a larger vocabulary), from encodings of their words.

    Where the vocabulary lets words stand apart, each is encoded once, many in one call: the last id of each ends a word, which
    tells where the next begins. The library gets whole texts where that could differ: with special strings, in any case, or
    with letters whose composed form appears or goes as case is dropped. For other vocabularies it gets all texts whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.by_word = words_stand_apart(spec)
        self.special = [t["content"].lower() for t in spec["added_tokens"]]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if self.by_word:
            self.ends[[i for t, i in vocab.items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, items: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known = {"": b"", **dict(islice(self.known.items(), CACHE // 8))}  # the first to come are the most frequent
            new = words.difference(self.known)
        letters = [w for w in new if w.isalpha()]
        for i in range(0, len(letters), 1000):
            some = letters[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            last = (self.kind.itemsize * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(last) == len(some):  # each word ends at least once, so each ends once
                raw, at = ids.tobytes(), 0
                for w, end in zip(some, last, strict=True):
                    self.known[w] = raw[at:end]
                    at = end
            else:
                self.known.update(zip(some, self._encode(some), strict=True))
        odd = [w for w in new if not w.isalpha()]
        self.known.update(zip(odd, self._encode(odd), strict=True))

    def _lower(self, text: str) -> str | None:
        """The text in lower case, line ends as spaces; None if the library must see it whole."""
        low = text.replace("\u03a3", "\u03c3").lower()  # letter by letter: no final form of sigma
        if any(s in low for s in self.special):
            return None
        if not low.isascii() and ("\u0130" in text or not unicodedata.is_normalized("NFC", text) or not unicodedata.is_normalized("NFC", low)):
            return None
        return low.replace("\n", " ")

    def ids(self, rows: list[str]) -> list[bytes]:
        low = [self._lower(t) if self.by_word else None for t in rows]
        apart = [i for i, t in enumerate(low) if t is not None]
        whole = [i for i, t in enumerate(low) if t is None]
        out: list[bytes] = [b""] * len(rows)
        for i, ids in zip(whole, self._encode([rows[i] for i in whole]), strict=True):
            out[i] = ids
        split = [t.split(" ") for t in pc.replace_substring_regex(pa.array([low[i] for i in apart], pa.large_string()), MARKS, r"\1 \2\3").to_pylist()]
        at = 0
        while at < len(split):
            # as many texts as have some 50,000 words, so that the table holds all words of those it serves
            stop, n = at, 0
            while stop < len(split) and (stop == at or n + len(split[stop]) <= 50_000):
                n += len(split[stop])
                stop += 1
            self._learn(set().union(*split[at:stop]))
            for i, words in zip(apart[at:stop], split[at:stop], strict=True):
                out[i] = b"".join(map(self.known.__getitem__, words))
            at = stop
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def crc(ids: bytes, kind: np.dtype | str = "<u2") -> int:
    return zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes())


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by an active set."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    least = 1e-9 * max(1.0, float(abs(a.T @ b).max()))
    for _ in range(steps):
        slope = np.where(on, -np.inf, a.T @ (b - a @ x))
        j = int(slope.argmax())
        if slope[j] <= least:
            break
        on[j] = True
        while on.any():
            at = np.flatnonzero(on)
            part = a[:, at]
            s = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(at)), part.T @ b)
            if s.min() > 1e-9:
                x[:] = 0
                x[at] = s
                break
            low = s <= 1e-9
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-12)).min()
            moved = x[at] + step * (s - x[at])
            gone = low & (moved <= 1e-9)
            x[at] = np.where(gone, 0, moved)
            on[at[gone]] = False
            if not gone.any():
                on[at[low]] = False
                x[at[low]] = 0
    return x


def combinations(full: int, depth: int) -> list[tuple[int, ...]]:
    """Ways to write `full` as up to `depth` classes, larger ones first."""
    if depth < 2:
        return [(full,)]
    out: list[tuple[int, ...]] = []

    def extend(left: int, most: int, taken: tuple[int, ...]) -> None:
        if left == 0:
            out.append(taken)
        elif len(taken) < depth:
            for c in range(min(left, most), -(-left // (depth - len(taken))) - 1, -1):
                extend(left - c, c, (*taken, c))

    extend(full, full - 1, ())
    return out


def plan(counts: dict[int, int], full: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats): what the least-squares solution takes of each class, never more than there is."""
    have = np.array([counts.get(c, 0) for c in range(full + 1)], float)
    ways = [w for w in combinations(full, depth) if all(have[c] > 0 for c in w)]
    if not ways:
        return []
    a = np.zeros((full + 1, len(ways)))
    for j, w in enumerate(ways):
        for c in w:
            a[c, j] += 1
    x = non_negative_least_squares(a, have)
    left, out = have.copy(), []
    for j in np.argsort(-x):
        need = a[:, j]
        fit = int(min((left[c] // need[c] for c in set(ways[j])), default=0))
        times = min(int(np.floor(x[j] + 1e-6)), fit)
        if times > 0:
            left -= times * need
            out.append((ways[j], times))
    return out


def before(df: DataFrame, by: list[str], at: str, sums: dict[str, str], block: int = 4096) -> DataFrame:
    """df with, for each name -> column of `sums`, the sum of that column over the rows of equal `by` with a smaller `at`.

    Sums run within blocks of `block` values of `at`, then over the blocks' totals, so that no task sees all rows of one key.
    """
    first = df.withColumn("_block", F.floor(F.col(at) / block))
    total = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = first.groupBy(*by, "_block").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    over_blocks = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block")
    blocks = blocks.select(*by, "_block", *(total(over_blocks, f"_{n}").alias(f"_{n}") for n in sums))
    inside = Window.partitionBy(*by, "_block").orderBy(at)
    return first.select("*", *(total(inside, c).alias(n) for n, c in sums.items())).join(blocks, [*by, "_block"]).select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, unit: int = 8, depth: int = 3, id_col: str = "doc_id", text_col: str = "text", per: int = 5_000) -> DataFrame:
    """One row per piece: identifier, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id and offset.

    A document is its ids and then end_id, so that a null or empty text is one id. Every id lies in one piece. In a sequence,
    offsets run from 0 without gaps. Repeated rows are packed as documents of their own, also under one identifier; a null
    identifier stays null. Other columns are ignored; an empty table gives an empty one.
    """
    spark = df.sparkSession
    small_batches(spark)
    ident = id_field(df, id_col)
    long = T.LongType()
    first = T.StructType([ident, *(T.StructField(n, t) for n, t in (("n", long), ("crcs", T.ArrayType(long)), ("tail_crc", long), ("tail", T.BinaryType())))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer)
        size, kind = enc.kind.itemsize, enc.kind
        w, end = size * window, np.array([end_id], kind).tobytes()
        for b in batches:
            ids = [x + end for x in enc.ids(b.column("text").to_pylist())]
            cut = [len(x) // w * w for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(x) // size for x in ids], pa.int64()),
                    pa.array([[crc(x[i : i + w], kind) for i in range(0, k, w)] for x, k in zip(ids, cut, strict=True)], pa.list_(pa.int64())),
                    pa.array([crc(x[k:], kind) for x, k in zip(ids, cut, strict=True)], pa.int64()), pa.array([x[k:] for x, k in zip(ids, cut, strict=True)], pa.binary()),
                ],
                names=first.names,
            )

    done = written(texts(df, id_col, text_col).mapInArrow(encode, first).withColumn("rid", F.monotonically_increasing_id()), "encoded")
    full = window // unit
    lengths = done.select(
        F.col(id_col).alias("id"), "rid", "n", "crcs", "tail_crc", (F.col("n") % window).alias("t"), F.floor(F.col("n") / window).alias("k"), F.ceil((F.col("n") % window) / unit).cast("int").alias("c"))
    hist = {r["c"]: r["count"] for r in lengths.groupBy("c").count().collect()}
    n_docs = sum(hist.values())
    hist.pop(0, None)
    takes = plan(hist, full, depth)

    # Slots of each class, by the plan: the tails numbered lo to hi - 1 go to sequences base, base + 1, ... at offset slots before them.
    slots, used, base = [], {}, 0
    for combo, times in takes:
        for place, c in enumerate(combo):
            lo = used.get(c, 0)
            slots.append((c, lo, lo + times, base, place))
            used[c] = lo + times
        base += times
    slot_rows = spark.createDataFrame(slots or [(-1, 0, 0, 0, 0)], "c int, lo long, hi long, base long, place int")
    used_rows = spark.createDataFrame(sorted(used.items()) or [(-1, 0)], "c int, planned long")

    # One exchange by group serves all windows; a group's counts come as one row of at most `full` + 1 classes.
    salted = lengths.withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(salts(n_docs, per))).cast("int"))
    by_class = before(salted.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")), ["c"], "g", {"m0": "m"})
    by_group = by_class.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("c", "m0"))).alias("m0"))
    in_class = Window.partitionBy("g", "c").orderBy("rid")
    in_group = Window.partitionBy("g").orderBy("c", "rid").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        salted.join(by_group.hint("shuffle_hash"), "g").join(F.broadcast(used_rows), "c", "left")
        .withColumn("r", F.row_number().over(in_class) - 1 + F.element_at("m0", F.col("c")))
        .withColumn("over", (F.col("c") > 0) & (F.col("r") >= F.coalesce("planned", F.lit(0))))
        .withColumn("rest", F.when(F.col("over"), F.col("t")).otherwise(0))
        .withColumn("k0", F.coalesce(F.sum("k").over(in_group), F.lit(0))).withColumn("p0", F.coalesce(F.sum("rest").over(in_group), F.lit(0)))
        .drop("m0", "planned")
    )
    numbered = written(numbered, "numbered")
    sums = written(numbered.groupBy("g").agg(F.sum("k").alias("ks"), F.sum("rest").alias("ps")), "group-sums")
    offsets = before(sums, [], "g", {"kg": "ks", "pg": "ps"}).select("g", "kg", "pg")
    total = sums.agg(F.coalesce(F.sum("ks"), F.lit(0)).alias("k")).first()["k"]
    rest_from = base + total

    out = T.StructType([ident, *(T.StructField(n, long) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def piece(start, length, checksum, sequence, offset):
        values = (start, length, checksum, F.col("n"), sequence, offset)
        return [F.col("id").alias(id_col), *(v.cast("long").alias(n) for v, n in zip(values, out.names[1:], strict=True))]

    # The plan's offset of a tail: the exact lengths of the tails before it in its sequence.
    placed = (
        numbered.where("c > 0 and not over").join(F.broadcast(slot_rows), "c").where("r >= lo and r < hi").withColumn("s", F.col("base") + F.col("r") - F.col("lo"))
        .withColumn("o", F.coalesce(F.sum("t").over(Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(piece(F.col("k") * window, F.col("t"), F.col("tail_crc"), F.col("s"), F.col("o")))
    )
    whole = (
        numbered.where("k > 0").join(offsets, "g").select("id", "n", (F.col("k0") + F.col("kg") + base).alias("s"), F.posexplode("crcs").alias("i", "crc"))
        .select(piece(F.col("i") * window, F.lit(window), F.col("crc"), F.col("s") + F.col("i"), F.lit(0)))
    )
    rest = numbered.where("over").join(offsets, "g").withColumn("p", F.col("p0") + F.col("pg")).withColumn("s", F.floor(F.col("p") / window) + rest_from).withColumn("o", F.col("p") % window)
    fits = F.col("o") + F.col("t") <= window
    uncut = rest.where(fits).select(piece(F.col("k") * window, F.col("t"), F.col("tail_crc"), F.col("s"), F.col("o")))
    # A tail is shorter than a window, so it is cut once at most. Only here do ids move.
    cut = done.select("rid", "tail").join(rest.where(~fits).select("rid", "id", "n", "k", "s", "o").hint("shuffle_hash"), "rid").select("id", "n", "k", "s", "o", "tail")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer)
        size = enc.kind.itemsize
        for b in batches:
            at, rows = [], []
            for i, (n, k, s, o, tail) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                m = window - o
                a, z = tail[: size * m], tail[size * m :]
                at += [i, i]
                rows += [(k * window, m, crc(a, enc.kind), n, s, o), (k * window + m, len(z) // size, crc(z, enc.kind), n, s + 1, 0)]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=out.names)

    return placed.unionByName(whole).unionByName(uncut).unionByName(cut.mapInArrow(halves, out))
