"""Quality by labelled line sequences: a linear-chain conditional random field marks lines as content or boilerplate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pipeloom.llm.common import id_field, labelled_sample, small_batches, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
BOILER = re.compile(r"\b(?:cookies?|copyright|licen[cs]ed?|rights reserved|terms of (?:use|service)|privacy policy|subscribe|sign (?:in|up)|log ?in|click here|read more|share this|advertisement|all rights)\b|©", re.IGNORECASE)
N_FEATURES = 20


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeated(words)


def repeated(words: list[str], width: int = 5) -> int:
    """Words that lie in a window of `width` words that the text has twice or more."""
    if len(words) <= width:
        return 0
    first: dict[tuple[str, ...], int] = {}
    marks: set[int] = set()
    for i, w in enumerate(zip(*(words[k:] for k in range(width)), strict=False)):
        j = first.setdefault(w, i)
        if j != i:
            marks.add(i)
            marks.add(j)
    n, end = 0, 0
    for i in sorted(marks):
        n += i + width - max(i, end)
        end = i + width
    return n


def line_features(line: str, seen: bool) -> int:
    """A bit for each feature that holds."""
    words = line.split()
    n, chars = len(words), max(1, len(line))
    symbols = len(SYMBOL.findall(line))
    letters = sum(map(str.isalpha, line))
    upper = sum(map(str.isupper, line))
    kinds = len(set(words))
    marks = line.count(",") + line.count(".")
    tail = line.rstrip()[-1:]
    bits = (
        True, n == 0, n <= 3, 4 <= n <= 8, n > 8, tail in (".", "!", "?", '"') and tail != "", seen, symbols > 0, symbols * 10 > n > 0, symbols * 2 > n > 0,
        letters * 10 < chars * 6, upper * 10 > letters * 3, upper * 10 > letters * 7, n > 5 and kinds * 2 < n, n > 20 and kinds * 10 < n * 7, marks * 40 > chars, n > 8 and marks == 0,
        line.count("|") > 1, line.count("!") > 2, bool(BOILER.search(line)),
    )
    return sum(1 << i for i, b in enumerate(bits) if b)


def sequence(text: str) -> tuple[list[int], list[int]]:
    """Features and length of each line with a word."""
    seen: set[str] = set()
    feats, sizes = [], []
    for line in text.split("\n"):
        if WORD.search(line):
            feats.append(line_features(line, line in seen))
            sizes.append(len(line))
            seen.add(line)
    return feats, sizes


class Chain:
    """Labels 0 (boilerplate) and 1 (content): a weight for each feature in favour of 1, and one for each pair of neighbours."""

    def __init__(self) -> None:
        self.w = np.zeros(N_FEATURES)
        self.t = np.zeros((2, 2))
        self.known: dict[int, float] = {}

    def emission(self, f: int) -> float:
        s = self.known.get(f)
        if s is None:
            if len(self.known) > 100_000:
                self.known.clear()
            s = self.known[f] = float(sum(self.w[i] for i in range(N_FEATURES) if f >> i & 1))
        return s

    def decode(self, feats: list[int]) -> list[int]:
        """The likeliest labels (Viterbi); content wins ties."""
        (t00, t01), (t10, t11) = self.t.tolist()
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for i, f in enumerate(feats):
            e = self.emission(f)
            if i:
                from0 = (a + t00, b + t10)
                from1 = (a + t01, b + t11)
                k0, k1 = int(from0[1] >= from0[0]), int(from1[1] >= from1[0])
                back.append((k0, k1))
                a, b = from0[k0], from1[k1] + e
            else:
                b = e
        out = [int(b >= a)] if feats else []
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]

    def fit(self, sequences: list[tuple[list[int], int, float]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> None:
        """Gradient ascent on the likelihood of sequences whose lines all bear the given label; classes weigh alike. A sequence
        comes with its share of its text."""
        sequences = [(f, y, part) for f, y, part in sequences if f]
        if len({y for _, y, _ in sequences}) < 2:
            self.w[0] = 1.0  # nothing to tell boilerplate from content: content
            return
        n_of = {y: sum(part for _, v, part in sequences if v == y) for y in (0, 1)}
        by_length: dict[int, list[tuple[list[int], int, float]]] = {}
        for s in sequences:  # padded to a power of two, so that few steps serve all
            by_length.setdefault((len(s[0]) - 1).bit_length(), []).append(s)
        packs = []
        for _, group in sorted(by_length.items()):
            sizes = np.array([len(f) for f, _, _ in group])
            bits = np.zeros((len(group), int(sizes.max())), np.int64)
            for row, (f, _, _) in zip(bits, group, strict=True):
                row[: len(f)] = f
            real = np.arange(bits.shape[1]) < sizes[:, None]
            y = np.array([v for _, v, _ in group])
            weight = np.array([part / n_of[v] / 2 for _, v, part in group])
            x = (bits[:, :, None] >> np.arange(N_FEATURES) & 1).astype(float) * real[:, :, None]
            packs.append((x, y, weight / sizes, sizes, real))
        gw2, gt2 = np.full(N_FEATURES, 1e-8), np.full((2, 2), 1e-8)
        for _ in range(rounds):
            gw, gt = -ridge * self.w, -ridge * self.t
            for x, y, weight, sizes, real in packs:
                e = x @ self.w
                m, n = e.shape
                fwd = np.zeros((n, m, 2))
                bwd = np.zeros((n, m, 2))
                fwd[0, :, 1] = e[:, 0]
                for i in range(1, n):
                    step = np.logaddexp.reduce(fwd[i - 1][:, :, None] + self.t, axis=1)
                    step[:, 1] += e[:, i]
                    fwd[i] = np.where(real[:, i, None], step, fwd[i - 1])
                for i in range(n - 2, -1, -1):
                    nxt = bwd[i + 1].copy()
                    nxt[:, 1] += e[:, i + 1]
                    bwd[i] = np.where(real[:, i + 1, None], np.logaddexp.reduce(self.t + nxt[:, None, :], axis=2), bwd[i + 1])
                z = np.logaddexp.reduce(fwd[-1], axis=1)
                p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z).T
                # a line's share of its text's weight, so that long texts don't drown short ones; padding has no features
                gw += np.einsum("m,mn,mnf->f", weight, y[:, None] - p1, x)
                for i in range(1, n):
                    nxt = bwd[i].copy()
                    nxt[:, 1] += e[:, i]
                    pair = np.exp(fwd[i - 1][:, :, None] + self.t + nxt[:, None, :] - z[:, None, None])
                    gt -= np.einsum("m,mab->ab", weight * real[:, i], pair)
                gt[0, 0] += (weight * (y == 0) * (sizes - 1)).sum()
                gt[1, 1] += (weight * (y == 1) * (sizes - 1)).sum()
            gw2, gt2 = gw2 + gw * gw, gt2 + gt * gt
            self.w += rate * gw / np.sqrt(gw2)
            self.t += rate * gt / np.sqrt(gt2)
        self.t = np.clip(self.t, -2.0, 2.0)  # texts of one label throughout would make neighbours decide alone
        self.known.clear()


def windows(feats: list[int], y: int, most: int) -> list[tuple[list[int], int, float]]:
    """A text's lines in stretches of at most `most`, each with its share of the text."""
    return [(feats[i : i + most], y, len(feats[i : i + most]) / len(feats)) for i in range(0, len(feats), most)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = 6_000, stretch: int = 256) -> Chain:
    """A chain from at most `sample` labelled documents, chosen by hash. All their lines count; long documents are fitted in
    stretches of `stretch` lines in a row, which share the document's weight (a text of any length is decoded whole)."""
    def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([sequence(t)[0] for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["y", "f"])

    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, "quality", sample, id_col).select("text", "y").mapInArrow(feats, "y int, f array<long>").collect()  # a number a line of at most `sample` documents
    chain = Chain()
    chain.fit([w for f, y in sorted(((list(r["f"]), int(r["y"] > 0)) for r in rows), key=lambda s: (len(s[0]), s)) for w in windows(f, y, stretch)])
    return chain


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5, **fit) -> DataFrame:
    """One row per row of df: identifier, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_share and line_labels (a character per line with a word: c content, b boilerplate).

    A text is kept if the base counts don't fail it and at least `share` of the characters of its lines are content. Null and
    empty texts have no words and fail. Repeated rows each get a row; extra columns are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = texts(df, id_col, text_col)
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, **fit))
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([
        id_field(df, id_col), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
        T.StructField("content_share", T.DoubleType()), T.StructField("line_labels", T.StringType()),
    ])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                counts = base(text)
                feats, sizes = sequence(text)
                marks = chain.decode(feats)
                part = sum(s for s, m in zip(sizes, marks, strict=True) if m) / max(1, sum(sizes))
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                rows.append((*counts, failed, not failed and part >= share, part, "".join("bc"[m] for m in marks)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.string()], strict=True))], names=schema.names) if rows else b.schema.empty_table().to_batches()[0]

    return docs.mapInArrow(judge, schema)
