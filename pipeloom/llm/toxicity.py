"""Toxicity by maximum-scoring segments.

A token scores the log-odds of a toxic document, with a Dirichlet prior in proportion to all documents, if they are surely
over 0; if not, it costs a constant, and more where its log-odds are surely under 0. One pass over a text finds every maximal scoring segment. A segment's tail probability under the extreme-value
law of clean texts makes scores of short and long texts comparable; their sum over the segments gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.llm.common import id_field, labelled_sample, small_batches, texts, written

WORD = re.compile(r"[^\W\d_]+")
#: A token's features: the word, and its first letters, for forms of one stem.
STEMS = (4, 5, 6)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def family(words: list[str]) -> int:
    """The same for most near copies of a text, which would count as many documents: the least hash of three words in a row."""
    import xxhash

    return min(map(xxhash.xxh3_64_intdigest, map(" ".join, zip(words, words[1:], words[2:], strict=False))), default=xxhash.xxh3_64_intdigest(" ".join(words))) >> 1


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence. Each positive position joins the nearest candidate to its
    left that starts lower, if it outgrows that. A candidate knows the nearest one that starts lower than itself, so that a
    search skips what lies between; linear in all."""
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before it, sum up to its end, place of the one that starts lower
    for i, (s, up_to) in enumerate(zip(scores, accumulate(scores), strict=True)):
        if s <= 0:
            continue
        first, low = i, up_to - s
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= low:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < up_to:
            first, _, low, _, k = stack[j]
            del stack[j:]
            j = k
        stack.append((first, i, low, up_to, j))
    return [(a, b, y - x) for a, b, x, y, _ in stack]


class Scores(dict):
    """Scores by word, each worked out once; it starts anew beyond 100,000 words."""

    def __init__(self, odds: dict[str, float], gap: float):
        super().__init__()
        self.odds, self.gap = odds, gap

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        best = max((self.odds.get(f, 0.0) for f in features(word)), default=0.0)
        self[word] = s = best if best > 0 else self.odds.get(word, 0.0) - self.gap
        return s


class Model:
    """Log-odds by feature, and the laws that turn segments into a score."""

    def __init__(self, odds: dict[str, float], gap: float):
        self.odds, self.gap = odds, gap
        self.rate, self.size, self.bias, self.slope = 1.0, 1.0, 0.0, 1.0
        self.known = Scores(odds, gap)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"known": Scores(state["odds"], state["gap"])}

    def found(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORD.findall(text.lower())
        return len(words), segments(list(map(self.known.__getitem__, words)))

    def chance(self, n: int, score: float) -> float:
        """The chance that a clean text of n tokens has a segment of that score or more."""
        return max(1e-300, -math.expm1(-self.size * max(n, 1) * math.exp(-min(700.0, self.rate * score))))

    def evidence(self, n: int, segs: list[tuple[int, int, float]]) -> float:
        """Sum of -log p over the segments, p being each one's chance."""
        return -sum(math.log(self.chance(n, s)) for *_, s in segs)

    def score(self, e: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.bias + self.slope * math.log1p(e)))))

    def fit_law(self, clean: list[tuple[int, float]]) -> None:
        """Fits the extreme-value law to (tokens, greatest segment) of clean texts."""
        clean = [(n, s) for n, s in clean if n]
        best = np.array([s for _, s in clean if s > 0])
        if len(best) >= 20:
            self.rate = float(np.clip(np.pi / math.sqrt(6) / max(best.std(), 1e-3), 0.05, 5))
        if clean:
            # the size that gives the observed share of clean texts with any segment over the median of these
            cut = float(np.median(best)) if len(best) else 1.0
            share = (sum(s >= cut for _, s in clean) + 0.5) / (len(clean) + 1)
            mean_n = max(1.0, float(np.mean([n for n, _ in clean])))
            self.size = -math.log1p(-min(share, 0.999)) / (mean_n * math.exp(-self.rate * cut))

    def fit_curve(self, rows: list[tuple[float, int]]) -> None:
        """Fits the score's logistic curve to (evidence, label)."""
        x = np.array([math.log1p(e) for e, _ in rows])
        y = np.array([t for _, t in rows], float)
        if len(set(y.tolist())) < 2:
            p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
            self.bias, self.slope = math.log(min(p, 0.4) / (1 - min(p, 0.4))), 1.0
            return

        def loss(at: np.ndarray) -> float:
            z = at[0] + at[1] * x
            return float((np.logaddexp(0, z) - y * z).sum() + 0.005 * at[1] ** 2)

        # Newton's steps, halved until the loss sinks by a part of what the slope foretells: where the classes lie apart, whole steps run away
        at = np.array([math.log(y.sum() / (len(y) - y.sum())), 0.0])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(at[0] + at[1] * x, -700, 700)))
            g = np.array([(p - y).sum(), ((p - y) * x).sum() + 0.01 * at[1]])
            d = p * (1 - p)
            h = np.array([[d.sum() + 1e-6, (d * x).sum()], [(d * x).sum(), (d * x * x).sum() + 0.01]])
            step = np.linalg.solve(h, g)
            part, now, falls = 1.0, loss(at), float(g @ step)
            while falls > 1e-9 and part > 1e-9 and loss(at - part * step) > now - 1e-4 * part * falls:
                part /= 2
            if falls <= 1e-9 or part <= 1e-9:
                break
            at = at - part * step
        self.bias, self.slope = float(at[0]), max(float(at[1]), 1e-3)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = 16_000, prior: float = 50.0, min_docs: int = 3, least: float = 3.0, sure: float = 2.6, gap: float = 1.0) -> Model:
    """A model from at most `sample` labelled documents, chosen by hash. Near copies of one text count once.

    A feature counts if at least `min_docs` toxic texts have it and its log-odds ratio, with a Dirichlet prior of `prior`
    documents spread as in both classes together, exceeds `least` and `sure` standard deviations. A word whose ratio lies that
    surely below 0 costs as much more than `gap`, what any other word costs. Laws and curve are fitted to all segments.
    """
    small_batches(docs.sparkSession)
    picked = written(labelled_sample(docs, labels, "toxic", sample, id_col).select("text", "y"), "labelled")
    schema = "key long, y int, n int, words array<string>"

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [WORD.findall(t.lower()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([family(w) for w in ws], pa.int64()), b.column("y"), pa.array([len(w) for w in ws], pa.int32()), pa.array([sorted(set(w)) for w in ws], pa.list_(pa.string()))], names=["key", "y", "n", "words"])

    rows = written(picked.mapInArrow(bags, schema).withColumn("rid", F.monotonically_increasing_id()), "bags")
    # one text of each family: at most `sample` numbers are broadcast
    one = rows.join(F.broadcast(rows.groupBy("key", "y").agg(F.min("rid").alias("rid")).select("rid")), "rid")
    n_docs = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    n1, n0 = n_docs.get(1, 0), n_docs.get(0, 0)
    odds: dict[str, float] = {}
    if n1 and n0:
        stems = lambda n: F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-")))
        feats = F.array_distinct(F.concat("words", *map(stems, STEMS)))
        share = lambda c, a, n: F.log((c + a) / (F.lit(n + prior) - c - a))
        a = (F.col("c1") + F.col("c0")) * (prior / (n1 + n0))
        ratio = share(F.col("c1"), a, n1) - share(F.col("c0"), a, n0)
        z = F.col("ratio") / F.sqrt(1 / (F.col("c1") + a) + 1 / (F.col("c0") + a))
        counts = one.select("y", F.explode(feats).alias("f")).groupBy("f").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0")).withColumn("ratio", ratio).withColumn("z", z)
        toxic = (F.col("c1") >= min_docs) & (F.col("ratio") > least) & (F.col("z") > sure)
        clean = (F.col("z") < -sure) & ~F.col("f").endswith("-")
        # bounded: a feature that counts stands in min_docs toxic texts of the sample, or surely in more clean ones
        odds = {r["f"]: r["ratio"] for r in counts.where(toxic | clean).select("f", "ratio").collect()}
    model = Model(odds, gap)

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.found(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([max((s for *_, s in g), default=0.0) for _, g in got], pa.float64())], names=["n", "s"])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([model.evidence(*model.found(t)) for t in b.column("text").to_pylist()], pa.float64())], names=["y", "e"])

    # at most `sample` rows of two numbers come to the driver each time
    model.fit_law([(r["n"], r["s"]) for r in picked.where("y = 0").select("text").mapInArrow(greatest, "n long, s double").collect()])
    model.fit_curve([(r["e"], r["y"]) for r in picked.mapInArrow(weighed, "y int, e double").collect()])
    return model


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, significance: float = 0.01, **fit) -> DataFrame:
    """One row per row of df: identifier, held_out, score, predicted, n_segments and passages.

    passages lists each segment whose chance in a clean text of that length is at most `significance`: its first and last token,
    score and chance; n_segments is their number. Labels with crc32(identifier) divisible by 5 are never read for fitting. Null
    and empty texts have no segment and get the score of a text without evidence; without any label of either class no text
    has evidence. Repeated rows each get a row; extra columns are ignored. held_out of a null identifier is false.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = texts(df, id_col, text_col)
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, **fit))
    passage = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("chance", T.DoubleType())])
    schema = T.StructType([id_field(df, id_col), T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])
    listed = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            scores, passages = [], []
            for t in b.column("text").to_pylist():
                n, segs = m.found(t)
                chances = [m.chance(n, s) for *_, s in segs]
                scores.append(m.score(-sum(map(math.log, chances))))
                passages.append([{"first": i, "last": j, "score": s, "chance": p} for (i, j, s), p in zip(segs, chances, strict=True) if p <= significance])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(passages, listed)], names=schema.names)

    return docs.mapInArrow(judge, schema).select(
        id_col, F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_segments"), "passages")


def toxic_free(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **fit) -> DataFrame:
    """df's rows with a score under `threshold`, with all their columns. Null and empty texts stay unless no evidence at all is toxic."""
    spark = df.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(texts(df, id_col, text_col), labels, id_col, **fit))
    at = df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield b.filter(pa.array([m.score(m.evidence(*m.found(t or ""))) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(keep, df.schema)
