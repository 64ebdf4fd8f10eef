"""Near duplicates by DartMinHash, banded joins and connected classes.

Signature: darts fall into the area weight x rank of each shingle, as a Poisson process that depends on the shingle alone. A
dart has a coordinate; of the darts under a shingle's weight the one of least rank is kept per coordinate. Ranks are thrown in
slices until each coordinate has its dart, so a text costs about k log k darts however long it is.

Texts that agree in a band share a bucket. In each bucket a few members are compared with all others: links are
linear in the rows, and differ by band. Links are verified by the exact similarity of the shingle sets. Where the members that
weren't drawn still lie in several classes, an exact join over the rarest shingles of these texts finds what links are left,
so that every two texts of a bucket are compared or known to be too far apart, or stand in one class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.llm.common import free_name, id_field, small_batches, texts, written

WORD = re.compile(r"\w+")
U = np.uint64
_known: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: a bijection that spreads every bit."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    if len(_known) > 100_000:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), U, len(words))


def shingles(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of `width` words, and their counts; a shorter text is one run."""
    if not words:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = word_hashes(words)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), U)
    for i in range(min(width, len(h))):
        out = mix(out ^ h[i : i + n])
    return np.unique(out, return_counts=True)


def layered(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """32-bit hashes of (shingle, i) for each i below its count: the Jaccard similarity of these sets is the weighted one of the
    counts, the sum of the lesser ones over the sum of the greater."""
    layer = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.repeat(keys, counts)
    more = layer > 0
    out[more] = mix(out[more] ^ mix(layer[more].astype(U)))
    return np.unique((out >> U(32)).astype(np.uint32))


def dart_signatures(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) winning darts of n weighted sets, given as concatenated elements; owner is the set of each. Empty sets get zeros."""
    times = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(keys)), times)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    room = np.minimum(weights[at] - layer, 1.0)  # of the layer's unit of weight
    region, owner = mix(keys[at] ^ mix(layer.astype(U))), owner[at]
    won = np.zeros(n * k, U)
    filled = np.zeros(n * k, bool)
    open_sets = np.zeros(n, bool)
    open_sets[owner] = True
    lo, hi, s = 0.0, 2.0**-8, 0
    while len(owner):
        area = hi - lo
        p, terms = np.exp(-area), []
        for i in range(64):
            terms.append(p)
            p *= area / (i + 1)
        base = mix(region + U((s * 2 + 1) * 0xD1342543DE82EF95 % 2**64))
        number = np.searchsorted(np.cumsum(terms), unit(base), side="right")
        hit = np.flatnonzero(number)
        j = np.repeat(hit, number[hit])
        d = np.arange(len(j)) - np.repeat(np.cumsum(number[hit]) - number[hit], number[hit])
        dart = mix(base[j] ^ mix(d.astype(U) + U(77)))
        under = unit(mix(dart ^ U(0x5851F42D4C957F2D))) < room[j]
        dart, j = dart[under], j[under]
        slot = owner[j] * k + (mix(dart ^ U(0x2545F4914F6CDD1D)) % U(k)).astype(np.int64)
        rank = unit(mix(dart ^ U(0xA0761D6478BD642F)))
        order = np.argsort(-rank, kind="stable")
        order = order[~filled[slot[order]]]
        won[slot[order]] = dart[order]  # the least rank is written last
        filled[slot] = True
        open_sets &= ~filled.reshape(n, k).all(1)
        lo, hi, s = hi, hi + min(hi, 4.0), s + 1
        keep = open_sets[owner]
        if not keep.all():
            region, owner, room = region[keep], owner[keep], room[keep]
    return won.reshape(n, k)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(mix(np.arange(bands, dtype=U) + U(1)), (len(sig), 1))
    parts = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        out = mix(out ^ parts[:, :, r])
    return out.view(np.int64)


def signed(df: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """Identifier, node (16 bytes: the text's words), bands and shingles (sorted 32-bit hashes, see `layered`) of each row."""
    schema = T.StructType([id_field(df, id_col), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sh", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            nodes, hashes, sets, part, size = [], [], [], [], 0

            def flush() -> None:
                nonlocal part, size
                if part:
                    owner = np.repeat(np.arange(len(part)), [len(u) for u, _ in part])
                    w = np.concatenate([c for _, c in part]).astype(float)
                    sig = dart_signatures(np.concatenate([u for u, _ in part]), w, owner, len(part), bands * rows)
                    hashes.extend(row if len(u) else None for row, (u, _) in zip(band_hashes(sig, bands, rows), part, strict=True))
                part, size = [], 0

            for text in b.column("text").to_pylist():
                words = WORD.findall(text.lower())
                nodes.append(xxhash.xxh3_128_digest(" ".join(words)))
                u, c = shingles(words, width)
                c = c if weighted else np.ones_like(c)
                sets.append(layered(u, c).tobytes())
                part.append((u, c))
                size += len(u)
                if size > 60_000:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array([None if h is None else h.tolist() for h in hashes], pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=[id_col, "node", "bands", "sh"])

    return texts(df, id_col, text_col).mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, least: float, copies: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the given Jaccard similarity. With `copies` (b, salts), pairs have a
    salt, below b's salts, by which the partners of one b are dealt to that many keys."""
    a = sets.select(F.col("nid").alias("a"), F.col("sh").alias("sa"))
    b = sets.select(F.col("nid").alias("b"), F.col("sh").alias("sb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for p, q in zip(x.column("sa").to_pylist(), x.column("sb").to_pylist(), strict=True):
                m, n = len(p) // 4, len(q) // 4
                if min(m, n) < least * max(m, n):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32), assume_unique=True))
                ok.append(both >= least * (m + n - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    on = ["b"]
    if copies is not None:
        b, on = b.join(copies, "b").select("b", "sb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")), ["b", "salt"]
    # Sets are joined by shuffles at every size: broadcast, they would fill an executor's memory.
    return pairs.select("a", *on).join(a.hint("merge"), "a").join(b.hint("merge"), on).select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def classes(edges: DataFrame) -> DataFrame:
    """nid, top: the least node of each node's class, for nodes with an edge. Edges move to their nodes' least neighbours until
    only stars are left; every round writes no more rows than there are edges."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Leasts are written, so that Spark can split the rows that a node of many edges brings to the joins.
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "leasts")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a != b").distinct()
        large = written(large, "large-stars")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "leasts")
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a != b")
        edges = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return edges.select(F.col("a").alias("nid"), F.col("b").alias("top"))  # stars, each around its least node


def widened(top: DataFrame, found: DataFrame) -> DataFrame:
    """top (nid, top), where classes that links in found (ca, cb) join have one name."""
    if found.isEmpty():
        return top
    over = classes(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("nid").alias("top"), F.col("top").alias("over"))
    # what `over` renames are tops of classes and nodes without one: neither stands among the classes' members
    return written(top.join(over, "top", "left").select("nid", F.coalesce("over", "top").alias("top")).unionByName(over.select(F.col("top").alias("nid"), F.col("over").alias("top"))), "classes")


#: Bits of a shingle's hash that name its slot in the table of counts; its size doesn't depend on the input's.
SLOT_BITS = 20


def slot_counts(sets: DataFrame) -> np.ndarray:
    """Of each slot of hashes, in how many of the sets (sh) its shingles stand."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for x in batches:
            for p in x.column(0).to_pylist():
                np.add.at(n, np.frombuffer(p, np.uint32) >> np.uint32(32 - SLOT_BITS), 1)
        slot = np.flatnonzero(n)
        for i in range(0, len(slot), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(slot[i : i + 100_000].astype(np.int32)), pa.array(n[slot[i : i + 100_000]])], names=["slot", "n"])

    found = sets.select("sh").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").select("slot", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out = np.ones(1 << SLOT_BITS, np.int32)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def candidates(sets: DataFrame, least: float) -> DataFrame:
    """a, b, ca, cb: pairs of sets (nid, c, sh) of different classes c, among them all of at least the given similarity.

    Shingles are ordered from rare to common. A set of n and one as large or larger that are similar enough share a shingle
    that is among the first n - 2 least n / (1 + least) + 1 of the smaller, and the first (1 - least) n + 1 of the larger; what is
    common to many dissimilar sets comes later and is not joined. The first shingle they share also leaves enough after it.
    """
    common = slot_counts(sets)
    share = 2 * least / (1 + least)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            firsts, sizes, lengths = [], [], []
            for p in x.column("sh").to_pylist():
                h = np.frombuffer(p, np.uint32)
                n = len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1 if len(h) else 0
                firsts.append(h[np.lexsort((h, common[h >> np.uint32(32 - SLOT_BITS)]))[:n]])
                sizes.append(len(h))
                lengths.append(len(firsts[-1]))
            if sum(lengths):
                row = np.repeat(np.arange(len(lengths)), lengths)
                at = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
                yield pa.RecordBatch.from_arrays([x.column("nid").take(pa.array(row)), x.column("c").take(pa.array(row)), pa.array(np.concatenate(firsts).view(np.int32)), pa.array(np.array(sizes, np.int32)[row]), pa.array(at)], names=["nid", "c", "s", "m", "at"])

    # By classes first: the members of one class aren't paired with each other, however many share a shingle.
    every = written(sets.select("nid", "c", "sh").mapInArrow(heads, "nid long, c long, s int, m int, at int"), "heads")
    mixed = every.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("s")
    every = written(every.join(mixed, "s"), "mixed-heads")
    # What a set of m whose shared shingle stands at `at` can be similar to: sizes of the other, in steps of STEP.
    half, step = share / 2, lambda c: F.floor(F.log(c) / math.log(STEP)).cast("int")
    longest = (F.col("m") * (1 - half) - F.col("at")) / half + 1e-6  # what is left after the shingle must hold half a share of both
    own = step(F.col("m"))
    early = every.where(F.col("at") < F.col("m") - F.ceil(share * F.col("m") - 1e-6) + 1).where(longest >= F.col("m"))
    small = early.select("s", own.alias("k"), F.explode(F.sequence(own, step(F.least(longest, F.col("m") / least + 1e-6)))).alias("l"), F.col("c").alias("ca"), F.col("nid").alias("x"), F.col("m").alias("mx"), F.col("at").alias("i"))
    shortest = F.greatest(least * F.col("m") - 1e-6, F.lit(1.0))
    large = every.where(longest >= shortest).select("s", F.explode(F.sequence(step(shortest), step(F.least(longest, F.col("m"))))).alias("k"), own.alias("l"), F.col("c").alias("cb"), F.col("nid").alias("y"), F.col("m").alias("my"), F.col("at").alias("j"))
    met = written(small.select("s", "k", "l", "ca").distinct().join(large.select("s", "k", "l", "cb").distinct(), ["s", "k", "l"]).where("ca != cb"), "met")
    fits = (F.col("mx") < F.col("my")) | ((F.col("mx") == F.col("my")) & (F.col("x") < F.col("y")))
    near = (F.col("mx") >= least * F.col("my") - 1e-6) & (F.least(F.col("mx") - F.col("i"), F.col("my") - F.col("j")) >= half * (F.col("mx") + F.col("my")) - 1e-6)
    found = met.join(small, ["s", "k", "l", "ca"]).join(large, ["s", "k", "l", "cb"]).where(fits & near)
    return found.select(F.col("x").alias("a"), F.col("y").alias("b"), "ca", "cb").distinct()


#: Ratio of the sizes that share a step.
STEP = 1.03
#: Partners of one drawn member that share a key.
PARTNERS = 500
#: Members of a bucket that all others are compared with.
PIVOTS = 2


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, bands: int = 24, rows: int = 5, weighted: bool = True) -> DataFrame:
    """One row per row of df: identifier, class_id (the least identifier of the class), n_links (verified links of its text to
    different texts, as far as classes needed them) and class_size.

    Texts are their lower-case words; those with the same words, and those linked by a similarity of `least` or more over runs
    of `width` words, directly or through others, are one class. A run weighs as often as its text has it (1 if not `weighted`):
    the similarity is the sum of the lesser weights over the sum of the greater. Null and wordless texts are one class of their
    own. Texts of fewer words than `width` are one run. Rows with a null identifier belong to classes like others, which are
    named by the least identifier that isn't null. Extra columns are ignored; an empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    given = written(signed(df, id_col, text_col, width, bands, rows, weighted).withColumn("rid", F.monotonically_increasing_id()), "signed")
    # A text's node is the first of its rows: copies meet in a count by their words' digest.
    nodes = written(given.groupBy("node").agg(F.min("rid").alias("nid"), F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    banded = given.where("bands is not null").select(F.col("rid").alias("nid"), "bands").join(nodes.select("nid"), "nid").select("nid", F.explode("bands").alias("bucket"))
    # joined by a shuffle at every size, so that small inputs show what large ones cost
    counts = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(banded.join(counts.hint("shuffle_hash"), "bucket"), "members")
    # Drawn: the member that meets most texts, often the one that the others were copied from, and others by hash.
    popular = members.groupBy("nid").agg(F.sum("n").alias("meets"))
    drawn = [F.max_by("nid", F.struct("meets", F.xxhash64("nid"))).alias("p0"), *(F.min_by("nid", F.xxhash64("bucket", "nid", F.lit(i))).alias(f"p{i}") for i in range(1, PIVOTS))]
    shared = members.join(popular, "nid").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *drawn)
    shared = written(shared.select("bucket", "n", F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("drawn")), "shared")
    # A drawn member may have any number of partners; a text has at most PIVOTS a band.
    salts = F.ceil(F.col("n") / PARTNERS).cast("long")
    met = members.drop("n").join(shared, "bucket").select("nid", salts.alias("salts"), F.explode("drawn").alias("b")).where("nid != b")
    pairs = written(met.groupBy(F.col("nid").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"), F.max("salts").alias("salts")).withColumn("salt", F.pmod(F.xxhash64("a"), "salts")), "pairs")
    copies = shared.select(F.explode("drawn").alias("b"), salts.alias("salts")).groupBy("b").agg(F.max("salts").alias("salts"))
    ends = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
    sets = written(given.select(F.col("rid").alias("nid"), "sh").join(ends.hint("shuffle_hash"), "nid"), "sets")
    # First each text's likeliest link; then all pairs that still lie between classes.
    first = pairs.groupBy("a").agg(F.max_by(F.struct("b", "salt"), F.col("n") * 4096 + F.pmod(F.xxhash64("a", "b"), F.lit(4096))).alias("p")).select("a", "p.b", "p.salt")
    links = written(verified(first, sets, least, copies), "links")
    top = classes(links)
    of = lambda side: top.select(F.col("nid").alias(side), F.col("top").alias(f"top_{side}"))
    between = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("ca", F.coalesce("top_a", "a")).withColumn("cb", F.coalesce("top_b", "b")).where("ca != cb")
    crossing = written(between.join(first, ["a", "b"], "left_anti").select("a", "b", "salt", "ca", "cb"), "crossing")
    more = written(verified(crossing, sets, least, copies).join(crossing, ["a", "b"]), "links")
    top = widened(top, more)
    # Then the rest: members that weren't drawn and weren't compared with each other, in buckets where they lie in several classes.
    undrawn = members.drop("n").join(shared.where("n > size(drawn) + 1"), "bucket").where(~F.array_contains("drawn", F.col("nid"))).select("bucket", "nid")
    placed_ = written(undrawn.join(top, "nid", "left").select("bucket", "nid", F.coalesce("top", "nid").alias("c")), "undrawn")
    several = placed_.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("bucket")
    undecided = written(placed_.join(several, "bucket").select("nid", "c").distinct(), "undecided")
    every = links.unionByName(more.select("a", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    if not undecided.isEmpty():
        rest = written(candidates(sets.join(undecided, "nid"), least), "rest")
        late = written(verified(rest, sets, least).join(rest, ["a", "b"]), "links")
        top, every = widened(top, late), every.unionByName(late.select("a", "b"))
    degree = every.select(F.col("a").alias("nid")).unionByName(every.select(F.col("b").alias("nid"))).groupBy("nid").agg(F.count(F.lit(1)).alias("n_links"))
    # Names come from counts by class of the texts, which are written: the joins with them have a row per key on one side, so that
    # Spark can split what a large class or a text with many copies brings to the other.
    placed = written(nodes.join(top, "nid", "left").join(degree, "nid", "left").select("node", F.coalesce("top", "nid").alias("c"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "low", "n"), "placed")
    named = written(placed.groupBy("c").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size")), "named")
    texts_ = written(placed.select("node", "c", "n_links").join(named, "c").drop("c"), "texts")
    return given.select(id_col, "node").join(texts_, "node").select(id_col, "class_id", "n_links", "class_size")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df's rows, one of each class: that with the least identifier.

    Rows without an identifier stay, unless their class has one. Where one identifier has several rows, they stay or go
    together, and of those with equal texts one stays.
    """
    found = near_duplicates(df, id_col, text_col, **options)
    ident = free_name(df, "_id")
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias(ident))
    leaders = found.where(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias(ident)).distinct()
    kept = df.join(leaders, F.col(id_col) == F.col(ident), "left_semi")
    if not df.where(F.col(id_col).isNull()).isEmpty():
        kept = kept.unionByName(df.where(F.col(id_col).isNull()) if gone.where(F.col(ident).isNull()).isEmpty() else df.where(F.lit(False)))
    if not df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept
