"""URL filters: host and path rules, and association rules that Spark's FP-growth mines from labelled URLs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.llm.common import id_field, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case. Path: from there up to ?, # or the end. Without :// both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def tokenised(df: DataFrame, id_col: str, url_col: str, extra: list[str] = ()) -> DataFrame:
    """Adds host, path and the array `tokens`: host suffixes, path segments with digits masked, file endings and query keys."""
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    segs = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    labels = F.filter(F.split(F.col("host"), r"\."), lambda s: s != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.greatest(F.size(labels), F.lit(1))), ".")))
    toks = F.concat(
        F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")),
        F.when(F.size(labels) > 2, F.array(F.concat(F.lit("sub="), labels[0]))).otherwise(F.array().cast("array<string>")),
        F.transform(segs, lambda s: F.concat(F.lit("path="), F.regexp_replace(s, "[0-9]+", "0"))),
        F.transform(F.filter(segs, lambda s: F.instr(s, ".") > 0), lambda s: F.concat(F.lit("end="), F.substring_index(s, ".", -1))),
        F.transform(F.filter(F.split(F.col("_query"), "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key="), F.substring_index(s, "=", 1))),
    )
    return df.select(F.col(id_col), *extra, host.alias("host"), path.alias("path"), query.alias("_query")).withColumn("tokens", F.array_sort(F.array_distinct(toks))).drop("_query")


def mine(pages: DataFrame, labels: DataFrame, id_col: str, label_id: str, bad: Column, min_support: float, min_confidence: float, max_rules: int) -> list[tuple[frozenset[str], ...]]:
    """Rules: groups of URL tokens. A URL with a token of each group is bad with the given confidence, support, and a lift over 1.2.

    Tokens that stand in the same URLs throughout are one group, so that what always comes together makes one itemset and not
    one for each subset. A group that is a rule alone takes no part in longer ones, which would block nothing more; nor does a
    token without support among bad URLs. More than `max_rules` tokens or rules are refused: none is dropped.
    """
    from pyspark.ml.fpm import FPGrowth

    y = labels.select(F.col(label_id).alias(id_col), bad.alias("_bad")).where(F.col(id_col).isNotNull() & F.col("_bad").isNotNull()).groupBy(id_col).agg(F.max("_bad").alias("_bad"))
    rows = written(pages.join(y, id_col).where(F.size("tokens") > 0).select("tokens", F.col("_bad").cast("int").alias("bad"), F.monotonically_increasing_id().alias("rid")), "labelled-urls")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not n_bad:
        return []
    least, share = min_support * n, max(min_confidence, 1.2 * n_bad / n)
    tokens = rows.select(F.explode("tokens").alias("t"), "bad", "rid").groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.sum(F.xxhash64("rid", F.lit(1)).cast("decimal(38,0)")).alias("s")).where(F.col("n_bad") >= least)
    groups = tokens.groupBy("n", "n_bad", "x", "s").agg(F.sort_array(F.collect_list("t")).alias("ts")).limit(max_rules + 1).collect()
    # each of these tokens has min_support among all rows: their number is bounded by 1 / min_support times the tokens of a URL
    if len(groups) > max_rules:
        raise ValueError(f"over {max_rules} groups of tokens have support: raise min_support or max_rules")
    alone = [g for g in groups if g["n_bad"] >= share * g["n"]]
    rules = [(frozenset(g["ts"]),) for g in alone]
    members = {g["ts"][0]: frozenset(g["ts"]) for g in groups if g["n_bad"] < share * g["n"]}
    if not members:
        return rules
    known = F.array(*map(F.lit, sorted(members)))
    items = rows.select(F.array_intersect("tokens", known).alias("items"), "bad").select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.array_contains("consequent", BAD) & (F.col("lift") > 1.2)).select("antecedent").limit(max_rules + 1).collect()
    if len(found) > max_rules:
        raise ValueError(f"over {max_rules} rules: raise min_support, min_confidence or max_rules")
    kept: list[frozenset[str]] = []
    for have in sorted((frozenset(r["antecedent"]) for r in found), key=lambda a: (len(a), sorted(a))):
        if not any(a <= have for a in kept):  # a shorter rule blocks all that this one does
            kept.append(have)
    return rules + [tuple(members[t] for t in sorted(a)) for a in kept]


def inverted(rules: list[tuple[frozenset[str], ...]]) -> dict[str, list[tuple[int, int]]]:
    """Token -> (rule, place of the group in it)."""
    index: dict[str, list[tuple[int, int]]] = {}
    for i, groups in enumerate(rules):
        for j, group in enumerate(groups):
            for t in group:
                index.setdefault(t, []).append((i, j))
    return index


def fired(toks: list[str], index: dict[str, list[tuple[int, int]]], sizes: list[int]) -> bool:
    seen: dict[int, set[int]] = {}
    for t in toks:
        for i, j in index.get(t, ()):
            seen.setdefault(i, set()).add(j)
            if len(seen[i]) == sizes[i]:
                return True
    return False


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule `host/path` that the URL fits: the host or a subdomain of it, and a path that starts with the rule's."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], bad: Column | None = None, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", min_support: float = 0.002, min_confidence: float = 0.6, max_rules: int = 10_000) -> DataFrame:
    """One row per page: identifier, host, path, rule, verdict and mined (whether a mined rule matched).

    A listed rule decides; else a URL is blocked if all tokens of a mined rule are among its own. Null URLs and those without
    :// have an empty host and path, fit no rule and are allowed. Without labelled rows nothing is mined. Repeated rows each
    get a row; extra columns are ignored. Executors get all mined rules, which number at most max_rules (more are refused).
    """
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)) if bad is None else bad
    toks = tokenised(pages, id_col, url_col)
    mined = mine(toks, labels, id_col, label_id, bad, min_support, min_confidence, max_rules)
    index, sizes = inverted(mined), [len(groups) for groups in mined]
    schema = T.StructType([id_field(pages, id_col), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("mined", T.BooleanType())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [fired(t or [], index, sizes) for t in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("host"), b.column("path"), pa.array(hit, pa.bool_())], names=schema.names)

    out = toks.select(id_col, "host", "path", "tokens").mapInArrow(match, schema).withColumn("rule", listed(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else None
    by_rule = verdicts[F.col("rule")] if rules else F.lit(None).cast("string")
    return out.select(id_col, "host", "path", "rule", F.coalesce(F.when(F.col("rule").isNotNull(), by_rule), F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined")
