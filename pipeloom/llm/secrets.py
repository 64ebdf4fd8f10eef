"""Secret scans in DataFrame functions only.

Patterns find the base kinds. Beside them, candidate strings are scanned by a sliding window: as it moves by one character,
the count of the character that enters grows and that of the one that leaves shrinks, and the sum of c log2 c follows by two
differences. Strings of hex digits and of the base-64 alphabet have thresholds of their own; allowed forms are suppressed.

All steps take time in proportion to a text, however many spans it has or how long one is: the patterns repeat single
character classes only, and running sums are folded in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeloom.llm.common import free_name

#: Kind, pattern, group that is the secret. Case is folded as by the SQL of secrets_base_counts:
#: the long s and the Kelvin sign are an s and a k too.
ASSIGN = r"""((?i)pa[s\u017F]{2}word|pa[s\u017F]{2}wd|[s\u017F]ecret|to[k\u212A]en|api_?[k\u212A]ey)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 18 or more, of the first AKIA on; shorter runs can't match from a later start either.
ACCESS = r"AKIA[A-Z0-9]{14,}"
#: Whole runs, of 16 or more.
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN = 12

#: A candidate is a whole run of these characters, of 20 or more, with a digit and a letter; = may pad its end.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]++={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Forms that look random and are no secrets: UUIDs, marked samples, dates and what is joined to them.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|example|sample|placeholder|dummy|changeme|x{6}|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
#: Paths and names of letters, with a short number at the end. Two strokes in a row make no path.
PATH = r"(?i)^[a-z_/-]++[0-9]{0,6}$"
WIDTH = 20
#: Bits a character, of at most log2(16) = 4 and log2(20) = 4.32 in a window of 20.
HEX_BITS, BASE64_BITS = 3.0, 3.7
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Values in a block of a running sum. Appending copies what a block has so far.
BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over the values up to each, of an array<int>; op is associative, with 0 as its zero."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("v"), none.alias("out"))

    def fold(a: Column) -> Column:
        return F.aggregate(a, start, lambda acc, x: F.struct(op(acc["v"], x).cast("int").alias("v"), F.concat(acc["out"], F.array(op(acc["v"], x).cast("int"))).alias("out")), lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(values, b * BLOCK + 1, BLOCK)))
    whole = _let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.concat(F.array(F.lit(0)), fold(F.transform(F.slice(bs, 1, F.size(bs) - 1), lambda b: F.element_at(b, -1)))), lambda b, o: F.transform(b, lambda x: op(x, o).cast("int")))))
    return F.when(F.size(values) > 0, whole).otherwise(none)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, pattern: str, group: int, kind: int) -> Column:
    """array<struct<start, kind, end, v>> of the group, which ends its match, for all matches. Between the matches lie the parts
    of a split by the same pattern; their lengths add up to the matches' places."""
    parts = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.struct(whole.alias("m"), value.alias("v"), parts.alias("gaps"))

    def placed(f: Column) -> Column:
        ends = _running(F.zip_with(f["m"], F.slice(f["gaps"], 1, F.size(f["m"])), lambda m, gap: F.length(m) + F.length(gap)), _plus)
        return F.zip_with(ends, f["v"], lambda end, v: F.struct((end - F.length(v)).cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), v.alias("v")))

    return F.when(text.rlike(pattern), _let(found, placed)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,v:string>>"))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _window(candidate: Column, width: int, bits: Column) -> Column:
    """struct<lo, hi>: start of the first and end of the last window of `candidate` with at least `bits` of entropy a character;
    nulls if there is none. State: the counts, a letter for each character of the alphabet, and the sum of c log2 c."""
    n = F.length(candidate)
    chars = F.transform(F.slice(F.split(candidate, ""), 1, n), lambda c: F.instr(F.lit(ALPHABET), c).cast("int"))
    # c log2 c sums to at most this where the entropy, log2(width) - sum / width, is at least `bits`
    most = F.lit(width) * (F.lit(math.log2(width)) - bits) + F.lit(1e-9)
    xlog = [c * math.log2(c) if c else 0.0 for c in range(width + 1)]
    grows = F.array(F.lit(0.0), *(F.lit(b - a) for a, b in zip(xlog, xlog[1:], strict=False)))  # by the c-th of a character
    start = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - 65
    put = lambda counts, at, c: F.overlay(counts, F.char(c + 65), at, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        def left(y: Column) -> Column:  # y: counts without what leaves, sum, into
            more = count(y["counts"], x["into"]) + 1
            return F.struct(put(y["counts"], x["into"], more).alias("counts"), (y["s"] + F.element_at(grows, more + 1)).alias("s"))

        less = count(acc["counts"], x["out"])
        gone = F.when(x["out"] > 0, F.struct(put(acc["counts"], x["out"], less - 1).alias("counts"), (acc["s"] - F.element_at(grows, less + 1)).alias("s"))).otherwise(F.struct(acc["counts"].alias("counts"), acc["s"].alias("s")))

        def moved(z: Column) -> Column:
            hit = (x["i"] + 1 >= width) & (z["s"] <= x["most"])
            return F.struct(z["counts"].alias("counts"), z["s"].alias("s"), F.coalesce(acc["lo"], F.when(hit, (x["i"] + 1 - width).cast("int"))).alias("lo"), F.when(hit, (x["i"] + 1).cast("int")).otherwise(acc["hi"]).alias("hi"))

        return _let(_let(gone, left), moved)

    # what enters and what leaves at each move; nothing leaves the first windows
    def scan(c: Column) -> Column:
        leaves = F.concat(F.array_repeat(F.lit(0), width), F.slice(c["at"], 1, F.greatest(n - width, F.lit(0))))
        pairs = F.arrays_zip(c["at"].alias("into"), leaves.alias("out"))
        moves = F.transform(F.slice(pairs, 1, F.size(c["at"])), lambda x, i: F.struct(i.alias("i"), x["into"].alias("into"), x["out"].alias("out"), c["most"].alias("most")))
        return F.aggregate(moves, start, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))

    return _let(F.struct(chars.alias("at"), most.alias("most")), scan)


def _entropy_spans(runs: Column) -> Column:
    """Spans of the candidates that a window finds, narrowed to the windows."""

    def narrowed(r: Column) -> Column:
        v = r["v"]
        is_hex = v.rlike("^[0-9a-f]++$|^[0-9A-F]++$")
        allowed = v.rlike(ALLOWED) | v.rlike(PATH) & ~v.contains("//")
        found = F.when(~allowed, _window(v, WIDTH, F.when(is_hex, F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))))
        return _let(found, lambda w: F.struct((r["start"] + w["lo"]).cast("int").alias("start"), F.when(is_hex, F.lit(3)).otherwise(F.lit(4)).alias("kind"), (r["start"] + w["hi"]).cast("int").alias("end")))

    return F.filter(F.transform(runs, narrowed), lambda s: s["start"].isNotNull())


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _uncovered(spans: Column) -> Column:
    """Sorted spans less those of entropy that lie within a base span."""
    covers = _running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0))), F.greatest)
    kept = F.zip_with(spans, covers, lambda s, m: F.when((s["kind"] < 3) | (m < s["end"]), s))
    return F.filter(kept, lambda s: s.isNotNull())


def found_spans(text: Column) -> tuple[Column, Column]:
    """(base spans, candidate runs) of a text."""
    assign = F.filter(_spans(text, ASSIGN, 2, 0), lambda s: s["end"] - s["start"] >= MIN_ASSIGN)
    base = F.array_sort(F.concat(_bare(assign), _bare(_spans(text, ACCESS, 0, 1)), _bare(_spans(text, HEX, 0, 2))))
    return base, _spans(text, RUN, 0, 4)


def scanned(df: DataFrame, text_col: str) -> tuple[DataFrame, str, str, str]:
    """df with the text, the base spans and all spans, by start and then kind, and the names of these columns."""
    text, base, spans, runs = (free_name(df, f"_{n}") for n in ("text", "base", "spans", "runs"))
    found, candidates = found_spans(F.col(text))
    more = F.when(F.size(runs) > 0, _entropy_spans(F.col(runs))).otherwise(F.array().cast(SPANS))
    out = (
        df.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn(base, found).withColumn(runs, candidates).withColumn(runs, more)
        .withColumn(spans, F.when(F.size(runs) > 0, _uncovered(F.array_sort(F.concat(base, runs)))).otherwise(F.col(base))).drop(runs)
    )
    return out, text, base, spans


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: identifier, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    A span is kind:start:end in code points, end exclusive, of the secret itself (of an assignment, the value). Null and empty
    texts have no span: counts of 0, the hash of an empty string, an empty list. Repeated rows each get a row; extra columns
    are ignored, whatever their names.
    """
    found, _, base, spans = scanned(df.select(F.col(id_col), F.col(text_col)), text_col)
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col, *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_joined(F.col(base)), 256).alias("base_sha256"),
        _joined(F.col(spans)).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_entropy"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each span of its texts replaced by `mark`; overlapping spans become one mark. Rows without a span, null texts and
    all other columns, whatever their names, stay as they are."""
    found, text, base, spans = scanned(df, text_col)
    part = lambda s, lo, hi: F.substring(s, lo + 1, F.greatest(hi - lo, F.lit(0)))

    def clean(f: Column) -> Column:  # f: spans, and the greatest end up to each
        n = F.size(f["spans"])
        before = lambda i: F.when(i > 0, F.element_at(f["ends"], F.greatest(i, F.lit(1)))).otherwise(F.lit(0))  # noqa: E731  the greatest end of the first i

        def block(b: Column) -> Column:  # cut from the text once, so that no piece is counted out from the text's start
            lo, last = b * BLOCK, F.least((b + 1) * BLOCK, n)
            def pieces(c: Column) -> Column:
                one = lambda s, i: F.when(s["start"] >= before(lo + i), F.concat(part(c["text"], before(lo + i) - c["from"], s["start"] - c["from"]), F.lit(mark))).otherwise(F.lit(""))
                return F.array_join(F.transform(F.slice(f["spans"], lo + 1, BLOCK), one), "")

            return _let(F.struct(before(lo).alias("from"), part(F.col(text), before(lo), before(last)).alias("text")), pieces)

        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block)
        return F.concat(F.array_join(blocks, ""), F.substring(F.col(text), before(n) + 1, F.length(text)))

    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    whole = _let(F.struct(F.col(spans).alias("spans"), ends.alias("ends")), clean)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(F.col(text_col))).drop(text, base, spans)
