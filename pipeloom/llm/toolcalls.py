"""Chat formatting in DataFrame functions only: tool calls are linked to their results, ordered, validated and serialised.

A message's text is plain, or a JSON object: a call message has {"tool_calls": [{"id", "name", "arguments"}, ...]}, a result
message {"tool_call_id", "content"}. Calls and results of one conversation meet in a hash join on (conversation, identifier);
messages themselves are never gathered by conversation, so that one of any length stays spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeloom.llm.common import written

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,content:string>"
RESULT = "struct<tool_call_id:string,content:string>"
#: An argument that refers to another call's result.
REFERENCE = r'"\$ref"\s*:\s*"([^"]+)"'


def parsed(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), t.alias("text")).withColumn(
        "_calls", F.when(F.col("text").rlike(r'^\s*\{[\s\S]*"tool_calls"'), F.from_json("text", CALLS))
    ).withColumn("_result", F.when(F.col("text").rlike(r'^\s*\{[\s\S]*"tool_call_id"'), F.from_json("text", RESULT)))


def valid(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """True if the arguments are an object with every required property, no undeclared one unless additionalProperties allows
    it, and each value of its declared type. An unknown tool's call is invalid. Types: string, number, integer, boolean,
    object, array."""
    kinds = {"string": r'^"', "number": r"^-?[0-9]", "integer": r"^-?[0-9]+$", "boolean": r"^(true|false)$", "object": r"^\{", "array": r"^\["}
    values = F.from_json(arguments, "map<string,variant>")
    raw = F.transform_values(values, lambda k, v: F.to_json(v))
    out = F.lit(False)
    for tool, schema in sorted(schemas.items()):
        props, ok = schema.get("properties", {}), F.coalesce(raw.isNotNull(), F.lit(False))
        for p in schema.get("required", []):
            ok = ok & F.coalesce(F.map_contains_key(raw, p), F.lit(False))
        if not schema.get("additionalProperties", False):
            ok = ok & F.coalesce(F.size(F.array_except(F.map_keys(raw), F.array(*map(F.lit, props)).cast("array<string>"))) == 0, F.lit(False))
        for p, s in sorted(props.items()):
            v = F.try_element_at(raw, F.lit(p))
            ok = ok & F.coalesce(v.rlike(kinds[s["type"]]), F.lit(True))
        out = F.when(name == tool, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def canonical(text: Column) -> Column:
    """A JSON object with its keys sorted, without white space; null if it isn't one."""
    m = F.from_json(text, "map<string,variant>")
    pairs = F.array_sort(F.map_entries(F.transform_values(m, lambda k, v: F.to_json(v))))
    quoted = lambda k: F.substring(F.to_json(F.array(k)), 2, F.length(F.to_json(F.array(k))) - 2)
    return F.when(m.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ","), F.lit("}")))


def _same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which equal means null and null too; `on` comes once."""
    named = b.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in b.columns))
    return a.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], how).drop(*(f"_{c}" for c in on))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls: 0 without references, else one more than the greatest of those; none on a cycle or
    behind one. A round for each level settles the calls whose references are settled."""
    if edges.isEmpty():
        return nodes.select("conv_id", "call_id", F.lit(0).alias("level"))
    edges = written(edges, "call-edges")
    referring = edges.select("conv_id", "call_id").distinct()
    leaves = written(_same(nodes.select("conv_id", "call_id"), referring, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "call-levels")
    state, settled = leaves, -1
    while True:
        of_ref = state.select("conv_id", F.col("call_id").alias("ref"), "level")
        found = _same(edges, of_ref, ["conv_id", "ref"], "left").groupBy("conv_id", "call_id").agg(F.when(F.count("level") == F.count(F.lit(1)), F.max("level") + 1).alias("level"))
        state = written(leaves.unionByName(found), "call-levels")
        now = state.agg(F.count("level")).first()[0]
        if now == settled:
            return state
        settled = now


def linked_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: rid (the message's), conv_id, turn, place, call_id, name, arguments (canonical), valid, level, result_turn, result.

    An identifier's first call by (turn, place) is the one that others refer to and that results link to; its first result after
    it counts. level is the length of the longest chain of references below a call; calls on a cycle, or behind one, have none.
    """
    calls = (
        messages.where(F.size("_calls.tool_calls") > 0).select("rid", "conv_id", "turn", F.posexplode("_calls.tool_calls").alias("place", "c"))
        .select("rid", "conv_id", "turn", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("raw"))
        .withColumn("arguments", canonical(F.col("raw"))).withColumn("valid", valid(F.col("name"), F.col("raw"), schemas))
        .withColumn("refs", F.array_distinct(F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(REFERENCE), F.lit(1)))).drop("raw")
        .withColumn("key", F.struct("turn", "place", "rid"))
    )
    results = messages.where("_result.tool_call_id is not null").select("conv_id", F.col("turn").alias("r_turn"), F.col("_result.tool_call_id").alias("call_id"), F.col("_result.content").alias("content"))
    firsts = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("key").alias("first"))
    nodes = written(_same(calls, firsts, ["conv_id", "call_id"], "left").withColumn("is_first", F.coalesce(F.col("key") == F.col("first"), F.lit(False))).drop("first"), "calls")
    heads = nodes.where("is_first")
    answered = (
        _same(heads.select("conv_id", "call_id", "turn"), results, ["conv_id", "call_id"]).where("r_turn > turn")
        .groupBy("conv_id", "call_id").agg(F.min(F.struct("r_turn", "content")).alias("r"))
    )
    edges = _same(heads.select("conv_id", "call_id", F.explode("refs").alias("ref")), heads.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"])
    linked = _same(_same(heads.select("rid", "place", "conv_id", "call_id"), levels(heads, edges), ["conv_id", "call_id"]), answered, ["conv_id", "call_id"], "left")
    return nodes.drop("key", "refs", "is_first").join(linked.select("rid", "place", "level", F.col("r.r_turn").alias("result_turn"), F.col("r.content").alias("result")), ["rid", "place"], "left")


def format_chats(df: DataFrame, schemas: dict[str, dict] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, n_calls, n_valid, n_linked and message, its canonical JSON.

    Keys are sorted and no white space stands between them. Calls are listed by level and place, with their results inside,
    beside the message's own content. A result message that no call takes is an orphan and keeps its text as content. Null
    texts are empty; null roles and turns are left out of the JSON; calls and results of a null conversation belong together.
    Malformed JSON is plain text. Repeated rows each get a row, with their own calls; extra columns are ignored.
    """
    messages = parsed(df, conv, turn, role, text)
    whole = F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"))
    none = [F.lit(0).cast("long").alias(n) for n in ("n_calls", "n_valid", "n_linked")]
    calling = F.coalesce(F.size("_calls.tool_calls"), F.lit(0)) > 0
    if messages.where(calling).isEmpty():
        return messages.select("conv_id", "turn", "role", *none, whole.alias("message"))
    # Row numbers hold once written. Only messages that call or answer are.
    numbered = written(messages.where(calling | F.col("_result").isNotNull()).drop("text").withColumn("rid", F.monotonically_increasing_id()), "messages")
    one = F.struct(
        F.coalesce("level", F.lit(2147483647)).alias("o1"), F.col("place").alias("o2"), "valid", F.col("result_turn").isNotNull().alias("linked"),
        F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "level", "name", "result", "result_turn", "valid")).alias("json"))
    by_message = linked_calls(numbered, schemas or {}).groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias("cs"))  # the calls of one message
    others = F.to_json(F.struct(F.col("_calls.content").alias("content"), "role", "turn"))
    listed = F.concat(F.lit('{"calls":['), F.array_join(F.transform("cs", lambda c: c["json"]), ","), F.lit("]"), F.when(others == "{}", others.substr(2, 1)).otherwise(F.concat(F.lit(","), others.substr(F.lit(2), F.length(others)))))
    per = lambda f: F.size(F.filter("cs", f)).cast("long")
    made = numbered.where(calling).join(by_message, "rid").select(
        "conv_id", "turn", "role", F.size("cs").cast("long").alias("n_calls"), per(lambda c: c["valid"]).alias("n_valid"), per(lambda c: c["linked"]).alias("n_linked"), listed.alias("message"))
    return messages.where(~calling).select("conv_id", "turn", "role", *none, whole.alias("message")).unionByName(made)
