"""The queries of this subpackage's operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.llm.common import table
from pipeloom.llm.decontaminate import leaks
from pipeloom.llm.html_main import extract
from pipeloom.llm.near_dup import near_duplicates
from pipeloom.llm.packing import pack
from pipeloom.llm.quality_crf import quality
from pipeloom.llm.secrets import secret_spans
from pipeloom.llm.token_counts import token_counts
from pipeloom.llm.toolcalls import format_chats
from pipeloom.llm.toxicity import toxicity
from pipeloom.llm.url_rules import url_filter

URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


#: The tools that conversations may call.
TOOLS = {
    "search": {"required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
    "calculate": {"required": ["expression"], "properties": {"expression": {"type": "string"}}},
    "fetch": {"required": ["url"], "properties": {"url": {"type": "string"}, "headers": {"type": "object"}}},
    "run": {"required": ["code"], "properties": {"code": {"type": "string"}, "arguments": {"type": "array"}, "timeout": {"type": "number"}, "network": {"type": "boolean"}}},
}


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"), TOOLS)


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Parts of the results above that SQL can express, and tables with cases that the given ones lack.
def secrets_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def tokens_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def urls_listed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("listed"))


def urls_mined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page bears a host that only bad pages have."""
    ids = table(spark, sf_dir, "pages").select("page_id")
    pages = ids.withColumn("url", F.expr("concat('http://', if(page_id % 5 = 0, 'promo', 'blog'), '.example.org/', if(page_id % 2 = 0, 'a/', 'b/'), page_id)"))
    marks = ids.selectExpr("page_id AS doc_id", "if(page_id % 5 = 0, 0, 1) AS quality", "0 AS toxic")
    return url_filter(pages, marks, URL_RULES)


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality_crf(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines")


def chats_with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn makes two calls, of which the first refers to the second; the turn after it answers the second."""
    calls = F.expr("""concat('{"tool_calls":[{"id":"b', turn, '","name":"search","arguments":"{\\\\"query\\\\": {\\\\"$ref\\\\": \\\\"a', turn, '\\\\"}}"},{"id":"a', turn, '","name":"search","arguments":"{\\\\"query\\\\": \\\\"q', conv_id, '\\\\"}"}]}')""")
    answer = F.expr("""concat('{"tool_call_id":"a', turn - 1, '","content":"r', conv_id, '"}')""")
    talk = table(spark, sf_dir, "conversations")
    return format_chats(talk.withColumn("text", F.when(F.col("turn") % 3 == 0, calls).when(F.col("turn") % 3 == 1, answer).otherwise(F.col("text"))), TOOLS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_token_counts, op3_decontamination, op4_packing, op5_url_filter, op6_chat_formatting, op7_quality_crf, op8_dartminhash, op9_html_extraction, op10_toxicity,
                             secrets_base_counts, tokens_byte_counts, urls_listed_rules, urls_mined_rules, quality_base_counts, chats_with_calls)
}

ORACLE_SQL: dict[str, str] = {
    "op6_chat_formatting": """
        SELECT conv_id, turn, role, 0::BIGINT AS n_calls, 0::BIGINT AS n_valid, 0::BIGINT AS n_linked,
               CASE WHEN role IS NULL THEN to_json({content: coalesce(text, ''), turn: turn}) ELSE to_json({content: coalesce(text, ''), role: role, turn: turn}) END::VARCHAR AS message
        FROM conversations""",
    "secrets_base_counts": r"""
        SELECT doc_id,
               len([x for x in regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) if length(x) >= 12])::BIGINT AS n_assign,
               len([x for x in regexp_extract_all(t, 'AKIA[A-Z0-9]+') if length(x) >= 18])::BIGINT AS n_access, len([x for x in regexp_extract_all(t, '[0-9a-f]+') if length(x) >= 16])::BIGINT AS n_hex
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "tokens_byte_counts": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents",
    "urls_listed_rules": """
        WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
             q AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
             f AS (SELECT *, '.' || host AS h FROM q),
             g AS (SELECT page_id, host, path, CASE WHEN suffix(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN suffix(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                   WHEN suffix(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN suffix(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN suffix(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM f)
        SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS listed FROM g""",
    "urls_mined_rules": """
        SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'promo' ELSE 'blog' END || '.example.org' AS host, '/' || CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END || '/' || page_id AS path, NULL::VARCHAR AS rule,
               CASE WHEN page_id % 5 = 0 THEN 'block' ELSE 'allow' END AS verdict, page_id % 5 = 0 AS mined
        FROM pages""",
    "quality_base_counts": r"""
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines
        FROM (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "chats_with_calls": r"""
        WITH c AS (SELECT a.*, r.turn AS answered FROM conversations a LEFT JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1)
        SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n_calls, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_valid, CASE WHEN turn % 3 = 0 AND answered IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n_linked,
               CASE turn % 3
               WHEN 0 THEN '{"calls":[{"arguments":"{\"query\":\"q' || conv_id || '\"}","id":"a' || turn || '","level":0,"name":"search",' || CASE WHEN answered IS NULL THEN '' ELSE '"result":"r' || conv_id || '","result_turn":' || answered || ',' END
                   || '"valid":true},{"arguments":"{\"query\":{\"$ref\":\"a' || turn || '\"}}","id":"b' || turn || '","level":1,"name":"search","valid":false}],' || CASE WHEN role IS NULL THEN '' ELSE '"role":' || to_json(role) || ',' END || '"turn":' || turn || '}'
               WHEN 1 THEN '{"content":"{\"tool_call_id\":\"a' || (turn - 1) || '\",\"content\":\"r' || conv_id || '\"}",' || CASE WHEN role IS NULL THEN '' ELSE '"role":' || to_json(role) || ',' END || '"turn":' || turn || '}'
               ELSE CASE WHEN role IS NULL THEN to_json({content: coalesce(text, ''), turn: turn}) ELSE to_json({content: coalesce(text, ''), role: role, turn: turn}) END::VARCHAR END AS message
        FROM c""",
}
