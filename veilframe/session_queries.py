"""Queries of sessions, overrides in time, fallback attempts, pattern matches, subtotals of hits and event-time windows over the driver's tables, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pattern_table
from .operators import attempts, pages, scrub, sessions, spans
from .plans.config import ScrubConfig, plan_rules, term_rules
from .queries import CLEAN_PAGES_SQL, detection_sql, paged_conversations, table
from .sources import match_results


def language_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of conversations turn by turn: every third is set to German at its third turn, every fifth is released at its fifth."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.where("(conv_id % 3 = 0 AND turn = 2) OR (conv_id % 5 = 0 AND turn = 4)").select("conv_id", "turn", F.when(F.col("turn") == 2, "de").otherwise("auto").alias("lang"))
    return sessions.locked(turns, said, session="conv_id").select("conv_id", "turn", "content_lang", "asked", "lock")


LANGUAGE_LOCKS_SQL = f"""
WITH {detection_sql("conversations", "conv_id, turn")},
d AS (SELECT conv_id, turn, trim(text) = '' AS blank, CASE WHEN reason = 'han_ratio' THEN 'zh' WHEN reason LIKE 'ngram%' THEN top END AS sure FROM k),
s AS (SELECT *, count(*) FILTER (WHERE conv_id % 3 = 0 AND turn = 2 OR conv_id % 5 = 0 AND turn = 4) OVER o AS part, conv_id % 3 = 0 AND turn >= 2 AND NOT (conv_id % 5 = 0 AND turn >= 4) AS forced FROM d WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT *, CASE WHEN forced THEN 'de' ELSE (SELECT arg_min(e.sure, e.turn) FROM s AS e WHERE e.conv_id = s.conv_id AND e.part = s.part AND e.turn <= s.turn AND e.sure IS NOT NULL) END AS lock FROM s)
SELECT conv_id, turn, CASE WHEN blank THEN '' ELSE coalesce(lock, '') END AS content_lang, NOT blank AND lock IS NULL AS asked, lock FROM l
"""

#: Languages that users choose in turn, and the event that is a choice.
CHOICES, CHOICE = ("en", "de", "zh"), "signup"


def chosen_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that each event's user had chosen last before it, a day's events at a time."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    chosen = events.where(F.col("event_type") == CHOICE).select("user_id", "ts", F.element_at(F.array(*[F.lit(x) for x in CHOICES]), (F.col("event_id") % len(CHOICES) + 1).cast("int")).alias("lang"))
    rows = events.where(F.col("event_type") != CHOICE)
    return sessions.as_of(rows, chosen, ["user_id"], "ts", "lang", "chosen", stretch=F.to_date("ts")).select("event_id", "user_id", "chosen")


CHOSEN_SQL = f"""
WITH c AS (SELECT user_id, ts, max(CASE event_id % 3 {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(CHOICES))} END) AS lang FROM events WHERE event_type = '{CHOICE}' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, c.lang AS chosen FROM (SELECT * FROM events WHERE event_type <> '{CHOICE}') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts
"""

#: Terms that only some texts of a turn have: the cleaned page, the page with its header and foot, the turn with who spoke.
ATTEMPT_TERMS = ("the", "Page 2", "assistant")


def _attempted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = paged_conversations(spark, sf_dir)
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), F.concat_ws(": ", "role", "text").alias("spoken"))
    every = raw.join(pages.without_headers(raw).withColumnRenamed("text", "clean"), attempts.PAGE).join(said, attempts.PAGE)
    rules = term_rules(ScrubConfig(lang="en", terms=ATTEMPT_TERMS))
    texts = {"clean": F.col("clean"), "raw": F.col("text"), "spoken": F.col("spoken")}
    return every, attempts.first_served(every, attempts.hit_attempts(texts, lambda text: spans.hits_of(text, rules, "en")))


def page_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of conversations by the first of their texts in which a term is found: ``doc_id, page_number, attempt, n``."""
    _, served = _attempted(spark, sf_dir)
    return served.select("doc_id", "page_number", "attempt", F.size("hits").cast("long").alias("n"))


def attempt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each attempt served, and how many none did."""
    every, served = _attempted(spark, sf_dir)
    return attempts.audit(every, served)


_CLEAN = CLEAN_PAGES_SQL.rpartition("SELECT doc_id, page_number, CAST")[0].strip()
_TERM = r"'(?i)\b(the|page 2|assistant)\b'"
_ATTEMPTS_SQL = f"""
{_CLEAN}, y AS (SELECT o.doc_id, o.page_number, len(regexp_extract_all(o.t, {_TERM})) AS a, len(regexp_extract_all(p.text, {_TERM})) AS b, len(regexp_extract_all(coalesce(v.role, '') || ': ' || coalesce(v.text, ''), {_TERM})) AS c
  FROM o JOIN p ON p.doc_id = o.doc_id AND p.page_number = o.page_number JOIN conversations v ON v.conv_id = o.doc_id AND v.turn = o.page_number),
z AS (SELECT doc_id, page_number, CASE WHEN a > 0 THEN 'clean' WHEN b > 0 THEN 'raw' WHEN c > 0 THEN 'spoken' END AS attempt, CAST(CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE c END AS BIGINT) AS n FROM y)
"""
PAGE_ATTEMPTS_SQL = f"{_ATTEMPTS_SQL} SELECT * FROM z WHERE attempt IS NOT NULL"
ATTEMPT_COUNTS_SQL = f"{_ATTEMPTS_SQL} SELECT attempt, count(*) AS pages, CAST(count(*) FILTER (WHERE attempt IS NOT NULL) AS BIGINT) AS rows FROM z GROUP BY attempt"

#: Patterns that both the table function and SQL can run, and one with a group.
PATTERNS = {"number": r"[0-9]{2,}(?:\.[0-9]+)?", "mail": r"([A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "double": r"([a-z])[a-z] [A-Z][a-z]+"}


def pattern_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of patterns in all documents by the table function: ``doc_id, key, start, end, value, first_group``."""
    found = pattern_table.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), PATTERNS)
    return found.select("doc_id", "key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value", F.get("groups", 0).alias("first_group"))


def _places_sql(key: str, pattern: str) -> str:
    group = "chr(57600) || '\\1'" if "([" in pattern else "chr(57600)"
    first = "parts[i + 2]" if "([" in pattern else "CAST(NULL AS VARCHAR)"
    return f"""SELECT doc_id, '{key}' AS key, CAST(coalesce(list_sum(list_transform(range(1, i, 3), lambda j: length(parts[j]) + length(parts[j + 1]))), 0) AS BIGINT) + length(parts[i]) AS start, parts[i + 1] AS value, {first} AS first_group
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) - 2, 3)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '{pattern}', chr(57600) || '\\0' || {group} || chr(57600), 'g'), chr(57600)) AS parts FROM documents))"""


PATTERN_PLACES_SQL = "SELECT doc_id, key, start, start + length(value) AS \"end\", value, first_group FROM (" + " UNION ALL ".join(_places_sql(k, p) for k, p in PATTERNS.items()) + ")"

#: Terms whose hits are counted beside those of the e-mail rule.
COUNTED_TERMS = ("the", "und", "que")


def hit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of e-mail addresses and a user's terms by language, source and key, with subtotals and the total."""
    rules = [*term_rules(ScrubConfig(lang="en", terms=COUNTED_TERMS)), *[r for r in plan_rules(ScrubConfig(lang="en")) if r.key == "email"]]
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", spans.unmarked(F.col("text")).alias("_text"))
    return scrub.hit_totals(docs.withColumn("hits", spans.hits_of("_text", rules, "en")), ["lang", "source"])


HIT_TOTALS_SQL = rf"""
WITH h AS (SELECT doc_id, lang, source, 'email' AS key, len(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+[ \t]*@[ \t]*[A-Z0-9.-]+[ \t]*\.[ \t]*[A-Z]{{2,}}\b')) AS n FROM documents
           UNION ALL SELECT doc_id, lang, source, 'manual_term', len(regexp_extract_all(text, '(?i)\b({"|".join(COUNTED_TERMS)})\b')) FROM documents)
SELECT lang, source, key, CAST(grouping(lang, source, key) AS BIGINT) AS level, CAST(sum(n) AS BIGINT) AS hits, count(DISTINCT doc_id) AS documents FROM h WHERE n > 0 GROUP BY ROLLUP (lang, source, key)
"""

#: Order lines as hit records of several makes, by the line's number; SQL text that both engines read.
RECORDS = """CASE l_linenumber
  WHEN 1 THEN '{"key":"k' || l_suppkey % 3 || '","a":' || l_partkey % 50 || ',"b":' || (l_partkey % 50 + l_suppkey % 9) || ',"id":"h' || l_orderkey || '"}'
  WHEN 2 THEN '{"ruleKey":"r","start":' || l_partkey % 50 || ',"end":' || (l_partkey % 50 + 3) || ',"preferSub":{"offsetStart":1,"offsetEnd":2}}'
  WHEN 3 THEN '{"type":"t","from":-' || l_partkey % 5 || ',"to":' || l_suppkey % 7 || '}'
  WHEN 4 THEN '{"key":' || l_partkey || ',"type":"number before","index":' || l_partkey % 50 || ',"len":' || l_suppkey % 4 || '}'
  WHEN 5 THEN '{"key":"","a":1,"b":2}'
  WHEN 6 THEN '{"key":"broken","a":1,"b":'
  ELSE '{"key":"text place","a":"1","start":2.5,"b":null,"end":7.5}' END"""


def hit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of stored hit records that name their fields in different ways; unusable ones are left out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(RECORDS).alias("record"))
    return match_results.hit_spans(lines)


def _first(kind: str, names: tuple[str, ...], cast: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(j, '$.{n}') IN ({kind}) THEN CAST(json_extract_string(j, '$.{n}') AS {cast}) END" for n in names) + ")"


_NUMBERS = "'BIGINT', 'UBIGINT', 'DOUBLE'"
HIT_RECORDS_SQL = f"""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN json_valid({RECORDS}) THEN {RECORDS} END AS j FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, j, coalesce({_first("'VARCHAR'", match_results.KEY_NAMES, "VARCHAR")}, '') AS key, {_first(_NUMBERS, match_results.START_NAMES, "DOUBLE")} AS a, {_first(_NUMBERS, match_results.END_NAMES, "DOUBLE")} AS b0, {_first(_NUMBERS, ("len",), "DOUBLE")} AS n FROM r WHERE j IS NOT NULL),
e AS (SELECT *, coalesce(b0, a + n) AS b FROM s)
SELECT l_orderkey, l_linenumber, key, CAST(trunc(greatest(a, 0)) AS INTEGER) AS a, CAST(trunc(greatest(b, 0)) AS INTEGER) AS b, CAST(json_extract(j, '$.preferSub.offsetStart') AS INTEGER) AS part_a, CAST(json_extract(j, '$.preferSub.offsetEnd') AS INTEGER) AS part_b, coalesce(json_extract_string(j, '$.id'), '') AS id
FROM e WHERE key <> '' AND b > a
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "language_locks": language_locks,
    "chosen_languages": chosen_languages,
    "page_attempts": page_attempts,
    "attempt_counts": attempt_counts,
    "pattern_places": pattern_places,
    "hit_totals": hit_totals,
    "hit_records": hit_records,
}
ORACLES: dict[str, str] = {
    "language_locks": LANGUAGE_LOCKS_SQL,
    "chosen_languages": CHOSEN_SQL,
    "page_attempts": PAGE_ATTEMPTS_SQL,
    "attempt_counts": ATTEMPT_COUNTS_SQL,
    "pattern_places": PATTERN_PLACES_SQL,
    "hit_totals": HIT_TOTALS_SQL,
    "hit_records": HIT_RECORDS_SQL,
}
