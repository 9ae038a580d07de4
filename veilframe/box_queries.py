"""Queries of the languages' rectangle packs, merged spans, collapsed and a user's own boxes, and the audit, over the driver's tables, and equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .more_queries import _ROUNDED, _thousandths, set_words
from .operators import geometry, pages, scrub, spans
from .plans.labels import LABELS, labelled_tuning
from .plans.tuning import LONGEST, NAME_KEYS, RECT_FONT, language_tuning
from .queries import table, word_items

#: Print density: a page of 612 by 840 units at eight times its size; font size and width of a character of set words.
SCALE, WIDE, HIGH, FONT, CHAR = 8.0, 4896.0, 6720.0, 10.0, 0.5


def box_keys(lang: str) -> list[str]:
    """Keys that a language's pack treats in its own way, and one that it does not name."""
    t = language_tuning(lang)
    return sorted({*t.pads, *t.groups, *t.whole, *t.special, *t.strict, *NAME_KEYS, "manual_term", "unnamed"})


def key_spans(spark: SparkSession, sf_dir: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """Set words as hits of the pack's keys in turn, every second one without its first character; and the words."""
    items, layout = set_words(spark, sf_dir, SCALE)
    keys, n = F.array(*[F.lit(k) for k in box_keys(lang)]), len(box_keys(lang))
    skip = F.when(F.length("str") > 1, F.col("idx") % 2).otherwise(0)
    hits = items.select("doc_id", "page_number", F.format_string("h%06d", "idx").alias("id"), F.get(keys, F.col("idx") % n).alias("key"), (F.col("start") + skip).alias("a"), F.col("end").alias("b"))
    return hits, geometry.on_device(items, layout)


def key_rects(lang: str) -> Callable[[SparkSession, str], DataFrame]:
    """Rectangles by a language's pack."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _thousandths(geometry.device_rects(*key_spans(spark, sf_dir, lang), lang), "doc_id", "id", "key")

    return query


def _words_sql(lang: str) -> str:
    t, keys = language_tuning(lang), box_keys(lang)
    quote = lambda k: f"'{k}'"
    rows = []
    for n, key in enumerate(keys):
        group = "manual_term" if key == "manual_term" else t.groups.get(key, "default")
        own = t.special.get(key)
        rows.append(f"({n}, {quote(key)}, {', '.join(map(str, t.widths[group]))}, {str(group == 'longValue').lower()}, {', '.join(map(str, own or ['NULL'] * 5))}, {', '.join(map(str, t.pads.get(key, t.pad)))}, {str(key in t.whole).lower()}, {str(key in NAME_KEYS).lower()})")
    ends = "[" + "".join("\\" + c if c in "[]" else c for c in geometry.WEAK).replace("'", "''") + "]+"
    return f"""
g(n_key, key, page, most, hard, soft, long, f, p1, e1, e0, p0, pw, ph, mx, my, all_of, named) AS (VALUES {", ".join(rows)}),
b AS (SELECT item_id AS doc_id, regexp_split_to_array(coalesce(text, ''), ' +') AS words FROM benchmark),
i AS (SELECT doc_id, words, unnest(range(len(words))) AS idx FROM b),
k AS (SELECT doc_id, idx, words[idx + 1] AS s, length(words[idx + 1]) AS n, {SCALE} * (idx % 10 * 50) AS lft, {HIGH} - {SCALE} * (800.0 - floor(idx / 10) * 14) AS base, {SCALE * FONT} AS font, length(words[idx + 1]) * {CHAR * SCALE * FONT} AS wide FROM i WHERE trim(words[idx + 1]) <> ''),
u AS (SELECT k.*, g.*, CASE WHEN n > 1 THEN idx % 2 ELSE 0 END AS lo0 FROM k JOIN g ON n_key = idx % {len(keys)}),
v AS (SELECT *, CASE WHEN key = 'manual_term' THEN s[lo0 + 1:] ELSE regexp_replace(s[lo0 + 1:], '^{ends}', '') END AS rest FROM u),
c AS (SELECT *, CASE WHEN key = 'manual_term' THEN rest ELSE regexp_replace(rest, '{ends}$', '') END AS core FROM v),
x AS (SELECT *, CASE WHEN all_of THEN 0 ELSE n - length(rest) END AS lo, CASE WHEN all_of THEN n ELSE n - length(rest) + length(core) END AS hi, greatest({RECT_FONT[1]}, least({RECT_FONT[2]}, font * {RECT_FONT[0]})) AS rf FROM c),
e AS (SELECT *, greatest(10.0, n * rf * {RECT_FONT[3]}) AS est FROM x WHERE hi > lo),
z AS (SELECT *, CASE WHEN wide > est * hard THEN est * soft ELSE wide END AS fit FROM e),
o AS (SELECT *, greatest(0.0, least({WIDE}, lft)) AS bx, 6 + CASE WHEN f IS NOT NULL THEN greatest(greatest(1.0, least(least({WIDE} * p1, est * e1), fit * f)), least(est * e0, {WIDE} * p0))
        ELSE greatest(greatest(1.0, least(least({WIDE} * page, est * most), fit)), least(est * CASE WHEN long THEN 0.92 ELSE 0.80 END, {WIDE} * CASE WHEN long THEN 0.38 ELSE 0.18 END)) END AS bw0,
        greatest(0.0, least({HIGH}, base - rf + greatest(2.0, least(4.0, rf * 0.16)))) AS y0 FROM z),
p AS (SELECT *, greatest(1.0, least({WIDE} - bx, bw0)) AS bw, greatest(4.0, least({HIGH} - y0, rf - greatest(2.0, least(4.0, rf * 0.14)))) AS bh, all_of OR n <= {geometry.WHOLE_ITEM_LENGTH} OR hi - lo >= n * {t.cover} AS whole FROM o),
r AS (SELECT *, CASE WHEN whole THEN bx ELSE bx + bw * lo / n END AS x1, CASE WHEN whole THEN bx + bw ELSE bx + bw * hi / n END AS x2, greatest(mx, bw * pw) AS px, greatest(my, bh * ph) AS py, CASE WHEN named THEN greatest(2.0, least(4.0, bw * 0.04)) ELSE 0.0 END AS nudge FROM p),
t AS (SELECT *, greatest(0.0, least({WIDE}, x1 - px - nudge)) AS x_, greatest(0.0, least({HIGH}, y0 - py + 2 + {t.down})) AS y_ FROM r),
boxes AS (SELECT doc_id, 'h' || lpad(CAST(idx AS VARCHAR), 6, '0') AS id, key, x_ AS x, y_ AS y, greatest(1.0, least({WIDE} - x_, x2 - x1 + 2 * px + nudge)) AS w, greatest(3.0, least({HIGH} - y_, bh + 2 * py - {t.trim})) AS h FROM t)
"""


def key_rects_sql(lang: str) -> str:
    return f"WITH {_words_sql(lang)} SELECT doc_id, id, key, {_ROUNDED} FROM boxes"


def rect_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with and without a box, by document: a hit of weak characters alone has none."""
    hits, placed = key_spans(spark, sf_dir, "en")
    return geometry.audit(hits, geometry.device_rects(hits, placed, "en"))


RECT_AUDIT_SQL = f"""
WITH {_words_sql("en")}, n AS (SELECT doc_id, count(*) AS mapped FROM boxes GROUP BY doc_id)
SELECT k.doc_id, count(*) AS hits, CAST(coalesce(max(mapped), 0) AS BIGINT) AS mapped, CAST(count(*) - coalesce(max(mapped), 0) AS BIGINT) AS unmapped, CAST(coalesce(max(mapped), 0) AS BIGINT) AS rects FROM k LEFT JOIN n ON n.doc_id = k.doc_id GROUP BY k.doc_id
"""

#: Keys of order lines as spans, by return flag.
SPAN_KEYS = {"A": "person_name", "N": "money", "R": "unnamed"}


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spans of keys on two pages of their order."""
    key = F.element_at(F.create_map(*[F.lit(x) for kv in SPAN_KEYS.items() for x in kv]), F.col("l_returnflag"))
    begin = (F.col("l_partkey") % 90).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page_number"), F.format_string("h%d", "l_linenumber").alias("id"), key.alias("key"), begin.alias("a"), (begin + 1 + (F.col("l_suppkey") % 60).cast("int")).alias("b")
    )


def merged_key_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans joined where they overlap or touch, those beyond their key's length left out as the original tuning did."""
    return geometry.merged_spans(order_spans(spark, sf_dir), LONGEST)


_SPANS_SQL = f"""
s AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 + 1 AS INTEGER) AS page_number, 'h' || l_linenumber AS id, CASE l_returnflag {" ".join(f"WHEN '{f}' THEN '{k}'" for f, k in SPAN_KEYS.items())} END AS key,
      CAST(l_partkey % 90 AS INTEGER) AS a, CAST(l_partkey % 90 + 1 + l_suppkey % 60 AS INTEGER) AS b FROM lineitem)
"""
# two spans are joined if every place between the first's start and the second's end is covered: a start that no other span reaches begins a joined one
MERGED_SPANS_SQL = f"""
WITH {_SPANS_SQL},
f AS (SELECT * FROM s WHERE b - a <= CASE key {" ".join(f"WHEN '{k}' THEN {LONGEST.get(k, geometry.LONGEST_SPAN)}" for k in SPAN_KEYS.values())} END),
h AS (SELECT DISTINCT doc_id, page_number, key, a FROM f WHERE NOT EXISTS (SELECT 1 FROM f AS o WHERE o.doc_id = f.doc_id AND o.page_number = f.page_number AND o.key = f.key AND o.a < f.a AND o.b >= f.a)),
m AS (SELECT f.doc_id, f.page_number, f.key, f.id, f.b, (SELECT max(h.a) FROM h WHERE h.doc_id = f.doc_id AND h.page_number = f.page_number AND h.key = f.key AND h.a <= f.a) AS a FROM f)
SELECT doc_id, page_number, key, a, max(b) AS b, min(id) AS id FROM m GROUP BY doc_id, page_number, key, a
"""


def order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes; lines of a key and page share their hit."""
    spans = order_spans(spark, sf_dir)
    return spans.select("doc_id", "page_number", F.concat("key", F.lit("-"), "page_number").alias("id"), "key", *[F.col(c).cast("double").alias(n) for c, n in (("a", "x"), ("b", "y"))], (F.col("b") - F.col("a")).cast("double").alias("w"), F.lit(9.0).alias("h"))


def collapsed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for each hit of the Chinese pack's collapsing keys, others as they are."""
    return geometry.collapsed(order_boxes(spark, sf_dir), list(language_tuning("zh").collapse))


COLLAPSED_SQL = f"""
WITH {_SPANS_SQL}, o AS (SELECT doc_id, page_number, key || '-' || page_number AS id, key, CAST(a AS DOUBLE) AS x, CAST(b AS DOUBLE) AS y, CAST(b - a AS DOUBLE) AS w, 9.0::DOUBLE AS h FROM s)
SELECT doc_id, page_number, id, key, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM o WHERE key = 'money' GROUP BY doc_id, page_number, id, key
UNION ALL SELECT * FROM o WHERE key <> 'money'
"""


def manual_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that a user drags in any direction over the pages of orders; those under six pixels are clicks."""
    lines = table(spark, sf_dir, "lineitem")
    drags = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("l_partkey") % 500).alias("x"), (F.col("l_linenumber") * 50).alias("y"), (F.col("l_suppkey") % 41 - 20).alias("w"), (F.col("l_quantity").cast("int") - 25).alias("h"))
    none = geometry.numbered(order_boxes(spark, sf_dir)).where("false").drop("rect_id")
    return geometry.with_manual(none, drags)


MANUAL_SQL = """
WITH d AS (SELECT l_orderkey AS doc_id, 1 AS page_number, l_partkey % 500 AS x, l_linenumber * 50 AS y, l_suppkey % 41 - 20 AS w, CAST(l_quantity AS INTEGER) - 25 AS h FROM lineitem),
u AS (SELECT doc_id, page_number, CAST(least(x, x + w) AS DOUBLE) AS x, CAST(least(y, y + h) AS DOUBLE) AS y, CAST(abs(w) AS DOUBLE) AS w, CAST(abs(h) AS DOUBLE) AS h FROM d WHERE abs(w) >= 6 AND abs(h) >= 6)
SELECT doc_id, page_number, 'manual_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y, x, w, h) AS VARCHAR), 6, '0') AS id, 'manual_rect' AS key, x, y, w, h FROM u
"""



def label_values(lang: str) -> list[tuple[str, str]]:
    """Each key of a language with each of its labels, and two keys whose values keep what they begin with."""
    return [(key, word) for key, words in LABELS[lang].items() for word in words] + [("manual_term", "Name"), ("unnamed", "Name")]


#: What stands between a label and its value.
BETWEEN = (": ", "：", " ", "")


def label_starts(lang: str) -> Callable[[SparkSession, str], DataFrame]:
    """Customers' names behind each of a language's labels, less the label: ``doc_id, key, skip, value``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        listed, n, sep = label_values(lang), len(label_values(lang)), F.array(*[F.lit(x) for x in BETWEEN])
        pick = lambda k: F.get(F.array(*[F.lit(x[k]) for x in listed]), (F.col("c_custkey") % n).cast("int"))
        rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), pick(0).alias("key"), F.concat(pick(1), F.get(sep, (F.floor(F.col("c_custkey") / n) % len(BETWEEN)).cast("int")), F.lit("#"), "c_name", F.lit(");")).alias("sub"))
        return rows.select("doc_id", "key", geometry.value_in(F.col("sub"), labelled_tuning(lang)).alias("v")).select("doc_id", "key", "v.skip", "v.value")

    return query


def label_starts_sql(lang: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = label_values(lang)
    rows = ", ".join(f"({n}, {quote(k)}, {quote(w)})" for n, (k, w) in enumerate(listed))
    each = " ".join(f"WHEN {quote(k)} THEN regexp_replace(sub, {quote('(?i)^(?:' + '|'.join(re.sub('([^0-9A-Za-z ])', lambda m: chr(92) + m[1] if m[1].isascii() else m[1], w) for w in words) + r')\s*[:：]?\s*')}, '')" for k, words in LABELS[lang].items())
    ends = "[" + "".join("\\" + c if c in "[]" else c for c in geometry.WEAK).replace("'", "''") + "]+"
    return f"""
WITH l(n, key, word) AS (VALUES {rows}), b(k, sep) AS (VALUES {", ".join(f"({k}, {quote(x)})" for k, x in enumerate(BETWEEN))}),
s AS (SELECT c_custkey AS doc_id, key, word || sep || '#' || c_name || ');' AS sub FROM customer JOIN l ON n = c_custkey % {len(listed)} JOIN b ON k = c_custkey // {len(listed)} % {len(BETWEEN)}),
r AS (SELECT doc_id, key, sub, CASE WHEN key = 'manual_term' THEN sub ELSE regexp_replace(CASE key {each} ELSE sub END, '^{ends}', '') END AS rest FROM s)
SELECT doc_id, key, CAST(length(sub) - length(rest) AS INTEGER) AS skip, CASE WHEN key = 'manual_term' THEN rest ELSE regexp_replace(rest, '{ends}$', '') END AS value FROM r
"""


#: The term's hits are whole words, each within one item, so no two boxes of a hit are joined.
HIT_RECTS_SQL = f"""
WITH b AS (SELECT item_id AS doc_id, regexp_split_to_array(coalesce(text, ''), ' +') AS words FROM benchmark),
i AS (SELECT doc_id, words, unnest(range(len(words))) AS idx FROM b),
k AS (SELECT doc_id, idx, length(words[idx + 1]) AS n, idx % 10 * 50.0::DOUBLE AS x0, 800.0::DOUBLE - idx // 10 * 14 AS y0, string_split(regexp_replace(words[idx + 1], '(?i)\\b(the)\\b', chr(57600) || '\\1' || chr(57600), 'g'), chr(57600)) AS parts FROM i WHERE trim(words[idx + 1]) <> ''),
u AS (SELECT *, unnest(range(1, len(parts), 2)) AS j FROM k),
c AS (SELECT *, CAST(list_sum(list_transform(parts[1:j], lambda t: length(t))) AS INTEGER) AS lo FROM u),
d AS (SELECT *, n <= {geometry.WHOLE_ITEM_LENGTH} OR CAST(3 AS DOUBLE) / n >= {geometry.WHOLE_ITEM_SHARE} AS whole, n * 5.0::DOUBLE AS w0, 'hit_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx, lo) AS VARCHAR), 6, '0') AS id FROM c),
e AS (SELECT *, CASE WHEN whole THEN x0 ELSE x0 + w0 * lo / n END AS x1, CASE WHEN whole THEN x0 + w0 ELSE x0 + w0 * (lo + 3) / n END AS x2 FROM d),
r AS (SELECT doc_id, 1 AS page_number, id, 'manual_term' AS key, x1 - 1 AS x, y0 - 1 AS y, (x1 - 1 + (x2 - x1 + 2)) - (x1 - 1) AS w, (y0 - 1 + 12) - (y0 - 1) AS h FROM e)
SELECT *, 'rect_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y, x, id) AS VARCHAR), 6, '0') AS rect_id FROM r
"""


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blank-joined strings of set pages."""
    return word_items(spark, sf_dir).select("doc_id", pages.joined_text(F.col("items")).alias("text"))


ITEM_TEXTS_SQL = "SELECT item_id AS doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), ' +'), lambda x: x <> ''), ' ') AS text FROM benchmark"


def risk_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and advice for levels of customers, in languages of which one has none of its own."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("low", "mid", "high")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "zh", "fr")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), scrub.risk_words(level, lang).alias("t")).select("doc_id", "t.word", "t.advice")


def risk_advice_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({a}, {b}, {quote(word)}, {quote(advice)})" for a, lang in enumerate(("en", "de", "zh", "en")) for b, (word, advice) in enumerate(scrub.RISK_WORDS[lang].values()))
    return f"WITH w(a, b, word, advice) AS (VALUES {rows}) SELECT c_custkey AS doc_id, word, advice FROM customer JOIN w ON a = c_custkey % 4 AND b = c_custkey % 3"


def phone_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether digits of 7 to 18 places after a label count as a phone number, by language; the empty one has no guard of its own."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr("repeat('7', cast(7 + c_custkey % 12 AS int))").alias("value"), F.element_at(F.array(*[F.lit(x) for x in PHONE_LABELS]), (F.col("c_custkey") % len(PHONE_LABELS) + 1).cast("int")).alias("label"))
    return rows.select("doc_id", *[F.expr(spans.phone_guard(lang, "label", "value")).alias(f"in_{lang or 'other'}") for lang in ("en", "de", "zh", "")])


#: Labels before numbers, and the languages in which they say that the number is none of a phone.
PHONE_LABELS = {"phone: ": (), "order no ": ("en",), "Kundennummer ": ("de",), "订单 ": ("zh",), "case ": ()}


def phone_verdicts_sql() -> str:
    not_in = lambda lang: " OR ".join(f"c_custkey % {len(PHONE_LABELS)} = {n}" for n, langs in enumerate(PHONE_LABELS.values()) if lang in langs) or "false"
    return "SELECT c_custkey AS doc_id, " + ", ".join(f"NOT (7 + c_custkey % 12 >= {most} OR {not_in(lang)}) AS in_{lang}" for lang, most in (("en", 14), ("de", 16), ("zh", 16), ("other", 16))) + " FROM customer"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"label_starts_{lang}": label_starts(lang) for lang in LABELS},
    **{f"key_rects_{lang}": key_rects(lang) for lang in ("en", "de", "zh")},
    "rect_audit": rect_audit,
    "merged_key_spans": merged_key_spans,
    "collapsed_boxes": collapsed_boxes,
    "manual_boxes": manual_boxes,
    "item_texts": item_texts,
    "risk_advice": risk_advice,
    "phone_verdicts": phone_verdicts,
}
ORACLES: dict[str, str] = {
    **{f"label_starts_{lang}": label_starts_sql(lang) for lang in LABELS},
    **{f"key_rects_{lang}": key_rects_sql(lang) for lang in ("en", "de", "zh")},
    "rect_audit": RECT_AUDIT_SQL,
    "merged_key_spans": MERGED_SPANS_SQL,
    "collapsed_boxes": COLLAPSED_SQL,
    "manual_boxes": MANUAL_SQL,
    "hit_rects": HIT_RECTS_SQL,
    "item_texts": ITEM_TEXTS_SQL,
    "risk_advice": risk_advice_sql(),
    "phone_verdicts": phone_verdicts_sql(),
}
