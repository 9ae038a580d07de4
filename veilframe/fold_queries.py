"""Queries of merged and drawn boxes and of interval joins over the driver's tables, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import geometry, manual, merging, preferred
from .plans.tuning import LONGEST, language_tuning
from .queries import table

#: Keys of the boxes by return flag; the Chinese pack joins ``company`` only where boxes nearly touch.
BOX_KEYS = {"A": "company", "N": "money", "R": "unnamed"}


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes of two pages of their order that nest, touch, chain, drift downwards and differ in height; every fifth has no hit."""
    line = table(spark, sf_dir, "lineitem")
    key = F.element_at(F.create_map(*[F.lit(x) for kv in BOX_KEYS.items() for x in kv]), F.col("l_returnflag"))
    hit = F.when(F.col("l_partkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("h"), F.col("l_suppkey") % 2))
    whole = lambda c: F.col(c).cast("double")
    return line.select(
        (F.col("l_orderkey") / 4).cast("long").alias("doc_id"), (F.col("l_orderkey") % 2 + 1).cast("int").alias("page_number"), hit.alias("id"), key.alias("key"),
        (whole("l_partkey") % 60).alias("x"), (whole("l_linenumber") % 4 * (whole("l_linenumber") % 4 + 1) / 2).alias("y"), (whole("l_suppkey") % 23 + 4).alias("w"), (whole("l_quantity") % 3 + 9).alias("h"),
    )


def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each page merged by the Chinese pack as a running union, until nothing joins."""
    return geometry.merged_rects(page_boxes(spark, sf_dir), tuning=language_tuning("zh"))


def export_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each page as an export draws them, anchored at the first of each."""
    return geometry.export_merged(page_boxes(spark, sf_dir))


_BOXES_SQL = f"""
b AS (SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS doc_id, CAST(l_orderkey % 2 + 1 AS INTEGER) AS page_number, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'h' || l_suppkey % 2 END AS id, CASE l_returnflag {" ".join(f"WHEN '{f}' THEN '{k}'" for f, k in BOX_KEYS.items())} END AS key,
      CAST(l_partkey % 60 AS DOUBLE) AS x, CAST(l_linenumber % 4 * (l_linenumber % 4 + 1) / 2 AS DOUBLE) AS y, CAST(l_suppkey % 23 + 4 AS DOUBLE) AS w, CAST(CAST(l_quantity AS BIGINT) % 3 + 9 AS DOUBLE) AS h FROM lineitem)
"""


def _union(a: str, b: str) -> str:
    return f"{{'y': least({a}.y, {b}.y), 'x': least({a}.x, {b}.x), 'id': CASE WHEN {a}.id <> '' THEN {a}.id ELSE {b}.id END, 'key': {a}.key, 'w': greatest({a}.x + {a}.w, {b}.x + {b}.w) - least({a}.x, {b}.x), 'h': greatest({a}.y + {a}.h, {b}.y + {b}.h) - least({a}.y, {b}.y)}}"


def _fold(boxes: str, together: str, joined: str) -> str:
    """A list of boxes folded from the left, as list functions; ``together`` and ``joined`` speak of the last box as ``a[-1]`` and the next as ``t[1]``."""
    return f"list_reduce(list_transform({boxes}, lambda e: [e]), lambda a, t: CASE WHEN {together} THEN list_append(a[:-2], {joined}) ELSE list_append(a, t[1]) END)"


def _joins(a: str, b: str) -> str:
    low = f"least({a}.h, {b}.h)"
    shared = f"greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) / greatest(1.0, {low}) > {merging.SAME_LINE}"
    gap = f"{b}.x - ({a}.x + {a}.w)"
    strict = ", ".join(f"'{k}'" for k in language_tuning("zh").strict)
    near = f"CASE WHEN {a}.key IN ({strict}) THEN {gap} BETWEEN {merging.STRICT_INTO} AND greatest({merging.STRICT_GAP}, {low} * {merging.STRICT_SHARE}) ELSE {gap} BETWEEN {merging.NEAR_INTO} AND greatest({merging.NEAR_GAP}, {low} * {merging.NEAR_SHARE}) END"
    return f"{a}.key = {b}.key AND ({a}.id = '' OR {b}.id = '' OR {a}.id = {b}.id) AND {shared} AND {low} / greatest({a}.h, {b}.h) > {merging.SIMILAR_HEIGHT} AND {near}"


_ONE_PASS = _fold("boxes", _joins("a[-1]", "t[1]"), _union("a[-1]", "t[1]"))
MERGED_BOXES_SQL = f"""
WITH RECURSIVE {_BOXES_SQL},
r AS (SELECT doc_id, page_number, list({{'y': y, 'x': x, 'id': id, 'key': key, 'w': w, 'h': h}} ORDER BY y, x, id, key, w, h) AS boxes, CAST(0 AS BIGINT) AS before FROM b GROUP BY doc_id, page_number
      UNION ALL SELECT doc_id, page_number, {_ONE_PASS}, len(boxes) FROM r WHERE len(boxes) <> before),
o AS (SELECT doc_id, page_number, unnest(boxes) AS e FROM r WHERE len(boxes) = before)
SELECT doc_id, page_number, e.id AS id, e.key AS key, e.x AS x, e.y AS y, e.w AS w, e.h AS h FROM o
"""


def drawn_sql(boxes: str) -> str:
    """SQL of boxes to draw: lines by their first top, then a fold along each line, over the common table ``boxes`` (``doc_id, page_number, x, y, w, h``)."""
    lines = "list_reduce(list_transform(boxes, lambda e: [e]), lambda a, t: list_append(a, CASE WHEN t[1].y - a[-1].line < {0} THEN struct_update(t[1], line := a[-1].line) ELSE t[1] END))".format(merging.EXPORT_OFFSET)
    near = f"abs(a[-1].y - t[1].y) < {merging.EXPORT_OFFSET} AND abs(a[-1].h - t[1].h) < {merging.EXPORT_HEIGHT} AND t[1].x <= a[-1].x + a[-1].w + {merging.EXPORT_GAP}"
    wider = "struct_update(a[-1], x := least(a[-1].x, t[1].x), w := greatest(a[-1].x + a[-1].w, t[1].x + t[1].w) - least(a[-1].x, t[1].x))"
    return f"""
l AS (SELECT doc_id, page_number, list({{'line': y, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY y, x, w, h) AS boxes FROM {boxes} GROUP BY doc_id, page_number),
s AS (SELECT doc_id, page_number, list_sort({lines}) AS boxes FROM l),
g AS (SELECT doc_id, page_number, unnest({_fold("boxes", near, wider)}) AS e FROM s),
drawn AS (SELECT doc_id, page_number, e.x AS x, e.y AS y, e.w AS w, e.h AS h FROM g)
"""


EXPORT_BOXES_SQL = f"WITH {_BOXES_SQL}, {drawn_sql('b')} SELECT * FROM drawn"


def crowded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as hits of four long texts, orders as their pages: how many hits each page has, and how many of its places they cover."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    begin = F.col("l_orderkey") * 10 + F.col("l_partkey") % 40
    hits = line.select((F.col("l_suppkey") % 4).alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("k").alias("key"), begin.alias("start"), (begin + F.col("l_quantity").cast("long")).alias("end"))
    pages = order.select(F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("doc_id"), F.col("o_orderkey").alias("page_number"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 40 + F.col("o_custkey") % 90).alias("end"))
    return geometry.localized(hits, pages).groupBy("doc_id", "page_number").agg(F.count("*").alias("hits"), F.sum(F.col("b") - F.col("a")).alias("covered"), F.min("a").alias("first"))


CROWDED_PAGES_SQL = """
WITH h AS (SELECT l_suppkey % 4 AS doc_id, l_orderkey * 10 + l_partkey % 40 AS s, l_orderkey * 10 + l_partkey % 40 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
p AS (SELECT unnest([0, 1, 2, 3]::BIGINT[]) AS doc_id, o_orderkey AS page_number, o_orderkey * 10 AS s, o_orderkey * 10 + 40 + o_custkey % 90 AS e FROM orders)
SELECT p.doc_id, page_number, count(*) AS hits, CAST(sum(least(h.e, p.e) - greatest(h.s, p.s)) AS BIGINT) AS covered, CAST(min(greatest(h.s, p.s) - p.s) AS BIGINT) AS first
FROM p JOIN h ON h.doc_id = p.doc_id AND h.s < p.e AND h.e > p.s GROUP BY p.doc_id, page_number
"""

#: Patterns of two keys over set words: the second group of the first and the first group of the second hold the preferred part.
PART_PATTERNS = {"account": r"([a-z]+) ([a-z]{3,6})", "person_name": r"([A-Z][a-z]{2,}) [a-z]+"}
#: Words to a line of a set page.
LINE = 10


def _word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark texts as items of one page each; every tenth ends a line."""
    words = F.split(F.coalesce("text", F.lit("")), " +")
    items = F.transform(words, lambda w, i: F.struct(w.alias("str"), (i % LINE == LINE - 1).alias("hasEOL")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(1).alias("page_number"), preferred.run_text(items)["text"].alias("text"))


def preferred_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged spans of two keys with the parts that they prefer."""
    return preferred.preferred_spans(_word_runs(spark, sf_dir), PART_PATTERNS)


def _matches_sql(key: str, ord: int, pattern: str, group: int) -> str:
    return f"""SELECT doc_id, '{key}' AS key, {ord} AS ord, CAST(coalesce(list_sum(list_transform(range(1, i, 3), lambda j: length(parts[j]) + length(parts[j + 1]))), 0) AS INTEGER) + length(parts[i]) AS a, parts[i + 1] AS value, parts[i + 2] AS part
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) - 2, 3)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '{pattern}', chr(57600) || '\\0' || chr(57600) || '\\{group}' || chr(57600), 'g'), chr(57600)) AS parts FROM t))"""


_LAST, _NEXT = "acc[-1]", "nxt[1]"
_JOINED = f"struct_update({_LAST}, b := greatest({_LAST}.b, {_NEXT}.b), p := CASE WHEN {_LAST}.p IS NULL THEN {_NEXT}.p WHEN {_NEXT}.p IS NULL OR {_LAST}.p = {_NEXT}.p THEN {_LAST}.p END)"
PREFERRED_SQL = f"""
WITH w AS (SELECT item_id, regexp_split_to_array(coalesce(text, ''), ' +') AS words FROM benchmark),
e AS (SELECT item_id AS doc_id, unnest(range(len(words))) AS i, unnest(words) AS s FROM w),
n AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM e WHERE s <> ''),
t AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(coalesce(before, ''), '[A-Za-z0-9]$') AND regexp_matches(s, '^[A-Za-z0-9]') AND i % {LINE} NOT IN (0, {LINE - 1}) THEN ' ' ELSE '' END || s || CASE WHEN i % {LINE} = {LINE - 1} THEN chr(1) ELSE '' END, '' ORDER BY i) AS text FROM n GROUP BY doc_id),
m AS ({" UNION ALL ".join(_matches_sql(k, o, p, g) for o, ((k, p), g) in enumerate(zip(PART_PATTERNS.items(), (2, 1), strict=True)))}),
s AS (SELECT doc_id, key, ord, a, a + length(value) AS b, strpos(value, part) - 1 AS pa, strpos(value, part) - 1 + length(part) AS pb FROM m WHERE length(value) <= CASE key {" ".join(f"WHEN '{k}' THEN {LONGEST[k]}" for k in PART_PATTERNS)} END),
l AS (SELECT doc_id, list({{'key': key, 'a': a, 'b': b, 'p': {{'pa': pa, 'pb': pb}}}} ORDER BY a, b, ord, pa, pb) AS spans FROM s GROUP BY doc_id),
f AS (SELECT doc_id, unnest(list_reduce(list_transform(spans, lambda e: [e]), lambda acc, nxt: CASE WHEN {_LAST}.key = {_NEXT}.key AND {_NEXT}.a <= {_LAST}.b THEN list_append(acc[:-2], {_JOINED}) ELSE list_append(acc, {_NEXT}) END)) AS r FROM l)
SELECT doc_id, 1 AS page_number, r.key AS key, CAST(r.a AS INTEGER) AS a, CAST(r.b AS INTEGER) AS b, CAST(r.p.pa AS INTEGER) AS part_a, CAST(r.p.pb AS INTEGER) AS part_b FROM f
"""

#: What a user does on the page of an order, by the line's number.
ACTIONS = {1: "drag", 2: "drag", 3: "tap", 4: "drag", 5: "undo", 6: "clear", 7: "drag"}


def edited_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a user's actions on pages of four orders each; an order of many parts at its first line clears all that came before it."""
    line = table(spark, sf_dir, "lineitem")
    act = F.element_at(F.create_map(*[x for n, a in ACTIONS.items() for x in (F.lit(n), F.lit(a))]), F.col("l_linenumber").cast("int"))
    return manual.edited(line.select(
        F.floor(F.col("l_orderkey") / 16).alias("doc_id"), (F.floor(F.col("l_orderkey") / 4) % 4).cast("int").alias("page_number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 48), "clear_all").otherwise(act).alias("action"), (F.col("l_partkey") % 30 + 0.25).alias("x"), (F.col("l_suppkey") % 30 + 0.5).alias("y"),
        (F.col("l_quantity").cast("int") - 25).cast("double").alias("w"), (F.col("l_partkey") % 45 - 20).cast("double").alias("h"),
    ))


_HELD = "list_filter(range(1, len(acc) + 1), lambda k: acc[k].x <= nxt[1].x AND nxt[1].x <= acc[k].x + acc[k].w AND acc[k].y <= nxt[1].y AND nxt[1].y <= acc[k].y + acc[k].h)"
EDITED_BOXES_SQL = f"""
WITH a AS (SELECT CAST(floor(l_orderkey / 16) AS BIGINT) AS doc_id, CAST(floor(l_orderkey / 4) % 4 AS INTEGER) AS page_number, l_orderkey * 10 + l_linenumber AS seq,
     CASE WHEN l_linenumber = 1 AND l_quantity > 48 THEN 'clear_all' ELSE CASE l_linenumber {" ".join(f"WHEN {n} THEN '{x}'" for n, x in ACTIONS.items())} END END AS action,
     l_partkey % 30 + 0.25::DOUBLE AS x, l_suppkey % 30 + 0.5::DOUBLE AS y, CAST(CAST(l_quantity AS INTEGER) - 25 AS DOUBLE) AS w, CAST(l_partkey % 45 - 20 AS DOUBLE) AS h FROM lineitem),
l AS (SELECT *, max(seq) FILTER (WHERE action = 'clear_all') OVER (PARTITION BY doc_id) AS gone, max(seq) FILTER (WHERE action = 'clear') OVER (PARTITION BY doc_id, page_number) AS wiped FROM a),
k AS (SELECT doc_id, page_number, seq, action, CASE WHEN action = 'drag' THEN floor(least(x, x + w) + 0.5) ELSE x END AS x, CASE WHEN action = 'drag' THEN floor(least(y, y + h) + 0.5) ELSE y END AS y, floor(abs(w) + 0.5) AS w, floor(abs(h) + 0.5) AS h
      FROM l WHERE (gone IS NULL OR seq > gone) AND (wiped IS NULL OR seq > wiped) AND (action <> 'drag' OR (abs(w) >= 6 AND abs(h) >= 6))),
g AS (SELECT doc_id, page_number, list({{'action': action, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY seq, action, x, y, w, h) AS acts FROM k GROUP BY doc_id, page_number),
f AS (SELECT doc_id, page_number, list_reduce(list_prepend([], list_transform(acts, lambda e: [e])), lambda acc, nxt: CASE nxt[1].action WHEN 'drag' THEN list_append(acc, nxt[1]) WHEN 'undo' THEN acc[:-2]
      WHEN 'tap' THEN CASE WHEN len({_HELD}) > 0 THEN list_concat(acc[:list_max({_HELD}) - 1], acc[list_max({_HELD}) + 1:]) ELSE acc END ELSE acc END) AS boxes FROM g),
u AS (SELECT doc_id, page_number, unnest(range(1, len(boxes) + 1)) AS n, unnest(boxes) AS b FROM f)
SELECT doc_id, page_number, CAST(n AS INTEGER) AS n, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM u
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"merged_boxes": merged_boxes, "export_boxes": export_boxes, "crowded_pages": crowded_pages, "preferred_spans": preferred_spans, "edited_boxes": edited_boxes}
ORACLES: dict[str, str] = {"merged_boxes": MERGED_BOXES_SQL, "export_boxes": EXPORT_BOXES_SQL, "crowded_pages": CROWDED_PAGES_SQL, "preferred_spans": PREFERRED_SQL, "edited_boxes": EDITED_BOXES_SQL}
