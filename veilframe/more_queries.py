"""Queries of conflict resolution, risk, pages of hits, raster boxes and the sequential mode over the driver's tables, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cascade, geometry, pages, rect_results, scrub, spans
from .plans import config as C
from .plans.config import ScrubConfig, term_rules
from .plans.tuning import COVER, ITEM_CAP, ITEM_FONT, PAD, RECT_FONT, SHORT_TOKEN, WIDTHS, tuned
from .fold_queries import drawn_sql
from .queries import _PAGES, MASKED, paged_conversations, table, texts

#: A page of 612 by 840 units at one and a half times its size, with the origin at its foot; font size and width of a character of set words.
PAGE, SCALE, FONT, CHAR = (918.0, 1260.0), 1.5, 10.0, 0.5


def interval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as overlapping hits of one text for each order, of which conflict resolution keeps some: ``doc_id, start, end, ord``."""
    begin = (F.col("l_partkey") % 40).cast("int")
    line = F.struct(F.lit("k").alias("key"), F.when(F.col("l_returnflag") == "A", "manual").otherwise("rule").alias("source"), (F.col("l_suppkey") % 5).cast("int").alias("ord"), begin.alias("start"), (begin + 1 + F.col("l_quantity").cast("int") % 12).alias("end"), *[F.lit("").alias(c) for c in ("text", "placeholder", "mode", "tag", "term", "full")])
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(line).alias("hits"))
    kept = grouped.select("doc_id", F.explode_outer(spans.resolve(F.col("hits"))).alias("h")).where("h IS NOT NULL")
    return kept.select("doc_id", F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.ord").alias("ord"))


INTERVAL_HITS_SQL = """
WITH RECURSIVE h AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 40 AS INTEGER) AS s, CAST(l_partkey % 40 + 1 + CAST(l_quantity AS INTEGER) % 12 AS INTEGER) AS e, CAST(l_suppkey % 5 AS INTEGER) AS o, l_returnflag <> 'A' AS late FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY late, o, e - s, s, e) AS k FROM h),
r AS (SELECT doc_id, k, s, e, o, true AS taken, [{'s': s, 'e': e}] AS kept FROM n WHERE k = 1
      UNION ALL
      SELECT n.doc_id, n.k, n.s, n.e, n.o, len(list_filter(r.kept, lambda x: x.s < n.e AND n.s < x.e)) = 0,
             CASE WHEN len(list_filter(r.kept, lambda x: x.s < n.e AND n.s < x.e)) = 0 THEN list_append(r.kept, {'s': n.s, 'e': n.e}) ELSE r.kept END FROM r JOIN n ON n.doc_id = r.doc_id AND n.k = r.k + 1)
SELECT doc_id, s AS start, e AS "end", o AS ord FROM r WHERE taken
"""

#: Keys that stand for the lines of an order, by return flag, and for the order itself.
RISK_KEYS = {"A": "secret", "N": "email", "R": "account"}


def order_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of orders whose lines count as hits: ``doc_id, score, level, top`` (keys of the three heaviest sources)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(*[F.count(F.when(F.col("l_returnflag") == f, 1)).cast("int").alias(k) for f, k in RISK_KEYS.items()], F.sum("l_quantity").alias("q"))
    counts = F.map_filter(F.create_map(*[x for k in sorted(RISK_KEYS.values()) for x in (F.lit(k), F.col(k))]), lambda k, n: n > 0)
    report = lines.select("doc_id", scrub.risk(counts, F.col("q") * 20, F.col("doc_id") % 2 == 0).alias("r"))
    return report.select("doc_id", "r.score", "r.level", F.concat_ws(",", F.transform("r.top", lambda t: F.concat_ws(":", t["k"], t["c"], t["s"]))).alias("top"))


def order_risk_sql() -> str:
    group = {k: next(g for g, keys in C.RISK_GROUPS.items() if k in keys) for k in RISK_KEYS.values()}
    parts = " + ".join(f"{C.GROUP_WEIGHT[g]} * (1 - exp(-{C.GROUP_K[g]} * least({k}, {C.CAP_PER_KEY})))" for k, g in group.items())
    bonus = f"CASE WHEN q * 20 >= 1500 THEN {C.BONUS['len1500']} ELSE 0 END + CASE WHEN q * 20 >= 4000 THEN {C.BONUS['len4000']} ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN {C.BONUS['from_pdf']} ELSE 0 END"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE l_returnflag = '{f}') AS INTEGER) AS {k}" for f, k in RISK_KEYS.items())
    each = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS k, {k} AS c, {k} * {C.RISK_WEIGHTS[k]} AS s FROM t WHERE {k} > 0" for k in RISK_KEYS.values())
    return f"""
WITH t AS (SELECT l_orderkey AS doc_id, {counts}, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
s AS (SELECT doc_id, CAST(least(greatest(floor(100 * ({parts}) + 0.5) + {bonus}, 0), 100) AS INTEGER) AS score FROM t),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, k) AS n FROM ({each})),
p AS (SELECT doc_id, string_agg(k || ':' || c || ':' || s, ',' ORDER BY n) AS top FROM w WHERE n <= 3 GROUP BY doc_id)
SELECT s.doc_id, score, CASE WHEN score >= {C.THRESHOLDS["high"]} THEN 'high' WHEN score >= {C.THRESHOLDS["mid"]} THEN 'mid' ELSE 'low' END AS level, top FROM s JOIN p ON p.doc_id = s.doc_id
"""


def hit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which pages of conversations a term's hits lie: ``doc_id, page_number, n``."""
    paged = paged_conversations(spark, sf_dir)
    rule = term_rules(ScrubConfig(lang="en", terms=("the",)))[0]
    docs = pages.document_text(paged).withColumn("_text", F.col("text"))
    found = docs.select("doc_id", "text", F.coalesce(F.expr(spans.rule_hits("_text", rule, "en")), F.array().cast(f"array<{spans.HIT}>")).alias("hits"))
    told = pages.with_pages(found, paged).select("doc_id", F.explode_outer("hits").alias("h")).where("h IS NOT NULL")
    return told.groupBy("doc_id", F.col("h.page").alias("page_number")).agg(F.count("*").alias("n"))


HIT_PAGES_SQL = f"""
WITH p AS ({_PAGES}), m AS (SELECT doc_id, page_number, len(regexp_extract_all(text, '(?i)\\bthe\\b')) AS n FROM p)
SELECT doc_id, page_number, CAST(n AS BIGINT) AS n FROM m WHERE n > 0
"""


def set_pages(spark: SparkSession, sf_dir: str, scale: float = SCALE) -> tuple[DataFrame, DataFrame]:
    """Benchmark texts as one page each, whose items are its words, ten to a line; and the pages' layout."""
    wide, high = PAGE[0] / SCALE * scale, PAGE[1] / SCALE * scale
    base = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(1).alias("page_number"), F.split(F.coalesce("text", F.lit("")), " +").alias("words"))
    item = lambda w, i: F.struct(w.alias("str"), F.array(F.lit(FONT), F.lit(0.0), F.lit(0.0), F.lit(FONT), (i % 10 * 50).cast("double"), (F.lit(800.0) - F.floor(i / 10) * 14)).alias("transform"), (F.length(w) * CHAR).alias("width"))
    layout = base.select("doc_id", "page_number", F.lit(wide).alias("viewport_width"), F.lit(high).alias("viewport_height"), F.array(*[F.lit(x) for x in (scale, 0.0, 0.0, -scale, 0.0, high)]).alias("viewport_transform"))
    return base.select("doc_id", "page_number", F.transform("words", item).alias("items")), layout


def set_words(spark: SparkSession, sf_dir: str, scale: float = SCALE) -> tuple[DataFrame, DataFrame]:
    """The items of :func:`set_pages` one by one, with their places in the text; and the pages' layout."""
    paged, layout = set_pages(spark, sf_dir, scale)
    each = paged.withColumn("p", geometry.item_ranges(F.col("items"))).select("doc_id", "page_number", "items", F.explode("p.ranges").alias("r")).select("doc_id", "page_number", "r.idx", "r.start", "r.end", F.expr("items[r.idx]").alias("it"))
    return each.select("doc_id", "page_number", "idx", "start", "end", "it.str", "it.transform", "it.width"), layout


def _thousandths(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.select(*keys, *[F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("x", "y", "w", "h")])


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, layout = set_words(spark, sf_dir)
    return _thousandths(geometry.item_boxes(geometry.on_device(items, layout)), "doc_id", "idx")


def term_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of a term's hits on the raster."""
    items, layout = set_words(spark, sf_dir)
    rule = term_rules(ScrubConfig(lang="en", terms=("the",)))[0]
    # hits are found item by item: a word is never part of two
    found = items.withColumn("_text", F.col("str")).select("doc_id", "page_number", "idx", "start", F.explode_outer(F.expr(spans.rule_hits("_text", rule, "en"))).alias("h")).where("h IS NOT NULL")
    hits = found.select("doc_id", "page_number", F.concat_ws("-", "idx", "h.start").alias("id"), "h.key", (F.col("start") + F.col("h.start")).alias("a"), (F.col("start") + F.col("h.end")).alias("b"))
    return _thousandths(geometry.device_rects(hits, geometry.on_device(items, layout), tuning=tuned("en")), "doc_id")


def match_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered boxes of a term's hits on set pages, from hits to rectangles in one call."""
    paged, layout = set_pages(spark, sf_dir)
    rule = term_rules(ScrubConfig(lang="en", terms=("the",)))[0]
    texts = paged.select("doc_id", geometry.item_ranges(F.col("items"))["text"].alias("_text"))
    hits = texts.select("doc_id", F.posexplode(F.expr(spans.rule_hits("_text", rule, "en"))).alias("i", "h")).select("doc_id", F.format_string("hit_%06d", F.col("i") + 1).alias("id"), "h.key", "h.start", "h.end")
    return _thousandths(rect_results.match_rects(hits, paged, layout, "en", tuned("en")), "doc_id", "page_number", "id", "key", "rect_id")


def drawn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of words, joined along their lines as an export draws them."""
    items, layout = set_words(spark, sf_dir)
    return _thousandths(geometry.export_merged(geometry.item_boxes(geometry.on_device(items, layout))), "doc_id")


_WORDS_SQL = f"""
b AS (SELECT item_id AS doc_id, regexp_split_to_array(coalesce(text, ''), ' +') AS words FROM benchmark),
i AS (SELECT doc_id, words, unnest(range(len(words))) AS idx FROM b),
k AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, words[idx + 1] AS s, greatest(length(words[idx + 1]), 1) AS n, {SCALE} * (idx % 10 * 50) AS lft, {PAGE[1]} - {SCALE} * (800.0 - floor(idx / 10) * 14) AS base, {SCALE * FONT} AS font,
      length(words[idx + 1]) * {CHAR} * {SCALE * FONT} AS wide FROM i WHERE trim(words[idx + 1]) <> ''),
f AS (SELECT *, greatest({ITEM_FONT[1]}, least({ITEM_FONT[2]}, font * {ITEM_FONT[0]})) AS fh FROM k),
e AS (SELECT *, greatest(8.0, n * fh * {ITEM_FONT[3]}) AS est, greatest(0.0, least({PAGE[0]}, lft)) AS x, greatest(0.0, least({PAGE[1]}, base - fh)) AS y FROM f),
boxes AS (SELECT doc_id, idx, x, y, greatest(1.0, least({PAGE[0]} - x, least(wide, est * CASE WHEN n <= 4 THEN {SHORT_TOKEN} ELSE {ITEM_CAP} END))) AS w, greatest({ITEM_FONT[1]}, least({PAGE[1]} - y, fh)) AS h FROM e)
"""
_ROUNDED = ", ".join(f"CAST(floor({c} * 1000 + 0.5) AS BIGINT) AS {c}" for c in "xywh")
WORD_BOXES_SQL = f"WITH {_WORDS_SQL} SELECT doc_id, idx, {_ROUNDED} FROM boxes"
DRAWN_BOXES_SQL = f"""
WITH {_WORDS_SQL},
one AS (SELECT *, 1 AS page_number FROM boxes),
{drawn_sql("one")}
SELECT doc_id, {_ROUNDED} FROM drawn
"""


def term_rects_sql(numbered: bool = False) -> str:
    page, most, hard, soft = WIDTHS["manual_term"]
    factor, least, top, char = RECT_FONT
    rows = f"SELECT doc_id, {_ROUNDED} FROM w"
    if numbered:
        rows = f""", num AS (SELECT *, 'hit_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx, lo) AS VARCHAR), 6, '0') AS id FROM w)
SELECT doc_id, 1 AS page_number, id, 'manual_term' AS key, 'rect_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y, x, id) AS VARCHAR), 6, '0') AS rect_id, {_ROUNDED} FROM num"""
    return f"""
WITH {_WORDS_SQL},
v AS (SELECT *, string_split(regexp_replace(s, '(?i)\\b(the)\\b', chr(57600) || '\\1' || chr(57600), 'g'), chr(57600)) AS parts FROM k),
u AS (SELECT *, unnest(range(1, len(parts), 2)) AS j FROM v),
c AS (SELECT *, CAST(list_sum(list_transform(parts[1:j], lambda t: length(t))) AS INTEGER) AS lo, greatest({least}, least({top}, font * {factor})) AS rf FROM u),
q AS (SELECT *, lo + 3 AS hi, greatest(10.0, n * rf * {char}) AS est FROM c),
z AS (SELECT *, CASE WHEN wide > est * {hard} THEN est * {soft} ELSE wide END AS fit FROM q),
o AS (SELECT *, greatest(0.0, least({PAGE[0]}, lft)) AS bx, greatest(greatest(1.0, least(least({PAGE[0]} * {page}, est * {most}), fit)), least(est * 0.80, {PAGE[0]} * 0.18)) + 6 AS bw0,
      greatest(0.0, least({PAGE[1]}, base - rf + greatest(2.0, least(4.0, rf * 0.16)))) AS y0 FROM z),
p AS (SELECT *, greatest(1.0, least({PAGE[0]} - bx, bw0)) AS bw, greatest(4.0, least({PAGE[1]} - y0, rf - greatest(2.0, least(4.0, rf * 0.14)))) AS bh, n <= {geometry.WHOLE_ITEM_LENGTH} OR hi - lo >= n * {COVER["en"]} AS whole FROM o),
r AS (SELECT *, CASE WHEN whole THEN bx ELSE bx + bw * lo / n END AS x1, CASE WHEN whole THEN bx + bw ELSE bx + bw * hi / n END AS x2, greatest({PAD[2]}, bw * {PAD[0]}) AS px, greatest({PAD[3]}, bh * {PAD[1]}) AS py FROM p),
t AS (SELECT *, greatest(0.0, least({PAGE[0]}, x1 - px)) AS x_, greatest(0.0, least({PAGE[1]}, y0 - py + 5)) AS y_ FROM r),
w AS (SELECT doc_id, idx, lo, x_ AS x, y_ AS y, greatest(1.0, least({PAGE[0]} - x_, x2 - x1 + 2 * px)) AS w, greatest(3.0, least({PAGE[1]} - y_, bh + 2 * py - 2)) AS h FROM t)
{rows}
"""


PAGE_TEXTS_SQL = r"""
WITH b AS (SELECT item_id AS doc_id, regexp_split_to_array(coalesce(text, ''), ' +') AS words FROM benchmark),
i AS (SELECT doc_id, words, unnest(range(len(words))) AS idx FROM b),
k AS (SELECT doc_id, idx, idx // 10 AS line, trim(regexp_replace(words[idx + 1], '\s+', ' ', 'g')) AS s FROM i),
l AS (SELECT *, lag(s) OVER (PARTITION BY doc_id, line ORDER BY idx) AS p FROM k WHERE s <> ''),
j AS (SELECT doc_id, line, string_agg(CASE WHEN p IS NULL OR regexp_matches(s, '^[)\]}.,;:/一-鿿]') OR regexp_matches(p, '[-(\[{/一-鿿]$') THEN '' ELSE ' ' END || s, '' ORDER BY idx) AS t FROM l GROUP BY doc_id, line),
a AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY line) AS text FROM j GROUP BY doc_id)
SELECT b.doc_id, coalesce(a.text, '') AS text FROM b LEFT JOIN a ON a.doc_id = b.doc_id
"""


def sequential_texts(lang: str) -> Callable[[SparkSession, str], DataFrame]:
    """Composed texts by the sequential mode."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cascade.scrub_sequential(texts(spark, sf_dir, lang), ScrubConfig(lang=lang)).select("doc_id", "text_masked")

    return query


def sequential_sql(lang: str) -> str:
    """The closed forms of the composed texts.  In this mode a later rule sees earlier placeholders: the address rule takes what follows ``IP address:`` once more."""
    lines = [x.replace("IP address: [Secret]", "IP address: [Address]") for x in MASKED[lang]]
    return "SELECT c_custkey AS doc_id, " + " || chr(10) || ".join(lines) + " AS text_masked FROM customer"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "interval_hits": interval_hits,
    "order_risk": order_risk,
    "hit_pages": hit_pages,
    "word_boxes": word_boxes,
    "term_rects": term_rects,
    "match_boxes": match_boxes,
    "drawn_boxes": drawn_boxes,
    **{f"sequential_{lang}": sequential_texts(lang) for lang in MASKED},
}
ORACLES: dict[str, str] = {
    "interval_hits": INTERVAL_HITS_SQL,
    "order_risk": order_risk_sql(),
    "hit_pages": HIT_PAGES_SQL,
    "word_boxes": WORD_BOXES_SQL,
    "term_rects": term_rects_sql(),
    "match_boxes": term_rects_sql(numbered=True),
    "drawn_boxes": DRAWN_BOXES_SQL,
    "page_texts": PAGE_TEXTS_SQL,
    **{f"sequential_{lang}": sequential_sql(lang) for lang in MASKED},
}
