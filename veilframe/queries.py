"""Queries over the driver's tables, and equivalent SQL.  Texts with labels are composed from relational columns by one expression that Spark and the oracle share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dialect import SPACES
from .operators import geometry, language, pages, scrub, spans
from .plans.config import GROUP_K, GROUP_WEIGHT, PACKS, ScrubConfig, plan_rules, term_rules

_K = "cast(c_custkey as string)"
_NL = "chr(10)"

#: Texts of customers, by language; plain SQL that both engines read.
TEXTS = {
    "en": f"""'Customer name: ' || c_name || {_NL} || 'SSN: ' || lpad({_K}, 9, '1') || {_NL} || 'Passport: P' || lpad({_K}, 7, '0') || {_NL} || 'IP address: 10.0.' || cast(c_custkey % 250 as string) || '.7' || {_NL}
        || 'Email: user' || {_K} || '@mail.example.com' || {_NL} || 'Password: s3cret' || {_K} || {_NL} || 'Amount: USD ' || cast(c_custkey % 900 + 100 as string) || '.50' || {_NL} || 'Tax ID: AB' || lpad({_K}, 6, '0') || {_NL}
        || 'Account number: ' || lpad({_K}, 12, '4') || {_NL} || 'Phone: +1 743 555 ' || lpad(cast(c_custkey % 10000 as string), 4, '0') || {_NL} || 'Company: ' || c_mktsegment || ' Trading LLC' || {_NL} || 'see https://shop.example.org/c/' || {_K}""",
    "de": f"""'Passwort: geheim' || {_K} || {_NL} || 'Steuer-ID: ' || lpad({_K}, 11, '7') || {_NL} || 'Geburtsdatum: 01.02.19' || lpad(cast(c_custkey % 100 as string), 2, '0') || {_NL} || 'IBAN: DE89 3704 0044 0532 ' || lpad(cast(c_custkey % 10000 as string), 4, '0') || ' 00' || {_NL}
        || 'E-Mail: kunde' || {_K} || '@post.example.de' || {_NL} || 'Telefon: 030 ' || lpad({_K}, 7, '2') || {_NL} || 'Betrag 1.234,' || lpad(cast(c_custkey % 100 as string), 2, '0') || ' EUR' || {_NL} || 'Firma: ' || c_mktsegment || ' GmbH' || {_NL} || 'BLZ: ' || lpad(cast(c_custkey % 1000 as string), 8, '5')""",
    "zh": f"""'密码：mima' || {_K} || {_NL} || '手机：138' || lpad({_K}, 8, '0') || {_NL} || '邮箱：user' || {_K} || '@mail.example.cn' || {_NL} || '护照号：E' || lpad({_K}, 8, '0') || {_NL} || '开户行：' || lpad({_K}, 8, '6') || {_NL} || '合计：' || cast(c_custkey % 900 + 100 as string) || '.50' || {_NL} || '客户编号：CUST-' || lpad({_K}, 8, '0')""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table whose scan has fewer tasks than there are cores over the cores.  Larger tables stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).select(F.col("c_custkey").alias("doc_id"), F.expr(TEXTS[lang]).alias("text"))


def _plain(rule_flags: str, pattern: str) -> str | None:
    """The oracle's form of a pattern, or None where it needs look-around or anchors, which that engine lacks."""
    if re.search(r"\(\?[=!]|\(\?<[=!]|\\p|\\1|(?<!\[)\^|\$", pattern):
        return None
    out = re.sub(r"\(\?<(\w+)>", r"(?P<\1>", pattern)
    out = re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), out)
    spaces = re.sub(r"\\u([0-9A-F]{4})", lambda m: chr(int(m[1], 16)), SPACES)
    inside, done = False, []
    for token in re.findall(r"\\.|.", out, re.DOTALL):
        inside = token == "[" or (inside and token != "]")
        done.append((spaces if inside else f"[{spaces}]") if token == "\\s" else token)
    return ("(?i)" if "i" in rule_flags else "") + "".join(done)


def plain_rules(lang: str) -> dict[str, tuple[str, int]]:
    """Rules the oracle can run: key to pattern and the group that is the value."""
    out = {}
    for key, _, mode, flags, pattern in PACKS[lang].RULES:
        form = _plain(flags, pattern)
        if form and mode in ("prefix", "whole") and key in PACKS[lang].PRIORITY and key != "phone":
            out[key] = (form, 2 if mode == "prefix" else 0)
    return out


def rule_matches(lang: str) -> Callable[[SparkSession, str], DataFrame]:
    """Hits before conflicts of each rule whose pattern SQL can run, too: ``doc_id, key, n, first_value, last_value``.  (``rule_samples_*`` and the tests' plain model have all rules.)"""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = list(plain_rules(lang))
        config = ScrubConfig(lang=lang, enabled=frozenset(PACKS[lang].PRIORITY))
        hits = texts(spark, sf_dir, lang).withColumn("_text", spans.unmarked(F.col("text"))).select("doc_id", F.explode_outer(spans.raw_hits("_text", config)).alias("h"))
        return hits.where(F.col("h.key").isin(keys)).groupBy("doc_id", F.col("h.key").alias("key")).agg(F.count("*").alias("n"), F.min("h.text").alias("first_value"), F.max("h.text").alias("last_value"))

    return query


def rule_matches_sql(lang: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    base = f"SELECT c_custkey AS doc_id, {TEXTS[lang]} AS text FROM customer"
    each = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key, unnest(regexp_extract_all(text, {quote(p)}, {g})) AS v FROM t" for k, (p, g) in plain_rules(lang).items())
    return f"WITH t AS ({base}), m AS ({each}) SELECT doc_id, key, count(*) AS n, min(v) AS first_value, max(v) AS last_value FROM m WHERE v <> '' GROUP BY doc_id, key"


def scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents masked by their language's rules, with counts and risk."""
    done = scrub.scrub(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), ScrubConfig(lang="en"))
    return done.select("doc_id", "rule_lang", "hit_count", "masked_length", F.md5(F.col("text_masked").cast("binary")).alias("masked_md5"), F.col("risk.score").alias("score"), F.col("risk.level").alias("level"))


def scrub_texts(lang: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = scrub.match(texts(spark, sf_dir, lang), ScrubConfig(lang=lang))
        return done.select("doc_id", "hit_count", "masked_length", F.col("risk.score").alias("score"), F.col("risk.level").alias("level"), "text_masked")

    return query


def hits_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all documents by language and key."""
    done = scrub.scrub(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), ScrubConfig(lang="en"))
    return scrub.hit_rows(done, "doc_id", "rule_lang").groupBy("rule_lang", "key", "category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def email_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of e-mail addresses in documents, in code points."""
    rule = [r for r in plan_rules(ScrubConfig(lang="en")) if r.key == "email"][0]
    docs = table(spark, sf_dir, "documents").select("doc_id", spans.unmarked(F.col("text")).alias("_text"))
    hits = docs.select("doc_id", F.explode_outer(F.expr(spans.rule_hits("_text", rule, "en"))).alias("h")).where("h IS NOT NULL")
    return hits.select("doc_id", F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), F.col("h.text").alias("value"))


EMAIL_PLACES_SQL = r"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)(\b[A-Z0-9._%+-]+[ \t]*@[ \t]*[A-Z0-9.-]+[ \t]*\.[ \t]*[A-Z]{2,}\b)', chr(57600) || '\1' || chr(57600), 'g'), chr(57600)) AS parts FROM documents),
     q AS (SELECT doc_id, parts, unnest(range(1, len(parts), 2)) AS i FROM p)
SELECT doc_id, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS BIGINT) AS start, CAST(list_sum(list_transform(parts[1:i + 1], lambda x: length(x))) AS BIGINT) AS "end", parts[i + 1] AS value FROM q
"""

TERMS = ("the", "of", "und", "que")


def manual_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a user's terms masked, by the terms alone."""
    rules = term_rules(ScrubConfig(lang="en", terms=TERMS))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", spans.unmarked(F.col("text")).alias("_text"))
    done = docs.withColumn("hits", spans.hits_of("_text", rules, "en")).withColumn("s", spans.settled(F.col("hits"), F.col("_text")))
    return done.select("doc_id", F.size("s.kept").cast("long").alias("hit_count"), F.md5(F.col("s.masked").cast("binary")).alias("masked_md5"))


MANUAL_TERMS_SQL = f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\b({"|".join(TERMS)})\\b')) AS BIGINT) AS hit_count, md5(regexp_replace(text, '(?i)\\b({"|".join(TERMS)})\\b', '[REDACTED]', 'g')) AS masked_md5 FROM documents
"""


def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", language.stats(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("length", "han", "latin", "umlaut")])


LANGUAGE_STATS_SQL = """
SELECT doc_id, CAST(length(text) AS BIGINT) AS length, CAST(len(regexp_extract_all(text, '[一-鿿]')) AS BIGINT) AS han, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS BIGINT) AS latin,
       CAST(len(regexp_extract_all(text, '[äöüÄÖÜß]')) AS BIGINT) AS umlaut FROM documents
"""


def language_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = language.route(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return routed.select("doc_id", F.col("detection.lang").alias("detected"), F.col("detection.needs_confirm").alias("needs_confirm"), F.col("detection.reason").alias("reason"), "route", "content_lang")


def paged_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose turns are pages, with a running header and page numbers: ``doc_id, page_number, text``."""
    turns = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("Transcript "), F.col("conv_id"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\nPage "), F.col("turn") + 1, F.lit(" of 99"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), text.alias("text"))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.without_headers(paged_conversations(spark, sf_dir)).select("doc_id", "page_number", F.length("text").alias("kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def page_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.modes(paged_conversations(spark, sf_dir)).where("doc_id IS NOT NULL")


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.repeated_edge_lines(paged_conversations(spark, sf_dir))


EDGE_LINES_SQL = r"""
WITH p AS (SELECT conv_id AS doc_id, 'Transcript ' || conv_id || chr(10) || coalesce(text, '') || chr(10) || 'Page ' || (turn + 1) || ' of 99' AS text FROM conversations),
     l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM p),
     e AS (SELECT doc_id, unnest(list_concat(lines[1:5], lines[greatest(len(lines) - 4, 1):len(lines)])) AS line FROM l),
     many AS (SELECT doc_id FROM p GROUP BY doc_id HAVING count(*) >= 2)
SELECT doc_id, line FROM e WHERE doc_id IN (SELECT doc_id FROM many) GROUP BY doc_id, line HAVING count(*) >= 2
"""


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_offsets(paged_conversations(spark, sf_dir)).select("doc_id", "page_number", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


OFFSETS_SQL = r"""
WITH p AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_number, length('Transcript ' || conv_id || chr(10) || coalesce(text, '') || chr(10) || 'Page ' || (turn + 1) || ' of 99') AS n FROM conversations),
     s AS (SELECT doc_id, page_number, n, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p)
SELECT doc_id, page_number, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS "end" FROM s
"""


def word_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts set as words, ten to a line: one page each, with the items of its words."""
    words = F.split(F.coalesce("text", F.lit("")), " +")
    item = lambda w, i: F.struct(w.alias("str"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), (i % 10 * 50).cast("double"), (F.lit(800.0) - F.floor(i / 10) * 14)).alias("transform"), (F.length(w) * 5).cast("double").alias("width"), F.lit(10.0).alias("height"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(1).alias("page_number"), F.transform(words, item).alias("items"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_items(spark, sf_dir).select("doc_id", pages.pretty_text(F.col("items")).alias("text"))


def hit_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of a term's hits on set pages."""
    paged = word_items(spark, sf_dir).withColumn("p", geometry.item_ranges(F.col("items"))).select("doc_id", "page_number", "items", F.col("p.text").alias("text"), F.col("p.ranges").alias("ranges"))
    rules = term_rules(ScrubConfig(lang="en", terms=("the",)))
    hits = paged.withColumn("_text", F.col("text")).select("doc_id", F.posexplode(F.expr(spans.rule_hits("_text", rules[0], "en"))).alias("i", "h")).select("doc_id", F.format_string("hit_%06d", F.col("i") + 1).alias("id"), "h.key", "h.start", "h.end")
    items = paged.select("doc_id", "page_number", "items", F.explode("ranges").alias("r")).select("doc_id", "page_number", "r.idx", "r.start", "r.end", F.expr("items[r.idx]").alias("it"))
    items = items.select("doc_id", "page_number", "idx", "start", "end", F.col("it.transform")[4].alias("x"), F.col("it.transform")[5].alias("y"), F.col("it.width").alias("w"), F.col("it.height").alias("h"))
    local = geometry.localized(hits, pages.page_offsets(paged.select("doc_id", "page_number", "text")))
    return geometry.numbered(geometry.merged_rects(geometry.rects(local, items)))


def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and risk level."""
    return scrub_documents(spark, sf_dir).groupBy("rule_lang", "level").agg(F.count("*").alias("documents"), F.max("score").alias("top_score"))


def masked_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-call mask with a fixed token."""
    done = scrub.mask_text(texts(spark, sf_dir, "en"), ScrubConfig(lang="en"))
    return done.select("doc_id", "masked_text")


#: What is left of the composed texts, one line for each label: closed forms that the rules must reach.  Values: text of a line, placeholder or None, rest.
MASKED = {
    "en": ["'Customer name: [Name]' || substr(c_name, 9)", "'SSN: [Secret]'", "'Passport: [Secret]'", "'IP address: [Secret]'", "'Email: [Email]'", "'Password: [Secret]'", "'Amount: [Amount]'", "'Tax ID: [Secret]'", "'Account number: [Account]'", "'Phone: [Phone]'", "'Company: [Company]'", "'see [URL]'"],
    "de": ["'Passwort: [Geheim]'", "'Steuer-ID: [Geheim]'", "'Geburtsdatum: [Geheim]'", "'IBAN: [Konto]'", "'E-Mail: [E-Mail]'", "'Telefon: [Telefon]'", "'Betrag [Betrag]'", "'Firma: [Firma]'", "'BLZ: [Konto]'"],
    "zh": ["'密码：【敏感】'", "'手机：【电话】'", "'邮箱：【邮箱】'", "'护照号：【敏感】'", "'开户行：' || lpad(cast(c_custkey as string), 8, '6')", "'合计：【金额】'", "'客户编号：【编号】'"],
}
#: Hits of each risk group in a composed text: critical, financial, identity, contact, tracking.
GROUP_HITS = {"en": (1, 1, 3, 4, 1), "de": (1, 1, 1, 2, 0), "zh": (1, 0, 1, 2, 0)}


def scrub_texts_sql(lang: str) -> str:
    marks = "\\[[^\\]]*\\]|【[^】]*】"
    hits = sum(bool(re.search(marks, x)) for x in MASKED[lang])
    placeholders = sum(len(m[0]) for x in MASKED[lang] for m in re.finditer(marks, x))
    score = " + ".join(f"{w} * (1 - exp(-{k} * {n}))" for w, k, n in zip(GROUP_WEIGHT.values(), GROUP_K.values(), GROUP_HITS[lang], strict=True))
    masked = f" || {_NL} || ".join(MASKED[lang])
    return f"""
WITH t AS (SELECT c_custkey AS doc_id, {TEXTS[lang]} AS text, {masked} AS text_masked FROM customer)
SELECT doc_id, CAST({hits} AS INTEGER) AS hit_count, CAST(length(text) - length(text_masked) + {placeholders} AS INTEGER) AS masked_length, CAST(floor(100 * ({score}) + 0.5) AS INTEGER) AS score, 'low' AS level, text_masked FROM t
"""


MASKED_FIXED_SQL = "SELECT c_custkey AS doc_id, " + re.sub(r"\[[^\]]*\]", "███", f" || {_NL} || ".join(MASKED["en"])) + " AS masked_text FROM customer"


def detection_sql(base: str, columns: str) -> str:
    """Common tables up to ``k``: ``columns``, ``top`` and ``reason`` of the detection of each row of ``base`` (``columns, text``)."""
    flat = "'_' || regexp_replace(trim(lower(text)), '[^\\p{L}'']+', '_', 'g') || '_'"
    scores = []
    for code, profile in language.PROFILES.items():
        total = " + ".join("(n - length(replace(flat, '{}', ''))) * {}".format(g.replace("'", "''"), len(profile) - k) for k, g in enumerate(profile))
        scores.append(f"{{'neg': -({total}), 'code': '{code}'}}")
    return f"""
f AS (SELECT {columns}, coalesce(text, '') AS text, {flat} AS flat FROM {base}),
g AS (SELECT *, length(flat) AS n FROM f),
r AS (SELECT {columns}, text, list_transform(list_sort([{", ".join(scores)}]), lambda x: x.code) AS codes FROM g),
c AS (SELECT *, CASE codes[1] WHEN 'eng' THEN 'en' WHEN 'deu' THEN 'de' END AS top, CASE codes[2] WHEN 'eng' THEN 'en' WHEN 'deu' THEN 'de' END AS second FROM r),
k AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty' WHEN len(regexp_extract_all(text, '[一-鿿]')) / greatest(length(text), 1) >= 0.02 THEN 'han_ratio' WHEN length(trim(text)) < 24 THEN 'too_short'
      WHEN top IS NULL THEN 'unmapped:' || codes[1] WHEN second IS NOT NULL AND second <> top THEN 'en_de_ambiguous:' || codes[1] ELSE 'ngram:' || codes[1] END AS reason FROM c)
"""


LANGUAGE_ROUTES_SQL = f"""
WITH {detection_sql("documents", "doc_id")}
SELECT doc_id, CASE WHEN reason = 'han_ratio' THEN 'zh' WHEN reason LIKE 'ngram%' OR reason LIKE 'en_de%' THEN top ELSE '' END AS detected, reason NOT LIKE 'ngram%' AND reason NOT IN ('empty', 'han_ratio') AS needs_confirm, reason,
       CASE WHEN reason LIKE 'ngram%' OR reason = 'han_ratio' THEN 'auto' ELSE 'needs_confirm' END AS route, CASE WHEN reason LIKE 'ngram%' THEN top ELSE 'zh' END AS content_lang FROM k
"""


def _line_test(patterns: list[str], flags: str = "(?i)") -> str:
    return "(" + " OR ".join("regexp_matches(s, '" + flags + p.replace("'", "''") + "')" for p in patterns) + ")"


_PAGES = "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_number, 'Transcript ' || conv_id || chr(10) || coalesce(text, '') || chr(10) || 'Page ' || (turn + 1) || ' of 99' AS text FROM conversations"
_PAGE_LINE = _line_test(pages.PAGE_LINES)
_LEGAL = _line_test([pages.LEGAL_FORM], "")
_FOOTER = f"({_PAGE_LINE} OR ({_LEGAL} AND {_line_test([pages.STREET])}) OR (regexp_matches(s, '[·|]') AND ({_LEGAL} OR {_line_test([pages.POSTAL], '')})))"
CLEAN_PAGES_SQL = f"""
WITH p AS ({_PAGES}), rep AS ({EDGE_LINES_SQL}),
l AS (SELECT doc_id, page_number, string_split(text, chr(10)) AS lines FROM p),
x AS (SELECT doc_id, page_number, len(lines) - 1 AS last, unnest(range(len(lines))) AS i, unnest(lines) AS raw FROM l),
n AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS s FROM x),
k AS (SELECT n.doc_id, page_number, i, raw FROM n LEFT JOIN rep ON rep.doc_id = n.doc_id AND rep.line = n.s
      WHERE s = '' OR NOT ({_PAGE_LINE} OR (NOT {_line_test([pages.PROTECTED])} AND ((rep.line IS NOT NULL AND (i <= 4 OR i >= last - 4)) OR (i >= last - 2 AND {_FOOTER}))))),
j AS (SELECT doc_id, page_number, string_agg(raw, chr(10) ORDER BY i) AS t FROM k GROUP BY doc_id, page_number),
o AS (SELECT p.doc_id, p.page_number, regexp_replace(coalesce(t, ''), '^\\s+|\\s+$', '', 'g') AS t FROM p LEFT JOIN j ON j.doc_id = p.doc_id AND j.page_number = p.page_number)
SELECT doc_id, page_number, CAST(length(t) AS INTEGER) AS kept, md5(t) AS text_md5 FROM o
"""

# a phrase of three words of three letters or more that comes again later in its line: what a back-reference finds
_SAID_TWICE = """len(list_filter(range(1, len(w) - 1), lambda j: regexp_matches(w[j], '(?:^|[^0-9A-Za-z_])[A-Za-z]{3,}$') AND regexp_matches(w[j + 1], '^[A-Za-z]{3,}$') AND regexp_matches(w[j + 2], '^[A-Za-z]{3,}(?:[^0-9A-Za-z_]|$)')
  AND regexp_matches(array_to_string(list_prepend(regexp_replace(w[j + 2], '^[A-Za-z]+', ''), w[j + 3:]), ' '), '(?i)(?:^|[^0-9A-Za-z_])' || regexp_extract(w[j], '[A-Za-z]+$') || ' ' || w[j + 1] || ' ' || regexp_extract(w[j + 2], '^[A-Za-z]+') || '(?:[^0-9A-Za-z_]|$)'))) > 0"""
_LABELS = " + ".join("len(regexp_extract_all(s, '(?i)" + p + "'))" for p in pages.LABELS)
PAGE_MODES_SQL = f"""
WITH p AS ({_PAGES}),
l AS (SELECT doc_id, page_number, string_split(text, chr(10)) AS lines FROM p),
x AS (SELECT doc_id, page_number, len(lines) - 1 AS last, unnest(range(len(lines))) AS i, unnest(lines) AS raw FROM l),
n AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS s FROM x),
b AS (SELECT *, string_split(s, ' ') AS w, {_LABELS} AS labels, len(regexp_extract_all(s, '[·|]')) AS bars FROM n),
v AS (SELECT doc_id, page_number, count(*) FILTER (WHERE length(s) >= {pages.SUSPICIOUS_LENGTH} AND (labels >= 2 OR (bars >= 4 AND labels >= 1) OR {_SAID_TWICE})) >= {pages.SUSPICIOUS_LINES} AS bad,
             string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE s = '' OR NOT ({_PAGE_LINE} OR (NOT {_line_test([pages.PROTECTED])} AND i >= last - {pages.LAST_LINES - 1} AND {_FOOTER}))) AS t FROM b GROUP BY doc_id, page_number),
k AS (SELECT v.doc_id, length(trim(regexp_replace(coalesce(t, ''), '^\\s+|\\s+$', '', 'g'))) AS kept, bad, length(p.text) AS raw, length(regexp_replace(p.text, '\\s', '', 'g')) AS chars FROM v JOIN p ON p.doc_id = v.doc_id AND p.page_number = v.page_number),
d AS (SELECT doc_id, sum(kept) AS total, count(*) AS n, count(*) FILTER (WHERE kept < {pages.WEAK_PAGE}) AS weak, sum(raw) AS raw, bool_or(bad) AS bad, sum(chars) AS chars FROM k GROUP BY doc_id),
g AS (SELECT *, total >= {pages.LEAST_TOTAL} AND total / n >= {pages.LEAST_AVERAGE} AND weak <= n // 2 AND NOT (raw > 0 AND total / greatest(raw, 1) < {pages.LEAST_SHARE}) AS usable FROM d)
SELECT doc_id, usable AS coverage_usable, NOT bad AS semantic_usable, CASE WHEN chars >= {pages.LEAST_TEXT_LAYER} AND usable AND NOT bad THEN 'A' ELSE 'B' END AS mode FROM g
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scrub_documents": scrub_documents,
    "hits_by_key": hits_by_key,
    "risk_levels": risk_levels,
    "email_places": email_places,
    "manual_terms": manual_terms,
    "language_stats": language_stats,
    "language_routes": language_routes,
    "edge_lines": edge_lines,
    "clean_pages": clean_pages,
    "page_modes": page_modes,
    "page_offsets": offsets,
    "page_texts": page_texts,
    "hit_rects": hit_rects,
    "masked_fixed": masked_fixed,
    **{f"rule_matches_{lang}": rule_matches(lang) for lang in PACKS},
    **{f"scrub_texts_{lang}": scrub_texts(lang) for lang in PACKS},
}
ORACLES: dict[str, str] = {
    "email_places": EMAIL_PLACES_SQL,
    "manual_terms": MANUAL_TERMS_SQL,
    "language_stats": LANGUAGE_STATS_SQL,
    "edge_lines": EDGE_LINES_SQL,
    "page_offsets": OFFSETS_SQL,
    "language_routes": LANGUAGE_ROUTES_SQL,
    "clean_pages": CLEAN_PAGES_SQL,
    "page_modes": PAGE_MODES_SQL,
    "masked_fixed": MASKED_FIXED_SQL,
    **{f"scrub_texts_{lang}": scrub_texts_sql(lang) for lang in PACKS},
    **{f"rule_matches_{lang}": rule_matches_sql(lang) for lang in PACKS},
}
