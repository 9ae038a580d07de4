"""SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import quality_rules as rules
from .divergence import LEAST_DOCS, RANKS, SCALE
from .sharding import LIMIT
from .treap_search import TOP

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SHARDING = f"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash FROM documents),
b AS (SELECT 0 AS depth, CAST(0 AS BIGINT) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS held, count(*) AS n FROM d
      UNION ALL
      SELECT b.depth + 1, d.hash >> (59 - b.depth), CAST(sum(d.n_bytes) AS BIGINT), count(*) FROM b JOIN d ON (d.hash >> (60 - b.depth)) = b.prefix WHERE b.held > {LIMIT} AND b.n > 1 GROUP BY b.depth, d.hash >> (59 - b.depth)),
leaf AS (SELECT * FROM b WHERE held <= {LIMIT} OR n = 1)
SELECT doc_id, n_bytes, substr(lpad(CAST(bin(hash) AS VARCHAR), 60, '0'), 1, depth) AS shard, CAST(depth AS INTEGER) AS depth, held AS shard_bytes, n AS shard_docs
FROM d JOIN leaf ON (d.hash >> (60 - leaf.depth)) = leaf.prefix
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS size FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.size > 0 AND b.size > 0 AND list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
l AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN l USING (vec_id)
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], CAST(rank % 3 + 1 AS BIGINT)) AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
lv AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS level FROM w
       WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wt AS (SELECT arg_min(level, cap / weight) AS water FROM lv WHERE level * weight <= cap),
t AS (SELECT source, source_size, rank, least(cap, coalesce(water * weight, cap)) AS target FROM lv, wt),
a AS (SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS aim, CAST(sum(size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS high FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN size * (aim // source_size) + greatest(least(high, aim % source_size) - (high - size), 0) ELSE 0 END AS BIGINT) AS taken FROM a
"""

_FEATURES = f"""d AS (SELECT doc_id, CAST(lang AS VARCHAR) AS lang, CAST(source AS VARCHAR) AS source, row_number() OVER () AS rid, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n, count(*) AS lines FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
gi AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
gr AS (SELECT rid, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g FROM gi),
tw AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM gr) WHERE n > 1),
rp AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM tw) GROUP BY rid),
f AS (SELECT d.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(text) - len(regexp_extract_all(text, '[\\x20\\x09-\\x0D]')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rp.n, 0) AS BIGINT) AS n_repeat_words, coalesce(dl.lines, 0) AS n_lines,
        CAST(len(regexp_extract_all(text, '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]')) AS BIGINT) AS n_punctuation,
        CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS BIGINT) AS n_upper_words,
        CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS n_doubled_words FROM d LEFT JOIN dl ON d.rid = dl.rid LEFT JOIN rp ON d.rid = rp.rid)"""


def _case(values: dict[str, str], otherwise: str) -> str:
    return "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


def _quality() -> str:
    names = [f"p{q}" for q in rules.PERCENTILES]
    entry = ", ".join(f"{{'metric': '{m}', 'v': CAST(greatest({over} - {free}, 0) * {factor} // greatest({under}, 1) AS BIGINT)}}" for m, over, free, under, factor, *_ in rules.METRICS)
    shift = f"greatest(length(bin(v)) - {rules.EXACT_BITS}, 0)"
    reach = lambda outer, inner, sign: f"greatest({sign}(p{outer} - p{inner}), p{outer} // {1 << (rules.EXACT_BITS - 1)})"
    high = _case({m[0]: f"p{m[6]} + {m[7]} * {reach(m[6], m[5], '')}" for m in rules.METRICS}, "NULL")
    low = _case({m[0]: f"p{100 - m[6]} - {m[7]} * {reach(100 - m[6], m[5], '-')}" for m in rules.METRICS if m[8]}, "-1")
    drawn = lambda n, own, to: f"({n} * {own} + {rules.PRIOR} * {to}) // ({n} + {rules.PRIOR})"
    return f"""
WITH {_FEATURES},
m AS (SELECT rid, lang, source, base_failed, unnest([{entry}], recursive := true) FROM (SELECT *, n_words < {rules.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {rules.MOST_REPEATED} AS base_failed FROM f)),
b AS (SELECT rid, lang, source, base_failed, metric, (v >> {shift}) << {shift} AS bucket FROM m),
g AS (SELECT 0 AS level, lang, source, metric, bucket FROM b WHERE NOT base_failed UNION ALL SELECT 1, lang, NULL, metric, bucket FROM b WHERE NOT base_failed UNION ALL SELECT 2, NULL, NULL, metric, bucket FROM b WHERE NOT base_failed),
r AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS nth, count(*) OVER (PARTITION BY level, lang, source, metric) AS n FROM g),
q AS (SELECT level, lang, source, metric, max(n) AS n, {", ".join(f"min(CASE WHEN nth * 100 >= n * {p} THEN bucket END) AS p{p}" for p in rules.PERCENTILES)} FROM r GROUP BY level, lang, source, metric),
l AS (SELECT l.lang, l.metric, {", ".join(drawn("l.n", f"l.{c}", f"e.{c}") + f" AS {c}" for c in names)} FROM q l JOIN q e ON e.level = 2 AND e.metric = l.metric WHERE l.level = 1),
o AS (SELECT o.lang, o.source, o.metric, {", ".join(drawn("o.n", f"o.{c}", f"l.{c}") + f" AS {c}" for c in names)} FROM q o JOIN l ON l.lang IS NOT DISTINCT FROM o.lang AND l.metric = o.metric WHERE o.level = 0),
fe AS (SELECT lang, source, metric, {low} AS low, {high} AS high FROM o),
ok AS (SELECT rid, bool_and(coalesce(bucket BETWEEN low AND high, FALSE)) AS inside FROM b LEFT JOIN fe ON fe.lang IS NOT DISTINCT FROM b.lang AND fe.source IS NOT DISTINCT FROM b.source AND fe.metric = b.metric GROUP BY rid),
z AS (SELECT f.*, n_words < {rules.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {rules.MOST_REPEATED} AS base_failed, inside FROM f JOIN ok ON f.rid = ok.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM z
"""


QUALITY_RULES = _quality()

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS n FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM tf, s GROUP BY term),
m AS (SELECT rid, doc_id, 75 + 25 * len(w) * docs // terms AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
sc AS (SELECT item_id, rid, CAST(sum(times * weight * (1000000000 * n // (1000 * n + 12 * m))) AS BIGINT) AS score, any_value(doc_id) AS doc_id FROM q JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY item_id, rid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""

# every kept term of every pair, as plain as can be
DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
l AS (SELECT lang, CAST(count(*) AS BIGINT) AS v, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS BIGINT) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, CAST(coalesce(total, 0) AS BIGINT) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + {SCALE}::BIGINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p, 1 + {SCALE}::BIGINT * (k.n + 1) // (l.total + l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
pr AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
al AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
       UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM al)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {RANKS}
"""

ORACLES = {"op1_sharding": SHARDING, "op5_near_vectors": NEAR_VECTORS, "op6_mixing": MIXING, "op7_quality_rules": QUALITY_RULES, "op11_lexical_search": LEXICAL_SEARCH, "op13_divergence": DIVERGENCE}
