"""Language routing: Han ratio, then trigram profiles, then a decision to lock or to ask; projections alone, no shuffle."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import arrow_function

#: Share of Han characters that makes a text Chinese, least length for trigrams, confidences and the one that locks.
HAN_RATIO, LEAST_LENGTH, HAN_CONFIDENCE, PLAIN, AMBIGUOUS, LOCK = 0.02, 24, 0.99, 0.86, 0.74, 0.78
#: Languages with rules, by three-letter code; other codes have none.
KNOWN = {"eng": "en", "deu": "de"}

#: Frequent trigrams of each language ("_" for a blank), most frequent first (fixed values).
PROFILES = {
    "eng": "_th the he_ nd_ and _an ing ng_ _of of_ ed_ _to to_ ion _in is_ on_ tio er_ at_ es_ re_ _co ent hat _a_ tha ati or_ _be in_ en_ for _fo _wh her ly_ his _wi ith wit as_ was ver all _re ter ere _no you _yo not are".split(),
    "deu": "en_ er_ _de der ie_ die _di sch ein ich che _un und nd_ ch_ den _ei in_ ung gen te_ _da cht ine _ge ten _ve ver ng_ _be ber it_ das as_ _au auf _mi mit ist st_ _is nen ens _zu zu_ nde eit hen lic _ni nic des es_ _wi".split(),
    "fra": "es_ _de de_ ent nt_ _le le_ on_ ion re_ _la la_ les ne_ _et et_ que ue_ _qu e_d tio _co _pa des _un une men ons _en en_ s_d our _po par eur ait us_ is_ _ce est st_ _es ans _da dan pou _l' er_ ur_ it_ au_".split(),
    "spa": "de_ _de os_ _la la_ que ue_ _qu el_ _el es_ ión ón_ as_ ció aci _en en_ do_ _co ent con ar_ los ado al_ _se nte to_ _un a_d s_d res del _pa par sta ra_ por _po las _es est ida ier ien una na_ se_ er_ era ica".split(),
}


def stats(text: Column) -> Column:
    """``length, han, latin, umlaut, han_ratio``."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    n, han = F.length(text), count("[\\u4E00-\\u9FFF]")
    return F.struct(n.alias("length"), han.alias("han"), count("[A-Za-z]").alias("latin"), count("[äöüÄÖÜß]").alias("umlaut"), (han / F.greatest(n, F.lit(1))).alias("han_ratio"))


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, int, np.ndarray, np.ndarray, list[int], list[str]]:
    """Number of each character (0: in no trigram), how many there are, number of each trigram by its characters' numbers, weights of trigrams by profile, trigrams that can overlap themselves, codes."""
    names = sorted(PROFILES)
    grams = sorted({g for p in PROFILES.values() for g in p})
    signs = sorted(set("".join(grams)))
    many = len(signs) + 1
    number = np.zeros(max(map(ord, signs)) + 2, np.int32)
    number[[ord(c) for c in signs]] = np.arange(1, many)
    place = np.zeros(many**3, np.int16)
    weight = np.zeros((len(grams) + 1, len(names)))
    for k, g in enumerate(grams, 1):
        a, b, c = (int(number[ord(x)]) for x in g)
        place[(a * many + b) * many + c] = k
        for j, name in enumerate(names):
            weight[k, j] = len(PROFILES[name]) - PROFILES[name].index(g) if g in PROFILES[name] else 0
    return number, many, place, weight, [k for k, g in enumerate(grams, 1) if g[0] == g[2]], names


def _ranked(texts: list[str | None], _: list) -> list[list[str] | None]:
    number, many, place, weight, twice, names = _tables()
    ends = np.cumsum([len(t or "") for t in texts])
    signs = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = number[np.minimum(signs, len(number) - 1)]
    gram = place[(ids[:-2] * many + ids[1:-1]) * many + ids[2:]] if len(ids) > 2 else np.zeros(0, np.int16)
    at = np.flatnonzero(gram)
    row = np.searchsorted(ends, at, "right")
    inside = at + 2 < ends[row]
    at, row = at[inside], row[inside]
    held = gram[at]
    counted = np.ones(len(at), bool)
    for k in twice:  # in a run that overlaps itself every second one is counted, as removal from left to right does
        own = np.flatnonzero(held == k)
        fresh = np.concatenate([[True], np.diff(at[own]) != 2]) if len(own) else np.zeros(0, bool)
        order = np.arange(len(own))
        counted[own] = (order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0 if len(own) else fresh
    scores = np.stack([np.bincount(row[counted], weight[held[counted], j], len(texts)) for j in range(len(names))], axis=1)
    best = np.argsort(-scores, axis=1, kind="stable").tolist()
    return [None if t is None else [names[j] for j in b] for t, b in zip(texts, best, strict=True)]


def ranked_codes(text: Column) -> Column:
    """Language codes of all profiles, best first: each trigram of a profile counts as often as the text holds it, by its place; ties by code.  Null for null.

    A text is passed once, whatever the number of trigrams: by Arrow batches, each place looked up in one table.
    """
    flat = F.concat(F.lit("_"), F.regexp_replace(F.trim(F.lower(text)), "[^\\p{L}']+", "_"), F.lit("_"))
    return arrow_function(SparkSession.active(), _ranked, "array<string>", pa.list_(pa.string()))(flat, F.lit(0))


def detect(text: Column) -> Column:
    """Detection record: ``lang, confidence, needs_confirm, candidates, reason, source``."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    s = F.trim(raw)
    record = lambda lang, conf, ask, cand, reason, source: F.struct(lang.cast("string").alias("lang"), F.lit(conf).alias("confidence"), F.lit(ask).alias("needs_confirm"), cand.cast("array<string>").alias("candidates"), reason.alias("reason"), F.lit(source).alias("source"))
    none, blank = F.array(), F.lit("")
    han = F.regexp_count(raw, F.lit("[\\u4E00-\\u9FFF]")) / F.greatest(F.length(raw), F.lit(1)) >= HAN_RATIO
    # texts that are told without trigrams do not go to the workers
    codes = ranked_codes(F.when(~han & (F.length(s) >= LEAST_LENGTH), s))

    def decided(codes: Column) -> Column:
        pack = F.create_map(*[x for k, v in KNOWN.items() for x in (F.lit(k), F.lit(v))])
        top, second = F.element_at(pack, codes[0]), F.element_at(pack, codes[1])
        both = F.array_compact(F.array_distinct(F.array(top, second)))
        unmapped = record(blank, 0.0, True, both, F.concat(F.lit("unmapped:"), codes[0]), "ngram")
        ambiguous = record(top, AMBIGUOUS, True, both, F.concat(F.lit("en_de_ambiguous:"), codes[0]), "ngram")
        return F.when(top.isNull(), unmapped).when(F.size(both) == 2, ambiguous).otherwise(record(top, PLAIN, PLAIN < LOCK, both, F.concat(F.lit("ngram:"), codes[0]), "ngram"))

    return (
        F.when(s == "", record(blank, 0.0, False, none, F.lit("empty"), "none"))
        .when(han, record(F.lit("zh"), HAN_CONFIDENCE, False, F.array(F.lit("zh")), F.lit("han_ratio"), "heuristic"))
        .when(F.length(s) < LEAST_LENGTH, record(blank, 0.0, True, none, F.lit("too_short"), "ngram"))
        .otherwise(F.transform(F.array(codes), decided)[0])
    )


def route(docs: DataFrame, overrides: DataFrame | None = None, ui_lang: str = "", text: str = "text") -> DataFrame:
    """Adds ``detection``, ``route`` (``locked``, ``auto``, ``needs_confirm``) and ``content_lang``.

    A locked language (``overrides``: ``doc_id, lang``) wins; then a sure detection; then the interface's language; then Chinese.  Rows
    that would have needed a user's answer stay flagged.
    """
    out = docs.withColumn("detection", detect(F.col(text)))
    if overrides is not None:
        out = out.join(overrides.select("doc_id", F.lower("lang").alias("_locked")), "doc_id", "left")
    else:
        out = out.withColumn("_locked", F.lit(None).cast("string"))
    known = F.when(F.col("_locked").isin("en", "de", "zh"), F.col("_locked"))
    sure = F.when(~F.col("detection.needs_confirm") & (F.col("detection.lang") != "") & (F.col("detection.confidence") >= LOCK), F.col("detection.lang"))
    way = F.when(known.isNotNull(), "locked").when(sure.isNotNull(), "auto").otherwise("needs_confirm")
    return out.withColumn("route", way).withColumn("content_lang", F.coalesce(known, sure, F.lit(ui_lang or None), F.lit("zh"))).drop("_locked")
