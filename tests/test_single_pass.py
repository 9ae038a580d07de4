"""Work that is done once a row, however often its result is read."""

from pyspark.sql import functions as F

from veilframe import queries
from veilframe.functions.dialect import to_java
from veilframe.operators import language
from veilframe.operators.pages import REPEATED_PHRASE
from veilframe.sources import match_results


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_records_are_parsed_once(spark):
    records = spark.createDataFrame([(1, '{"key":"k","a":2,"b":5}'), (2, "{"), (3, None)], "n int, record string")
    spans = match_results.hit_spans(records)
    assert _plan(spans).count("parsejson") + _plan(spans).count("parse_json") <= 2
    assert [tuple(r) for r in spans.collect()] == [(1, "k", 2, 5, None, None, "")]


def _by_removal(flat: str) -> list[str]:
    score = lambda p: sum((len(flat) - len(flat.replace(g, ""))) * (len(p) - k) for k, g in enumerate(p))
    return [c for _, c in sorted((-score(p), c) for c, p in language.PROFILES.items())]


def test_ranking_equals_counting_by_removal_and_passes_a_text_once(spark):
    words = ["a a a a the", "erererere und", "nenenen en en", "y_y ' les", "", "😀the the😀 ist", "de la que", "ion ión été"]
    texts = [" ".join(words[i:] + words[:j]) for i in range(8) for j in range(8)] + ["a", "x", "the"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate([*texts, None])], "n int, text string").coalesce(1)
    ranked = docs.select("n", language.ranked_codes(F.col("text")).alias("codes"))
    assert "replace(" not in _plan(ranked).replace("regexp_replace(", "")
    flat = {r.n: r.flat for r in docs.select("n", F.concat(F.lit("_"), F.regexp_replace(F.trim(F.lower("text")), "[^\\p{L}']+", "_"), F.lit("_")).alias("flat")).collect()}
    assert {r.n: r.codes for r in ranked.collect()} == {n: None if f is None else _by_removal(f) for n, f in flat.items()}


def test_page_modes_read_the_pages_once(spark):
    modes = queries.page_modes(spark, "/root/testdata/sf0.001")
    assert modes.columns == ["doc_id", "coverage_usable", "semantic_usable", "mode"]
    assert _plan(modes).count("relation ") == 1 and " join " not in _plan(modes)


def test_repeated_phrases_are_those_of_the_longer_pattern(spark):
    whole = to_java(r"\b([A-Za-z]{3,}(?:\s+[A-Za-z]{3,}){2,6})\b.*\b\1\b", "i")
    lines = ["one two three four x ONE two three", "one two three one two threes", "one two three1 one two three1", "xone two three one two three", "aaa aaa aaa aaa aaa", "one  two three, one two three", "one two three four five six seven eight; one two three four five six seven eight", "", "été one two three été one two three"]
    docs = spark.createDataFrame([(x,) for x in lines], "s string")
    assert all(r[0] == r[1] for r in docs.select(F.col("s").rlike(whole), F.col("s").rlike(to_java(REPEATED_PHRASE, "i"))).collect())
    assert "{2,6}" not in REPEATED_PHRASE
