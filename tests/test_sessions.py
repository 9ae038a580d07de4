"""Session locks, values as of a time, fallback attempts, the pattern table function, subtotals and differences of hits."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions import pattern_table
from veilframe.functions.dialect import to_java
from veilframe.operators import attempts, scrub, sessions, spans
from veilframe.plans.config import Rule, ScrubConfig, term_rules

ENGLISH = "The people of the town were waiting for the train that was to bring the letters and the news of the war."
GERMAN = "Die Leute in der Stadt haben auf den Zug gewartet, der die Briefe und die Nachrichten von dem Krieg bringen sollte."
HAN = "客户的电话号码是多少"


def test_lock_of_a_session(spark):
    turns = [(1, 0, "hm"), (1, 1, ENGLISH), (1, 2, GERMAN), (1, 3, " "), (2, 0, HAN), (2, 1, ENGLISH), (2, 2, None), (3, 0, "?"), (3, 1, "!"), (None, 0, "x")]
    said = [(2, 1, "DE"), (3, 1, "en"), (1, 3, "auto"), (9, 0, "de")]
    rows = spark.createDataFrame([(*t, "kept") for t in turns], "session long, turn int, text string, lock_note string").repartition(3)
    got = {(r.session, r.turn): (r.content_lang, r.asked, r.lock) for r in sessions.locked(rows, spark.createDataFrame(said, "session long, turn int, lang string")).collect()}
    assert got[1, 0] == ("", True, None)
    first = got[1, 1]
    assert first[1] is False or first[0] == ""
    assert got[1, 3] == ("", False, None)  # released, and a blank turn asks nothing
    assert got[2, 0] == ("zh", False, "zh") and got[2, 1] == ("de", False, "de") and got[2, 2] == ("", False, "de")
    assert got[3, 0] == ("", True, None) and got[3, 1] == ("en", False, "en") and got[None, 0][1]
    free = {(r.session, r.turn): r.lock for r in sessions.locked(rows).collect()}
    assert free[2, 1] == free[2, 2] == "zh" and len(free) == len(turns)
    assert sessions.locked(rows.where("false")).count() == 0


@pytest.mark.parametrize("stretch", [None, 1, 7, 1000])
def test_as_of_equals_a_plain_search(spark, stretch):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([*range(40), None]), i) for i in range(120)]
    news = [(rng.choice([1, 2, 3, None]), rng.choice([*range(40), None]), rng.choice(["a", "b", None])) for _ in range(30)]
    cut = None if stretch is None else F.floor(F.col("t") / stretch)
    left, right = spark.createDataFrame(rows, "k int, t int, i int").repartition(4), spark.createDataFrame(news, "k int, t int, v string")
    got = {r.i: r.got for r in sessions.as_of(left, right, ["k"], "t", "v", "got", cut).collect()}
    best = {}
    for k, t, v in news:
        if k is not None and t is not None:
            best[k, t] = max(filter(None, [best.get((k, t)), v]), default=None)
    for k, t, i in rows:
        times = [x for y, x in best if y == k and t is not None and x <= t]
        assert got[i] == (best[k, max(times)] if times else None)
    assert len(got) == len(rows)


def test_attempts_run_only_for_what_is_left(spark):
    pages = spark.createDataFrame([(1, p, t, u) for p, (t, u) in enumerate([("bob", "x"), ("y", "Bob bob"), (None, None), ("z", "q")])], "doc_id int, page_number int, text string, other string")
    rules, asked = term_rules(ScrubConfig(lang="en", terms=("bob",))), []

    def counting(name, run):
        def go(left):
            asked.append((name, left.count()))
            return run(left)

        return name, go

    tries = attempts.hit_attempts({"one": F.col("text"), "two": F.col("other"), "three": F.lit("bob")}, lambda t: spans.hits_of(t, rules, "en"))
    served = attempts.first_served(pages, [counting(*t) for t in tries])
    assert sorted((r.page_number, r.attempt, len(r.hits)) for r in served.collect()) == [(0, "one", 1), (1, "two", 2), (2, "three", 1), (3, "three", 1)]
    assert asked == [("one", 4), ("two", 3), ("three", 2)]
    asked.clear()
    served = attempts.first_served(pages.where("page_number = 0"), [counting(*t) for t in tries])
    assert asked == [("one", 1)] and served.count() == 1
    none = attempts.first_served(pages, [counting(*t) for t in tries[:2]])
    assert {tuple(r) for r in attempts.audit(pages, none).collect()} == {("one", 1, 1), ("two", 1, 1), (None, 2, 0)}
    assert attempts.page_hits(pages, {"text": F.lit("mail a@b.org")}, ScrubConfig(lang="en")).count() == 4


def test_pattern_table(spark):
    docs = spark.createDataFrame([(1, "id: 漢9 and id:  77x"), (2, ""), (3, None), (1, "id: 5")], "doc_id int, text string")
    got = [(r.doc_id, r.key, r.start, r.end, r.value, r.groups) for r in pattern_table.matches(docs, {"behind": r"(?<=id:\s*)(\p{Han})?(\d+)", "empty": "x*"}).collect()]
    assert sorted(got, key=repr) == sorted([(1, "behind", 4, 6, "漢9", ["漢", "9"]), (1, "behind", 16, 18, "77", [None, "77"]), (1, "empty", 18, 19, "x", []), (1, "behind", 4, 5, "5", [None, "5"])], key=repr)
    pattern_table.register(spark)
    docs.createOrReplaceTempView("texts")
    assert spark.sql("SELECT doc_id, m.value FROM texts, LATERAL pattern_matches(text, '[0-9]+') m").count() == 3


def test_extra_rules_run_after_the_pack(spark):
    mine = Rule("badge", "ID", "whole", 900, to_java(r"\bBDG-\d{3}\b"), 0, "[Badge]", needs=(frozenset(["bdg-"]),))
    docs = spark.createDataFrame([(1, "BDG-123 or bob@site.org"), (2, "BDG-12")], "doc_id int, text string")
    done = {r.doc_id: r.text_masked for r in scrub.match(docs, ScrubConfig(lang="en", extra_rules=(mine,))).collect()}
    assert done == {1: "[Badge] or [Email]", 2: "BDG-12"}


def test_totals_and_differences(spark):
    hits = lambda *keys: [{"key": k} for k in keys]
    rows = [(1, "en", "a", hits("x", "x", "y")), (1, "en", "b", hits("x")), (2, "en", "a", None), (3, None, "a", hits("y")), (4, "de", "a", [])]
    matched = spark.createDataFrame(rows, "doc_id int, lang string, source string, hits array<struct<key:string>>")
    got = {(r.lang, r.source, r.key, r.level): (r.hits, r.documents) for r in scrub.hit_totals(matched, ["lang", "source"]).collect()}
    assert got[None, None, None, 7] == (5, 2) and got["en", None, None, 3] == (4, 1) and got["en", "a", "x", 0] == (2, 1) and got[None, None, None, 3] == (1, 1) and got["en", "a", None, 1] == (3, 1)
    one = spark.createDataFrame([(1, {"x": 2, "y": 1}), (2, {"x": 1})], "doc_id int, by_key map<string,int>")
    two = spark.createDataFrame([(1, {"x": 2, "z": 4}), (2, None)], "doc_id int, by_key map<string,int>")
    assert {tuple(r) for r in scrub.coverage(one, two, "doc_id").collect()} == {(1, "y", 1, 0), (1, "z", 0, 4), (2, "x", 1, 0)}
