"""Patterns pass a text once, behind a look at the first sign of a match; the cheaper forms find the same."""

import re

from pyspark.sql import functions as F

from veilframe import queries
from veilframe.functions import dialect
from veilframe.functions.required import ends_sql, folded_sql
from veilframe.operators import spans
from veilframe.plans.config import PACKS, ScrubConfig, plan_rules

LEAD = re.compile(r"^((?:\(\?iu?\))?)\(\?-iu:\(\?=\[.*?\]\)\)")


def test_each_pattern_stands_once_in_the_expression():
    rules = plan_rules(ScrubConfig(lang="en"))
    told = spans.hits_sql("text", rules, "en")
    assert all(told.count(spans.quoted(r.pattern)) == 1 for r in rules)


def test_most_rules_look_at_the_first_sign_first():
    for lang, pack in PACKS.items():
        rules = plan_rules(ScrubConfig(lang=lang, enabled=frozenset(pack.PRIORITY)))
        assert sum(bool(LEAD.match(r.pattern)) for r in rules) >= 0.9 * len(rules)


def test_boundaries_are_halved_only_where_a_side_is_sure():
    assert dialect.boundaries(r"\bab\b") == [(False, True), (True, False)]
    assert dialect.boundaries(r"\b(?:a|-)b?\b") == [(False, False), (False, False)]
    assert dialect.boundaries(r"(?:x|\d+)\b[ \t]*\bé") == [(True, False), (False, False)]
    assert dialect.boundaries(r"\p{L}\b") == [(False, False)]


def test_signs_of_a_word_are_those_of_the_plain_class(spark):
    java = spark._jvm.java.util.regex.Pattern
    signs = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    for flags, word in (("(?iu)", dialect.WORD_ANY_CASE), ("(?i)", dialect.WORD), ("", dialect.WORD)):
        assert java.compile(flags + word).matcher(signs).replaceAll("") == java.compile(flags + "[0-9A-Za-z_]").matcher(signs).replaceAll("")


def test_leads_take_every_sign_that_equals_a_letter(spark):
    java = spark._jvm.java.util.regex.Pattern
    signs = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    for flags in ("i", "iu", ""):
        for c in "abcdefghijklmnopqrstuvwxyzäöüßSKI-7":
            case = f"(?{flags})" if flags else ""
            assert set(signs) - set(java.compile(case + c).matcher(signs).replaceAll("")) <= dialect._forms(ord(c), flags)


def test_rules_find_the_same_without_their_lead(spark):
    texts = ["ſSN: 123-45-6789\ntoKen: abcdefgh12 İP address: 10.0.0.1 (Ann) -USD 5.00", "überwiesen von Strauß GmbH, Straße 5\n手机：13800001111\nEmail a.b@c.de x@y.org", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for lang, pack in PACKS.items():
        rules = plan_rules(ScrubConfig(lang=lang, enabled=frozenset(pack.PRIORITY)))
        bare = [LEAD.sub(r"\1", r.pattern) for r in rules]
        tests = [F.regexp_replace("text", r.pattern, "<$0>") == F.regexp_replace("text", b, "<$0>") for r, b in zip(rules, bare, strict=True)]
        assert all(all(row) for row in docs.select(*tests).collect())


def test_ends_of_labels_are_in_every_match(spark):
    labels = {"de": [p for _, _, _, _, p in PACKS["de"].RULES], "en": [p for _, _, _, _, p in PACKS["en"].RULES], "zh": [p for _, _, _, _, p in PACKS["zh"].RULES]}
    for lang, patterns in labels.items():
        rules = [r for r in plan_rules(ScrubConfig(lang=lang, enabled=frozenset(PACKS[lang].PRIORITY))) if r.ends]
        assert len(rules) >= 20 and len(rules) <= len(patterns)
        # a value for each kind of rule behind each label that the patterns name, with and without space, in both cases
        words = sorted({w for p in patterns for w in re.findall(r"[A-Za-zÄÖÜäöüß一-鿿0-9.\-]+(?: [A-Za-z.]+)*", re.sub(r"\[[^\]]*\]\*?|\(\?:|\\.", " ", p)) if len(w) > 1})
        values = ["Anna Berg", "AB-12-34567", "123456789012", "01.02.1990", "12/2030", "DE89 3704 0044 0532 0130 00", "10.0.0.1", "京A12345", "100.50", "甲方有限公司"]
        texts = [f"{w}{sep}{v}\n" for w in words for sep in (":", " \t：", "　= ", " := ") for v in values]
        data = spark.createDataFrame([(t,) for s in texts for t in (s, s.upper().replace("S", "ſ"))], "text string")
        ends = F.expr(ends_sql(folded_sql("text")))
        tests = [F.count_if(F.col("text").rlike(r.pattern) & ~F.expr(spans.ended(r, "ends") + "true")) for r in rules]
        assert set(data.withColumn("ends", ends).select(*tests).first()) == {0}, lang


def test_values_and_words_of_a_text_do_not_run_a_label_s_pattern(spark):
    docs = queries.texts(spark, "/root/testdata/sf0.001", "de").limit(1).withColumn("ends", F.expr(ends_sql(folded_sql("text"))))
    rules = [r for r in plan_rules(ScrubConfig(lang="de")) if r.ends]
    run = [r.key for r, on in zip(rules, docs.select(*[F.expr(spans.ended(r, "ends") + "true") for r in rules]).first(), strict=True) if on]
    assert {"secret", "tax_id", "birthdate", "account", "blz", "company_label"} <= set(run) and not any("name" in k for k in run)  # kunde1@... is no label
    assert docs.where(F.expr(spans.ended(next(r for r in rules if r.key == "person_name"), "ends") + "true")).count() == 0


def test_space_before_separators_takes_time_in_proportion(spark):
    assert spark.sql("SELECT length(" + ends_sql("repeat(' ', 300000) || 'x' || repeat(' ', 300000) || ':'") + ")").first()[0] == 300_002


def test_lines_are_looked_at_whole_only_where_the_rest_matches():
    address = next(r for r in PACKS["de"].RULES if r[0] == "address_de_inline_street")[4]
    assert dialect.sooner(address).startswith("^(?=") and dialect.sooner(address).endswith(address[1:])
    assert dialect.sooner("^(?!a)b|c$") == "^(?!a)b|c$" and dialect.sooner(r"^(?!a)(b)\1$") == r"^(?!a)(b)\1$"
    assert dialect.lead(r"(?:Name|Kunde)[ \t]*:", "") == r"(?-iu:(?=[KN][au][mn][de][\u0009\u0020\u003Ae]))"


def test_classes_sign_by_sign_take_the_same_signs(spark):
    java = spark._jvm.java.util.regex.Pattern
    signs = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    for inner in (r"A-Za-zÄÖÜäöüß0-9&.\-", r"A-ZÄÖÜ", r"\d \t().-", r"A-F0-9", r"a-zå.", ":：=", r"A-Za-zÀ-Ö", r"\w.", "^a", "a&&b"):
        for flags in ("", "i", "iu"):
            form = dialect.listed(inner, flags)
            assert (form is None) == (inner in (r"A-Za-zÀ-Ö", r"\w.", "^a", "a&&b")), inner
            if form:
                case = f"(?{flags})" if flags else ""
                assert java.compile(case + form).matcher(signs).replaceAll("") == java.compile(f"{case}[{inner}]").matcher(signs).replaceAll("")
