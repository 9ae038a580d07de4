"""The scrub of whole documents against a plain model: every rule by another regular-expression engine, then conflicts and masks one by one."""

import collections
import hashlib
import warnings

import pytest
import regex

from veilframe import queries, rule_samples
from veilframe.operators import scrub
from veilframe.plans.config import CATALOG, PACKS, ScrubConfig, plan_rules

SPACES = r"\t\n\x0B\f\r    -     　﻿"


def compiled(pattern, flags):
    """A pack's pattern for the other engine: ASCII words and digits, wide white space, line ends as the packs' dialect has them."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        token = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        k += len(token)
        if token == "\\s":
            out.append(SPACES if inside else f"[{SPACES}]")
        elif token == "\\S":
            out.append(f"[^{SPACES}]")
        elif not inside and token == "$":
            out.append(r"(?=[\n\r  ]|\Z)" if "m" in flags else r"\Z")
        elif not inside and token == "^":
            out.append(r"(?:\A|(?<=[\n\r  ]))" if "m" in flags else r"\A")
        elif not inside and token == ".":
            out.append(r"[^\n\r  ]")
        else:
            out.append("\\[" if inside and token == "[" else token)
            inside = token == "[" or (inside and token != "]")
    wide = regex.UNICODE if "u" in flags else regex.ASCII
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return regex.compile("".join(out), wide | (regex.IGNORECASE if "i" in flags else 0))


def phone_is_none(lang, label, value):
    """Whether a number with its label is something else than a phone's."""
    low, bare, digits = label.lower(), value.strip(" "), len(regex.sub("[^0-9]", "", value))
    word, iban = r"(?<![0-9A-Za-z_])", r"(?i)^[A-Z]{2}\d{2}(?:[ \t]?[A-Z0-9]{3,5}){2,9}\Z"
    has = lambda p, s: regex.search(p, s, regex.ASCII) is not None
    if lang == "en":
        named = has(word + r"(?:case|ticket|order|invoice|reference|ref|customer|application|request|account)\b", low) and has(word + r"(?:id|no|number)\b", low)
        return digits >= 14 or has(iban, bare) or named or has(r"(?i)\b(?:CUST|CASE|ORD|INV|APP|REF|ACC|MEM|INS|REQ|PR)-", value) or has(r"(?i)\b[A-Z]{2,6}(?:-[A-Z0-9]{1,12}){1,6}-\d{4,}\b", value)
    if lang == "zh":
        return digits >= 16 or has("编号|单号|订单|发票|合同|申请|工单|票据|客户|账号|账户|卡号|对公|税号", low) or has(r"(?i)\b(?:CUST|CASE|ORD|INV|APP|REF|ACC|REQ|TKT|TK|LC|CLM|LEGAL)-", value)
    nouns = r"\b(?:aktenzeichen|geschäftszeichen|kundennummer|rechnungsnummer|rechnungsnr|vorgangs-?id|referenz|ticketnummer|bestellnummer|antragsnummer)\b"
    return digits >= 16 or has(r"(?i)^DE\d{2}", bare) or has(r"\biban\b", low) or has(nouns, low) or has(r"(?i)\b(?:knd|re|ord|ab|ref|v|vg|js)[ \t]*[-/:][ \t]*", value) or has(iban, bare)


def value_of(rule, m):
    """Begin and length of a match's value within it, and whether the match counts."""
    full, g = m.group(), ["", *[x or "" for x in m.groups()], "", "", "", ""]
    number = g[2] or g[3] or g[4] or full
    label = rule.key != "phone" and rule.mode == "prefix" or rule.key == "phone" and rule.mode == "prefix"
    if rule.mode == "phone":
        return full.find(number), len(number), number, g[1]
    if label and (g[1] or g[2]):
        return (max(full.find(g[2], len(g[1])), 0) if g[2] else len(g[1])), len(g[2]), number, g[1]
    if rule.mode == "company" and rule.groups and g[1]:
        return full.find(g[1]), len(g[1]), number, g[1]
    return 0, len(full), number, g[1]


@pytest.fixture(scope="module")
def model():
    made = {}
    for lang in PACKS:
        raw = {k: (flags, pattern) for k, _, _, flags, pattern in PACKS[lang].RULES}
        made[lang] = [(r, compiled(raw[r.key][1], raw[r.key][0])) for r in plan_rules(ScrubConfig(lang=lang, enabled=frozenset(PACKS[lang].PRIORITY)))]

    default = {lang: {r.key for r in plan_rules(ScrubConfig(lang=lang))} for lang in PACKS}

    def masked(text, lang, every=False):
        hits = []
        for rule, pattern in made[lang]:
            if not every and rule.key not in default[lang]:
                continue
            for m in pattern.finditer(text):
                begin, size, number, label = value_of(rule, m)
                if m.group() and size > 0 and not (rule.key == "phone" and phone_is_none(lang, label, number)):
                    hits.append((rule.order, size, m.start() + begin, m.start() + begin + size, rule.key, rule.placeholder))
        kept = []
        for hit in sorted(hits, key=lambda h: h[:4]):
            if all(hit[3] <= k[2] or k[3] <= hit[2] for k in kept):
                kept.append(hit)
        kept.sort(key=lambda h: h[2])
        out, at = [], 0
        for _, _, a, b, _, mark in kept:
            out += [text[at:a], mark]
            at = b
        return "".join([*out, text[at:]]), kept

    return masked


@pytest.mark.parametrize("lang", sorted(PACKS))
def test_lines_of_every_rule_equal_the_model(spark, model, lang):
    """All rules on lines of each of them, alone and several in one text: hits of other rules on a line count as well."""
    lines = [head + value + tail for _, head, value, tail in rule_samples.SAMPLES[lang]]
    texts = [*lines, *["\n".join(lines[k : k + 9]) for k in range(0, len(lines), 5)], *[" ".join(lines[k : k + 3]) for k in range(0, len(lines), 4)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    config = ScrubConfig(lang=lang, enabled=frozenset(PACKS[lang].PRIORITY))
    got = {r.doc_id: ([(h.key, h.start, h.end) for h in r.hits], r.text_masked) for r in scrub.match(docs, config).select("doc_id", "hits", "text_masked").collect()}
    for k, text in enumerate(texts):
        want, kept = model(text, lang, every=True)
        assert got[k] == ([(h[4], h[2], h[3]) for h in kept], want), text


@pytest.fixture(scope="module")
def wanted(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    return {r.doc_id: (r.lang if r.lang in PACKS else "en", *model(r.text or "", r.lang if r.lang in PACKS else "en")) for r in rows}


def test_documents_equal_the_model(spark, wanted):
    got = {r.doc_id: r for r in queries.scrub_documents(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == wanted.keys() and CATALOG
    for doc, (lang, text, kept) in wanted.items():
        r = got[doc]
        assert (r.rule_lang, r.hit_count, r.masked_length) == (lang, len(kept), sum(k[3] - k[2] for k in kept)), doc
        assert r.masked_md5 == hashlib.md5(text.encode()).hexdigest(), doc
    assert sum(len(kept) for *_, kept in wanted.values()) > 40


def test_hits_by_key_and_risk_equal_the_model(spark, wanted):
    n, documents = collections.Counter(), collections.defaultdict(set)
    for doc, (lang, _, kept) in wanted.items():
        for k in kept:
            n[lang, k[4]] += 1
            documents[lang, k[4]].add(doc)
    got = {(r.rule_lang, r.key): (r.n, r.documents) for r in queries.hits_by_key(spark, "/root/testdata/sf0.01").collect()}
    assert got == {k: (c, len(documents[k])) for k, c in n.items()}
    levels = {(r.rule_lang, r.level): r.documents for r in queries.risk_levels(spark, "/root/testdata/sf0.01").collect()}
    assert sum(levels.values()) == len(wanted)
