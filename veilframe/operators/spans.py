"""Span extraction with exact offsets, guards, conflict resolution and hit records.

Offsets are in code points.  One ``regexp_replace`` a rule wraps its matches and their groups in private-use marks; splitting at the marks
and adding up lengths gives places and groups.  Rules whose required strings a text lacks do not see it.  Hits that overlap are settled, and texts spliced, by a
small Arrow function, in time that grows with the hits and not with their square.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import arrow_function
from ..functions.required import DIGITS, ends_sql, folded_sql
from ..plans.config import Rule, ScrubConfig, category_of, group_of, norm_lang, plan_rules

#: Marks around a match, and what stands for them where a text holds them itself.
OPEN, CLOSE, STAND_INS = "\ue100", "\ue101", "\ue102\ue103"

#: Matches in a stretch of running sums.
STRETCH = 64

HIT = "struct<key:string,source:string,ord:int,start:int,end:int,text:string,placeholder:string,mode:string,tag:string,term:string,full:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and names it in ``body``."""
    return F.transform(F.array(value), body)[0]


def clean(text: Column) -> Column:
    """Null as empty, NUL removed, line ends as LF."""
    out = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "\\x00", "")
    return F.regexp_replace(out, "\r\n?", "\n")


def unmarked(text: Column) -> Column:
    """The text with the marks replaced by stand-ins, character for character."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), OPEN + CLOSE, STAND_INS)


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# What says that a number is none of a phone, by language: digits from which it is too long (the empty one: without a guard of its own), words of its label, and codes that begin it.
TOO_LONG = {"en": 14, "de": 16, "zh": 16, "": 16}
EN_NOUNS, EN_MARKS = "case|ticket|order|invoice|reference|ref|customer|application|request|account", "id|no|number"
DE_NOUNS = "aktenzeichen|geschäftszeichen|kundennummer|rechnungsnummer|rechnungsnr|vorgangs-?id|referenz|ticketnummer|bestellnummer|antragsnummer"
ZH_NOUNS = "编号|单号|订单|发票|合同|申请|工单|票据|客户|账号|账户|卡号|对公|税号"
EN_CODES, ZH_CODES, DE_CODES = "CUST|CASE|ORD|INV|APP|REF|ACC|MEM|INS|REQ|PR", "CUST|CASE|ORD|INV|APP|REF|ACC|REQ|TKT|TK|LC|CLM|LEGAL", "knd|re|ord|ab|ref|v|vg|js"


def phone_guard(lang: str, label: str, value: str) -> str:
    """SQL condition under which a phone match counts: long ids, account numbers and references are not phones (fixed word lists by language)."""
    word, ends = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
    iban = "(?i)^[A-Z]{2}\\d{2}(?:[ \\t]?[A-Z0-9]{3,5}){2,9}\\z"
    test = lambda x, pattern: f"{x} RLIKE {quoted(pattern)}"
    digits = f"length(regexp_replace({value}, '[^0-9]', ''))"
    low, bare = f"lower({label})", f"trim({value})"
    if lang == "en":
        ids = test(low, f"{word}(?:{EN_NOUNS}){ends}") + " AND " + test(low, f"{word}(?:{EN_MARKS}){ends}")
        codes = test(value, f"(?i){word}(?:{EN_CODES})-") + " OR " + test(value, f"(?i){word}[A-Z]{{2,6}}(?:-[A-Z0-9]{{1,12}}){{1,6}}-\\d{{4,}}{ends}")
        no = [f"{digits} >= {TOO_LONG['en']}", test(bare, iban), ids, codes]
    elif lang == "de":
        no = [f"{digits} >= {TOO_LONG['de']}", test(bare, "(?i)^DE\\d{2}"), test(low, f"{word}iban{ends}"), test(low, f"(?iu){word}(?:{DE_NOUNS}){ends}"), test(value, f"(?i){word}(?:{DE_CODES})[ \\t]*[-/:][ \\t]*"), test(bare, iban)]
    elif lang != "zh":
        no = [f"{digits} >= {TOO_LONG['']}"]  # a pack without a guard of its own
    else:
        no = [f"{digits} >= {TOO_LONG['zh']}", test(low, ZH_NOUNS), test(value, f"(?i){word}(?:{ZH_CODES})-")]
    return "NOT (" + " OR ".join(f"({x})" for x in no) + ")"


def needed(rule: Rule, fold: str, digit: str) -> str:
    """SQL condition that any text with a match fulfils: ``fold`` is the folded text, ``digit`` whether it has one."""
    some = lambda s: [f"contains({fold}, {quoted(x)})" for x in sorted(s - DIGITS if s >= DIGITS else s)] + [digit] * (s >= DIGITS)
    tests = ["(" + " OR ".join(some(s)) + ")" for s in rule.needs]
    return " AND ".join(tests) or "true"


def ended(rule: Rule, ends: str) -> str:
    """SQL condition that any text with a match fulfils: ``ends`` is its form in which a label's end stands right before a colon."""
    return f"contains({ends}, ':') AND (" + " OR ".join(f"contains({ends}, {quoted(x)})" for x in sorted(rule.ends)) + ") AND " if rule.ends else ""


#: Which part of a match is its value: all of it, the group after a label, the first group of a phone number, a group.
ALL, AFTER_LABEL, NUMBER, GROUP = range(4)


def _value_of(rule: Rule) -> tuple[int, list[int]]:
    """What a rule's value is, and the pattern's groups that tell it."""
    if rule.key == "phone" or rule.mode == "phone":
        return (NUMBER if rule.mode == "phone" else AFTER_LABEL if rule.mode == "prefix" else ALL), [g for g in (1, 2, 3, 4) if g <= rule.groups]
    if rule.mode == "prefix":
        return AFTER_LABEL, [g for g in (1, 2) if g <= rule.groups]
    if rule.mode in ("company", "manual") and rule.groups:
        return GROUP, [1 if rule.mode == "company" else rule.groups]
    return ALL, []


def hits_sql(text: str, rules: list[Rule], lang: str, parity: bool = False) -> str:
    """SQL expression: array of hits of the rules over the column ``text``, in the rules' order.  Patterns are literals, so Spark compiles each once.

    Per rule there is only its test and its one replacement, so its pattern passes a text once; places, values, guards and records are one expression over what was found, which
    keeps the plan small.  A value that stands apart from its label has its own range; ``parity`` lets it begin where the label ends, as the original does.
    """
    found, kinds = [], []
    for k, rule in enumerate(rules):
        kind, held = _value_of(rule)
        kinds.append(kind)
        pattern = quoted(rule.pattern)
        groups = "".join(OPEN + (f"${held[g]}" if g < len(held) else "") for g in range(4))
        found.append(f"named_struct('rule', {k + 1}, 'marked', CASE WHEN {ended(rule, 'z.ends')}{needed(rule, 'z.fold', 'z.digit')} THEN regexp_replace({text}, {pattern}, '{OPEN}$0{groups}{OPEN}') END)")
    table = lambda values: f"element_at(array({', '.join(values)}), w.rule)"
    kind = table([str(k) for k in kinds])
    full, at, *group = "w.parts[i * 6 + 1]", "w.starts[i]", *[f"w.parts[i * 6 + {2 + g}]" for g in range(4)]
    first = "coalesce(" + ", ".join([f"nullif({g}, '')" for g in group[1:]] + [full]) + ")"
    # ranges within the match
    apart = f"length({group[0]})" if parity else f"IF({group[1]} = '', length({group[0]}), greatest(locate({group[1]}, {full}, length({group[0]}) + 1) - 1, 0))"
    labelled, grouped = f"{kind} = {AFTER_LABEL} AND ({group[0]} <> '' OR {group[1]} <> '')", f"{kind} = {GROUP} AND {group[0]} <> ''"
    begin = f"CASE WHEN {labelled} THEN {apart} WHEN {kind} = {NUMBER} THEN locate({first}, {full}) - 1 WHEN {grouped} THEN locate({group[0]}, {full}) - 1 ELSE 0 END"
    size = f"CASE WHEN {labelled} THEN length({group[1]}) WHEN {kind} = {NUMBER} THEN length({first}) WHEN {grouped} THEN length({group[0]}) ELSE length({full}) END"
    phone = any(r.key == "phone" for r in rules)
    good = f"IF({table([quoted(r.key) for r in rules])} = 'phone', {phone_guard(lang, group[0], first)}, true)" if phone else "true"
    lengths = "transform(sequence(0, cast((size(s.parts) - 1) / 6 AS int) - 1), i -> named_struct('gap', length(s.parts[i * 6]), 'all', length(s.parts[i * 6]) + length(s.parts[i * 6 + 1])))"
    # starts are running sums: of stretches first, then within a stretch, so that no array grows one by one
    total = lambda x: f"aggregate({x}, 0, (a, x) -> a + x.all)"
    stretches = f"transform(sequence(0, cast((size(s.lengths) - 1) / {STRETCH} AS int)), q -> {total(f'slice(s.lengths, q * {STRETCH} + 1, {STRETCH})')})"
    heads = "aggregate(s.stretches, named_struct('at', 0, 'all', cast(array() AS array<int>)), (a, p) -> named_struct('at', a.at + p, 'all', concat(a.all, array(a.at))), a -> a.all)"
    start = f"s.heads[cast(i / {STRETCH} AS int)] + {total(f'slice(s.lengths, cast(i / {STRETCH} AS int) * {STRETCH} + 1, i % {STRETCH})')} + x.gap"
    # a rule that replaced nothing left the text as it was; one mark for all, six parts a match: Java splits at a single sign without a pattern
    bound = f"transform(filter(array({', '.join(found)}), m -> m.marked <> {text}), m -> named_struct('rule', m.rule, 'parts', split(m.marked, '{OPEN}', -1)))"
    bound = f"transform({bound}, s -> named_struct('rule', s.rule, 'parts', s.parts, 'lengths', {lengths}))"
    bound = f"transform({bound}, s -> named_struct('rule', s.rule, 'parts', s.parts, 'lengths', s.lengths, 'stretches', {stretches}))"
    bound = f"transform({bound}, s -> named_struct('rule', s.rule, 'parts', s.parts, 'lengths', s.lengths, 'heads', {heads}))"
    bound = f"transform({bound}, s -> named_struct('rule', s.rule, 'parts', s.parts, 'starts', transform(s.lengths, (x, i) -> {start})))"
    hit = f"named_struct('at', {at}, 'a', {begin}, 'n', {size}, 'full', {full}, 'good', {good})"
    field = lambda read: table([quoted(read(r)) for r in rules])
    record = (
        f"named_struct('key', {field(lambda r: r.key)}, 'source', {field(lambda r: 'manual' if r.mode == 'manual' else 'rule')}, 'ord', {table([str(r.order) for r in rules])}, 'start', h.at + h.a, 'end', h.at + h.a + h.n, "
        f"'text', substring(h.full, h.a + 1, h.n), 'placeholder', {field(lambda r: r.placeholder)}, 'mode', {field(lambda r: r.mode)}, 'tag', {field(lambda r: r.tag)}, 'term', {field(lambda r: r.term)}, 'full', h.full)"
    )
    hits = f"transform({bound}, w -> transform(filter(transform(sequence(0, size(w.starts) - 1), i -> {hit}), h -> h.good AND h.full <> '' AND h.n > 0), h -> {record}))"
    told = f"transform(array(named_struct('fold', {folded_sql(text)}, 'digit', {text} RLIKE '[0-9]')), z -> named_struct('fold', z.fold, 'digit', z.digit, 'ends', {ends_sql('z.fold')}))"
    return f"transform({told}, z -> flatten({hits}))[0]"


def rule_hits(text: str, rule: Rule, lang: str) -> str:
    """:func:`hits_sql` of one rule."""
    return hits_sql(text, [rule], lang)


def hits_of(text: str, rules: list[Rule], lang: str, parity: bool = False) -> Column:
    """All hits of the given rules over the text in the column named ``text``, which is folded once for all of them."""
    return F.expr(hits_sql(text, rules, lang, parity)) if rules else F.array().cast(f"array<{HIT}>")


def raw_hits(text: str, config: ScrubConfig) -> Column:
    """All hits of all planned rules over the original text in the column named ``text`` (rules do not see each other's masks)."""
    return hits_of(text, plan_rules(config), norm_lang(config.lang) or "zh", config.parity)


_SETTLED = pa.struct([("kept", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("masked", pa.string())])


def settle(late: list[bool], order: list[int], start: list[int], end: list[int]) -> list[int]:
    """Hits that do not overlap, by place: manual terms first, then by rule order, shorter, earlier; a hit is kept if it meets none kept before.

    Kept hits do not overlap, so only the nearest kept ones on either side can meet the next.
    """
    places: list[int] = []
    ends: dict[int, int] = {}
    kept: dict[int, int] = {}
    for k in sorted(range(len(start)), key=lambda k: (late[k], order[k], end[k] - start[k], start[k], end[k])):
        at = bisect.bisect_left(places, end[k])  # kept hits that begin before its end
        if at and ends[places[at - 1]] > start[k]:
            continue
        places.insert(at, start[k])
        ends[start[k]], kept[start[k]] = end[k], k
    return [kept[p] for p in places]


def _settled(texts: list[str | None], hits: list[dict | None]) -> list[dict | None]:
    out = []
    for text, h in zip(texts, hits, strict=True):
        if h is None:
            out.append(None)
            continue
        text = text or ""
        kept = settle(h["late"], h["order"], h["start"], h["end"])
        wide = [k for k, c in enumerate(text) if c > "\uffff"] if text and max(text) > "\uffff" else []
        units = lambda n, wide=wide: n + bisect.bisect_left(wide, n)
        pieces, at = [], 0
        for k in kept:
            pieces += [text[at : h["start"][k]], h["mask"][k]]
            at = h["end"][k]
        out.append({"kept": kept, "starts": [units(h["start"][k]) for k in kept], "ends": [units(h["end"][k]) for k in kept], "masked": "".join([*pieces, text[at:]])})
    return out


def settled(hits: Column, text: Column | None = None, mask: Callable[[Column], Column] = lambda h: h["placeholder"]) -> Column:
    """``kept`` (indexes of the hits that stay, by place), ``starts, ends`` in UTF-16 units, and ``masked``, the text with those hits replaced.  Null for null hits."""
    column = lambda f: F.transform(hits, f)
    told = F.struct(column(lambda h: h["source"] != "manual").alias("late"), column(lambda h: h["ord"]).alias("order"), column(lambda h: h["start"]).alias("start"), column(lambda h: h["end"]).alias("end"), column(mask).alias("mask"))
    spark = SparkSession.active()
    kind = "struct<kept:array<int>,starts:array<int>,ends:array<int>,masked:string>"
    whole, some = F.lit("") if text is None else text, F.size(hits) > 0
    none = F.array().cast("array<int>")
    # a text without hits is its own result and does not go to the workers
    done = arrow_function(spark, _settled, kind, _SETTLED)(F.when(some, whole), F.when(some, told))
    return F.when(F.size(hits) == 0, F.struct(none.alias("kept"), none.alias("starts"), none.alias("ends"), whole.alias("masked"))).otherwise(done)


def resolve(hits: Column) -> Column:
    """Hits that do not overlap, sorted by place (:func:`settle`)."""
    return let(F.struct(hits.alias("hits"), settled(hits)["kept"].alias("kept")), lambda s: F.transform(s["kept"], lambda k: F.get(s["hits"], k)))


def _lookup(table: dict[str, str], key: Column, otherwise: str) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(otherwise))


def standard_hits(hits: Column, starts: Column, ends: Column, lang: str | Column) -> Column:
    """Standard records of resolved hits: id in output order, category, type, risk level, offsets in code points and (given) in UTF-16 units."""
    categories, risks = category_of(), group_of()
    lang = F.lit(lang) if isinstance(lang, str) else lang

    def record(h: Column, i: Column) -> Column:
        category = _lookup(categories, h["key"], "other")
        return F.struct(
            F.format_string("hit_%06d", i + 1).alias("id"), h["key"].alias("key"), F.when(category == "business", "business").otherwise("pii").alias("type"), category.alias("category"),
            _lookup(risks, h["key"], "unknown").alias("risk_level"), h["start"].alias("start"), h["end"].alias("end"), F.get(starts, i).alias("start_utf16"), F.get(ends, i).alias("end_utf16"),
            h["text"].alias("text"), h["placeholder"].alias("masked"), F.lit(1.0).alias("confidence"), F.struct(lang.alias("lang"), lang.alias("pack"), h["key"].alias("rule_id")).alias("rule"),
            F.struct(h["tag"].alias("label"), h["mode"].alias("match_mode"), h["source"].alias("source"), h["tag"].alias("tag"), h["term"].alias("manual_term"), h["full"].alias("full_match")).alias("meta"),
        )

    return F.transform(hits, record)


def spliced(text: Column, hits: Column, mask: Callable[[Column], Column]) -> Column:
    """The text with each hit replaced, left to right; a hit that starts before the last one's end is skipped."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, h: F.when(h["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, h["start"] - a["at"]), mask(h)).alias("out"), h["end"].alias("at")))
    return F.aggregate(hits, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
