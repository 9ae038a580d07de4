"""The older, sequential mode: each rule rewrites what the rules before it left.  Chained replacements, one projection, no shuffle.

:func:`..scrub.match` is the semantics; this mode is for outputs that must equal those of the older path.  It keeps no offsets: a
match of a labelled rule is its label, a placeholder and whatever follows the value; a company keeps its legal form (in Chinese also
the last words of its name, which say its trade); a phone match that the guard refuses stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Rule, ScrubConfig, norm_lang, plan_rules
from .spans import CLOSE, OPEN, let, rule_hits, spliced, unmarked

#: Private-use characters around the number of a placeholder that the text already held, and between the parts of a company.
HELD, RELEASED, BETWEEN = "\ue000", "\ue001", "\ue104"
# Labelled rules whose matches go on after the value, or have a gap before it.
PLACED = ("person_name_title_line", "account_holder_name_keep_title", "person_name_keep_title", "person_name_broken_ocr", "titled_name_bare_multiline")
# Bracketed placeholders that are protected (full-width ones are by their brackets), and words for a company's trade.
PROTECTED = ["Telefon", "E-Mail", "URL", "Geheim", "Konto", "Adresse", "Handle", "Referenz", "Anrede", "Zahl", "Betrag", "Firma", "Name", "Phone", "Email", "Secret", "Account", "Address", "Ref", "Title", "Number", "Amount", "Company", "REDACTED"]
TRADES = ["网络科技", "科技", "数据服务", "品牌管理", "创新股份", "创新", "信息技术", "技术", "咨询", "服务", "贸易", "传媒", "物流", "电子", "软件", "金融", "投资", "实业", "工程", "建筑", "教育", "医疗", "广告", "文化", "餐饮", "供应链", "电商", "互联网", "事务所"]
TRADE_WITHIN, TAIL = 10, 4
HOUSE_NUMBER = r"([一-鿿]{1,40}(?:路|街|道|大道|巷|弄|里|坊|胡同|区|镇|村|桥|湾|园|城|厦|楼))[ \t]*(\d{1,6}(?:-\d{1,4})?[ \t]*号)"
KEPT = "【[^【】\\n\\r]{1,120}】|\\[(?:" + "|".join(PROTECTED) + ")\\]"


def protected(text: Column) -> Column:
    """``text, held``: placeholders replaced by their numbers between two private-use characters, and the placeholders."""
    split = lambda t: F.struct(F.split(t, KEPT, -1).alias("parts"), F.regexp_extract_all(t, F.lit(KEPT), F.lit(0)).alias("held"))
    numbered = lambda s: F.array_join(F.transform(s["parts"], lambda p, i: F.when(i < F.size(s["held"]), F.concat(p, F.lit(HELD), i.cast("string"), F.lit(RELEASED))).otherwise(p)), "")
    return let(let(text, split), lambda s: F.struct(numbered(s).alias("text"), s["held"].alias("held")))


def restored(text: Column, held: Column) -> Column:
    """The text with its numbers turned back into the placeholders."""
    both = F.transform(held, lambda h, i: F.struct(F.concat(F.lit(HELD), i.cast("string"), F.lit(RELEASED)).alias("mark"), h.alias("was")))
    return F.aggregate(both, text, lambda t, b: F.replace(t, b["mark"], b["was"]))


def _literal(placeholder: str) -> str:
    return placeholder.replace("\\", "\\\\").replace("$", "\\$")


def _companies(text: Column, rule: Rule, lang: str) -> Column:
    legal = "${legal}" if "(?<legal>" in rule.pattern else ""
    if lang != "zh" or not legal:
        return F.regexp_replace(text, rule.pattern, _literal(rule.placeholder) + legal)
    marked = F.regexp_replace(text, rule.pattern, f"{OPEN}${{name}}{BETWEEN}{legal}{CLOSE}")
    inner = f"[^{OPEN}{BETWEEN}{CLOSE}]"
    for word in TRADES:  # the first trade in order that stands near the end of the name
        marked = F.regexp_replace(marked, f"{OPEN}{inner}*({word}{inner}{{0,{TRADE_WITHIN - len(word)}}}){BETWEEN}({inner}*){CLOSE}", _literal(rule.placeholder) + "$1$2")
    marked = F.regexp_replace(marked, f"{OPEN}{inner}+({inner}{{{TAIL}}}){BETWEEN}({inner}*){CLOSE}", _literal(rule.placeholder) + "$1$2")
    return F.regexp_replace(marked, f"{OPEN}{inner}*{BETWEEN}({inner}*){CLOSE}", _literal(rule.placeholder) + "$1")


def house_numbers_masked(value: Column, placeholder: str) -> Column:
    """Only the house numbers after a road word are masked; a value without any is masked whole."""
    return F.when(value.rlike(HOUSE_NUMBER), F.regexp_replace(value, HOUSE_NUMBER, "$1" + _literal(placeholder))).otherwise(F.lit(placeholder))


def rewritten(text: Column, rule: Rule, lang: str) -> Column:
    """The text after one rule that needs no places of its matches."""
    if rule.mode == "company":
        return _companies(text, rule, lang)
    if rule.mode in ("prefix", "prefix_keep_tail") and rule.groups >= 1:
        return F.regexp_replace(text, rule.pattern, "$1" + _literal(rule.placeholder) + ("$3" if rule.mode == "prefix_keep_tail" and rule.groups >= 3 else ""))
    if rule.mode == "manual" and rule.groups:
        return F.regexp_replace(text, rule.pattern, "$1" + _literal(rule.placeholder))
    return F.regexp_replace(text, rule.pattern, _literal(rule.placeholder))


def scrub_sequential(docs: DataFrame, config: ScrubConfig, text: str = "text") -> DataFrame:
    """Adds ``text_masked`` by the sequential mode.  A null text is empty.

    Manual terms go first, then placeholders (the text's own and those of the terms) are protected, then the rules run in order.  Each
    step is a column of its own that the next one reads, so the plan stays linear in the number of rules.
    """
    lang = norm_lang(config.lang) or "zh"
    rules = plan_rules(config)
    manual = [r for r in rules if r.mode == "manual"]
    out = unmarked(F.col(text))
    for rule in manual:
        out = rewritten(out, rule, lang)
    done = docs.withColumn("_p", protected(out)).withColumn("_t", F.col("_p.text"))
    for rule in (r for r in rules if r.mode != "manual"):
        if rule.key in ("phone", *PLACED) or rule.mode == "address_cn_partial":
            mask = (lambda h, r=rule: house_numbers_masked(h["text"], r.placeholder)) if rule.mode == "address_cn_partial" else (lambda h: h["placeholder"])
            hits = F.expr(rule_hits("_t", rule, lang))
            done = done.withColumn("_t", F.when(hits.isNotNull(), spliced(F.col("_t"), hits, mask)).otherwise(F.col("_t")))
        else:
            done = done.withColumn("_t", rewritten(F.col("_t"), rule, lang))
    return done.withColumn("text_masked", restored(F.col("_t"), F.col("_p.held"))).drop("_p", "_t")

