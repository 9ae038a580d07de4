"""Spans with a preferred part: matches over a page's items in their given order, which part of each is the value, and spans merged with their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import ordered_groups
from ..functions.pattern_table import matches
from ..plans.tuning import LONGEST, NAME_KEYS
from .geometry import LONGEST_SPAN

#: Longest manual term, and what may follow a phone number.
LONGEST_TERM = 90
MESSENGER = r"(?i)^\s*(?:\(|（)(?:WhatsApp|WeChat|Telegram|Signal)(?:\)|）)"


def run_text(items: Column) -> Column:
    """``text, ranges`` of a page's items (``str, hasEOL``) in their given order: a blank between two ASCII letters or digits unless the later item ends a line, and a line break after an item that does."""
    row = lambda it, i: F.struct(i.cast("int").alias("idx"), it["str"].alias("s"), F.coalesce(it["hasEOL"], F.lit(False)).alias("eol"))
    some = F.filter(F.transform(items, row), lambda r: F.coalesce(r["s"], F.lit("")) != "")
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<idx:int,start:int,end:int>>").alias("ranges"))

    def add(a: Column, r: Column) -> Column:
        blank = F.when(F.right(a["text"], F.lit(1)).rlike("[A-Za-z0-9]") & F.left(r["s"], F.lit(1)).rlike("[A-Za-z0-9]") & ~r["eol"], " ").otherwise("")
        at = F.length(a["text"]) + F.length(blank)
        place = F.struct(r["idx"].alias("idx"), at.alias("start"), (at + F.length(r["s"])).alias("end"))
        return F.struct(F.concat(a["text"], blank, r["s"], F.when(r["eol"], "\n").otherwise("")).alias("text"), F.concat(a["ranges"], F.array(place)).alias("ranges"))

    return F.aggregate(F.coalesce(some, F.array().cast("array<struct<idx:int,s:string,eol:boolean>>")), start, add)


def _part(key: Column, value: Column, groups: Column) -> Column:
    """The text that a match prefers to show as its value, or null: by key, the groups that may hold it."""
    group = lambda n, least=1: F.when(F.length(F.get(groups, n - 1)) >= least, F.get(groups, n - 1))
    longest = F.array_sort(F.transform(F.array_compact(F.array(group(2), group(3), group(4))), lambda g, i: F.struct((-F.length(g)).alias("n"), i.alias("i"), g.alias("g"))))
    return (
        F.when(key == "company", F.coalesce(group(2, 2), group(5, 2)))
        .when(key.isin(*NAME_KEYS), F.coalesce(group(1, 2), group(2, 2), value))
        .when(key == "account", group(2))
        .when(key == "phone", F.get(longest, 0)["g"])
        .when(key.isin("money", "money_label"), F.coalesce(group(2), group(4), group(5)))
    )


def preferred_spans(pages: DataFrame, patterns: dict[str, str], longest: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, page_number, key, a, b, part_a, part_b`` of the patterns' matches on each page (``text`` as :func:`run_text` joins it), merged.

    A match that runs over a line break or is longer than its key allows is no span.  ``part_a, part_b`` are places from the span's start on (null: no part is preferred).  In order of
    place, a span that begins before the last one's end, or at it, joins that one if both are of one key: equal parts stay, different ones cancel, and a part that only one has is
    kept as it stands, counted from the joined span's start, as the original does.  ``patterns``: by key, in the order of the rules, of the ``regex`` module.  A page's spans are held at once.
    """
    longest = LONGEST if longest is None else longest
    lined = pages.select("doc_id", "page_number", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\0")).alias("text"))
    found = matches(lined, patterns)
    key, value = F.col("key"), F.col("value")
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in longest.items() for x in kv]), key), F.lit(LONGEST_SPAN)) if longest else F.lit(LONGEST_SPAN)
    found = found.where((F.col("end") - F.col("start") <= limit) & ~F.contains(value, F.lit("\0")))
    # a manual term is narrowed to its own characters; others carry their part along
    term = F.coalesce(F.get("groups", 1), F.get("groups", 0))
    inner = F.when((key == "manual_term") & (term != ""), F.call_function("locate", term, value))
    a = F.col("start") + F.when(inner > 0, inner - 1).otherwise(0)
    b = F.when(inner > 0, a + F.length(term)).otherwise(F.col("end"))
    part = _part(key, value, F.col("groups"))
    at = F.call_function("locate", part, value) - 1
    tail = F.when(key == "phone", F.length(F.regexp_extract(F.substring(value, at + F.length(part) + 1, F.length(value)), MESSENGER, 0))).otherwise(0)
    order = F.array_position(F.array(*[F.lit(k) for k in patterns]), key).cast("int")
    spans = found.select("doc_id", "page_number", a.cast("int").alias("a"), b.cast("int").alias("b"), order.alias("ord"), "key", F.when(at >= 0, at).cast("int").alias("part_a"), F.when(at >= 0, at + F.length(part) + tail).cast("int").alias("part_b"))
    spans = spans.where((key != "manual_term") | (F.col("b") - F.col("a") <= longest.get("manual_term", LONGEST_TERM)))

    def fold(rows: list[tuple]) -> list[tuple]:
        out: list[list] = []
        for _, _, a, b, _, key, part_a, part_b in rows:
            part = None if part_a is None else (part_a, part_b)
            if out and out[-1][0] == key and a <= out[-1][2]:
                last = out[-1]
                last[2] = max(last[2], b)
                last[3] = (last[3] if last[3] == part else None) if last[3] and part else last[3] or part
            else:
                out.append([key, a, b, part])
        return [(*rows[0][:2], key, a, b, *(part or (None, None))) for key, a, b, part in out]

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return ordered_groups(spans, ["doc_id", "page_number"], ["a", "b", "ord", "part_a", "part_b"], fold, f"doc_id {kind('doc_id')}, page_number {kind('page_number')}, key string, a int, b int, part_a int, part_b int")
