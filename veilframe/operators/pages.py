"""Paged text: lines from positioned items, repeated headers and footers, quality gates, and the page of a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import to_java

#: How far items of one line may differ, the gap that makes a paragraph, edge lines, and the gates.
LINE_GAP, PARAGRAPH_GAP, EDGE_LINES, LAST_LINES = 1.2, 12, 5, 3
LEAST_TOTAL, LEAST_AVERAGE, WEAK_PAGE, LEAST_SHARE = 120, 80, 50, 0.15
LEAST_TEXT_LAYER, SUSPICIOUS_LENGTH, SUSPICIOUS_LINES = 20, 40, 3

# Patterns of page numbers, footers, protected lines and merged labels.
PAGE_LINES = [r"^page\s*\d+\s*(of|/)\s*\d+$", r"^\d+\s*/\s*\d+$", r"page\s*\d+\s*(of|/)\s*\d+"]
LEGAL_FORM = r"(?:GmbH|LLC|L\.?L\.?C\.?|Ltd\.?|Limited|Inc\.?|Incorporated|Corp\.?|Corporation|PLC|LLP)\b"
STREET = r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|dr\.?|way|boulevard|blvd\.?|court|ct\.?|place|pl\.?|square|sq\.?)\b"
POSTAL = r"\b\d{4,6}\s+[A-Za-zÀ-ÖØ-öø-ÿ'’.\- ]+\b"
PROTECTED = r"^(?:customer|account|reference|order|invoice|section|date|bill to|ship to|payment details|statement period)\s*:"
LABELS = [r"ticket\s*no\.?", r"case\s*id", r"email\s*:", r"phone\s*:", r"contact\s*:", r"ref\s*:", r"amount\s*:"]
# a phrase of up to seven words that comes again begins with three words that do, so three are looked for; a word gives no letter back, as it ends at no other place
REPEATED_PHRASE = r"\b([A-Za-z]{3,}+(?:\s+[A-Za-z]{3,}+){2})\b.*\b\1\b"

_J = to_java
_SPACE = _J(r"\s", "")


def norm_line(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), _J(r"\s") + "+", " "))


def is_page_line(s: Column) -> Column:
    out = F.lit(False)
    for p in PAGE_LINES:
        out = out | s.rlike(_J(p, "i"))
    return out


def is_footer_line(s: Column) -> Column:
    legal = s.rlike(_J(LEGAL_FORM))
    return (s != "") & (is_page_line(s) | (legal & s.rlike(_J(STREET, "i"))) | (s.rlike("[·|]") & (legal | s.rlike(_J(POSTAL)))))


def is_protected_line(s: Column) -> Column:
    return s.rlike(_J(PROTECTED, "i"))


def pretty_text(items: Column) -> Column:
    """Text of a page from its items (``str, transform``): lines from top to bottom, words from left to right, blank lines at large gaps."""
    row = lambda it: F.struct((-(F.floor(F.coalesce(it["transform"][5], F.lit(0.0)) * 2 + 0.5) / 2)).alias("down"), F.coalesce(it["transform"][4], F.lit(0.0)).alias("x"), norm_line(it["str"]).alias("s"))
    numbered = F.transform(F.filter(F.transform(items, row), lambda r: r["s"] != ""), lambda r, i: F.struct(r["down"], r["x"], i.alias("i"), r["s"]))
    # sorted items carry the height of their line's first item, which decides where the next line begins
    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<struct<line:double,x:double,i:int,s:string>>").alias("out"))

    def place(a: Column, r: Column) -> Column:
        line = F.when(a["y"].isNull() | (F.abs(a["y"] - r["down"]) > LINE_GAP), r["down"]).otherwise(a["y"])
        return F.struct(line.alias("y"), F.concat(a["out"], F.array(F.struct(line.alias("line"), r["x"], r["i"], r["s"]))).alias("out"))

    lined = F.array_sort(F.aggregate(F.array_sort(numbered), start, place, lambda a: a["out"]))
    han = "[\\u4E00-\\u9FFF]"

    def add(a: Column, r: Column) -> Column:
        spaced = ~a["text"].rlike(han + "\\z") & ~r["s"].rlike("^" + han) & ~r["s"].rlike("^[\\s)\\]}.,;:/]") & ~a["text"].rlike("[\\s\\-(\\[{/]\\z")
        same = F.concat(a["text"], F.when(spaced, F.lit(" ")).otherwise(F.lit("")), r["s"])
        fresh = F.concat(F.regexp_replace(a["text"], "[ \\t]+\\z", ""), F.when(r["line"] - a["y"] > PARAGRAPH_GAP, F.lit("\n\n")).otherwise(F.lit("\n")), r["s"])
        text = F.when(a["y"].isNull(), r["s"]).when(a["y"] == r["line"], same).otherwise(fresh)
        return F.struct(r["line"].alias("y"), text.alias("text"))

    joined = F.aggregate(lined, F.struct(F.lit(None).cast("double").alias("y"), F.lit("").alias("text")), add, lambda a: a["text"])
    return F.coalesce(F.trim(F.regexp_replace(joined, "\n{3,}", "\n\n")), F.lit(""))


def has_text_layer(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")) >= LEAST_TEXT_LAYER


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)


def repeated_edge_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, line`` of normalised lines that occur twice or more among the first and last five of a document's pages (documents of two pages or more).

    A page of fewer than ten lines counts lines in both of its edges.
    """
    lines = F.filter(F.transform(_lines(F.col("text")), norm_line), lambda s: s != "")
    edges = F.concat(F.slice(lines, 1, EDGE_LINES), F.slice(lines, F.greatest(F.size(lines) - EDGE_LINES + 1, F.lit(1)), F.lit(EDGE_LINES)))
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 2").select("doc_id")
    every = pages.select("doc_id", F.explode(edges).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 2")
    return every.join(counted, "doc_id", "left_semi").select("doc_id", "line")


def _cleaned(text: Column, repeated: Column) -> Column:
    lines = _lines(text)
    last = F.size(lines) - 1

    def keep(raw: Column, i: Column) -> Column:
        s = norm_line(raw)
        edge = (i <= EDGE_LINES - 1) | (i >= last - (EDGE_LINES - 1))
        drop = is_page_line(s) | (~is_protected_line(s) & ((F.array_contains(repeated, s) & edge) | ((i >= last - (LAST_LINES - 1)) & is_footer_line(s))))
        return F.when((s == "") | ~drop, raw)

    return F.trim(F.regexp_replace(F.array_join(F.transform(lines, keep), "\n"), "^\\s+|\\s+\\z", ""))


def without_headers(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, text``: pages without page numbers, repeated edge lines and footers.  The repeated lines of a document are joined as an array."""
    repeated = repeated_edge_lines(pages).groupBy("doc_id").agg(F.collect_set("line").alias("repeated"))
    joined = pages.join(repeated, "doc_id", "left").withColumn("repeated", F.coalesce("repeated", F.array().cast("array<string>")))
    return joined.select("doc_id", "page_number", _cleaned(F.col("text"), F.col("repeated")).alias("text"))


def joined_text(items: Column) -> Column:
    """Non-empty strings of a page's items in their given order, a blank between."""
    return F.array_join(F.filter(F.transform(items, lambda it: it["str"]), lambda s: s != ""), " ")


def with_item_text(pages: DataFrame) -> DataFrame:
    """Pages (``text, items``) whose empty or null ``text`` is the joined text of their items; other pages and columns stay."""
    return pages.withColumn("text", F.coalesce(F.nullif(F.col("text"), F.lit("")), joined_text(F.coalesce("items", F.array().cast(pages.schema["items"].dataType))), F.lit("")))


def document_text(pages: DataFrame) -> DataFrame:
    """``doc_id, text``: non-empty pages in order, a blank line between."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    texts = F.filter(F.transform(ordered, lambda p: p["text"]), lambda t: t != "")
    return pages.groupBy("doc_id").agg(F.array_join(texts, "\n\n").alias("text"))


def is_suspicious_line(line: Column) -> Column:
    s = norm_line(line)
    labels = F.lit(0)
    for p in LABELS:
        labels = labels + F.regexp_count(s, F.lit(_J(p, "i")))
    bars = F.regexp_count(s, F.lit("[·|]"))
    return (F.length(s) >= SUSPICIOUS_LENGTH) & ((labels >= 2) | s.rlike(_J(REPEATED_PHRASE, "i")) | ((bars >= 4) & (labels >= 1)))


def modes(pages: DataFrame) -> DataFrame:
    """``doc_id, coverage_usable, semantic_usable, mode``: both gates and the mode of each document, in one pass of the pages and one shuffle of numbers.

    Coverage: enough text is left after cleaning page by page.  Semantic: no page has three merged lines.  Mode: A (readable text) if there is a text layer and both gates pass, else B (manual redaction).
    """
    alone = _cleaned(F.col("text"), F.array().cast("array<string>"))
    merged = F.size(F.filter(_lines(F.col("text")), is_suspicious_line))
    whole = F.coalesce("text", F.lit(""))
    each = pages.select("doc_id", F.length(alone).alias("kept"), F.length(whole).alias("raw"), F.length(F.regexp_replace(whole, _SPACE, "")).alias("chars"), (merged >= SUSPICIOUS_LINES).alias("bad"))
    told = each.groupBy("doc_id").agg(F.sum("kept").alias("total"), F.count("*").alias("n"), F.sum((F.col("kept") < WEAK_PAGE).cast("int")).alias("weak"), F.sum("raw").alias("raw"), F.sum("chars").alias("chars"), F.max("bad").alias("bad"))
    usable = (F.col("total") >= LEAST_TOTAL) & (F.col("total") / F.col("n") >= LEAST_AVERAGE) & (F.col("weak") <= F.floor(F.col("n") / 2)) & ~((F.col("raw") > 0) & (F.col("total") / F.greatest("raw", F.lit(1)) < LEAST_SHARE))
    out = told.select("doc_id", "chars", usable.alias("coverage_usable"), (~F.col("bad")).alias("semantic_usable"))
    return out.select("doc_id", "coverage_usable", "semantic_usable", F.when((F.col("chars") >= LEAST_TEXT_LAYER) & F.col("coverage_usable") & F.col("semantic_usable"), "A").otherwise("B").alias("mode"))


def gates(pages: DataFrame) -> DataFrame:
    """The gates of :func:`modes`: ``doc_id, coverage_usable, semantic_usable``."""
    return modes(pages).drop("mode")


def mode(pages: DataFrame) -> DataFrame:
    """The mode of :func:`modes`: ``doc_id, mode``, of documents with an id."""
    return modes(pages).where("doc_id IS NOT NULL").select("doc_id", "mode")


def segments(pages: Column, text: Column) -> Column:
    """Places of pages in a document's text: found one after another; if one is missing, laid end to end with two characters between.  ``pages``: array of ``page_number, text``."""
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.array().cast("array<struct<page:int,start:int,end:int>>").alias("out"))
    seg = lambda p, a, b: F.array(F.struct(p["page_number"].cast("int").alias("page"), a.cast("int").alias("start"), b.cast("int").alias("end")))

    def find(a: Column, p: Column) -> Column:
        t = F.coalesce(p["text"], F.lit(""))
        got = F.call_function("locate", t, text, a["at"] + 1)
        here = F.when(t == "", a["at"]).otherwise(got - 1)
        end = here + F.length(t)
        return F.struct(end.cast("int").alias("at"), (a["ok"] & ((t == "") | (got > 0))).alias("ok"), F.concat(a["out"], seg(p, here, end)).alias("out"))

    def lay(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(F.coalesce(p["text"], F.lit("")))
        return F.struct((end + 2).cast("int").alias("at"), a["ok"], F.concat(a["out"], seg(p, a["at"], end)).alias("out"))

    found = F.aggregate(pages, start, find)
    return F.when((text != "") & found["ok"], found["out"]).otherwise(F.aggregate(pages, start, lay)["out"])


def page_of(segs: Column, start: Column, end: Column) -> Column:
    """First page that a hit meets, else the first whose bounds hold its start."""
    met = F.filter(segs, lambda s: (start < s["end"]) & (end > s["start"]))
    near = F.filter(segs, lambda s: (start >= s["start"]) & (start <= s["end"]))
    return F.coalesce(F.get(met, 0)["page"], F.get(near, 0)["page"])


def with_pages(matched: DataFrame, pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``page`` to each of ``hits`` of :func:`..scrub.match` output, from a table of pages (``doc_id, page_number, text``)."""
    grouped = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("_pages"))
    joined = matched.join(grouped, "doc_id", "left").withColumn("_segs", segments(F.col("_pages"), F.coalesce(F.col(text), F.lit(""))))
    return joined.withColumn("hits", F.transform("hits", lambda h: h.withField("page", page_of(F.col("_segs"), h["start"], h["end"])))).drop("_pages", "_segs")


def page_offsets(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, start, end`` of pages joined by two characters."""
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(F.coalesce("text", F.lit("")))
    return pages.select("doc_id", "page_number", F.coalesce(F.sum(n + 2).over(before), F.lit(0)).alias("start"), n.alias("n")).select("doc_id", "page_number", "start", (F.col("start") + F.col("n")).alias("end"))
