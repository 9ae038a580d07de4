"""A user's own rectangles as they are edited: drags, taps that delete the topmost one, undo, and clearing of a page or of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import ordered_groups
from .geometry import LEAST_DRAG


def edited(actions: DataFrame) -> DataFrame:
    """Rectangles that are left on each page: ``doc_id, page_number, n, x, y, w, h`` (``n``: order of drawing, from 1).

    ``actions``: ``doc_id, page_number, seq, action, x, y, w, h``.  ``drag`` draws a rectangle in any direction, rounded to pixels, if it is six pixels or more each way; ``tap`` deletes the last drawn one that holds
    the point, its edges included; ``undo`` deletes the last drawn one; ``clear`` empties the page and ``clear_all`` (whatever its page) the document.  Only what follows the last clearing is folded, page by page, in the order of ``seq`` (equal ones by action and place); rows
    with other actions do nothing.
    """
    page = Window.partitionBy("doc_id", "page_number")
    wiped = actions.where("action = 'clear_all'").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("seq").alias("_all"))
    live = actions.where("action <> 'clear_all'").join(wiped, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    live = live.withColumn("_page", F.max(F.when(F.col("action") == "clear", F.col("seq"))).over(page)).where("(_all IS NULL OR seq > _all) AND (_page IS NULL OR seq > _page)")
    rounded = lambda c: F.floor(c + 0.5)
    low = lambda a, s: F.least(F.col(a), F.col(a) + F.coalesce(F.col(s), F.lit(0)))
    point = F.col("action") == "tap"
    columns = [F.when(point, F.col(a)).otherwise(rounded(low(a, s))).cast("double").alias(a) for a, s in (("x", "w"), ("y", "h"))] + [rounded(F.abs(s)).cast("double").alias(s) for s in ("w", "h")]
    kept = live.where((F.col("action") != "drag") | ((F.abs("w") >= LEAST_DRAG) & (F.abs("h") >= LEAST_DRAG)))

    def fold(rows: list[tuple]) -> list[tuple]:
        drawn: list[tuple] = []
        for _, _, _, action, x, y, w, h in rows:
            if action == "drag":
                drawn.append((x, y, w, h))
            elif action == "undo" and drawn:
                drawn.pop()
            elif action == "tap":
                for k in range(len(drawn) - 1, -1, -1):
                    a, b, c, d = drawn[k]
                    if a <= x <= a + c and b <= y <= b + d:
                        del drawn[k]
                        break
        return [(*rows[0][:2], n + 1, *box) for n, box in enumerate(drawn)]

    kind = lambda c: actions.schema[c].dataType.simpleString()
    return ordered_groups(kept.select("doc_id", "page_number", "seq", "action", *columns), ["doc_id", "page_number"], ["seq", "action", "x", "y", "w", "h"], fold, f"doc_id {kind('doc_id')}, page_number {kind('page_number')}, n int, x double, y double, w double, h double")
