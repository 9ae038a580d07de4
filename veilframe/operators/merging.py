"""Boxes merged as a running union: per page a fold in reading order, whose next decision sees what it has merged so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.arrow import ordered_groups
from ..plans.tuning import BoxTuning

#: Share of the lower height that two boxes of a line must share, how alike their heights must be, and gaps: fixed parts, shares of the lower height, and how far boxes may reach into each other.
SAME_LINE, SIMILAR_HEIGHT = 0.80, 0.72
NEAR_GAP, NEAR_SHARE, NEAR_INTO = 1.2, 0.45, -3
STRICT_GAP, STRICT_SHARE, STRICT_INTO = 1.5, 0.12, -1
#: Fixed values of the export: offset of tops, difference of heights and gap within which boxes join.
EXPORT_OFFSET, EXPORT_HEIGHT, EXPORT_GAP = 3.0, 3.0, 4.0

Box = tuple[float, float, float, float, str, str]  # x, y, w, h, key, id


def joins(last: Box, box: Box, gap: float = NEAR_GAP, strict: frozenset[str] = frozenset()) -> bool:
    """Whether a box continues the last one: same key and hit (boxes without a hit go with any), one line, alike in height, and near."""
    (x, y, w, h, key, hit), (x2, y2, w2, h2, key2, hit2) = last, box
    if key != key2 or (hit and hit2 and hit != hit2):
        return False
    low = min(h, h2)
    shared = max(0.0, min(y + h, y2 + h2) - max(y, y2)) / max(1.0, low)
    between = x2 - (x + w)
    share, fixed, into = (STRICT_SHARE, STRICT_GAP, STRICT_INTO) if key in strict else (NEAR_SHARE, gap, NEAR_INTO)
    return shared > SAME_LINE and low / max(h, h2) > SIMILAR_HEIGHT and into <= between <= max(fixed, low * share)


def union(last: Box, box: Box) -> Box:
    x, y = min(last[0], box[0]), min(last[1], box[1])
    return x, y, max(last[0] + last[2], box[0] + box[2]) - x, max(last[1] + last[3], box[1] + box[3]) - y, last[4], last[5] or box[5]


def folded(boxes: list[Box], together: Callable[[Box, Box], bool]) -> list[Box]:
    """Boxes in order, each joined with the union before it where they go together; repeated until nothing joins."""
    while True:
        out: list[Box] = []
        for box in boxes:
            if out and together(out[-1], box):
                out[-1] = union(out[-1], box)
            else:
                out.append(box)
        if len(out) == len(boxes):
            return out
        boxes = out


def merged_rects(boxes: DataFrame, gap: float = NEAR_GAP, tuning: BoxTuning | None = None) -> DataFrame:
    """Boxes of a page (``doc_id, page_number, id, key, x, y, w, h``) merged where one continues the other, down the page and from left to right.

    All hits of a page go through one fold, as the original does it: a box of another hit or key between two parts keeps them apart.  Strict keys of ``tuning``
    must nearly touch; boxes that lie deeper inside each other than the limits stay apart.  A page's boxes are held at once.  Boxes with a size that is null or not finite are dropped.
    """
    strict = frozenset(tuning.strict) if tuning else frozenset()

    def fold(rows: list[tuple]) -> list[tuple]:
        page = [(x, y, w, h, key, hit) for *_, y, x, w, h, key, hit in rows]
        return [(*rows[0][:2], hit, key, x, y, w, h) for x, y, w, h, key, hit in folded(page, lambda a, b: joins(a, b, gap, strict))]

    finite = boxes.where(" AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('Infinity') AND NOT isnan({c})" for c in "xywh"))
    rows = finite.selectExpr("doc_id", "page_number", *[f"cast({c} AS double) AS {c}" for c in "yxwh"], "key", "id")
    key = boxes.schema["doc_id"].dataType.simpleString()
    return ordered_groups(rows, ["doc_id", "page_number"], ["y", "x", "id", "key", "w", "h"], fold, f"doc_id {key}, page_number {boxes.schema['page_number'].dataType.simpleString()}, id string, key string, x double, y double, w double, h double")


def drawn(boxes: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """``x, y, w, h`` of boxes to draw, from boxes in order of ``y, x``.

    A line holds the boxes whose tops lie within ``EXPORT_OFFSET`` of its first one's.  Along a line a box joins the last drawn one if their tops and heights differ little
    and it begins before that one's end or just after.  The drawn one keeps the place and height of its first box, so neither drifts.
    """
    lines: list[list[tuple]] = []
    for box in boxes:
        if lines and box[1] - lines[-1][0][1] < EXPORT_OFFSET:
            lines[-1].append(box)
        else:
            lines.append([box])
    out: list[tuple] = []
    for line in lines:
        for x, y, w, h in sorted(line):
            if out and abs(out[-1][1] - y) < EXPORT_OFFSET and abs(out[-1][3] - h) < EXPORT_HEIGHT and x <= out[-1][0] + out[-1][2] + EXPORT_GAP:
                left, top, wide, high = out[-1]
                start = min(left, x)
                out[-1] = (start, top, max(left + wide, x + w) - start, high)
            else:
                out.append((x, y, w, h))
    return out


def export_merged(boxes: DataFrame) -> DataFrame:
    """Boxes to draw, neighbours on a page as one whatever their hit (:func:`drawn`): ``doc_id, page_number, x, y, w, h``.

    The original orders boxes by a comparison that is no order where tops drift; here lines are formed down the page first, which agrees with it wherever lines stand apart.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        return [(*rows[0][:2], *box) for box in drawn([(x, y, w, h) for *_, y, x, w, h in rows])]

    rows = boxes.selectExpr("doc_id", "page_number", *[f"cast({c} AS double) AS {c}" for c in "yxwh"])
    key = boxes.schema["doc_id"].dataType.simpleString()
    return ordered_groups(rows, ["doc_id", "page_number"], ["y", "x", "w", "h"], fold, f"doc_id {key}, page_number {boxes.schema['page_number'].dataType.simpleString()}, x double, y double, w double, h double")
