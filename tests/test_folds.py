"""Box merging as a fold and interval joins, against plain versions and for growth."""

import random
import time

import pytest

from veilframe.operators import geometry, merging
from veilframe.operators.intervals import overlapping
from veilframe.plans.tuning import language_tuning

BOXES = "doc_id long, page_number int, id string, key string, x double, y double, w double, h double"


def plain_merge(boxes, near):
    """Passes over boxes in order, each joined with the last one where they go together, until a pass changes nothing."""
    changed = True
    while changed:
        changed, out = False, []
        for b in boxes:
            a = out[-1] if out else None
            if a and near(a, b):
                x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
                out[-1] = {"id": a["id"] or b["id"], "key": a["key"], "x": x, "y": y, "w": max(a["x"] + a["w"], b["x"] + b["w"]) - x, "h": max(a["y"] + a["h"], b["y"] + b["h"]) - y}
                changed = True
            else:
                out.append(b)
        boxes = out
    return boxes


def near(a, b, strict=()):
    low, high = min(a["h"], b["h"]), max(a["h"], b["h"])
    if a["key"] != b["key"] or (a["id"] and b["id"] and a["id"] != b["id"]):
        return False
    shared = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    gap = b["x"] - a["x"] - a["w"]
    fits = -1 <= gap <= max(1.5, 0.12 * low) if a["key"] in strict else -3 <= gap <= max(1.2, 0.45 * low)
    return shared / max(1, low) > 0.80 and low / high > 0.72 and fits


@pytest.mark.parametrize("lang", ["", "zh"])
def test_merging_is_a_running_union(spark, lang):
    rng = random.Random(5)
    rows = [(d, p, rng.choice(["", "h1", "h2"]), rng.choice(["company", "k", "k"]), float(rng.randint(0, 40)), rng.choice([0.0, 0.5, 1.0, 20.0]), float(rng.randint(1, 12)), rng.choice([9.0, 10.0, 14.0])) for d in range(12) for p in range(3) for _ in range(rng.randint(0, 40))]
    tuning = language_tuning(lang) if lang else None
    got = sorted(tuple(r) for r in geometry.merged_rects(spark.createDataFrame(rows, BOXES).repartition(5), tuning=tuning).collect())
    want, passes = [], 0
    for d, p in sorted({r[:2] for r in rows}):
        page = [dict(zip(("id", "key", "x", "y", "w", "h"), r[2:], strict=True)) for r in sorted((r for r in rows if r[:2] == (d, p)), key=lambda r: (r[5], r[4], r[2], r[3], r[6], r[7]))]
        done = plain_merge(page, lambda a, b: near(a, b, tuning.strict if tuning else ()))
        passes += len(done) < len(page)
        want += [(d, p, b["id"], b["key"], b["x"], b["y"], b["w"], b["h"]) for b in done]
    assert got == sorted(want) and passes > 10


def test_boxes_in_each_other_and_other_hits_between(spark):
    box = lambda hit, key, x, w, y=0.0: (1, 1, hit, key, float(x), y, float(w), 10.0)
    merged = lambda *rows: [(r.id, r.x, r.w) for r in geometry.merged_rects(spark.createDataFrame(rows, BOXES)).orderBy("x", "w").collect()]
    assert merged(box("h", "k", 0, 20), box("h", "k", 5, 5)) == [("h", 0.0, 20.0), ("h", 5.0, 5.0)]  # 15 into each other: apart
    assert merged(box("h", "k", 0, 20), box("h", "k", 18, 5)) == [("h", 0.0, 23.0)]
    assert merged(box("h", "k", 0, 5), box("g", "k", 5, 1), box("h", "k", 6, 5)) == [("h", 0.0, 5.0), ("g", 5.0, 1.0), ("h", 6.0, 5.0)]
    assert merged(box("", "k", 0, 5), box("g", "k", 6, 5)) == [("g", 0.0, 11.0)]
    # a second pass: the union of the later two reaches back to the first
    assert [b[:4] for b in merging.folded([(0, 0, 10, 10, "k", "h"), (10, 3, 2, 10, "k", "h"), (12, 1.5, 5, 10, "k", "h")], merging.joins)] == [(0, 0, 17, 13)]
    assert geometry.merged_rects(spark.createDataFrame([], BOXES)).count() == 0
    odd = [(1, 1, "h", "k", float("nan"), 0.0, 1.0, 1.0), (1, 1, "h", "k", None, 0.0, 1.0, 1.0), (None, 1, "h", "k", 0.0, 0.0, 1.0, 1.0)]
    assert [tuple(r) for r in geometry.merged_rects(spark.createDataFrame(odd, BOXES)).collect()] == [(None, 1, "h", "k", 0.0, 0.0, 1.0, 1.0)]


def test_export_keeps_the_first_box_as_anchor(spark):
    def drawn(*boxes):
        rows = [(1, 1, *map(float, b)) for b in boxes]
        return sorted(tuple(r)[2:] for r in geometry.export_merged(spark.createDataFrame(rows, "doc_id long, page_number int, x double, y double, w double, h double")).collect())

    assert drawn((0, 0, 5, 10), (0, 2, 5, 10), (0, 4, 5, 10), (0, 6, 5, 10)) == [(0.0, 0.0, 5.0, 10.0), (0.0, 4.0, 5.0, 10.0)]
    assert drawn((0, 0, 5, 10), (5, 0, 5, 12), (10, 0, 5, 14)) == [(0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 5.0, 14.0)]
    assert drawn((0, 0, 50, 10), (10, 0, 5, 10), (54, 0, 5, 10), (64, 0, 5, 10)) == [(0.0, 0.0, 59.0, 10.0), (64.0, 0.0, 5.0, 10.0)]


def test_overlapping_equals_all_pairs(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.choice([1, 1, 2, None]), i, a, a + rng.choice([0, 1, 7, 64, 65, 700])) for i in range(n) for a in [rng.randint(0, 900)]]
    one, two = make(150), [*make(150), (1, 999, None, 5)]
    left = spark.createDataFrame(one, "k int, i int, a int, b int")
    right = spark.createDataFrame(two, "k int, j int, c int, d int")
    want = sorted((x[1], y[1]) for x in one for y in two if x[0] is not None and x[0] == y[0] and y[2] is not None and x[2] < y[3] and x[3] > y[2])
    for width in (1, 64, 5000):
        got = sorted(tuple(r) for r in overlapping(left, right, ["k"], ("a", "b"), ("c", "d"), width).select("i", "j").collect())
        assert got == want


def test_one_long_document_takes_time_near_the_sum(spark):
    def seconds(pages):
        offsets = spark.range(pages).selectExpr("1L AS doc_id", "cast(id AS int) AS page_number", "id * 2000 AS start", "id * 2000 + 1990 AS end")
        hits = spark.range(10 * pages).selectExpr("1L AS doc_id", "cast(id AS string) AS id", "'k' AS key", "id * 200 AS start", "id * 200 + 30 AS end")
        began = time.time()
        n = geometry.localized(hits, offsets).count()
        return n, time.time() - began

    seconds(100)
    (n, small), (m, large) = seconds(1250), seconds(10_000)
    # every page holds ten hits; the tenth ends before the page does
    assert n == 12_500 and m == 100_000 and large < 8 * small + 4
