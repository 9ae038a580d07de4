"""Preferred parts, labels at a value's start, the one call from hits to boxes, edited rectangles, and streams against plain models."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from veilframe.functions.scratch import shared_folder
from veilframe.operators import geometry, manual, preferred, rect_results
from veilframe.plans.labels import LABELS, labelled_tuning
from veilframe.plans.tuning import tuned
from veilframe.streaming import windows

ITEM = "array<struct<str:string,hasEOL:boolean>>"


def test_text_of_items_in_their_order(spark):
    rows = [([("Tel", False), ("030", False), (":", None), ("", True), (None, True), ("x", True), ("y", False)],), (None,), ([],)]
    got = [r.t for r in spark.createDataFrame(rows, f"items {ITEM}").select(preferred.run_text(F.col("items")).alias("t")).collect()]
    assert got[0].text == "Tel 030:x\ny" and [(r.idx, r.start, r.end) for r in got[0].ranges] == [(0, 0, 3), (1, 4, 7), (2, 7, 8), (5, 8, 9), (6, 10, 11)]
    assert got[1].text == got[2].text == "" and got[1].ranges == []


def test_parts_cancel_stay_or_carry_over(spark):
    text = "acct a 1234 b\nacct c 99 d; bob 77 (WhatsApp) end co Xy Ltd"
    patterns = {
        "account": r"(acct) (\w \d+)|(?:1234) (b)", "phone": r"(bob) (\d+)(?: \(WhatsApp\))?", "company": r"(co)(X)?(y)?(z)?( Xy) Ltd", "secret": r"end\s", "manual_term": r"(^|\W)(99)(?=\W)",
    }
    pages = spark.createDataFrame([(1, 1, text), (1, 2, None), (None, 1, "acct x 5")], "doc_id int, page_number int, text string")
    got = sorted((tuple(r) for r in preferred.preferred_spans(pages, patterns).collect()), key=repr)
    assert got == sorted([
        (1, 1, "account", 0, 11, 5, 11), (1, 1, "account", 14, 23, 5, 9), (1, 1, "manual_term", 21, 23, None, None), (1, 1, "phone", 27, 44, 4, 17), (1, 1, "secret", 45, 49, None, None), (1, 1, "company", 49, 58, 2, 5),
        (None, 1, "account", 0, 8, 5, 8),
    ], key=repr)
    merged = {"k": r"ab|b+c", "money": r"(a)(b)|(b)(c)"}
    one = spark.createDataFrame([(1, 1, "abbc")], "doc_id int, page_number int, text string")
    assert [tuple(r)[2:] for r in preferred.preferred_spans(one, {"k": r"ab|bc"}).collect()] == [("k", 0, 4, None, None)]
    # two spans that touch: parts one and two places in cancel, equal ones stay
    assert [tuple(r)[2:] for r in preferred.preferred_spans(one, {"money": r"(a)(b)|(b)(c)"}).collect()] == [("money", 0, 4, 1, 2)]
    assert [tuple(r)[2:] for r in preferred.preferred_spans(one, {"money": r"(a)(b)|(?:)(?:)(b)(?:)(c)"}).collect()][0][:3] == ("money", 0, 4)
    assert merged and preferred.preferred_spans(pages.where("false"), patterns).count() == 0


def test_boxes_of_preferred_parts(spark):
    items = [(1, 1, 0, "acct 1234", 0, 9, [10.0, 0.0, 0.0, 10.0, 100.0, 500.0], 45.0), (1, 1, 1, "56 end", 9, 15, [10.0, 0.0, 0.0, 10.0, 150.0, 500.0], 30.0)]
    layout = spark.createDataFrame([(1, 1, 600.0, 800.0, [1.0, 0.0, 0.0, -1.0, 0.0, 800.0])], "doc_id int, page_number int, viewport_width double, viewport_height double, viewport_transform array<double>")
    placed = geometry.on_device(spark.createDataFrame(items, "doc_id int, page_number int, idx int, str string, start int, end int, transform array<double>, width double"), layout)
    span = lambda part: spark.createDataFrame([(1, 1, "", "account", 0, 15, *part)], "doc_id int, page_number int, id string, key string, a int, b int, part_a int, part_b int")
    parted = geometry.device_rects(span((5, 11)), placed, tuning=tuned("")).orderBy("x").collect()
    same = geometry.device_rects(spark.createDataFrame([(1, 1, "", "account", 5, 11)], "doc_id int, page_number int, id string, key string, a int, b int"), placed, tuning=tuned("")).orderBy("x").collect()
    assert parted == same and len(same) == 2
    only = geometry.device_rects(span((0, 4)), placed, tuning=tuned("")).collect()
    assert len(only) == 1  # the second item holds nothing of the part
    whole = geometry.device_rects(span((5, 11)), placed, tuning=tuned("", ignore_part=("account",))).orderBy("x").collect()
    assert whole == geometry.device_rects(span((None, None)), placed, tuning=tuned("")).orderBy("x").collect() and whole != parted


@pytest.mark.parametrize("lang", ["en", "de", "zh"])
def test_values_lose_exactly_their_label(spark, lang):
    rows = [(key, word + sep + "#value#") for key, words in LABELS[lang].items() for word in words for sep in (": ", "：", "")] + [("manual_term", "Name: x"), ("none", "Name: x"), ("phone", None)]
    got = spark.createDataFrame(rows, "key string, sub string").select("key", "sub", geometry.value_in(F.col("sub"), labelled_tuning(lang)).alias("v")).collect()
    for r in got:
        words = LABELS[lang].get(r.key)
        if words and r.sub is not None:
            label = next(w for w in words if r.sub.lower().startswith(w.lower()))
            rest = regex.sub(r"^\s*[:：]?\s*", "", r.sub[len(label) :])
            assert r.v.value == rest.strip(geometry.WEAK) and r.v.skip == len(r.sub) - len(rest.lstrip(geometry.WEAK))
    told = {(r.key, r.sub): (r.v.skip, r.v.value) for r in got}
    assert told["manual_term", "Name: x"] == told["none", "Name: x"] == (0, "Name: x") and told["phone", None] == (None, None)


def test_hits_to_boxes_in_one_call(spark):
    item = lambda s, x: (s, [10.0, 0.0, 0.0, 10.0, float(x), 500.0], 5.0 * len(s))
    paged = spark.createDataFrame([(1, 1, [item("call bob", 50), item("now", 120)]), (1, 2, [item("bob again", 50)]), (2, 1, [])], "doc_id int, page_number int, items array<struct<str:string,transform:array<double>,width:double>>")
    layout = spark.createDataFrame([(1, p, 600.0, 800.0, [1.0, 0.0, 0.0, -1.0, 0.0, 800.0]) for p in (1, 2)], "doc_id int, page_number int, viewport_width double, viewport_height double, viewport_transform array<double>")
    hits = spark.createDataFrame([(1, "h1", "k", 5, 8), (1, "h2", "k", 14, 17), (1, "h3", "k", 9, 9), (1, "h4", "k", 4, 5)], "doc_id int, id string, key string, start int, end int")
    boxes = rect_results.match_rects(hits, paged, layout, tuning=tuned(""))
    assert [(r.page_number, r.id, r.rect_id) for r in boxes.orderBy("rect_id").collect()] == [(1, "h1", "rect_000001"), (2, "h2", "rect_000002")]
    given = spark.createDataFrame([(1, 1, "h4", "k", 1.0, 2.0, 3.0, 4.0), (1, 1, "h1", "k", 1.0, 2.0, 3.0, 4.0), (1, 2, "h4", "k", 1.0, 2.0, 3.0, 4.0), (1, 1, "h4", "k", 1.0, 2.0, 0.0, 4.0)], "doc_id int, page_number int, id string, key string, x double, y double, w double, h double")
    more = rect_results.match_rects(hits, paged, layout, tuning=tuned(""), given=given)
    assert sorted((r.id, r.page_number) for r in more.collect()) == [("h1", 1), ("h2", 2), ("h4", 1)]
    texts = paged.select("doc_id", "page_number", geometry.item_ranges(F.col("items"))["text"].alias("text"))
    stats = {(r.doc_id, r.page_number): (r.hits, r.mapped, r.rects) for r in rect_results.page_stats(hits, texts, boxes).collect()}
    assert stats == {(1, 1): (3, 1, 1), (1, 2): (1, 1, 1), (2, 1): (0, 0, 0)}
    audit = geometry.audit(hits, boxes).first()
    assert (audit.hits, audit.mapped, audit.unmapped) == (4, 2, 2)


def test_edited_rectangles_equal_a_plain_replay(spark):
    rng = random.Random(6)
    acts = ["drag"] * 5 + ["tap"] * 3 + ["undo", "undo", "clear", "clear_all", "other"]
    rows = [(d, None if d == 2 else rng.randint(1, 2), k, rng.choice(acts), rng.randint(0, 40) + 0.5, rng.randint(0, 40) + 0.25, float(rng.randint(-30, 30)), float(rng.randint(-30, 30))) for d in (1, 2, 3) for k in range(60)]
    schema = "doc_id int, page_number int, seq int, action string, x double, y double, w double, h double"
    want = {}
    for d, p, _, action, x, y, w, h in rows:
        page = want.setdefault((d, p), [])
        if action == "drag" and abs(w) >= 6 and abs(h) >= 6:
            page.append(tuple(float(int(v + 0.5)) for v in (min(x, x + w) + 100, min(y, y + h) + 100, abs(w), abs(h))))
            page[-1] = (page[-1][0] - 100, page[-1][1] - 100, *page[-1][2:])
        elif action == "tap":
            at = [k for k, (a, b, c, e) in enumerate(page) if a <= x <= a + c and b <= y <= b + e]
            if at:
                del page[at[-1]]
        elif action == "undo" and page:
            page.pop()
        elif action == "clear":
            page.clear()
        elif action == "clear_all":
            for (doc, _), other in want.items():
                if doc == d:
                    other.clear()
    got = {}
    for r in manual.edited(spark.createDataFrame(rows, schema).repartition(3)).orderBy("n").collect():
        got.setdefault((r.doc_id, r.page_number), []).append((r.x, r.y, r.w, r.h))
    assert got == {k: v for k, v in want.items() if v}
    assert manual.edited(spark.createDataFrame([], schema)).count() == 0


def test_streams_drop_late_rows_and_go_on_after_a_stop(spark, tmp_path):
    at = lambda *hours: [(k, f"2024-01-01 {h:02}:30:00" if h < 24 else f"2024-01-0{1 + h // 24} {h % 24:02}:30:00") for k, h in hours]
    frames = [spark.createDataFrame(rows, "u string, ts string").withColumn("ts", F.col("ts").cast("timestamp")) for rows in (at(("a", 1), ("a", 2), ("b", 3)), at(("a", 40), ("b", 30)), at(("a", 5), ("b", 41), ("a", 90)))]
    counted = windows.replayed(spark, frames, lambda s: windows.window_counts(s, "u")).collect()
    # the row of hour 5 comes after the mark (hour 16.5 of the first day) has passed its window
    assert sorted((r.u, r.start.day, r.start.hour, r.n) for r in counted) == [("a", 1, 0, 2), ("a", 2, 12, 1), ("b", 1, 0, 1), ("b", 2, 0, 1), ("b", 2, 12, 1)]
    sessions = windows.replayed(spark, frames[:2], lambda s: windows.user_sessions(s, "u", gap="2 hours", late="1 hour")).collect()
    assert sorted((r.u, r.start.day, r.start.hour, r.end.hour, r.n) for r in sessions) == [("a", 1, 1, 4, 2), ("b", 1, 3, 5, 1), ("b", 2, 6, 8, 1)]
    # a second call on the same checkpoint without new files gives nothing again
    frames[0].write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(frames[0].schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        windows.drain(source(), lambda s: s.select("u"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    assert shared_folder(spark) != shared_folder(spark)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)
