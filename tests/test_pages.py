"""Language routing, paged text, geometry, sources, streaming."""

from pyspark.sql import functions as F

from veilframe.operators import geometry, language, pages
from veilframe.operators.scrub import match
from veilframe.plans.config import ScrubConfig
from veilframe.sources import readers
from veilframe.streaming.scrub_stream import counts_by_window, masked_stream


def test_language(spark):
    en = "The quick brown fox and the other animals were running over the hills in the morning."
    fr = "Les enfants sont dans la maison et les parents font la cuisine pour toute la famille."
    data = spark.createDataFrame(list(enumerate(["中" + "a" * 49, "中" + "a" * 50, "x" * 23, en, fr, "", None])), "doc_id long, text string")
    locks = spark.createDataFrame([(2, "DE")], "doc_id long, lang string")
    got = {r.doc_id: r for r in language.route(data, locks).collect()}
    assert got[0].detection.lang == "zh" and got[0].route == "auto" and got[1].detection.reason != "han_ratio"
    assert got[2].detection.reason == "too_short" and (got[2].route, got[2].content_lang) == ("locked", "de")
    assert got[3].detection.lang == "en" and got[4].detection.reason.startswith("unmapped") and got[4].route == "needs_confirm"
    assert got[5].detection.reason == got[6].detection.reason == "empty" and got[6].content_lang == "zh"


def _items(*spec):
    return [{"str": s, "transform": [1.0, 0.0, 0.0, 1.0, float(x), float(y)]} for s, x, y in spec]


def test_lines_from_items(spark):
    rows = [
        (0, _items(("world", 50, 700), ("Hello", 0, 701), (")", 80, 700))), (1, _items(("a", 0, 700), ("b", 9, 698.5))), (2, _items(("a", 0, 700), ("b", 0, 687.5))), (3, _items(("a", 0, 700), ("b", 0, 688))),
        (4, _items(("中", 0, 700), ("b", 9, 700))), (5, []), (6, _items(("co-", 0, 700), ("op  x", 9, 700))),
    ]
    data = spark.createDataFrame(rows, "id int, items array<struct<str:string,transform:array<double>>>")
    got = {r.id: r.t for r in data.select("id", pages.pretty_text(F.col("items")).alias("t")).collect()}
    assert got == {0: "Hello world)", 1: "a\nb", 2: "a\n\nb", 3: "a\nb", 4: "中b", 5: "", 6: "co-op x"}


def test_headers_and_gates(spark):
    body = lambda k: "\n".join(f"body line {k} {j} with some words" for j in range(12))
    rows = [(1, k, f"ACME Report\nInvoice: 7\n{body(k)}\nPage {k} of 2") for k in (1, 2)] + [(2, 1, "short")] + [(3, 1, "x" * 119), (4, 1, "x" * 120)]
    data = spark.createDataFrame(rows, "doc_id long, page_number int, text string")
    got = {(r.doc_id, r.page_number): r.text for r in pages.without_headers(data).collect()}
    assert got[1, 1] == f"Invoice: 7\n{body(1)}" and got[2, 1] == "short"
    modes = {r.doc_id: r.mode for r in pages.mode(data).collect()}
    assert modes == {1: "A", 2: "B", 3: "B", 4: "A"}
    merged = "ticket no. 1 contact: a email: b and much more text here to be long"
    bad = spark.createDataFrame([(1, 1, "\n".join([merged] * 2) + "\n" + "y" * 200), (2, 1, "\n".join([merged] * 3) + "\n" + "y" * 200)], data.schema)
    assert {r.doc_id: r.semantic_usable for r in pages.gates(bad).collect()} == {1: True, 2: False}


def test_page_of_hit(spark):
    text = "mail a@b.co here\n\nand c@d.co\n\nlast"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    paged = spark.createDataFrame([(1, 1, "mail a@b.co here"), (1, 2, "and c@d.co"), (1, 3, "last")], "doc_id long, page_number int, text string")
    row = pages.with_pages(match(docs, ScrubConfig(lang="en")), paged).first()
    assert [h.page for h in row.hits] == [1, 2]
    got = readers.paged(paged).first()
    assert got.text == text and got.from_pdf


def test_geometry(spark):
    items = _items(("Hello", 0, 700), ("bob", 40, 700), ("again", 0, 680))
    ranges = spark.createDataFrame([(items,)], "items array<struct<str:string,transform:array<double>>>").select(geometry.item_ranges(F.col("items")).alias("p")).first().p
    assert ranges.text == "Hello bob\n\nagain" and [(r.start, r.end) for r in ranges.ranges] == [(0, 5), (6, 9), (11, 16)]
    spans = spark.createDataFrame([(1, 1, "h1", "k", 0, 2), (1, 1, "h2", "k", 2, 4), (1, 1, "h3", "z", 6, 9)], "doc_id long, page_number int, id string, key string, a int, b int")
    joined = {(r.key, r.a, r.b) for r in geometry.merged_spans(spans).collect()}
    assert joined == {("k", 0, 2), ("k", 2, 4), ("z", 6, 9)} or joined == {("k", 0, 4), ("z", 6, 9)}
    boxes = spark.createDataFrame([(1, 1, 0, 0, 5, 0.0, 700.0, 50.0, 10.0), (1, 1, 1, 6, 9, 52.0, 700.0, 30.0, 10.0)], "doc_id long, page_number int, idx int, start int, end int, x double, y double, w double, h double")
    one = spark.createDataFrame([(1, 1, "h1", "k", 3, 9)], "doc_id long, page_number int, id string, key string, a int, b int")
    rects = geometry.rects(one, boxes)
    assert sorted((r.x, r.w) for r in rects.collect()) == [(29.0, 22.0), (51.0, 32.0)]
    merged = geometry.numbered(geometry.merged_rects(rects)).collect()
    assert [(r.rect_id, r.x, r.w) for r in merged] == [("rect_000001", 29.0, 54.0)]
    report = geometry.audit(spark.createDataFrame([(1, "h1"), (1, "h9")], "doc_id long, id string"), rects).first()
    assert (report.hits, report.mapped, report.unmapped, report.rects) == (2, 1, 1, 2)


def test_sources_and_sinks(spark, tmp_path):
    docs = readers.from_texts(spark, ["SSN: 123-45-6789", "plain"])
    done = match(docs, ScrubConfig(lang="en"))
    readers.write_masked(done, str(tmp_path / "m"))
    readers.write_report(done, str(tmp_path / "r"))
    assert sorted(r.text for r in readers.documents(spark, str(tmp_path / "m"), text="text_masked").collect()) == ["SSN: [Secret]", "plain"]
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"%PDF-1.7")
    (tmp_path / "f" / "b.PNG").write_bytes(b"zz")
    assert sorted(r.kind for r in readers.files(spark, str(tmp_path / "f")).collect()) == ["image", "pdf"]


def test_stream_equals_batch(spark, tmp_path):
    source = spark.createDataFrame([(k, f"mail u{k}@x.org", f"2026-01-01 00:0{k}:00") for k in range(6)], "doc_id long, text string, at string").withColumn("ts", F.to_timestamp("at"))
    source.write.parquet(str(tmp_path / "in"))
    stream = masked_stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), ScrubConfig(lang="en"))
    query = stream.select("doc_id", "text_masked").writeStream.format("memory").queryName("masked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = match(source, ScrubConfig(lang="en"))
    assert sorted(map(tuple, spark.table("masked").collect())) == sorted(map(tuple, batch.select("doc_id", "text_masked").collect()))
    assert counts_by_window(batch).agg(F.sum("n")).first()[0] == 6


def test_text_against_authority(spark):
    items = _items(("Hello", 0, 700), ("bob.", 40, 700), ("again", 0, 690))
    texts = ["Hello   bob.\r\nagain", "Hello there", "  ", None, "x Hello bob. again Hello"]
    data = spark.createDataFrame([(k, items, t) for k, t in enumerate(texts)], "k int, items array<struct<str:string,transform:array<double>>>, t string")
    got = {r.k: (r.p.text, [(x.start, x.end) for x in r.p.ranges]) for r in data.select("k", geometry.against_authority(geometry.item_ranges(F.col("items")), F.col("t")).alias("p")).collect()}
    own = ("Hello bob.\nagain", [(0, 5), (6, 10), (11, 16)])
    assert got == {0: ("Hello   bob.\nagain", [(0, 5), (8, 12), (13, 18)]), 1: own, 2: own, 3: own, 4: (texts[4], [(2, 7), (8, 12), (13, 18)])}


def test_boxes_on_the_raster(spark):
    items = [(1, 1, 0, "Name: Bob,", [10.0, 0.0, 0.0, 10.0, 50.0, 700.0], 60.0, 0, 10), (1, 1, 1, "ab", [10.0, 0.0, 0.0, 10.0, 200.0, 700.0], 0.0, 11, 13), (1, 1, 2, "", None, None, 14, 14)]
    data = spark.createDataFrame(items, "doc_id long, page_number int, idx int, str string, transform array<double>, width double, start int, end int")
    layout = spark.createDataFrame([(1, 1, 612.0, 792.0, [1.0, 0.0, 0.0, -1.0, 0.0, 792.0])], "doc_id long, page_number int, viewport_width double, viewport_height double, viewport_transform array<double>")
    placed = geometry.on_device(data, layout)
    boxes = {r.idx: tuple(round(x, 4) for x in (r.x, r.y, r.w, r.h)) for r in geometry.item_boxes(placed).collect()}
    est = 10 * 10.8 * 0.72
    assert boxes[0] == (50.0, round(92 - 10.8, 4), round(est * 1.18, 4), 10.8)
    assert boxes[1] == (200.0, round(92 - 10.8, 4), round(2 * 10.8 * 0.72, 4), 10.8) and boxes[2][3] == 6.0
    spans = spark.createDataFrame([(1, 1, "h1", "person_name", 0, 10), (1, 1, "h2", "manual_term", 11, 13), (1, 1, "h3", "k", 4, 6)], "doc_id long, page_number int, id string, key string, a int, b int")
    got = {r.id: r for r in geometry.device_rects(spans, placed, "en", geometry.tuned("en", labels={"person_name": ("name",)})).collect()}
    assert set(got) == {"h1", "h2"}  # the third covers weak characters alone
    font = 11.0
    width = 10 * font * 0.82 * 1.08 + 6  # ten times what the characters can fill, so the estimate holds
    pad, nudge = max(0.22, width * 0.0022), min(4, max(2, width * 0.04))
    assert abs(got["h1"].x - (50 + width * 0.6 - pad - nudge)) < 1e-9 and abs(got["h1"].w - (width * 0.3 + 2 * pad + nudge)) < 1e-9  # "Bob" of ten characters
    assert abs(got["h1"].y - (92 - font + 2 - 0.34 + 5)) < 1e-9 and abs(got["h1"].h - (font - 2 + 0.68 - 2)) < 1e-9
    assert geometry.device_rects(spans.where("id = 'h2'"), placed, "en", drop_oversize=True).count() == 1
    manual = spark.createDataFrame([(1, 1, 10, 10, -8, 20), (1, 1, 0, 0, 5, 50)], "doc_id long, page_number int, x int, y int, w int, h int")
    mine = geometry.with_manual(geometry.device_rects(spans, placed, "en"), manual).where("key = 'manual_rect'").collect()
    assert [(r.id, r.x, r.y, r.w, r.h) for r in mine] == [("manual_000001", 2.0, 10.0, 8.0, 20.0)]


def test_export_merge(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 10.0, 20.0, 8.0), (1, 1, 23.0, 11.0, 5.0, 9.0), (1, 1, 40.0, 10.0, 5.0, 8.0), (1, 1, 0.0, 30.0, 5.0, 8.0), (1, 2, 0.0, 10.0, 5.0, 8.0)], "doc_id long, page_number int, x double, y double, w double, h double")
    got = sorted(tuple(r) for r in geometry.export_merged(boxes).collect())
    assert got == [(1, 1, 0.0, 10.0, 28.0, 8.0), (1, 1, 0.0, 30.0, 5.0, 8.0), (1, 1, 40.0, 10.0, 5.0, 8.0), (1, 2, 0.0, 10.0, 5.0, 8.0)]
