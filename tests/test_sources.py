"""Sources of every format, clean-up of texts, and the sequential mode's own steps."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import cascade, pages, spans
from veilframe.operators.scrub import match
from veilframe.plans.config import ScrubConfig
from veilframe.sources import match_results, readers


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_tables_of_every_format(spark, tmp_path, kind):
    texts = ["SSN: 123-45-6789", 'two\nlines, "quoted"; and a comma', "漢字 ümlaut", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    writer = rows.write.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.format(kind).save(f"{tmp_path}/t")
    got = {int(r.doc_id): r.text or "" for r in readers.documents(spark, f"{tmp_path}/t", kind, text="body", doc_id="id").collect()}
    assert got == dict(enumerate(texts))
    unnamed = readers.documents(spark, f"{tmp_path}/t", kind, text="body", doc_id=None)
    assert unnamed.select("doc_id").distinct().count() == 4
    assert match(unnamed, ScrubConfig(lang="en")).where("hit_count > 0").count() == 1


def test_whole_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    got = {r.doc_id.rpartition("/")[2]: r.text for r in readers.documents(spark, str(tmp_path), "text").collect()}
    assert got["a.txt"] == "one\ntwo" and got.get("b.txt", "") == ""


def test_clean_up_of_texts(spark):
    rows = spark.createDataFrame([("a\r\nb\rc\x00d",), (None,), ("",), ("\r\r\n\n",)], "text string")
    assert [r[0] for r in rows.select(spans.clean(F.col("text"))).collect()] == ["a\nb\ncd", "", "", "\n\n\n"]


def test_values_apart_from_their_label_begin_where_the_original_has_them(spark):
    docs = spark.createDataFrame([(1, "Customer name:   Ann Lee\n")], "doc_id int, text string")
    hit = lambda parity: next(h for h in match(docs, ScrubConfig(lang="en", parity=parity)).first().hits if "name" in h.key)
    own, shifted = hit(False), hit(True)
    assert own.text.strip().startswith("Ann") and own.end - own.start == shifted.end - shifted.start and shifted.start <= own.start


def test_pages_whose_text_is_in_their_items(spark):
    rows = [(1, 1, "given", [("x",)]), (1, 2, "", [("from",), ("",), ("items",)]), (1, 3, None, None), (1, 4, None, [("last",)])]
    paged = spark.createDataFrame(rows, "doc_id int, page_number int, text string, items array<struct<str:string>>")
    filled = pages.with_item_text(paged)
    assert [r.text for r in filled.orderBy("page_number").collect()] == ["given", "from items", "", "last"]
    text = pages.document_text(filled).first().text
    assert text == "given\n\nfrom items\n\nlast"
    hits = spark.createDataFrame([(1, text, [(7, 11), (20, 22)])], "doc_id int, text string, hits array<struct<start:int,end:int>>")
    assert [h.page for h in pages.with_pages(hits, filled).first().hits] == [2, 4]


@pytest.mark.parametrize(("lang", "text"), [("en", "Company: Blue River Trading LLC\nShip to: 12 Main Street, Springfield"), ("de", "Firma: Nordlicht Handel GmbH\nAnschrift: Lange Straße 5, 10115 Berlin"), ("zh", "公司名称：蓝河贸易有限公司\n地址：上海市浦东新区世纪大道100号3单元502室")])
def test_sequential_mode_leaves_no_marks(spark, lang, text):
    docs = spark.createDataFrame([(1, text), (2, None), (3, "[Name] stays 【敏感】")], "doc_id int, text string")
    got = {r.doc_id: r.text_masked for r in cascade.scrub_sequential(docs, ScrubConfig(lang=lang, terms=("stays",))).collect()}
    assert got[2] in (None, "") and "[Name]" in got[3] and "【敏感】" in got[3] and "stays" not in got[3]
    assert got[1] != text and not any(0xE000 <= ord(c) <= 0xF8FF or ord(c) < 9 for c in got[1])


def test_stored_results_and_pages(spark):
    rows = [
        (1, '{"version":"","lang":"EN","hits":[{"id":"h1","key":"email","page":2,"start":3,"end":9,"text":"a@b.cd","rects":[{"x":1,"y":2,"w":3,"h":4}]},{"key":"x"},null]}'),
        (2, '{"lang":"fr","hits":null}'), (3, "no json"), (4, None), (5, "[]"),
    ]
    got = [(r.doc_id, r.version, r.source, r.lang, r.id, r.key, r.page, r.start, r.end, r.text, len(r.rects)) for r in match_results.results(spark.createDataFrame(rows, "doc_id int, result string")).orderBy("end").collect()]
    assert got == [(1, "match-result-v1", "matcher-core", "en", "", "x", None, 0, 0, "", 0), (1, "match-result-v1", "matcher-core", "en", "h1", "email", 2, 3, 9, "a@b.cd", 1)]
    pages_ = [(1, '[{"pageNumber":7,"items":[{"str":"a","transform":[1,2,3,4,5,6,7],"width":2,"hasEOL":true},{}]},{"items":null}]'), (2, "?"), (3, None)]
    told = match_results.paged_items(spark.createDataFrame(pages_, "doc_id int, pages string")).orderBy("page_number").collect()
    assert [(r.doc_id, r.page_number, [(i.str, i.transform, i.width, i.height, i.hasEOL) for i in r["items"]]) for r in told] == [(1, 2, []), (1, 7, [("a", [1, 2, 3, 4, 5, 6], 2, 0, True), ("", [1, 0, 0, 1, 0, 0], 0, 0, False)])]


def test_results_written_and_read_again(spark):
    docs = spark.createDataFrame([(1, "😀 mail bob@site.org now"), (2, "nothing")], "doc_id int, text string")
    done = match(docs, ScrubConfig(lang="en"))
    back = match_results.results(match_results.to_results(done, F.lit("en"))).collect()
    assert [(r.doc_id, r.key, r.start, r.end, r.text, r.masked) for r in back] == [(1, "email", 8, 20, "bob@site.org", "[Email]")]
