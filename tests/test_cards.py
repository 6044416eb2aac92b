"""Cards, files and bodies from JSON of varying shape."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gazette.functions import cards


def read(spark, make, x):
    df = spark.createDataFrame([(None if x is None else json.dumps(x, ensure_ascii=False),)], "j string").select(F.try_parse_json("j").alias("x"))
    return df.select(make(F.col("x")).alias("r")).first()["r"]


SOURCES = [
    {"source_id": " a b ", "source_type": "attachment_pdf", "refined_text": "첨부 글", "filename": "f.pdf", "storage_path": "p", "metadata": {"order_index": 2, "file_type": "pdf"}, "translations": {"vi": "bản dịch", "en": 5}, "needs_file": True},
    {"source_id": "i", "source_type": "inline_image", "refined_text": "# 제목\n이름: 홍\n첨부 1\n- a.hwp"}, "text", 7, None, [1], {"refined_text": 5}, {"source_type": "attachment_hwp", "refined_text": "", "filename": 3, "needs_file": "true"},
    {"source_id": "c", "source_type": "html_body", "refined_text": "본문", "metadata": {"order_index": "1"}, "storage_path": " "}, {"source_id": "a b", "source_type": "x", "storage_path": "q", "filename": " "},
]


def test_cards(spark):
    got = read(spark, lambda x: cards.source_cards(x, "vi", F.lit(None).cast("string"), F.lit("n/1")), {"sources": SOURCES})
    assert [tuple(c) for c in got] == [
        ("body", "", "본문", False, False, None), ("attachment", "f.pdf", "bản dịch", True, True, "/api/notices/n%2F1/attachments/a%20b"), ("attachment", "", "", False, False, None)
    ]
    assert [(c["kind"], c["content"]) for c in read(spark, lambda x: cards.source_cards(x, "en", F.lit("whole"), F.lit("n")), {"sources": SOURCES})] == [("body", "whole"), ("attachment", "첨부 글"), ("attachment", "")]
    assert [(c["kind"], c["content"]) for c in read(spark, lambda x: cards.source_cards(x, "en", F.lit("whole"), F.lit("n")), {"sources": SOURCES[:1]})] == [("body", "whole"), ("attachment", "첨부 글")]
    for x in (None, {"sources": {}}, [1], {}):
        assert read(spark, lambda x: cards.source_cards(x, "en", F.lit(""), F.lit("n")), x) == []
    assert len(read(spark, lambda x: cards.source_cards(x, "en", F.lit("t"), F.lit("n")), None)) == 1


def test_files(spark):
    got = read(spark, lambda x: cards.attachment_files(x, F.lit("n")), {"sources": SOURCES})
    assert [tuple(f) for f in got] == [("f.pdf", "/api/notices/n/attachments/a%20b", True)]
    assert [f["filename"] for f in read(spark, lambda x: cards.attachment_files(x, F.lit("n")), {"sources": SOURCES[::-1]})] == ["attachment"]


def test_full_body(spark):
    src = lambda i, t, text, **more: {"source_id": i, "source_type": t, "refined_text": text, **more}
    x = {"included_source_ids": ["p", "img", "b", "q", "gone"], "sources": [src("b", "html_body", " 본문 ", metadata={"order_index": 3}), src("img", "inline_image", "사진", metadata={"order_index": 1}), src("p", "attachment_pdf", "글", filename=" f.pdf "), src("q", "attachment_hwp", "다른 글"), src("r", "attachment_hwp", "not included")]}
    assert read(spark, cards.full_body, x) == "본문\n\n## 첨부: f.pdf\n\n글\n\n## 첨부: 첨부\n\n다른 글"
    x["sources"] = x["sources"][1:]
    assert read(spark, cards.full_body, x).startswith("사진\n\n## 첨부: f.pdf")
    assert read(spark, cards.full_body, {"included_source_ids": ["p", "q"], "sources": x["sources"][1:]}) == "글\n\n## 첨부: 첨부\n\n다른 글"
    assert read(spark, cards.full_body, {}) == ""
