"""Small golden examples of the functions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from gazette.functions import checks, dates, links, review, text, urls


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_quality_score(spark):
    notice = "가정통신문 안내 2026.03.02 까지 신청서를 제출해 주세요. 참가비 15,000원 문의 032-320-0096"
    assert one(spark, text.quality_score("t"), t=notice) > 50
    assert one(spark, text.quality_score("t"), t="  ") == 0.0
    assert one(spark, text.is_low_quality("t"), t="short") is True


def test_fingerprint(spark):
    assert one(spark, text.fingerprint("t"), t="A b-C!") == one(spark, text.fingerprint("t"), t="abc")
    assert one(spark, text.fingerprint("t"), t="--- !") == ""


def test_numbers(spark):
    assert one(spark, F.array_sort(text.significant_numbers("t")), t="2,240,000 and 2.240.000 on 2026. 5. 14. and ٢٠٢٥ of 12") == ["2025", "2026", "2240000"]


def test_numbers_of_any_script_and_no_break_spaces(spark):
    assert one(spark, F.array_sort(text.significant_numbers("t")), t="2\u00a0240\u00a0000, २०२५, ２０２６, 𝟐𝟎𝟐𝟕 and 12\u00a03456") == ["12345", "2025", "2026", "2027", "2240000"]
    src = ("행사 안내입니다. " * 10) + "\n\n시설이용료 20,000원 * 112명 = 2,240,000원, 총 2,300,000원 환불 60,000원"
    said = ("Avis de la fête. " * 10) + "\n\nFrais 20\u00a0000 * 112 = 2\u00a0240\u00a0000, total 2\u00a0300\u00a0000, retour 60\u00a0000"
    assert "numbers_lost" not in one(spark, checks.output_issues("s", "o"), s=src, o=said)
    assert "numbers_lost" in one(spark, checks.output_issues("s", "o"), s=src, o=said.replace("2\u00a0300", "2\u00a0301"))


def test_variants_keep_scheme_case_and_fragment(spark):
    assert one(spark, urls.variants("u"), u="http://Ex.kr/a?q#F") == ["http://Ex.kr/a?q#F", "http://Ex.kr/", "http://www.Ex.kr/a?q#F", "http://www.Ex.kr/", "https://Ex.kr/a?q#F", "https://Ex.kr/", "https://www.Ex.kr/a?q#F", "https://www.Ex.kr/"]
    assert one(spark, urls.variants("u"), u="https://www.ex.kr") == ["https://www.ex.kr", "https://ex.kr", "http://www.ex.kr", "http://ex.kr"]
    assert one(spark, urls.variants("u"), u="ftp://ex.kr/") == ["ftp://ex.kr/", "ftp://www.ex.kr/"] and one(spark, urls.variants("u"), u="ex.kr/a") == ["ex.kr/a"]


def test_richness(spark):
    page = "<p>x</p> serverFileObjArray 다운로드"
    assert one(spark, links.richness("h", "t"), h=page, t="text/HTML; a") == 1500 + len("x  serverFileObjArray 다운로드")
    assert one(spark, links.richness("h", "t"), h=page, t="image/png") == 0 and one(spark, links.richness("h", "t"), h="a" * 6000, t="text/html") == 5000


def test_access(spark):
    failure = lambda html, url="https://s.kr/b", status=200: one(spark, links.access_failure("u", "s", "h"), u=url, s=status, h=html)
    assert failure("<p>x</p>", status=401) == "unsupported_forbidden" and failure("x", "https://schoolbell-e.com/a") == "unsupported_external_dynamic" and failure("x", "https://s.kr/?mode=login") == "unsupported_login_required"
    assert failure("<body>로그인 후 이용</body>") == "unsupported_login_required" and failure("<body>로그인 후 이용 2026.3.2</body>") is None and failure("<body>로그인 후 이용 조회수</body>") is None
    assert failure("<body>" + "글 " * 400 + "<footer>권한이 없습니다</footer>") is None and failure("<title>권한이 없습니다</title>") == "unsupported_login_required"


def test_answers(spark):
    read = lambda t: one(spark, review.answer_object("t"), t=t)
    assert read('{"a": 1}') == '{"a":1}' and read('```json\n{"title": "안내"}\n```') == '{"title":"안내"}' and read('reply: {"a": "line1\nline2"}') == '{"a":"line1\\nline2"}'
    assert read('{"title": "수정 \\m 사용"}') == '{"title":"수정 \\\\m 사용"}'
    assert [read(t) for t in ("[1, 2, 3]", "JSON 없이", '[{"a":1},{"b":2}]', '{"a": [1', '{"a":1} and {"b":2}', "")] == [None] * 6


def test_titles_and_buckets(spark):
    assert one(spark, text.first_line_title("t"), t="\n ## Hello \nrest") == "Hello"
    h = 0
    for c in "과학A":
        h = (h * 31 + ord(c)) % 2**32
    assert one(spark, text.bucket31("t"), t="과학A") == h


def test_gate(spark):
    g = one(spark, text.quality_gate("t"), t="\n".join(["짧은 줄"] * 60))
    assert g["needs_file"] and "flattened" in g["reasons"]


def test_gate_signals(spark):
    g = one(spark, text.gate_signals("t", F.lit("FALLBACK")), t="글\n| a |  |\n|---|---|\n||\n| 자습 | 자습 | 자습 | 자습 |")
    assert (g["fallback"], g["chars"], g["table_empty_ratio"], g["repeat_junk"]) == (True, 45, 0.286, True)
    g = one(spark, text.gate_signals("t", F.lit("ok")), t="no table")
    assert (g["fallback"], g["table_empty_ratio"], g["repeat_junk"]) == (False, 0.0, False)


def test_urls(spark):
    assert one(spark, urls.canonical("u"), u="HTTPS://Ex.org/A/?q=1#top") == "https://ex.org/A/?q=1"
    assert one(spark, urls.post_id("u"), u="http://a.b/view/77?x=1") == "77"
    assert one(spark, urls.public_host("u"), u="http://127.0.0.1/x") is False
    assert one(spark, urls.public_host("u"), u="https://example.org/x") is True


def test_dates(spark):
    assert one(spark, dates.due_label(F.to_date("d"), F.lit(datetime.date(2026, 6, 1))), d="2026-06-04") == "D-3 · 6/4"
    assert one(spark, dates.month_day_dates("t", 2026), t="by 3/30, or 13/40") == ["2026-03-30"]
    periods = one(spark, dates.bell_periods("elementary"))
    assert [(p["start_min"], p["end_min"]) for p in periods] == [(540, 580), (590, 630), (640, 680), (690, 730), (780, 820), (830, 870)]
    assert one(spark, dates.clock("m"), m=-10) == "23:50"


def test_output_checks(spark):
    src = "# A\n# B\n- x\n- y\n" + "text " * 60 + "cost 15,000"
    issues = one(spark, checks.output_issues("s", "o"), s=src, o="짧은 글")
    assert issues == ["hangul_leftover", "too_short", "headings_lost", "list_items_lost", "numbers_lost"]
    assert one(spark, checks.output_issues("s", "o"), s=src, o=" \n") == ["empty_output"]
    assert one(spark, checks.verdict(checks.output_issues("s", "o")), s="hello", o="hola") == "passed"
    assert one(spark, checks.output_issues("s", "o"), s="a", o="\n".join(["this line is repeated often"] * 3)) == ["repeated_line"]
