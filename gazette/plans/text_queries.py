"""Queries on texts: quality, fingerprints, facts, checks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import checks, links, text as X, urls
from gazette.functions.notices import too_long
from gazette.operators import dedup
from gazette.plans.base import Query, spread, table
from gazette.plans.flagship import LATIN, best_document_per_source

# Literal values, apart from those of the library, so that a wrong pattern there shows.
_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DATE = "(?:20[0-9]{2}[.\\-/년]" + _BLANK + "*[0-9]{1,2}[.\\-/월]" + _BLANK + "*[0-9]{1,2}|(?:[0-9]{1,2}[./][0-9]{1,2}))"
_MONEY = "[0-9][0-9,]*" + _BLANK + "*원"
_PHONE = "(?:0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}|1[0-9]{2}|117)"
_ACTION, _DOMAIN = "제출|신청|동의|납부|참여|작성|회신|응답|지참", "가정통신문|안내|학부모|학생"
_STRIP = f"regexp_replace(text, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _score_sql(script: str) -> str:
    return f"""select doc_id, source, lang, t, case when length(t) = 0 then 0.0 else floor(greatest(0.0::double, least(100.0::double,
        least(length(t)::double / 2000.0::double, 1.0::double) * 30.0::double
        + least((length(regexp_replace(t, '[^' || '{script[1:-1]}' || ']', '', 'g'))::double / greatest(length(t)::double, 1.0::double)) / 0.45::double, 1.0::double) * 25.0::double
        + case when regexp_matches(t, '{_DATE}') then 8.0::double else 0.0::double end
        + case when regexp_matches(t, '{_PHONE}') then 6.0::double else 0.0::double end
        + case when regexp_matches(t, '{_MONEY}') then 6.0::double else 0.0::double end
        + case when regexp_matches(t, '{_ACTION}') then 10.0::double else 0.0::double end
        + case when regexp_matches(t, '{_DOMAIN}') then 10.0::double else 0.0::double end
        - least((length(t)::double - length(replace(t, '�', ''))::double) / greatest(length(t)::double, 1.0::double) / 0.03::double, 1.0::double) * 20.0::double)) * 100.0::double + 0.5::double)::double / 100.0::double end as score,
      length(regexp_replace(t, '[^' || '{script[1:-1]}' || ']', '', 'g')) as letters
      from (select doc_id, source, lang, {_STRIP} as t from documents where text is not null)"""


_SCRIPTS = {"hangul": X.HANGUL, "latin": LATIN}


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null")).select("doc_id", X.text_quality("text", _SCRIPTS).alias("q"))


def v1_text_quality(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("doc_id", F.col("q.hangul.score").alias("hangul_score"), F.col("q.latin.score").alias("latin_score"))


def v2_low_quality(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("doc_id", F.col("q.hangul.low").alias("low_hangul"), F.col("q.latin.low").alias("low_latin"))


def v3_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """A third of the texts as they are, others cut into short lines, with a divider or a heading, or as a nested table."""
    made = F.expr("case pmod(doc_id, 6) when 0 then replace(text, '. ', '.\n') when 1 then replace(text, ' ', '\n') when 2 then concat(replace(text, ' ', '\n'), '\n|---|:-:|\n') when 3 then concat('#', replace(text, ' ', '\n')) when 4 then concat(text, '\n | a | --- | b |') else text end")
    docs = spread(table(spark, d, "documents").where("text is not null")).select("doc_id", X.quality_gate(made, LATIN).alias("g"))
    return docs.select("doc_id", "g.fragment_ratio", "g.needs_file", F.array_join("g.reasons", ",").alias("reasons"), F.col("g.headings").cast("long").alias("headings"), F.col("g.tables").cast("long").alias("tables"))


def d1_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fingerprint_groups(spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text")), "doc_id", "text")


def d2_token_sets(spark: SparkSession, d: str) -> DataFrame:
    t = X.tokens("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.slice(F.array_sort(t), 1, 5), " ").alias("first_tokens"))


def d9_exact_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.char_length("text") >= 200)
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def c1_collapse(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(X.collapse("text").cast("binary"), 256).alias("sha"), F.char_length(X.collapse("text")).cast("long").alias("n"))


def c2_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(F.transform(X.lines("text"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != "")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(kept).cast("long").alias("n_lines"), F.sha2(F.array_join(kept, "\n").cast("binary"), 256).alias("sha"))


# Read alike by Spark and DuckDB: each text is followed by its length in thousands, grouped by a separator of several kinds, in digits of several scripts.
_GROUPED = "text || case doc_id % 7 when 0 then '' else ' ' || translate(cast(length(text) as varchar(9)) || case doc_id % 5 when 0 then ',' when 1 then '.' when 2 then chr(160) when 3 then ' ' else chr(39) end || '000', '0123456789', case doc_id % 4 when 0 then '०१२३४५६७८९' when 1 then '０１２３４５６７８９' when 2 then '٠١٢٣٤٥٦٧٨٩' else '0123456789' end) end"


def c58_numbers(spark: SparkSession, d: str) -> DataFrame:
    found = X.significant_numbers(F.expr(_GROUPED))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.array_sort(found), ",").alias("numbers")).where("numbers <> ''")


# Read alike by Spark and DuckDB: rows of tables after each text, with empty cells, a divider, and one cell four times.
_TABLED = "text || case doc_id % 5 when 0 then chr(10) || '| time | |' || chr(10) || '|---|---|' || chr(10) || '|same|same|same|same|' when 1 then chr(10) || '  | ' || lang || ' |  | ' || cast(length(text) as varchar(9)) || ' ||' when 2 then chr(10) || '||' || chr(10) || '|' || substr(text, 1, 9) || '|' when 3 then chr(10) || '|same|same|same|' else '' end"


def v3_gate_signals(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("text is not null"))
    g = docs.select("doc_id", X.gate_signals(F.expr(_TABLED), F.when(F.col("lang") == "de", "FALLBACK").otherwise("ok")).alias("g"))
    return g.select("doc_id", "g.fallback", F.col("g.chars").cast("long").alias("chars"), "g.table_empty_ratio", "g.repeat_junk")


def c63_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", X.bucket31("c_name").alias("bucket"))


def c65_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.redact(F.concat(F.col("url"), F.lit("&key=abc123"))).alias("safe"))


def c66_corpus_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    n = F.char_length("text")
    dense = F.regexp_count("text", F.lit("[0-9]+"))
    return docs.select("doc_id", F.when(n < 600, "short").when(n < 1600, "medium").otherwise("long").alias("length_tag"), F.when(dense >= 10, "dense").when(dense >= 3, "some").otherwise("sparse").alias("fact_tag"))


def c78_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.first_line_title("text").alias("title"))


def v4_invented_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns with numbers that the user turn before lacks."""
    pairs = _pairs(spark, d)
    return pairs.select("conv_id", "turn", F.array_join(checks.invented_numbers("asked", "said"), ",").alias("invented"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("asked"))
    said = turns.where("role = 'assistant'").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    return said.join(asked, ["conv_id", "turn"])


_PAIRS_SQL = """select s.conv_id, s.turn, asked, said from (select conv_id, turn, min(text) as said from conversations where role = 'assistant' group by all) s
  join (select conv_id, turn + 1 as turn, min(text) as asked from conversations where role = 'user' group by conv_id, turn) a on s.conv_id = a.conv_id and s.turn = a.turn"""


def v7_output_checks(spark: SparkSession, d: str) -> DataFrame:
    """Answers held against questions, with headings, lists, numbers, repeats and blanks added to some of either."""
    pairs = _pairs(spark, d).where("asked is not null and said is not null")
    asked = F.expr("asked || case conv_id % 4 when 0 then '\n# a\n## b\n- x\n1. y\n' when 1 then '\n회비 12,000 2024.5.14 0007' else repeat(' word', 50) end")
    said = F.expr("case conv_id % 5 when 0 then ' ' when 1 then said || '\n# a\n- x' when 2 then '안내 ' || said when 3 then repeat('this line is said again\n', 3) else said || ' 12' || chr(160) || '000' end")
    issues = checks.output_issues(asked, said)
    return pairs.select("conv_id", "turn", issues.alias("i")).select("conv_id", "turn", F.array_join("i", ",").alias("issues"), checks.verdict(F.col("i")).alias("verdict"))


def v24_length_gate(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", (F.char_length("said") > 3 * F.char_length("asked")).alias("too_long"), X.degenerate("said", "asked").alias("degenerate"))


def v22_long_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Attachments with too many pages, or characters where pages are not counted."""
    pages = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 40)
    return table(spark, d, "documents").select("doc_id", too_long(pages, F.col("text")).alias("too_long"))


def v25_forbidden_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").rlike("license|copyright")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def a16_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(X.lines("text")).alias("line")).select("doc_id", F.trim("line").alias("line")).where(F.char_length("line") >= 20)
    return rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").groupBy("doc_id").agg(F.count(F.lit(1)).alias("repeated"), F.max("n").alias("most"))


def a15_fragments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.count_if(X.fragment_ratio("text") > 0.4).alias("flattened"), F.count(F.lit(1)).alias("n"))


def c9_canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.canonical("url").alias("canonical"))


def c14_post_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.post_id("url").alias("post_id"))


# Read alike by Spark and DuckDB: whole, without its path, with a fragment and a capital in the authority, and by a scheme that has no other.
_KINDS = "case page_id % 5 when 0 then url when 1 then split_part(url, '/', 1) || '//' || split_part(url, '/', 3) when 2 then replace(split_part(url, '#', 1), '://', '://WWW.') || '#top' when 3 then split_part(url, '/', 3) else 'ftp://' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4) end"


def c67_url_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(urls.variants(F.expr(_KINDS))).alias("pos", "variant")).select("page_id", F.col("pos").cast("long").alias("pos"), "variant")


_FILES = {
    "head": "case page_id % 9 when 0 then '%PDF-1.7' when 1 then 'PK\x03\x04 xl/workbook.xml' when 2 then 'PK\x03\x04mimetypeapplication/hwp+zip' when 3 then 'PK\x03\x04 other' else html end".replace("\x03\x04", "' || chr(3) || chr(4) || '"),
    "name": "case page_id % 7 when 0 then 'a.HWP' when 1 then 'b.jpeg' when 2 then 'c.xlsm' when 3 then 'd.htm' else 'e' || page_id end", "mime": "case page_id % 5 when 0 then 'text/html; charset=utf-8' when 1 then 'image/png' when 2 then 'application/x-PDF' end",
}
_HOSTS = {
    "localhost": False, "127.0.0.1": False, "10.1.2.3:80": False, "192.168.0.1": False, "172.16.9.9": False, "172.32.0.1": True, "169.254.169.254": False, "100.64.0.1": False, "100.128.0.1": True, "0.0.0.0": False, "[::1]:8080": False, "[fd00::1]": False,
    "[fe80::1]": False, "[::ffff:10.0.0.1]": False, "[2606:4700::1111]": True, "2130706433": False, "0x7f.1": False, "8.8.8.8": True, "user@10.0.0.1": False, "user:pw@example.com": True, "224.0.0.1": False, "example.10.com": True, "metadata.google.internal": False, "": False,
}


def s10_file_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Heads, names and declared types of files, one of each a page."""
    rows = table(spark, d, "pages").selectExpr("page_id", *[f"{e} as {n}" for n, e in _FILES.items()])
    return rows.select("page_id", urls.file_kind(F.col("head").cast("binary"), "name", "mime").alias("kind"))


def s17_public_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The URL of each page with one of a list of hosts in place of its own, and in one of eleven another scheme."""
    hosts = F.array(*[F.lit(h) for h in _HOSTS])
    host = F.element_at(hosts, (F.col("page_id") % len(_HOSTS) + 1).cast("int"))
    url = F.concat(F.when(F.col("page_id") % 11 == 0, "ftp").otherwise("https"), F.lit("://"), host, F.lit("/a?b"))
    return table(spark, d, "pages").select("page_id", urls.public_host(url).alias("public"))


def c8_page_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.collapse(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


def c5_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of each page to its own host, those of its source and others of every form, by host and target."""
    more = F.lit("<a class=x href='../up?q=1#top'>a</a> <a href='sub/./page'>b</a> <A HREF=\"?p=2\">c</a> <a href='#x'>d</a> <a href='mailto:a@b'>e</a> <a href='https://other.example/'>f</a>")
    pages = table(spark, d, "pages").select("url", "page_id", F.concat(F.coalesce("html", F.lit("")), more).alias("html")).where("url is not null")
    links = pages.select(F.lower(urls.part("url", 2)).alias("host"), F.explode(urls.page_links("html", "url")).alias("target"))
    return links.groupBy("host", "target").agg(F.count(F.lit(1)).alias("pages"))


# Read alike by Spark and DuckDB: marks of attachments in some of the pages, and what the answers say that they are.
_MARKED = "html || case page_id % 5 when 0 then repeat('<a onclick=serverFileObjArray[0]>다운로드</a>', cast(page_id % 4 as int)) when 1 then '<p>파일첨부 atchFileId=1&fileSn=2 downFile.do' when 2 then 'DEXT5UPLOAD.AddUploadedFile(fn_egov_downFile)<>' else '' end"
_SAID = "case page_id % 6 when 0 then 'application/pdf' when 1 then 'TEXT/HTML' when 2 then null else 'text/html; charset=utf-8' end"


def c73_richness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", links.richness(F.expr(_MARKED), F.expr(_SAID)).alias("richness"))


def a13_toxic_share(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(X.round_half_up(F.count_if(F.col("toxic") == 1).cast("double") / F.count(F.lit(1)).cast("double") * 100.0, 1).alias("toxic_percent"), F.count(F.lit(1)).alias("n"))


_PART = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_FRAG = r"""(with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')), lambda x: x <> '') as s from documents where text is not null)
  select doc_id, case when len(s) = 0 then 0.0::double else len(list_filter(s, lambda x: length(x) < 12 and not regexp_matches(x, '^[#\-|*※☎○•□>]') and not regexp_matches(x, '[.!?:)）」』\]]$')))::double / len(s)::double end as ratio from l)"""

# Digits by their value in the Unicode table, which the engine of the SQL does not know beyond their class.
_ANY_DIGIT = [chr(c) for c in range(128, 0x110000) if unicodedata.digit(chr(c), None) is not None]
_NUMBERS = r"""list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(translate({0}, 'FROM', 'TO'), '[0-9]{{1,3}}(?:[,. \x{{A0}}][0-9]{{3}})+|[0-9]+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) >= 4), lambda x: case when regexp_matches(x, '^0+$') then '0' else regexp_replace(x, '^0+', '') end))""".replace("FROM", "".join(_ANY_DIGIT)).replace("TO", "".join(str(unicodedata.digit(c)) for c in _ANY_DIGIT))

QUERIES: dict[str, Query] = {
    "flagship_best_document": (best_document_per_source, f"select source, doc_id, lang, score from ({_score_sql(LATIN)}) where not (length(t) < 20 or (letters < 10 and length(t) < 200) or score < 12) qualify row_number() over (partition by source order by score desc, doc_id) = 1"),
    "v1_text_quality": (v1_text_quality, f"select h.doc_id, h.score as hangul_score, l.score as latin_score from ({_score_sql(X.HANGUL)}) h join ({_score_sql(LATIN)}) l on h.doc_id = l.doc_id"),
    "v2_low_quality": (v2_low_quality, f"select h.doc_id, length(h.t) < 20 or (h.letters < 10 and length(h.t) < 200) or h.score < 12 as low_hangul, length(l.t) < 20 or (l.letters < 10 and length(l.t) < 200) or l.score < 12 as low_latin from ({_score_sql(X.HANGUL)}) h join ({_score_sql(LATIN)}) l on h.doc_id = l.doc_id"),
    "v3_quality_gate": (v3_quality_gate, rf"""with m as (select doc_id, case doc_id % 6 when 0 then replace(text, '. ', '.' || chr(10)) when 1 then replace(text, ' ', chr(10)) when 2 then replace(text, ' ', chr(10)) || chr(10) || '|---|:-:|' || chr(10) when 3 then '#' || replace(text, ' ', chr(10)) when 4 then text || chr(10) || ' | a | --- | b |' else text end as text from documents where text is not null),
      l as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '') as s, {_STRIP} as t from m),
      g as (select doc_id, len(list_filter(s, lambda x: x[1] = '#')) as headings, len(list_filter(s, lambda x: regexp_matches(x, '^\|[-|: \t]+\|$') and contains(x, '-'))) as tables,
        floor(len(list_filter(s, lambda x: length(x) < 12 and not regexp_matches(x, '^[#\-|*※☎○•□>]') and not regexp_matches(x, '[.!?:)）」』\]]$')))::double / greatest(len(s), 1)::double * 1000.0::double + 0.5::double) / 1000.0::double as ratio,
        len(list_filter(s, lambda x: x[1] = '|' and not (regexp_matches(x, '^\|[-|: \t]+\|$') and contains(x, '-')) and regexp_matches(x, '\|[ \t]*:?-{{3,}}:?[ \t]*\|'))) > 0 as soup, t from l),
      q as (select *, length(t) < 20 or (length(regexp_replace(t, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) < 10 and length(t) < 200) or least(length(t)::double / 2000.0::double, 1.0::double) * 30.0::double + least(length(regexp_replace(t, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g'))::double / greatest(length(t)::double, 1.0::double) / 0.45::double, 1.0::double) * 25.0::double
        + case when regexp_matches(t, '{_DATE}') then 8 else 0 end + case when regexp_matches(t, '{_PHONE}') then 6 else 0 end + case when regexp_matches(t, '{_MONEY}') then 6 else 0 end + case when regexp_matches(t, '{_ACTION}') then 10 else 0 end + case when regexp_matches(t, '{_DOMAIN}') then 10 else 0 end
        - least((length(t)::double - length(replace(t, '\ufffd', ''))::double) / greatest(length(t)::double, 1.0::double) / 0.03::double, 1.0::double) * 20.0::double < 11.995 as low, headings = 0 and tables = 0 and ratio > 0.4 as flat from g)
      select doc_id, ratio as fragment_ratio, flat or soup or low as needs_file, array_to_string(list_filter([case when flat then 'flattened' end, case when soup then 'nested_table' end, case when low then 'low_quality' end], lambda x: x is not null), ',') as reasons, headings, tables from q""".replace("\\ufffd", "\ufffd")),
    "d1_fingerprints": (d1_fingerprints, "with f as (select doc_id, case when k = '' then '' else substr(sha1(k), 1, 20) end as fingerprint from (select doc_id, regexp_replace(lower(text), '[^0-9A-Za-z가-힣]+', '', 'g') as k from documents where text is not null)) select doc_id, fingerprint, case when fingerprint = '' then doc_id else min(doc_id) over (partition by fingerprint) end as primary, case when fingerprint = '' then 1 else count(*) over (partition by fingerprint) end as copies from f"),
    "d2_token_sets": (d2_token_sets, f"select doc_id, len(t)::bigint as n_tokens, array_to_string(list_sort(t)[1:5], ' ') as first_tokens from (select doc_id, list_distinct(regexp_extract_all(lower(text), '{X.TOKEN}')) as t from documents where text is not null)"),
    "d9_exact_texts": (d9_exact_texts, "select sha256(text) as sha, min(doc_id) as doc_id, count(*) as copies from documents where length(text) >= 200 group by 1"),
    "c1_collapse": (c1_collapse, r"select doc_id, sha256(c) as sha, length(c) as n from (select doc_id, trim(regexp_replace(text, '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') as c from documents where text is not null)"),
    "c2_clean_lines": (c2_clean_lines, r"select doc_id, len(k) as n_lines, sha256(array_to_string(k, chr(10))) as sha from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')), lambda x: x <> '') as k from documents where text is not null)"),
    "c58_numbers": (c58_numbers, f"select doc_id, array_to_string(list_sort(n), ',') as numbers from (select doc_id, {_NUMBERS.format(_GROUPED)} as n from documents where text is not null) where len(n) > 0"),
    "c63_bucket": (c63_bucket, "select c_custkey, list_reduce(list_prepend(0::bigint, list_transform(string_split(c_name, ''), lambda x: ascii(x)::bigint)), lambda h, x: (h * 31 + x) % 4294967296) as bucket from customer"),
    "c65_redact": (c65_redact, r"select page_id, substr(regexp_replace(regexp_replace(url || '&key=abc123', '(key|token|authorization)=[^&\s]+', '\1=***', 'gi'), 'bearer [A-Za-z0-9._\-]+', 'bearer ***', 'gi'), 1, 400) as safe from pages"),
    "c66_corpus_tags": (c66_corpus_tags, "select doc_id, case when length(text) < 600 then 'short' when length(text) < 1600 then 'medium' else 'long' end as length_tag, case when n >= 10 then 'dense' when n >= 3 then 'some' else 'sparse' end as fact_tag from (select doc_id, text, len(regexp_extract_all(text, '[0-9]+')) as n from documents where text is not null)"),
    "c78_titles": (c78_titles, r"select doc_id, substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[#*\-•> \t]+|[#*\-•> \t\r]+$', '', 'g')), lambda x: x <> '')[1], 1, 120) as title from documents where text is not null"),
    "v4_invented_numbers": (v4_invented_numbers, f"select conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(said, '[0-9]+')), lambda x: not list_contains(regexp_extract_all(asked, '[0-9]+'), x))), ',') as invented from ({_PAIRS_SQL})"),
    "v3_gate_signals": (v3_gate_signals, f"""with t as (select doc_id, lang, text, {_TABLED} as md from documents where text is not null), r as (select *, list_filter(list_transform(string_split(md, chr(10)), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x[1] = '|' and not (regexp_matches(x, '^[|][-|: \t]+[|]$') and contains(x, '-'))) as rows from t),
      c as (select *, flatten(list_transform(rows, lambda x: string_split(trim(x, '|'), '|'))) as cells from r)
      select doc_id, coalesce(lang = 'de', false) as fallback, length(md) as chars, case when len(cells) = 0 then 0.0::double else floor(len(list_filter(cells, lambda x: regexp_replace(x, '{_BLANK}+', '', 'g') = ''))::double / len(cells)::double * 1000.0::double + 0.5::double) / 1000.0::double end as table_empty_ratio, doc_id % 5 = 0 as repeat_junk from c"""),
    "v7_output_checks": (v7_output_checks, rf"""with p as ({_PAIRS_SQL}),
      t as (select conv_id, turn, asked || case conv_id % 4 when 0 then chr(10) || '# a' || chr(10) || '## b' || chr(10) || '- x' || chr(10) || '1. y' || chr(10) when 1 then chr(10) || '회비 12,000 2024.5.14 0007' else repeat(' word', 50) end as s,
        case conv_id % 5 when 0 then ' ' when 1 then said || chr(10) || '# a' || chr(10) || '- x' when 2 then '안내 ' || said when 3 then repeat('this line is said again' || chr(10), 3) else said || ' 12' || chr(160) || '000' end as o from p where asked is not null and said is not null),
      m as (select *, length(regexp_replace(s, '^{_BLANK}+|{_BLANK}+$', '', 'g')) as n, length(regexp_replace(o, '^{_BLANK}+|{_BLANK}+$', '', 'g')) as m, len(regexp_extract_all(s, '(?m)^[ \t]{{0,3}}#{{1,6}}[ \t]+[^ \t\n]')) as hs, len(regexp_extract_all(o, '(?m)^[ \t]{{0,3}}#{{1,6}}[ \t]+[^ \t\n]')) as ho,
        len(regexp_extract_all(s, '(?m)^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+[^ \t\n]')) as ls, len(regexp_extract_all(o, '(?m)^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+[^ \t\n]')) as lo, SIG_S as ns, SIG_O as no,
        list_filter(list_transform(string_split(o, chr(10)), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: length(x) >= 20) as long from t),
      i as (select conv_id, turn, case when m = 0 then ['empty_output'] else list_filter([case when regexp_matches(o, '[가-힣]{{2,}}') then 'hangul_leftover' end, case when n >= 200 and m < n * 0.4::double then 'too_short' end, case when hs >= 2 and ho < hs * 0.6::double then 'headings_lost' end,
        case when ls >= 2 and lo < ls * 0.6::double then 'list_items_lost' end, case when len(list_filter(ns, lambda x: not list_contains(no, x))) > 0 then 'numbers_lost' end, case when len(list_filter(list_distinct(long), lambda x: len(list_filter(long, lambda y: y = x)) >= 3)) > 0 then 'repeated_line' end], lambda x: x is not null) end as i from m)
      select conv_id, turn, array_to_string(i, ',') as issues, case when list_has_any(i, ['empty_output', 'hangul_leftover', 'too_short', 'numbers_lost']) then 'failed' when len(i) > 0 then 'warned' else 'passed' end as verdict from i""".replace("SIG_S", _NUMBERS.format("s")).replace("SIG_O", _NUMBERS.format("o"))),
    "v24_length_gate": (v24_length_gate, f"select conv_id, turn, length(said) > 3 * length(asked) as too_long, regexp_matches(said, ' {{30,}}') or length(said) > length(asked) * (case when length(asked) > 4000 then 1.6 else 2.6 end) + 400 as degenerate from ({_PAIRS_SQL})"),
    "v22_long_attachments": (v22_long_attachments, "select doc_id, (doc_id % 3 = 0 and doc_id % 40 > 20) or length(coalesce(text, '')) > 20000 as too_long from documents"),
    "v25_forbidden_words": (v25_forbidden_words, "select source, count(*) as n from documents where regexp_matches(lower(text), 'license|copyright') group by source"),
    "a15_fragments": (a15_fragments, f"select source, count(*) filter (where ratio > 0.4) as flattened, count(*) as n from {_FRAG} f join documents d on f.doc_id = d.doc_id group by source"),
    "a16_repeated_lines": (a16_repeated_lines, "with l as (select doc_id, trim(unnest(string_split(text, chr(10))), ' ') as line from documents) select doc_id, count(*) as repeated, max(n) as most from (select doc_id, line, count(*) as n from l where length(line) >= 20 group by all having count(*) >= 3) group by doc_id"),
    "c9_canonical_urls": (c9_canonical_urls, rf"select page_id, regexp_replace(lower(regexp_extract(url, '{_PART}', 1)) || '://' || lower(regexp_extract(url, '{_PART}', 2)) || regexp_extract(url, '{_PART}', 3) || regexp_extract(url, '{_PART}', 4), '[/.,;]+$', '') as canonical from pages"),
    "c14_post_ids": (c14_post_ids, rf"select page_id, coalesce(nullif(regexp_extract(url, '[?&]post=([0-9]+)', 1), ''), nullif(regexp_extract(url, '[?&]id=([0-9]+)', 1), ''), nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), nullif(regexp_extract(p, '/view/([0-9]+)', 1), ''), nullif(regexp_extract(p, '([0-9]+)/?$', 1), '')) as post_id from (select page_id, url, regexp_extract(url, '{_PART}', 3) as p from pages)"),
    "c67_url_variants": (c67_url_variants, rf"""with u as (select page_id, {_KINDS} as url from pages), w as (select *, split_part(url, '://', 1) as s, split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) as h from u where contains(url, '://')), x as (select *, substr(url, length(s) + length(h) + 4) as p from w),
      y as (select *, case s when 'https' then 'http' when 'http' then 'https' end as t, case when h[1:4] = 'www.' then h[5:] else 'www.' || h end as o, not starts_with(p, '/') or regexp_matches(p, '^/(?:[?#]|$)') as flat from x),
      l as (select page_id, [s || '://' || h || p, case when not flat then s || '://' || h || '/' end, s || '://' || o || p, case when not flat then s || '://' || o || '/' end, t || '://' || h || p, case when not flat then t || '://' || h || '/' end, t || '://' || o || p, case when not flat then t || '://' || o || '/' end] as l from y union all select page_id, [url] from u where not contains(url, '://')),
      e as (select page_id, unnest(l) as variant, generate_subscripts(l, 1) as i from l), f as (select page_id, variant, min(i) as i from e where variant is not null group by all)
      select page_id, row_number() over (partition by page_id order by i) - 1 as pos, variant from f"""),
    "s10_file_kinds": (s10_file_kinds, "select page_id, case when page_id % 9 = 0 or page_id % 5 = 2 then 'pdf' when page_id % 7 = 1 or page_id % 5 = 1 then 'image' when page_id % 9 = 2 then 'hwpx' when page_id % 7 = 0 then 'hwp' when page_id % 7 = 2 or page_id % 9 = 1 then 'xlsx' when page_id % 5 = 0 or page_id % 7 = 3 then 'html' else 'unknown' end as kind from pages"),
    "s17_public_hosts": (s17_public_hosts, "select page_id, page_id % 11 <> 0 and page_id % 24 in (5, 8, 14, 17, 19, 21) as public from pages"),
    "c8_page_titles": (c8_page_titles, r"select page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') as title from pages"),
    "c5_links": (c5_links, rf"""with u as (select page_id, html, regexp_extract(url, '{_PART}', 1) || '://' || regexp_extract(url, '{_PART}', 2) as head, regexp_extract(url, '{_PART}', 3) as path, lower(regexp_extract(url, '{_PART}', 2)) as host from pages where url is not null),
      p as (select *, regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') as dir from u),
      l as (select page_id, host, head || t as target from (select *, unnest(regexp_extract_all(coalesce(html, ''), '<a href="(/[^"#]*)"', 1)) as t from p) union all select page_id, host, head || regexp_replace(dir, '[^/]+/$', '') || 'up?q=1' from p union all select page_id, host, head || dir || 'sub/page' from p union all select page_id, host, head || path || '?p=2' from p)
      select host, target, count(distinct page_id) as pages from l group by all"""),
    "c73_richness": (c73_richness, rf"""select page_id, case when contains(coalesce(lower(t), ''), 'text/html') then (len(regexp_extract_all(h, 'serverFileObj|DEXT5UPLOAD\.AddUploadedFile|atchFileId|fileSn|fn_egov_downFile|downFile\.do|파일첨부|다운로드')) + len(regexp_extract_all(h, 'serverFileObjArray'))) * 500
      + least(length(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g')), 5000) else 0 end as richness from (select page_id, {_MARKED} as h, {_SAID} as t from pages)"""),
    "a13_toxic_share": (a13_toxic_share, "select source, floor((count(*) filter (where toxic = 1))::double / count(*)::double * 100.0::double * 10.0::double + 0.5::double) / 10.0::double as toxic_percent, count(*) as n from labels join documents using (doc_id) group by source"),
}
