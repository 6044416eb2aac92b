"""What is derived from the facts of a notice: actions, cards, events, risk, kinds of content, the text shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.links import hits, names_any
from gazette.functions.text import BLANK, col, collapse, lines, once, strip

_S = BLANK
# Cues of what is to be done.
CONCRETE = ("제출", "신청", "납부", "회신", "동의", "작성", "방문", "접수", "지참", "준비물", "등록", "예약", "결제", "서명")
COURTESY, SUBMIT = ("협조", "당부", "유의", "양해"), ("제출", "회신", "납부", "제출하기")
RISKY = ("첨부", "붙임", "별첨", "양식", "서식", "qr", "링크", "계좌", "스쿨뱅킹", "납부", "수납", "동의서", "서명")
MAX_ITEMS = 5
_NONE = "array<string>"


def is_actionable(c: Column) -> Column:
    """A concrete cue makes it one; a mere courtesy does not; all else does unless it is empty."""
    return F.coalesce(F.when(c == "", False).when(names_any(c, CONCRETE), True).otherwise(~names_any(c, COURTESY)), F.lit(False))


def already_asked(submission: Column, actions: Column) -> Column:
    """Whether an action that asks for something to be handed in holds all words, of two characters or more, of the submission."""
    words = F.filter(F.split(strip(submission), rf"{_S}+"), lambda w: F.char_length(w) >= 2)
    return (F.size(words) > 0) & F.exists(actions, lambda a: names_any(a, SUBMIT) & F.forall(words, lambda w: a.contains(w)))


def action_items(actions: Column, submissions: Column, deadline: Column) -> Column:
    """text and hint of the items of a card: actions, then submissions not among them; five at most, the deadline on the first."""
    kept = F.filter(actions, is_actionable)
    more = F.transform(F.filter(submissions, lambda s: ~already_asked(s, kept)), lambda s: F.concat(F.lit("제출: "), s))
    every = F.slice(F.array_distinct(F.concat(kept, more)), 1, MAX_ITEMS)
    return F.transform(every, lambda x, i: F.struct(x.alias("text"), F.when((i == 0) & (deadline != ""), deadline).alias("hint")))


def yearless_dates(c: Column | str, year: int) -> Column:
    """ISO dates of months and days named without a year, in three spellings, each read over the whole text."""
    patterns = (rf"(?<![0-9])([0-9]{{1,2}}){_S}*월{_S}*([0-9]{{1,2}}){_S}*일", rf"(?<![0-9])([0-9]{{1,2}}){_S}*[./]{_S}*([0-9]{{1,2}})(?:[./]|$)", rf"(?<![0-9])([0-9]{{1,2}}){_S}*/{_S}*([0-9]{{1,2}})(?![0-9])")
    found = F.flatten(F.array(*[F.arrays_zip(F.regexp_extract_all(col(c), F.lit(p), F.lit(1)).alias("m"), F.regexp_extract_all(col(c), F.lit(p), F.lit(2)).alias("d")) for p in patterns]))
    good = F.filter(found, lambda x: x["m"].cast("int").between(1, 12) & x["d"].cast("int").between(1, 31))
    days = F.transform(good, lambda x: F.concat(F.lit(f"{year}-"), F.lpad(x["m"], 2, "0"), F.lit("-"), F.lpad(x["d"], 2, "0")))
    return F.array_distinct(F.filter(days, lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull()))


def events(points: Column) -> Column:
    """event_date, end_date, event_kinds of points (start, end or null, kind) in the order in which dates were first named.

    A date has the kinds of all its points, deadlines first, and the latest end. A date that is an event only and
    ends a span is left out, as the span shows it.
    """

    def made(p: Column) -> Column:
        starts = F.array_distinct(F.transform(p, lambda x: x["start"]))
        of = lambda d: F.filter(p, lambda x: x["start"] == d)
        has = lambda d, kind: F.exists(of(d), lambda x: x["kind"] == kind)
        rows = F.transform(starts, lambda d: F.struct(d.alias("event_date"), F.array_max(F.transform(of(d), lambda x: x["end"])).alias("end"), F.array_compact(F.array(F.when(has(d, "deadline"), "deadline"), F.when(has(d, "event"), "event"))).alias("kinds")))
        return rows

    def kept(rows: Column) -> Column:
        spans = F.transform(F.filter(rows, lambda r: r["end"] > r["event_date"]), lambda r: r["end"])
        shown = F.filter(rows, lambda r: F.coalesce(r["end"] > r["event_date"], F.lit(False)) | ~((F.array_join(r["kinds"], ",") == "event") & F.array_contains(spans, r["event_date"])))
        return F.transform(shown, lambda r: F.struct(r["event_date"].alias("event_date"), F.when(r["end"] > r["event_date"], r["end"]).alias("end_date"), r["kinds"].alias("event_kinds")))

    return once(points, lambda p: once(made(p), kept))


def risk_reasons(text: Column | str, sizes: dict[str, Column], has_meal: Column) -> Column:
    """Why a notice needs care in translation, in a fixed order; sizes: how many facts of each field there are."""
    t = strip(text)
    n = lambda f: F.coalesce(sizes.get(f, F.lit(0)), F.lit(0))
    found = [F.when(n(f) > 0, f"has_{f}") for f in ("deadlines", "fees", "contacts", "urls", "submissions", "warnings")]
    found += [F.when(n("actions_required") > 1, "has_multiple_actions_required"), F.when(has_meal, "has_meal_or_dictionary_sensitive_content"), F.when((n("dates") > 2) | (n("times") > 2), "has_multiple_schedule_facts")]
    found += [F.when(F.char_length(t) > 1600, "long_notice"), F.when(names_any(F.lower(t), RISKY), "has_high_risk_text_cues")]
    return once(F.array_compact(F.array(*found)), lambda r: F.when(F.size(r) > 0, F.struct(F.lit("high").alias("level"), r.alias("reasons"))).otherwise(F.struct(F.lit("low").alias("level"), F.array(F.lit("simple_notice_without_actions_or_deadlines")).alias("reasons"))))


def review(text: Column, failure: Column, required: Column, reason: Column, cut: int = 500) -> Column:
    """needed and why: only where there is a text, by the failure's reason, else by the editor's."""
    why = F.coalesce(F.when(strip(failure) != "", failure), F.when(required, F.coalesce(F.when(strip(reason) != "", reason), F.lit("admin_review_required"))))
    why = F.when(F.coalesce(strip(text) != "", F.lit(False)), F.substring(why, 1, cut))
    return F.struct(why.isNotNull().alias("needed"), why.alias("reason"))


def priority(severities: Column) -> Column:
    s = F.transform(severities, F.lower)
    return F.when(F.array_contains(s, "critical"), "critical").when(F.array_contains(s, "high"), "high").otherwise("normal")


def content_kind(has_text: Column, has_image: Column, has_attachment: Column) -> Column:
    """One of eight kinds by what a notice has."""
    t, i, a = (F.coalesce(x, F.lit(False)) for x in (has_text, has_image, has_attachment))
    return (
        F.when(t & i & a, "mixed").when(t & i, "html_text_with_images").when(t & a, "html_text_with_attachments").when(i & a, "image_with_attachments")
        .when(t, "html_text_only").when(i, "image_only").when(a, "attachment_only").otherwise("empty_or_unreadable")
    )


def body_has_content(c: Column | str) -> Column:
    """Whether a line is left when headings, board lines and lists of attachments are set aside."""
    files, refs, meta = r"(?i)\.(hwp|hwpx|pdf|jpe?g|png|gif|docx?|xlsx?|pptx?|zip|hwt|txt)$", rf"^\[?첨부{_S}*[0-9]|^첨부파일", rf"^(이름|성명|작성자|작성일|등록일|게시일|수정일|조회수|조회|추천|댓글|좋아요){_S}*[:：]"

    def real(line: Column) -> Column:
        bare = strip(line)
        core = strip(F.regexp_replace(bare, rf"^(?:[-*•·]|{_S})+", ""))
        return (bare != "") & ~bare.startswith("#") & (core != "") & ~core.rlike(meta) & ~core.rlike(refs) & ~core.rlike(files)

    return F.exists(lines(c), real)


def without_decoration(c: Column | str) -> Column:
    """Lines of four tokens or more of which four in five are single letters left out."""

    def decorative(line: Column) -> Column:
        tokens = F.filter(F.split(line, rf"{_S}+"), lambda t: t != "")
        return (F.size(tokens) >= 4) & (F.size(F.filter(tokens, lambda t: t.rlike("^[A-Za-z]$"))) * 5 >= F.size(tokens) * 4)

    return F.array_join(F.filter(lines(c), lambda x: ~decorative(x)), "\n")


def looks_flattened(c: Column | str) -> Column:
    """Eight lines or more, of which over 45 in a hundred are short and neither list items nor sentences."""
    filled = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    bare = lambda x: (F.char_length(x) < 12) & ~x.rlike(r"^[#\-|*※○•□>❍∙·❑◦]") & ~x.rlike(r"[.!?:)）」』\]다요함음임됨]$")
    return once(filled, lambda f: (F.size(f) >= 8) & (F.size(F.filter(f, bare)) * 100 > F.size(f) * 45))


def is_board_text_only(kind: Column, c: Column | str) -> Column:
    """A body of under 160 characters that names two of author, date and views."""
    t = collapse(c)
    return (kind == "html_body") & (F.char_length(t) < 160) & (hits(t, ("작성자", "등록일", "조회수")) >= 2)


def combined_text(sources: Column) -> Column:
    """Texts of sources (kind, text), in order, between rules; a body of board lines alone is left out beside an attachment."""
    attached = ("attachment", "attachment_pdf", "attachment_hwp", "attachment_hwpx", "attachment_xlsx", "direct_file")
    beside = F.exists(sources, lambda s: s["kind"].isin(*attached) & (strip(s["text"]) != ""))
    kept = F.filter(sources, lambda s: (strip(s["text"]) != "") & ~(beside & is_board_text_only(s["kind"], s["text"])))
    return F.array_join(F.transform(kept, lambda s: strip(s["text"])), "\n\n---\n\n")


KEYWORDS = ("가정통신문", "학부모", "안내", "학교", "신청", "일시", "대상", "기간", "검사", "교육")


def document_score(c: Column | str) -> Column:
    """Score of a text from a word processor's file: letters, length, key words and lines, less stray ideographs."""
    t = strip(c)

    def scored(t: Column) -> Column:
        n = F.char_length(t)
        hangul, ideographs = n - F.char_length(F.regexp_replace(t, "[가-힣]+", "")), n - F.char_length(F.regexp_replace(t, "[一-鿿]+", ""))
        words = sum(((n - F.char_length(F.replace(t, F.lit(w), F.lit("")))) / len(w) for w in KEYWORDS), F.lit(0.0))
        filled = F.size(F.filter(lines(t), lambda x: strip(x) != ""))
        return hangul * 2 + n * 0.08 + words * 20 + F.least(filled, F.lit(30)) * 3 - ideographs * 3

    return F.round(once(t, scored), 2)


def drops_inline_text(kind: Column, score: Column, is_carrier: Column, has_clean_document: Column) -> Column:
    """Text read from a picture in the body goes if a clean document carries the same and its quality is under 60."""
    return has_clean_document & ~is_carrier & (kind == "inline_image") & (F.coalesce(score, F.lit(0.0)) < 60)


_MONTH_DAY = (rf"([0-9]{{1,2}}){_S}*월{_S}*([0-9]{{1,2}}){_S}*일", rf"[0-9]{{4}}{_S}*\.{_S}*([0-9]{{1,2}}){_S}*\.{_S}*([0-9]{{1,2}})", rf"([0-9]{{1,2}}){_S}*\.{_S}*([0-9]{{1,2}}){_S}*\.{_S}*\(")


def month_days(c: Column | str) -> Column:
    """month-day of dates in three spellings."""
    number = lambda x, p, k: F.regexp_extract(x, p, k).cast("int").cast("string")
    found = lambda p: F.transform(F.regexp_extract_all(col(c), F.lit(p), F.lit(0)), lambda x: F.concat(number(x, p, 1), F.lit("-"), number(x, p, 2)))
    return F.array_distinct(F.concat(*[found(p) for p in _MONTH_DAY]))


def invented_facts(summary: Column | str, source: Column | str) -> Column:
    """Dates (by month and day) and amounts of money of a summary that its source lacks, sorted. An amount is there if a whole number of the source has its digits."""
    days = F.array_except(month_days(summary), month_days(source))
    numbers = F.regexp_extract_all(F.regexp_replace(col(source), "(?<=[0-9]),(?=[0-9])", ""), F.lit("[0-9]+"), F.lit(0))
    money = F.array_distinct(F.regexp_extract_all(col(summary), F.lit(rf"[0-9][0-9,]*{_S}*원"), F.lit(0)))
    unknown = once(numbers, lambda known: F.filter(money, lambda m: ~F.array_contains(known, F.regexp_replace(m, "[^0-9]", ""))))
    return F.array_sort(F.concat(days, unknown).cast(_NONE))


#: Methods of extraction that are trusted most; fewest characters of a text; most pages and characters of an attachment.
EXACT_METHODS, MIN_TEXT, MAX_PAGES, MAX_CHARS = ("html", "html_file", "hwp_ole_bodytext_filtered", "hwp_prv_text", "hwpx_xml", "pdf_pymupdf"), 20, 20, 20_000


def source_status(status: Column, text: Column) -> Column:
    """A success of hardly any text is none."""
    return F.when((status == "success") & (F.char_length(strip(F.coalesce(text, F.lit("")))) < MIN_TEXT), "empty_or_unreadable").otherwise(status)


def default_confidence(method: Column, status: Column, model_prefix: str = "model") -> Column:
    return F.when(~status.isin("success", "partial_success"), 0.0).when(method.startswith(model_prefix), 0.72).when(method.isin(*EXACT_METHODS), 0.86).otherwise(0.65)


def too_long(pages: Column, text: Column) -> Column:
    """More pages than are worth cleaning, or as many characters where pages are not counted or few."""
    return F.coalesce(pages > MAX_PAGES, F.lit(False)) | (F.char_length(F.coalesce(text, F.lit(""))) > MAX_CHARS)


def earliest(*dates: Column) -> Column:
    """The least of ISO dates of several origins (arrays); null if there are none."""
    return F.array_min(F.array_distinct(F.filter(F.concat(*dates), lambda x: x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))))
