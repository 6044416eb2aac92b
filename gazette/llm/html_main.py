"""Main text of web pages by site template removal (operator 8).

Every page is read into a tree of elements. Each element's subtree (tag, marks, text, children) has a hash;
with the page's host it is a key, and Spark counts the pages of each key and of each host. A subtree that stands
on ``min_pages`` pages or more of its host, and on twice as many as what it is part of, is template and goes,
inside a marked article (article, main) as outside; there, unless it mostly consists of links, only if it stands
on more than half of the host's pages, since articles that differ quote the same passages too. What it is part of: the page; in a marked article that
article, the pages that more than half of its text stands on, or those with its title (h1), since articles are
copied, with edits too. In a marked article, headings, list items and table cells go with their whole only, unless
they are links; words within a sentence stay everywhere, links too in a marked article. On a page without a marked article, a recurring subtree of more than half of the remaining text
is the main part, unless it mostly consists of links, and its children are judged against its count; and text
that recurs and is more than half of what remains counts as copied if it stands on half of the host's pages or
fewer (on more it is template). A long notice on few pages with short articles is thus kept.

Counts are asked first. What they leave, because it is on too few pages, is settled by rules of the page: elements
that hold no text, those for navigation, headers, footers, asides and forms, and those whose class, id or role
says so (reader comments, adverts that change) go. On a host of fewer than ``min_pages`` pages, which counts say nothing
about, the text of a marked article is taken alone; on others all that counts and rules leave of the page.
``decided_col`` tells how much text went by counts and how much by rules.

Keys are 64-bit and counted with map-side combination, so a host with a third of all pages costs its tasks no
more than others. Recurring keys go to the workers while there are at most SENT_KEYS of them; beyond that the
keys of each page are joined with the recurring ones instead, with the same result.

Defined results: null and empty html, and pages without main text, give the empty text. A null url is a host
of its own. Rows repeat as given; other columns pass through. Pages are read whole; unclosed, misnested and
unknown elements are tolerated.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.shared import free_name, refuse, save, tidy

SENT_KEYS = 500_000
#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
SILENT = frozenset("head script style title noscript iframe template svg math object canvas audio video select option datalist button textarea input dialog menu".split())
CHROME = frozenset("nav header footer aside form".split())
MAIN = frozenset("article main".split())
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th caption".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
HOLDS = frozenset("article main section div ul ol dl table tbody thead body html nav header footer aside form blockquote".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
#: What a start tag ends if it is open.
ENDS = {tag: CLOSES.get(tag, frozenset()) | (frozenset({"p"}) if tag in ENDS_P else frozenset()) for tag in {*CLOSES, *ENDS_P}}
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer header masthead menu modal nav navbar navigation newsletter "
    "notice notices notification popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())

#: Elements nested deeper than this are siblings of the deepest one, as in browsers.
DEPTH = 512
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?)""")
_READ = frozenset("class id role hidden aria-hidden style".split())
#: References by number that no character has; they would be read digit by digit.
_ZEROS, _HUGE = re.compile(r"&#0{8,}"), re.compile(r"&#[0-9]{9,}")
_WORDS = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("tag", "marks", "kids", "chrome", "silent", "main", "size", "links", "hash")

    def __init__(self, tag: str, said: dict[str, str] | None = None) -> None:
        self.tag, self.marks, self.kids = tag, "", []
        self.silent, self.chrome = tag in SILENT, tag in CHROME
        self.size = self.links = self.hash = 0
        self.main = False
        if said:
            self.marks = f"{said.get('class', '')} {said.get('id', '')}".strip()
            named = {w.lower() for w in _WORDS.findall(self.marks)}
            if tag not in MAIN or named & {"comment", "comments", "reply", "replies"}:
                self.chrome |= (bool(named & MARKS) or said.get("role", "").lower() in ROLES) and tag not in ("html", "body")
            self.silent |= "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in said.get("style", "").replace(" ", "").lower()


def _decoded(text: str) -> str:
    return html.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#0", text)) if "&#" in text else text)


class _Scanner:
    """Tags of a page in one pass: each character is looked at a fixed number of times, whatever the markup."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.plain = page, page.rfind(">"), False

    def attributes(self, at: int) -> tuple[int, dict[str, str]]:
        """Where the tag whose name ends at ``at`` ends, and its attributes. If none closes it outside quotes, it and all that follow end at the next sign."""
        said: dict[str, str] = {}
        if self.page[at] == ">":
            return at + 1, said
        j = at
        while not self.plain and (m := _ATTRIBUTE.match(self.page, j)):
            j = m.end()
            if m[1]:
                return j, said
            if (name := m[2].lower()) in _READ:
                said.setdefault(name, m[3] or m[4] or m[5] or "")
        self.plain = True
        return self.page.index(">", at) + 1, {}

    def next(self, at: int) -> tuple[int, int, bool, str, dict[str, str]] | None:
        """start, end, whether it closes, name and attributes of the next tag; the name of a comment or declaration is empty."""
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if page.startswith("<!--", i):
                end = page.find("-->", i + 2)
                return i, len(page) if end < 0 else end + 3, False, "", {}
            if i >= self.last:
                return None
            if page[i + 1] in "!?":
                return i, page.index(">", i) + 1, False, "", {}
            if m := _NAME.match(page, i):
                if m.end() > self.last:
                    return None
                end, said = self.attributes(m.end())
                return i, end, bool(m[1]), m[2].lower(), said
            at = i + 1
        return None


def parse(page: str) -> Node:
    """The tree of a page; kids are nodes and strings, whose references are decoded."""
    root = Node("html")
    stack, at, n, scanner = [root], 0, len(page), _Scanner(page)
    opened: Counter[str] = Counter()

    def shut_from(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while at < n and (found := scanner.next(at)):
        start, end, close, tag, said = found
        if start > at:
            stack[-1].kids.append(_decoded(page[at:start]))
        at = end
        if not tag:
            continue
        if close:
            if opened[tag]:
                shut_from(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if (ends := ENDS.get(tag)) and any(map(opened.__getitem__, ends)):
            i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends or stack[i].tag in HOLDS)
            if stack[i].tag in ends:
                shut_from(i)
        node = Node(tag, said)
        stack[-1].kids.append(node)
        shut = page[end - 2] == "/"
        if tag in RAW and not shut:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not (shut and tag in ("svg", "path")) and len(stack) < DEPTH:
            stack.append(node)
            opened[tag] += 1
    if at < n:
        stack[-1].kids.append(_decoded(page[at:]))
    return root


def _measure(root: Node) -> list[Node]:
    """Set size, links and hash of every node, children first; returns the nodes in that order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    order.reverse()
    for node in order:
        parts = [node.tag, node.marks]
        for k in node.kids:
            if isinstance(k, Node):
                node.size += k.size
                node.links += k.links
                node.main |= k.main
                parts.append(str(k.hash))
            elif text := " ".join(k.split()):
                node.size += len(text)
                parts.append("=" + text)
        if node.silent:
            node.size = node.links = 0
        if node.tag == "a":
            node.links = node.size
        node.main = (node.main or (node.tag in MAIN and node.size > 0)) and not node.chrome
        node.hash = int.from_bytes(blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return order


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.\-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _salt(url: str | None) -> int:
    return int.from_bytes(blake2b(host(url).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _signed(keys: set[int]) -> np.ndarray:
    return np.array(sorted(keys), np.uint64).view(np.int64)


def subtree_keys(page: str | None, url: str | None) -> np.ndarray:
    """Keys of the subtrees with text that a page has, and of its host."""
    salt = _salt(url)
    return _signed({salt, *(node.hash ^ salt for node in _measure(parse(page)) if node.size)}) if page else np.zeros(0, np.int64)


def main_text(page: str | None, url: str | None, pages: dict[int, int] | None = None, min_pages: int = 5, decided: list[int] | None = None) -> str:
    """The article of a page. pages: on how many pages each recurring key stands. decided: gets the characters that counts, and rules, took."""
    decided = [0, 0] if decided is None else decided
    if not page:
        return ""
    pages, salt = pages or {}, _salt(url)
    root = parse(page)
    _measure(root)
    at = lambda key: pages.get(int(np.uint64(key).view(np.int64)), 1)
    seen = lambda node: at(node.hash ^ salt)
    on_host = at(salt)

    def usual(top: Node) -> tuple[int, int]:
        """On how many pages more than half of the text below stands, links left aside; and the size of all text, that page rules leave."""
        left, found, todo = 0, [], [(top, False)]
        while todo:
            node, linked = todo.pop()
            for k in node.kids:
                if isinstance(k, str):
                    n = len(" ".join(k.split()))
                    left += n
                    if n and not linked:
                        found.append((seen(node), n))
                elif not (k.silent or k.chrome):
                    todo.append((k, linked or k.tag == "a"))
        half = sum(n for _, n in found)
        for many, n in sorted(found, reverse=True):
            half -= 2 * n
            if half < 0:
                return many, left
        return 1, left

    def titles(top: Node) -> int:
        """On how many pages a title (h1) below stands."""
        most, todo = 1, [top]
        while todo:
            node = todo.pop()
            if node.tag == "h1" and node.size:
                most = max(most, seen(node))
            todo += [k for k in node.kids if isinstance(k, Node)]
        return most

    marks = root.main
    copies, left = seen(root), 0
    if not marks:
        many, left = usual(root)
        if 2 * many <= on_host:
            copies = max(copies, many)

    def by_counts(node: Node, marked: bool, base: int, within: bool) -> int:
        """0 if the element goes, else the count that its children are judged against. within: beside text of its parent."""
        many = seen(node) if node.size else 1
        if many < max(min_pages, 2 * base) or node.tag in ("html", "body") or (node.main and not marked):
            return base
        linked = 2 * node.links > node.size
        if within and node.tag in INLINE and (marked or not linked):
            return base
        if marked:
            return 0 if linked or (node.tag not in PARTS and 2 * many > on_host) else base
        return many if 2 * node.size > left and not linked and not marks else 0

    def judge(node: Node, marked: bool, base: int, within: bool) -> int:
        if node.silent:
            return 0
        if node.tag in MAIN and not node.chrome:
            return max(base, seen(node), usual(node)[0], titles(node))
        kept = by_counts(node, marked, base, within)
        if kept and node.chrome and not (node.tag == "header" and marked and not node.marks):
            decided[1] += node.size
            return 0
        decided[0] += 0 if kept else node.size
        return kept

    if marks and on_host < min_pages and (text := _blocks(root, judge, copies, True)):
        return text
    decided[:] = 0, 0
    return _blocks(root, judge, copies, False)


def _blocks(root: Node, judge, base: int, only_main: bool) -> str:
    """Text of the blocks that stay, in page order."""
    blocks, run = [], []

    def end() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    todo: list[tuple[Node | str, bool, int, bool, bool]] = [(root, False, base, False, False)]  # node or text, within the marked article, count to judge by, beside text, at its end
    while todo:
        node, marked, base, within, last = todo.pop()
        if last:
            end()
        elif isinstance(node, str):
            if marked or not only_main:
                run.append(node)
        elif base := judge(node, marked, base, within):
            if node.tag in ("br", "hr"):
                end()
                continue
            marked = marked or node.tag in MAIN
            if node.tag not in INLINE:
                end()
                todo.append((node, marked, base, False, True))
            within = any(isinstance(k, str) and k.strip() for k in node.kids)
            todo += [(k, marked, base, within, False) for k in reversed(node.kids)]
        elif node.tag not in INLINE:
            end()
    end()
    return " ".join(blocks)


def _template_keys(pages: DataFrame, min_pages: int) -> DataFrame:
    """key and n, the pages it stands on, of recurring subtrees. pages: url, html."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [subtree_keys(h, u) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n.astype(np.int64))], names=["key", "n"])

    counts = pages.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_pages)


def extract_main(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", min_pages: int = 5, decided_col: str | None = None) -> DataFrame:
    """Add text_col, the main text of each page, and decided_col if named: characters removed by_counts and by_rules."""
    refuse(pages, text_col, decided_col)
    spark = pages.sparkSession
    recurring = save(_template_keys(pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")), min_pages), "template-keys")
    names = pages.columns
    took = T.StructType([T.StructField("by_counts", T.LongType()), T.StructField("by_rules", T.LongType())])
    schema = T.StructType([*pages.schema.fields, T.StructField(text_col, T.StringType()), *([T.StructField(decided_col, took)] if decided_col else [])])
    u, h = names.index(url_col), names.index(html_col)

    def with_texts(batch: pa.RecordBatch, rows: Iterator[tuple]) -> pa.RecordBatch:
        texts, took = [], []
        for page, url, known in rows:
            took.append([0, 0])
            texts.append(main_text(page, url, known, min_pages, took[-1]))
        more = [pa.array(texts, pa.string())]
        if decided_col:
            more.append(pa.array([{"by_counts": a, "by_rules": b} for a, b in took], pa.struct([("by_counts", pa.int64()), ("by_rules", pa.int64())])))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=schema.names)

    if recurring.limit(SENT_KEYS + 1).count() <= SENT_KEYS:
        got = recurring.orderBy("key").toPandas()  # SENT_KEYS keys of 16 bytes at most
        held = spark.sparkContext.broadcast((got["key"].to_numpy(np.int64), got["n"].to_numpy(np.int64)))

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = dict(zip(*(x.tolist() for x in held.value), strict=True))
            for batch in batches:
                yield with_texts(batch, ((p, url, known) for url, p in zip(batch.column(u).to_pylist(), batch.column(h).to_pylist(), strict=True)))

        return pages.mapInArrow(run, schema)

    # Beyond the bound: keys of each distinct page meet the recurring ones in a join. Its columns get names that the caller's do not have.
    id_, key_, n_ = (free_name(pages, x) for x in ("_page", "_keys", "_n"))
    page = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.coalesce(F.col(html_col).cast("string"), F.lit(""))), 256)

    @tidy
    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [subtree_keys(p, url).tolist() for url, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=[id_, "keys"])

    each = pages.select(page.alias(id_), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).dropDuplicates([id_]).mapInArrow(keys_of, f"{id_} string, keys array<long>")
    has = each.select(id_, F.explode("keys").alias("key")).join(recurring, "key").groupBy(id_).agg(F.collect_list("key").alias(key_), F.collect_list("n").alias(n_))
    joined = pages.withColumn(id_, page).join(has, id_, "left").select(*names, key_, n_)

    @tidy
    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = zip(batch.column(u).to_pylist(), batch.column(h).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)
            yield with_texts(batch, ((p, url, dict(zip(k or [], n or [], strict=True))) for url, p, k, n in cols))

    return joined.mapInArrow(with_keys, schema)
