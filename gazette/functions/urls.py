"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import col, once

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def part(c: Column | str, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its question mark; empty where absent."""
    return F.regexp_extract(col(c), _PARTS, k)


def canonical(c: Column | str) -> Column:
    """Scheme and authority in lower case, fragment dropped, closing slashes and stops trimmed."""
    return F.regexp_replace(F.concat(F.lower(part(c, 1)), F.lit("://"), F.lower(part(c, 2)), part(c, 3), part(c, 4)), r"[/.,;]+$", "")


def post_id(c: Column | str, keys: tuple[str, ...] = ("post", "id", "page")) -> Column:
    """From query keys in order, else from /view/<digits>, else the last numeric path segment."""
    named = [F.nullif(F.regexp_extract(col(c), rf"[?&]{k}=([0-9]+)", 1), F.lit("")) for k in keys]
    viewed = F.nullif(F.regexp_extract(part(c, 3), r"/view/([0-9]+)", 1), F.lit(""))
    return F.coalesce(*named, viewed, F.nullif(F.regexp_extract(part(c, 3), r"([0-9]+)/?$", 1), F.lit("")))


def variants(c: Column | str) -> Column:
    """The URL with its own scheme, then the other of http and https; each with its own authority, then with www. added or taken off; each followed by its root if the path is not empty. Each once; what is no URL stays."""
    u = col(c)
    scheme, host = F.lower(part(u, 1)), part(u, 2)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1), "#$", ""), r"\?(?=#|$)", "")
    other = F.when(scheme == "https", "http").when(scheme == "http", "https")
    turned = F.when(host.startswith("www."), F.regexp_replace(host, r"^www\.", "")).otherwise(F.concat(F.lit("www."), host))
    deep = ~part(u, 3).isin("", "/")
    made = [F.when(ok, F.concat(s, F.lit("://"), h, end)) for s in (scheme, other) for h in (host, turned) for end, ok in ((rest, F.lit(True)), (F.lit("/"), deep))]
    return F.when((scheme == "") | (host == ""), F.array(u)).otherwise(F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull())))


# Addresses that are private, of the machine or the link, shared, for documentation, for many, or reserved.
_PRIVATE4 = (
    r"(?:0|10|127)\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|(?:22[4-9]|2[3-5][0-9])\."
)
_PRIVATE6 = r"::1?$|f[cdf][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:0?db8:|64:ff9b:1:"


def public_host(c: Column | str) -> Column:
    """http or https to a host that may be public by its name alone: no address of the kinds above, in IPv6 brackets or not, and no bare number, which resolvers read as an address."""
    host = F.regexp_replace(F.regexp_replace(F.lower(part(c, 2)), "^[^@]*@", ""), r":[0-9]*$", "")
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    mapped = F.regexp_extract(bare, r"^::(?:ffff:)?([0-9]+\.[0-9.]+)$", 1)
    four = F.when(mapped != "", mapped).otherwise(bare)
    numeric = four.rlike(r"^(?:0x[0-9a-f]+|[0-9]+)(?:\.(?:0x[0-9a-f]+|[0-9]+)){0,2}$|^[0-9.]*\b0[0-9]+[0-9.]*$|0x")
    dotted = four.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    barred = bare.isin("localhost", "metadata.google.internal") | numeric | (dotted & four.rlike(f"^(?:{_PRIVATE4})")) | (host.startswith("[") & (mapped == "") & bare.rlike(f"^(?:{_PRIVATE6})"))
    return F.lower(part(c, 1)).isin("http", "https") & (host != "") & ~barred


def file_kind(content: Column | str, name: Column | str, mime: Column | str) -> Column:
    """Kind of a file by its first bytes, suffix and declared type; what a zip archive is, by names and types within it. content: binary."""
    raw, suffix, said = F.hex(col(content)), F.lower(F.regexp_extract(col(name), r"\.([A-Za-z0-9]{1,5})$", 1)), F.lower(F.coalesce(col(mime), F.lit("")))
    zipped, holds = raw.startswith("504B0304"), lambda text: raw.contains(text.encode().hex().upper())
    hwpx = zipped & (holds("Contents/section") | holds("hwp+zip") | holds("owpml"))
    return (
        F.when(raw.startswith(b"%PDF".hex().upper()) | (suffix == "pdf") | said.contains("pdf"), "pdf").when(suffix.isin("png", "jpg", "jpeg", "webp", "bmp", "gif") | said.startswith("image/"), "image")
        .when((suffix == "hwpx") | hwpx, "hwpx").when((suffix == "hwp") | raw.startswith("D0CF11E0"), "hwp").when(suffix.isin("xlsx", "xlsm") | (zipped & holds("xl/workbook.xml")), "xlsx")
        .when(said.contains("html") | suffix.isin("html", "htm"), "html").otherwise("unknown")
    )


def resolve(base: Column | str, ref: Column | str) -> Column:
    """A link as a whole URL, read from the page at base; without its fragment."""
    return once(F.regexp_replace(F.trim(col(ref)), "#.*$", ""), lambda r: _resolved(base, r))


def _resolved(base: Column | str, r: Column) -> Column:
    path = F.regexp_replace(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "[^/]*$", "")
    head = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    query = F.regexp_extract(r, r"\?.*$", 0)
    steps = F.split(F.concat(F.when(r.startswith("/"), "").otherwise(path), F.regexp_replace(r, r"\?.*$", "")), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    ends = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    return (
        F.when(r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), r).when(r.startswith("//"), F.concat(part(base, 1), F.lit(":"), r)).when(r == "", F.concat(head, part(base, 3), part(base, 4)))
        .when(r.startswith("?"), F.concat(head, part(base, 3), r)).otherwise(F.concat(head, F.array_join(kept, "/"), ends, query))
    )


def page_links(html: Column | str, url: Column | str) -> Column:
    """Distinct links of a page to its own host, whole and without fragments; none by script, mail or phone."""
    refs = F.regexp_extract_all(col(html), F.lit(r"(?i)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    named = F.filter(F.transform(refs, lambda r: F.trim(r)), lambda r: ~r.rlike("(?i)^(?:#|javascript:|mailto:|tel:|$)"))
    whole = F.transform(named, lambda r: resolve(url, r))
    return F.array_distinct(F.filter(whole, lambda u: F.lower(part(u, 2)) == F.lower(part(url, 2))))
