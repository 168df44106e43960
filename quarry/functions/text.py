"""Word splitting and string helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DESCRIPTION_WORD = r"[A-Za-z][-A-Za-z0-9.@]*[A-Za-z0-9]"
#: Parts of URLs that say nothing; a site adds those of its own hosts.
DULL_URL_PARTS = ("", "http", "www", "de", "html", "htm", "pdf")
#: MIME types that are read as pages, and as documents to be converted.
PAGE_TYPES = ("text/html", "text/xhtml", "application/xhtml+xml")
PDF_TYPES = ("application/pdf",)


def words(text: Column) -> Column:
    """Runs of letters, digits, _ and -."""
    return F.array_remove(F.split(text, r"[^\p{L}\p{Nd}_-]+"), "")


def address_words(text: Column) -> Column:
    """Runs of letters, digits and .-_'@ (the older splitter)."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}.\-_'@]+"), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """All longest matches, left to right."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def whole_match(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def dull(word: Column) -> Column:
    """Too short, or without any letter."""
    return (F.length(word) < 2) | ~word.rlike(r"\p{L}")


def url_words(url: Column) -> Column:
    """Parts between :/#?=. and, for staff pages, ~name."""
    staff = F.regexp_extract(url, "/mitarbeiter/([a-z]{2,3})/", 1)
    return F.concat(F.when(staff != "", F.array(F.concat(F.lit("~"), staff))).otherwise(F.array().cast("array<string>")), matches(url, r"[^:/#?=.]+"))


def spaced_capitals(text: Column) -> Column:
    """A space before each run of capitals, and for each underscore."""
    return F.replace(F.regexp_replace(text, r"(?<![A-Z_])([A-Z])", " $1"), F.lit("_"), F.lit(" "))


def dashed(text: Column) -> Column:
    """The text, then its parts between dashes but the first."""
    parts = F.filter(F.split(text, r"[-\s]"), lambda p: p != "")
    return F.concat(F.array(text), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))))


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def without_umlauts(text: Column) -> Column:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def chunks(items: Column, n: int) -> Column:
    """Slices of n items; the last may be shorter."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, n))


def chunks_by_count(items: Column, n: int) -> Column:
    """n slices of about equal length, longer ones last; fewer items than n stay one slice."""
    edge = lambda k: F.floor(F.size(items) * k / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(items, edge(k) + 1, edge(k + 1) - edge(k)))
    return F.when(F.size(items) >= n, parts).otherwise(F.array(items))


def stripped(text: Column, left: bool = True, right: bool = True, of: str = r"\s") -> Column:
    """Without leading or trailing characters of a class."""
    ends = [p for p, asked in ((f"^{of}+", left), (f"{of}+$", right)) if asked]
    return F.regexp_replace(text, "|".join(ends), "")


def escaped(text: Column) -> Column:
    """Every character but letters, digits and white space as % and its code point in hexadecimal."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"[\p{L}\p{N}\s]"), c).otherwise(F.concat(F.lit("%"), F.lower(F.hex(F.ascii(c)))))), "")


def url_decoded(text: Column) -> Column:
    """Percent escapes as UTF-8; a plus stays a plus."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def last_words(text: Column, n: int) -> Column:
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")


def teaser(text: Column, n: int = 50) -> Column:
    """The first n words, and dots where there are more."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, " ...").otherwise(""))


def owner(url: Column, names: dict[str, str]) -> Column:
    """Whose pages a URL is among, by its part that begins with ~; null where there is none or it isn't known."""
    short = F.regexp_extract(url, r"[:/#?=.]~([^:/#?=.]*)", 1)
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[short] if names else F.lit(None).cast("string")


def class_text(html: Column, tag: str, name: str) -> Column:
    """The text of the first element of a tag and class, for templates that mark authors so; null if there is none."""
    found = F.regexp_extract(html, rf'(?s)<{tag}\s[^>]*?class="{name}"[^>]*>(.*?)</{tag}>', 1)
    return F.nullif(tidy(F.regexp_replace(found, r"<[^>]*>", " ")), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """The content of a meta element, null if there is none."""
    return F.nullif(F.regexp_extract(html, rf'(?i)<meta\s[^>]*?(?:name|http-equiv)="{name}"[^>]*?content="([^"]*)"', 1), F.lit(""))


def title(html: Column) -> Column:
    return tidy(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))


def headline(html: Column) -> Column:
    return tidy(F.regexp_replace(F.regexp_extract(html, r"(?s)<h1>(.*?)</h1>", 1), r"<[^>]*>", " "))


def plain(html: Column) -> Column:
    """All text outside scripts and styles; tags part words."""
    return tidy(F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)>.*?</(script|style)>", " "), r"<[^>]*>", " "))


def references(html: Column) -> Column:
    """What a page loads: images, inputs, linked files, scripts and applets."""
    return F.regexp_extract_all(html, F.lit(r'<(?:img|input|link|script|applet)\s[^>]*?(?:src|href|code)="([^"]*)"'), F.lit(1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<(?:a|frame|iframe)\s[^>]*?(?:href|src)="([^"]*)"'), F.lit(1))
