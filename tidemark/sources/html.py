"""Article text from HTML, as column expressions over the whole page."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.text import let

# Named entities that occur in running text; the ampersand must come last.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&hellip;", "…"), ("&amp;", "&"),
]
DROPPED = ["script", "style", "nav", "noscript", "template"]


def _code_point(hex_digits: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")


def _numeric(text: Column, pattern: str, mark: str, to_hex) -> Column:
    """Replace every distinct reference that matches ``pattern``; ``mark`` is what precedes its digits."""

    def put(acc, n):
        return F.replace(acc, F.concat(F.lit(mark), n, F.lit(";")), _code_point(to_hex(n)))

    def all_of(t):
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))
        return F.when(F.contains(t, F.lit(mark)), F.aggregate(found, t, put)).otherwise(t)

    return let(text, all_of)


def unescape(text: Column) -> Column:
    """Named and numeric character references to characters."""
    out = _numeric(text, r"&#([0-9]{1,8});", "&#", lambda n: F.conv(n, 10, 16))
    for x in "xX":
        out = _numeric(out, rf"&#{x}([0-9A-Fa-f]{{1,7}});", f"&#{x}", lambda n: n)
    for name, ch in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(ch))
    return out


def body_text(html: Column) -> Column:
    """Text of all paragraphs, one per line; '' when the page has none (NULL only for a NULL page)."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        t = F.regexp_replace(t, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    paras = F.regexp_extract_all(t, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), F.lit(1))
    # A line break separates words, other inline tags do not.
    plain = F.transform(paras, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?i)<br\s*/?>", " "), r"<[^>]*>", ""))
    clean = F.transform(plain, lambda p: F.trim(F.regexp_replace(p, r"[ \t\r\n]+", " ")))
    return unescape(F.array_join(F.filter(clean, lambda p: p != ""), "\n"))


def page_title(html: Column) -> Column:
    return unescape(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title>", 1))
