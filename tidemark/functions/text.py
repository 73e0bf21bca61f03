"""Column expressions over text, tags and labels."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Closed event vocabulary, alias and keyword lists, quote suffixes.
EVENT_TYPES = [
    "hack", "regulation", "partnership", "listing", "product_launch",
    "funding", "macro", "adoption", "market_move", "other",
]
ASSET_ALIASES = {
    "BTC": ["btc", "bitcoin"],
    "ETH": ["eth", "ethereum", "ether"],
    "BNB": ["bnb", "binance coin"],
    "SOL": ["sol", "solana"],
}
EVENT_KEYWORDS = {
    "hack": [
        "hack", "hacked", "hacking", "hacker", "hackers", "exploit", "exploited",
        "breach", "breached", "stolen", "drained",
    ],
    "regulation": [
        "sec", "regulation", "regulations", "regulatory", "lawsuit", "lawsuits",
        "bans", "banned", "banning", "compliance",
    ],
}
QUOTE_SUFFIXES = ["USDT", "USDC", "BUSD", "USD"]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often the expression refers to it."""
    return F.transform(F.array(value), use)[0]


def base_asset(symbol: Column) -> Column:
    """Drop one quote-currency suffix from the end of a symbol."""
    return F.regexp_replace(symbol, f"({'|'.join(QUOTE_SUFFIXES)})$", "")


def word_pattern(phrases: Sequence[str]) -> str:
    """Case-insensitive whole-word pattern of any phrase (taken literally).

    The U flag makes the word boundary know accented letters: no "eth" in "éthé".
    """
    literal = [re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", p) for p in phrases]
    return r"(?iU)\b(" + "|".join(literal) + r")\b"


def tags(text: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Names of the groups with a phrase in the whole text, in the groups' order."""
    hits = [F.when(text.rlike(word_pattern(p)), F.lit(name)) for name, p in groups.items()]
    return F.array_compact(F.array(*hits))


def scoring_text(body: Column, title: Column, asset: Column | None = None, limit: int | None = None) -> Column:
    """Body when it is longer than 20 characters, else the title; optional asset marker in front.

    ``limit`` cuts for a scorer with a bounded input; the default scores the whole text.
    """
    t = F.when(F.length(body) > 20, body).otherwise(title)
    if limit is not None:
        t = F.substring(t, 1, limit)
    return t if asset is None else F.concat(F.lit("["), asset, F.lit("] "), t)


def schema_version(names: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the comma-joined feature list."""
    return F.substring(F.sha2(F.concat_ws(",", names), 256), 1, 12)


def closed_label(answer_json: Column, vocabulary: Sequence[str] = tuple(EVENT_TYPES)) -> Column:
    """``event_type`` of a JSON answer when it is in the vocabulary, else NULL."""
    v = F.get_json_object(answer_json, "$.event_type")
    return F.when(v.isin(*vocabulary), v)


def title_from_url(url: Column) -> Column:
    """Readable title from the last path segment; a bare number gives way to the segment before."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")

    def pick(parts):
        last = F.element_at(parts, -1)
        return F.when(last.rlike("^[0-9]+$") & (F.size(parts) >= 2), F.element_at(parts, -2)).otherwise(last)

    words = F.trim(F.regexp_replace(let(F.split(path, "/"), pick), "[-_]+", " "))
    return let(words, lambda w: F.when(w == "", url).otherwise(title_case(w)))


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the other letters."""

    def cased(chars):
        def one(c, i):
            before = F.coalesce(F.get(chars, i - 1), F.lit(""))
            return F.when((i == 0) | ~before.rlike(r"^\p{L}$"), F.upper(c)).otherwise(F.lower(c))

        return F.array_join(F.transform(chars, one), "")

    return let(F.split(text, ""), cased)
