"""News table scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

BASE = ["url", "source", "title", "published_at", "assets"]


def load_news(
    news: DataFrame, asset: str | None = None, start: str | None = None, end: str | None = None,
    include: Sequence[str] = (),
) -> DataFrame:
    """Items by asset tag and publication time (both ends included), oldest first.

    ``include`` names optional wide columns; anything not named is pruned from the scan.
    """
    d = news
    if asset is not None:
        d = d.filter(F.array_contains("assets", asset))
    if start is not None:
        d = d.filter(F.col("published_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        d = d.filter(F.col("published_at") <= F.lit(end).cast("timestamp_ntz"))
    return d.select(*[c for c in BASE if c in news.columns], *include).orderBy("published_at", "url")


def known_urls(news: DataFrame, since: str) -> DataFrame:
    return news.filter(F.col("published_at") >= F.lit(since).cast("timestamp_ntz")).select("url")


def recent_texts(news: DataFrame, since: str) -> DataFrame:
    """Title and summary of recent items as one text."""
    d = news.filter(F.col("published_at") >= F.lit(since).cast("timestamp_ntz"))
    return d.select("url", F.trim(F.concat_ws(" ", "title", "summary")).alias("text"))
