"""Landed web payloads (JSON and XML texts) to news rows.

Fetching is not part of the engine: a payload table has one row per response with its text in
``payload``. Every parser drops entries without a usable url, title or date, since the publication
time orders everything downstream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import settle

# Response size limit, smallest window worth splitting, payload shapes and date formats.
MAX_RECORDS = 250
MIN_WINDOW_US = 3_600_000_000
SEEN_FORMAT = "yyyyMMdd'T'HHmmssX"
ARTICLES = "struct<articles: array<struct<url: string, title: string, seendate: string, domain: string>>>"
POSTS = "array<struct<link: string, date_gmt: string, title: struct<rendered: string>>>"
RSS = (
    "struct<channel: struct<item: array<struct<title: string, link: string, description: string, "
    "pubDate: string, updated: string>>>>"
)
SITEMAP_INDEX = "struct<sitemap: array<struct<loc: string>>>"
URLSET = "struct<url: array<struct<loc: string, lastmod: string>>>"


def utc(ts: Column) -> Column:
    """Instant to a zone-less UTC timestamp (the session zone is UTC)."""
    return ts.cast("timestamp_ntz")


def filled(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def article_list(payloads: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Article-search responses to (url, source, title, summary, published_at)."""
    a = F.from_json("payload", ARTICLES)["articles"]
    d = payloads.select(*keep, F.explode(a).alias("a"))
    published = utc(F.try_to_timestamp("a.seendate", F.lit(SEEN_FORMAT)))
    return d.select(
        *keep, F.col("a.url").alias("url"), F.concat(F.lit("gdelt:"), F.coalesce("a.domain", F.lit(""))).alias("source"),
        F.col("a.title").alias("title"), F.lit("").alias("summary"), published.alias("published_at"),
    ).filter(filled(F.col("url")) & filled(F.col("title")) & F.col("published_at").isNotNull())


def truncated(payload: Column, limit: int = MAX_RECORDS) -> Column:
    """Whether the *raw* article count reached the response limit."""
    return F.coalesce(F.size(F.from_json(payload, ARTICLES)["articles"]) >= limit, F.lit(False))


def windows_to_refetch(payloads: DataFrame, limit: int = MAX_RECORDS, floor_us: int = MIN_WINDOW_US) -> DataFrame:
    """Halves of the windows (start_us, end_us) whose response was cut, down to the smallest width."""
    mid = (F.col("start_us") + F.col("end_us")).cast("long") - F.floor((F.col("start_us") + F.col("end_us")) / 2)
    wide = F.col("end_us") - F.col("start_us") > floor_us
    halves = F.array(
        F.struct(F.col("start_us").alias("start_us"), mid.alias("end_us")),
        F.struct(mid.alias("start_us"), F.col("end_us").alias("end_us")),
    )
    return payloads.filter(truncated(F.col("payload"), limit) & wide).select(F.explode(halves).alias("w")).select("w.*")


def rss_time(text: Column) -> Column:
    """RFC 822 date; the weekday is dropped, it carries nothing."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return utc(
        F.coalesce(
            F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss z")),
            F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")),
            F.try_to_timestamp(F.trim(text)),
        )
    )


def rss_items(payloads: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Feed documents to news rows; ``pubDate``, else ``updated``, else the entry is dropped."""
    d = payloads.select(*keep, "source", F.explode(F.from_xml("payload", RSS)["channel"]["item"]).alias("i"))
    published = F.coalesce(rss_time(F.col("i.pubDate")), rss_time(F.col("i.updated")))
    return d.select(
        *keep, F.coalesce("i.link", F.lit("")).alias("url"), "source", F.coalesce("i.title", F.lit("")).alias("title"),
        F.coalesce("i.description", F.lit("")).alias("summary"), published.alias("published_at"),
    ).filter("published_at is not null")


def child_sitemaps(payloads: DataFrame) -> DataFrame:
    """(parent, loc) of sitemap index documents; other documents give nothing."""
    index = payloads.filter(F.col("payload").rlike(r"^\s*(<\?xml[^>]*>\s*)?<sitemapindex"))
    d = index.select(F.col("url").alias("parent"), F.explode(F.from_xml("payload", SITEMAP_INDEX)["sitemap"]).alias("s"))
    return d.select("parent", F.col("s.loc").alias("loc")).filter(filled(F.col("loc")))


def sitemap_entries(payloads: DataFrame) -> DataFrame:
    """(sitemap, url, lastmod) of leaf documents; a missing or unreadable date stays NULL."""
    leaf = payloads.filter(F.col("payload").rlike(r"^\s*(<\?xml[^>]*>\s*)?<urlset"))
    d = leaf.select(F.col("url").alias("sitemap"), F.explode(F.from_xml("payload", URLSET)["url"]).alias("u"))
    return d.select(
        "sitemap", F.col("u.loc").alias("url"), utc(F.try_to_timestamp(F.trim("u.lastmod"))).alias("lastmod")
    ).filter(filled(F.col("url")))


def walk_sitemaps(payloads: DataFrame, roots: DataFrame, keep_child: Column | None = None) -> DataFrame:
    """Entries of every leaf reachable from ``roots`` (url), however deep.

    One equi-join with the payload table per level, each frontier written before the next step. A document is visited
    once, so loops end; a child that was never fetched just drops out.
    """
    links = child_sitemaps(payloads)
    if keep_child is not None:
        links = links.filter(keep_child)
    level = settle(roots.select("url").distinct())
    seen = level
    while not level.isEmpty():
        found = level.join(links, F.col("url") == F.col("parent")).select(F.col("loc").alias("url")).distinct()
        level = settle(found.join(seen, "url", "left_anti"))
        seen = seen.unionByName(level)
    return sitemap_entries(payloads.join(seen, "url", "left_semi"))


def sitemap_news(entries: DataFrame, source: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dated entries in [start, end) as news rows with a title made from the url."""
    from tidemark.functions.text import title_from_url

    d = entries.filter("lastmod is not null")
    if start is not None:
        d = d.filter(F.col("lastmod") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        d = d.filter(F.col("lastmod") < F.lit(end).cast("timestamp_ntz"))
    return d.select(
        "url", F.lit(source).alias("source"), title_from_url(F.col("url")).alias("title"), F.lit("").alias("summary"),
        F.col("lastmod").alias("published_at"),
    )


def blog_posts(payloads: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Post-list responses to news rows; a response that is no list gives nothing."""
    from tidemark.sources.html import unescape

    d = payloads.filter(F.col("payload").rlike(r"^\s*\[")).select(*keep, "source", F.explode(F.from_json("payload", POSTS)).alias("p"))
    return d.select(
        *keep, F.col("p.link").alias("url"), "source", unescape(F.col("p.title.rendered")).alias("title"),
        F.lit("").alias("summary"), utc(F.try_to_timestamp("p.date_gmt")).alias("published_at"),
    ).filter(filled(F.col("url")) & filled(F.col("title")) & F.col("published_at").isNotNull())
