"""Queries on payload parsing, text tags, de-duplication and table upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import tables as T
from tidemark.functions import text as X
from tidemark.operators import dedup as DD, upserts as U
from tidemark.operators.blocks import from_micros
from tidemark.plans.features import rounded
from tidemark.plans.gates import INPUTS, gate_point
from tidemark.plans.joins import NEWS, news_items
from tidemark.plans.registry import query
from tidemark.plans.sql import with_
from tidemark.session import fresh_dir, settle
from tidemark.sources import files as FI, html as H, news as SN, payloads as P

ENT_SQL = "replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


# --- payloads made from the pages table: 25 pages per response -----------------------------------------
def pages(spark, sf):
    p = T.read(spark, sf, "pages")
    day = F.lit(1_704_067_200_000_000) + F.col("page_id") * F.lit(17 * T.MINUTE)
    return p.select(
        "page_id", "url", (F.floor(F.col("page_id") / 25)).cast("long").alias("grp"), day.alias("t"), from_micros(day).alias("ts"),
        F.concat(F.lit("Story & more "), F.col("page_id").cast("string")).alias("title"),
    )


PG = """
pg AS (SELECT page_id, url, page_id // 25 AS grp, TIMESTAMP '2024-01-01' + INTERVAL 17 MINUTE * page_id AS ts, 'Story & more ' || page_id AS title FROM pages)"""


def article_payloads(spark, sf):
    k = F.col("page_id")
    seen = F.when(k % 17 == 0, "not a date").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    a = F.struct(
        F.when(k % 13 != 0, F.col("url")).alias("url"), "title", seen.alias("seendate"),
        F.concat(F.lit("d"), (k % 5).cast("string")).alias("domain"),
    )
    return pages(spark, sf).groupBy("grp").agg(
        F.to_json(F.struct(F.collect_list(a).alias("articles"))).alias("payload"),
        F.min("t").alias("start_us"), (F.max("t") + F.lit(17 * T.MINUTE)).alias("end_us"),
    )


@query(
    "article_list",
    with_(PG) + "SELECT url, 'gdelt:d' || (page_id % 5) AS source, title, '' AS summary, ts AS published_at FROM pg WHERE page_id % 13 <> 0 AND page_id % 17 <> 0",
)
def article_list(spark, sf):
    return P.article_list(article_payloads(spark, sf))


@query(
    "article_windows",
    with_(PG)
    + """, w AS (SELECT grp, count(*) AS n, epoch_us(min(ts)) AS a, epoch_us(max(ts) + INTERVAL 17 MINUTE) AS b FROM pg GROUP BY 1 HAVING count(*) >= 25 AND epoch_us(max(ts) + INTERVAL 17 MINUTE) - epoch_us(min(ts)) > 3600000000)
    SELECT a AS start_us, (a + b) - CAST(floor((a + b) / 2) AS BIGINT) AS end_us FROM w UNION ALL SELECT (a + b) - CAST(floor((a + b) / 2) AS BIGINT), b FROM w""",
)
def article_windows(spark, sf):
    """Halves of the windows whose response reached the limit."""
    return P.windows_to_refetch(article_payloads(spark, sf), limit=25)


@query(
    "rss_items",
    with_(PG) + "SELECT url, 'feed' || grp % 3 AS source, title, 'about ' || page_id AS summary, ts AS published_at FROM pg WHERE page_id % 11 <> 0 OR page_id % 2 = 0",
)
def rss_items(spark, sf):
    """Some entries carry only ``updated``, some no date at all."""
    k = F.col("page_id")
    rfc = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    esc = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    link = F.replace("url", F.lit("&"), F.lit("&amp;"))
    date = F.when(k % 11 != 0, F.concat(F.lit("<pubDate>"), rfc, F.lit("</pubDate>"))).when(
        k % 2 == 0, F.concat(F.lit("<updated>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated>"))
    ).otherwise("")
    item = F.concat(
        F.lit("<item><title>"), esc, F.lit("</title><link>"), link, F.lit("</link><description>about "), k.cast("string"),
        F.lit("</description>"), date, F.lit("</item>"),
    )
    feeds = pages(spark, sf).groupBy("grp").agg(
        F.concat(F.lit("<rss><channel><title>t</title>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("payload")
    )
    return P.rss_items(feeds.withColumn("source", F.concat(F.lit("feed"), (F.col("grp") % 3).cast("string"))))


def sitemap_payloads(spark, sf):
    """A root index, one index per ten groups, one leaf per group; offsets and missing dates inside."""
    k = F.col("page_id")
    d = pages(spark, sf)
    date = F.when(k % 7 == 0, "").when(
        k % 2 == 0, F.concat(F.lit("<lastmod>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00</lastmod>"))
    ).otherwise(F.concat(F.lit("<lastmod>"), F.date_format(F.expr("ts + interval 3 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00</lastmod>")))
    loc = F.replace("url", F.lit("&"), F.lit("&amp;"))
    leaf = d.groupBy("grp").agg(
        F.concat(
            F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), loc, F.lit("</loc>"), date, F.lit("</url>"))), ""), F.lit("</urlset>"),
        ).alias("payload")
    )
    kind = F.when(F.col("grp") % 4 == 3, "page-sitemap").otherwise("post-sitemap")
    leaf = leaf.withColumn("url", F.concat(F.lit("s/"), kind, F.col("grp").cast("string")))
    entry = F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))
    mid = leaf.groupBy(F.floor(F.col("grp") / 10).alias("m")).agg(F.array_join(F.collect_list(entry), "").alias("x"))
    mid = mid.select(
        F.concat(F.lit("s/index-post-sitemap"), F.col("m").cast("string")).alias("url"),
        F.concat(F.lit("<sitemapindex>"), "x", F.lit("</sitemapindex>")).alias("payload"),
    )
    top = mid.groupBy().agg(F.array_join(F.collect_list(entry), "").alias("x")).select(
        F.lit("s/root").alias("url"), F.concat(F.lit("<sitemapindex>"), "x", F.lit("</sitemapindex>")).alias("payload")
    )
    # Payloads arrive as a landed table; so do these.
    return settle(leaf.select("url", "payload").unionByName(mid).unionByName(top)), top.select("url")


@query(
    "sitemap_walk",
    with_(PG) + "SELECT 's/post-sitemap' || grp AS sitemap, url, CASE WHEN page_id % 7 <> 0 THEN ts END AS lastmod FROM pg WHERE grp % 4 <> 3",
)
def sitemap_walk(spark, sf):
    payloads, roots = sitemap_payloads(spark, sf)
    return P.walk_sitemaps(payloads, roots, F.col("loc").contains("post-sitemap"))


TITLE_SQL = """list_aggregate(list_transform(range(1, CAST(len({s}) AS BIGINT) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr({s}, i - 1, 1), '^\\p{{L}}$') THEN upper(substr({s}, i, 1)) ELSE lower(substr({s}, i, 1)) END), 'string_agg', '')"""
SLUG = """
sl AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS path FROM pages),
sg AS (SELECT *, string_split(path, '/') AS parts FROM sl),
sw AS (SELECT page_id, url, trim(regexp_replace(CASE WHEN regexp_matches(parts[-1], '^[0-9]+$') AND len(parts) >= 2 THEN parts[-2] ELSE parts[-1] END, '[-_]+', ' ', 'g')) AS w FROM sg),
st AS (SELECT page_id, url, CASE WHEN w = '' THEN url ELSE """ + TITLE_SQL.format(s="w") + " END AS title FROM sw)"


@query("slug_titles", with_(SLUG) + "SELECT page_id, title FROM st")
def slug_titles(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", X.title_from_url(F.col("url")).alias("title"))


@query(
    "sitemap_news",
    with_(PG, SLUG) + "SELECT pg.url, 'outlet' AS source, st.title, '' AS summary, ts AS published_at FROM pg JOIN st USING (page_id) WHERE page_id % 7 <> 0 AND grp % 4 <> 3 AND ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts < TIMESTAMP '2024-01-03'",
)
def sitemap_news(spark, sf):
    payloads, roots = sitemap_payloads(spark, sf)
    e = P.walk_sitemaps(payloads, roots, F.col("loc").contains("post-sitemap"))
    return P.sitemap_news(e, "outlet", "2024-01-01 06:00:00", "2024-01-03")


@query(
    "blog_posts",
    with_(PG) + "SELECT url, 'blog' AS source, title || ' – ''q''' AS title, '' AS summary, ts AS published_at FROM pg WHERE page_id % 6 <> 0 AND grp % 5 <> 4",
)
def blog_posts(spark, sf):
    """Escaped titles, posts without a link, and responses that are error objects instead of lists."""
    k = F.col("page_id")
    title = F.concat(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit(" &#8211; &#x27;q&#39;"))
    post = F.struct(
        F.when(k % 6 != 0, F.col("url")).alias("link"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date_gmt"),
        F.struct(title.alias("rendered")).alias("title"),
    )
    d = pages(spark, sf).groupBy("grp").agg(F.to_json(F.collect_list(post)).alias("ok"))
    payload = F.when(F.col("grp") % 5 == 4, '{"code": "rest_invalid"}').otherwise(F.col("ok"))
    return P.blog_posts(d.select(payload.alias("payload"), F.lit("blog").alias("source")))


def _body_sql(col="html"):
    t = f"regexp_replace({col}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in H.DROPPED:
        t = f"regexp_replace({t}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    p = f"regexp_extract_all({t}, '(?is)<p(?:\\s[^>]*)?>(.*?)</p\\s*>', 1)"
    c = f"list_filter(list_transform({p}, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))), lambda x: x <> '')"
    x = f"array_to_string({c}, chr(10))"
    for name, ch in H.ENTITIES:
        x = f"replace({x}, '{name}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return x


@query("body_text", f"SELECT page_id, {_body_sql()} AS body FROM pages")
def body_text(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", H.body_text(F.col("html")).alias("body"))


# --- tags and labels -----------------------------------------------------------------------------------
def tag_sql(groups, col):
    hits = ", ".join(
        f"CASE WHEN regexp_matches({col}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(v)})([^\\p{{L}}\\p{{N}}_]|$)') THEN '{k}' END" for k, v in groups.items()
    )
    return f"array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',')"


@query(
    "text_tags",
    f"SELECT doc_id, {tag_sql(X.ASSET_ALIASES, 'text')} AS assets, {tag_sql(X.EVENT_KEYWORDS, 'text')} AS event_types, {tag_sql({'hack': ['the', 'que', 'der'], 'regulation': ['and', 'les', 'und', 'sur']}, 'text')} AS word_tags FROM documents",
)
def text_tags(spark, sf):
    """Asset and event tags of the whole text by word lists, joined for comparison."""
    from tidemark.plans.joins import WORDS

    t = F.col("text")
    return T.read(spark, sf, "documents").select(
        "doc_id",
        *[F.array_join(X.tags(t, g), ",").alias(n) for n, g in (("assets", X.ASSET_ALIASES), ("event_types", X.EVENT_KEYWORDS), ("word_tags", WORDS))],
    )


@query(
    "asset_tag_spread",
    """WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)the', 'Bitcoin'), '(?i)and', 'ether hack') AS x FROM documents)
    SELECT """ + tag_sql(X.ASSET_ALIASES, "x") + " AS assets, " + tag_sql(X.EVENT_KEYWORDS, "x") + " AS event_types, count(*) AS n FROM t GROUP BY 1, 2",
)
def asset_tag_spread(spark, sf):
    """Tag counts after planting one alias and one keyword in texts that have the words for it."""
    first = F.expr("regexp_replace(text, '^(?is)(.*?)the', '$1Bitcoin')")
    second = F.regexp_replace(first, r"(?is)^(.*?)and", "$1ether hack")
    d = T.read(spark, sf, "documents").select(second.alias("x"))
    return d.groupBy(
        F.array_join(X.tags(F.col("x"), X.ASSET_ALIASES), ",").alias("assets"), F.array_join(X.tags(F.col("x"), X.EVENT_KEYWORDS), ",").alias("event_types")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "base_assets",
    "SELECT DISTINCT event_type || s.x AS symbol, CASE WHEN s.x = 'EUR' THEN event_type || 'EUR' ELSE event_type END AS base FROM events, (VALUES ('USDT'), ('USDC'), ('BUSD'), ('USD'), ('EUR')) s(x)",
)
def base_assets(spark, sf):
    d = T.read(spark, sf, "events").select("event_type").distinct()
    d = d.withColumn("quote", F.explode(F.array(*[F.lit(x) for x in [*X.QUOTE_SUFFIXES, "EUR"]])))
    return d.withColumn("symbol", F.concat("event_type", "quote")).select("symbol", X.base_asset(F.col("symbol")).alias("base"))


@query(
    "scoring_text",
    "SELECT doc_id, md5('[' || lang || '] ' || CASE WHEN length(text) > 20 THEN text ELSE source END) AS text_md5, length('[' || lang || '] ' || CASE WHEN length(text) > 20 THEN text ELSE source END) AS n FROM documents",
)
def scoring_text(spark, sf):
    d = T.read(spark, sf, "documents").withColumn("x", X.scoring_text(F.col("text"), F.col("source"), F.col("lang")))
    return d.select("doc_id", F.md5("x").alias("text_md5"), F.length("x").cast("long").alias("n"))


@query(
    "closed_labels",
    with_(NEWS) + "SELECT url, CASE WHEN doc_id % 10 <> 3 THEN llm_event_type END AS event_type FROM news",
)
def closed_labels(spark, sf):
    """Classifier answers as JSON; broken or unknown answers stay NULL and so stay pending."""
    d = T.news(spark, sf)
    v = F.when(F.col("doc_id") % 10 == 3, F.lit("weather")).otherwise(F.col("llm_event_type"))
    js = F.when(F.col("llm_event_type").isNull(), F.lit("{broken")).otherwise(F.to_json(F.struct(v.alias("event_type"))))
    return d.select("url", X.closed_label(js).alias("event_type"))


# --- table scans and upserts ------------------------------------------------------------------------------
def news_table(spark, sf):
    d = news_items(spark, sf)
    k = F.col("doc_id")
    return d.select(
        "url", "doc_id", "source", "title", F.lit("").alias("summary"), "published_at", F.array("symbol").alias("assets"),
        F.when(k % 3 != 0, F.col("sentiment_pos")).alias("sentiment_pos"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "").otherwise(F.col("title")).alias("body"), "llm_event_type",
    )


@query(
    "news_scan",
    with_(NEWS) + "SELECT url, source, md5(title) AS title_md5, published_at, llm_event_type FROM news WHERE symbol = 'view' AND published_at >= TIMESTAMP '2024-01-05' AND published_at <= TIMESTAMP '2024-01-20'",
)
def news_scan(spark, sf):
    d = SN.load_news(news_table(spark, sf), "view", "2024-01-05", "2024-01-20", ["llm_event_type"])
    return d.select("url", "source", F.md5("title").alias("title_md5"), "published_at", "llm_event_type")


@query("recent_texts", with_(NEWS) + "SELECT url, md5(trim(title || ' ')) AS text_md5 FROM news WHERE published_at >= TIMESTAMP '2024-01-20'")
def recent_texts(spark, sf):
    return SN.recent_texts(news_table(spark, sf), "2024-01-20").select("url", F.md5("text").alias("text_md5"))


@query(
    "pending_scan",
    with_(NEWS) + "SELECT 'sentiment' AS work, url FROM news WHERE doc_id % 3 = 0 UNION ALL SELECT 'body', url FROM news WHERE doc_id % 4 = 0 AND symbol = 'click' UNION ALL SELECT 'event_type', url FROM news WHERE llm_event_type IS NULL AND symbol = 'view'",
)
def pending_scan(spark, sf):
    """Work lists: only NULL is pending, an empty body was tried."""
    n = news_table(spark, sf)
    parts = [("sentiment", "sentiment_pos", None), ("body", "body", "click"), ("event_type", "llm_event_type", "view")]
    out = None
    for name, col, asset in parts:
        d = U.pending(n, col, "doc_id", asset).select(F.lit(name).alias("work"), "url")
        out = d if out is None else out.unionByName(d)
    return out


BATCH = """
bt AS (SELECT doc_id, source || '/' || (doc_id % 97) AS url, n_chars FROM documents),
kn AS (SELECT DISTINCT source || '/' || (doc_id % 97) AS url FROM documents WHERE n_chars > 4000)"""


def batch(spark, sf):
    d = T.read(spark, sf, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), (F.col("doc_id") % 97).cast("string")).alias("url"), "n_chars")


@query(
    "url_dedup",
    f"WITH {BATCH} SELECT min(doc_id) AS doc_id, url, arg_min(n_chars, doc_id) AS n_chars FROM bt WHERE url NOT IN (SELECT url FROM kn) GROUP BY url",
)
def url_dedup(spark, sf):
    """First of each url in arrival order that the table does not know yet."""
    b = batch(spark, sf)
    return U.dedup_by_url(b, b.filter("n_chars > 4000"), ["doc_id"])


@query(
    "upsert_ignore",
    f"WITH {BATCH}, ol AS (SELECT url, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM bt WHERE doc_id % 2 = 0 GROUP BY 1) SELECT url, doc_id, n_chars, 'old' AS origin FROM ol UNION ALL SELECT url, min(doc_id), arg_min(n_chars, doc_id), 'new' FROM bt WHERE doc_id % 2 = 1 AND url NOT IN (SELECT url FROM ol) GROUP BY url",
)
def upsert_ignore(spark, sf):
    """Table after insert-ignore: existing keys keep their row, new keys get their first row."""
    b = batch(spark, sf)
    old = U.first_per_key(b.filter("doc_id % 2 = 0"), ["url"], ["doc_id"])
    new = U.insert_ignore(old, b.filter("doc_id % 2 = 1"), ["url"], ["doc_id"])
    return old.withColumn("origin", F.lit("old")).unionByName(new.withColumn("origin", F.lit("new")))


@query(
    "keyed_update",
    with_(NEWS) + "SELECT url, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN '' END WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE md5(title) END AS body FROM news",
)
def keyed_update(spark, sf):
    """Update every fifth body: half to '' (tried, nothing found), half back to NULL (not tried)."""
    n = news_table(spark, sf).withColumn("body", F.when(F.length("body") > 0, F.md5("body")).otherwise(F.col("body")))
    up = n.filter("doc_id % 5 = 0").select("url", F.when(F.col("doc_id") % 10 == 0, "").alias("body"))
    return U.keyed_update(n, up, "url", ["body"]).select("url", "body")


FUND = "fu AS (SELECT event_type AS symbol, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2000-01-01') AS ts, round(avg(value), 6) AS rate FROM events GROUP BY 1, 2)"


@query(
    "cache_extend",
    f"WITH {FUND} SELECT symbol, ts, rate + CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 1 ELSE 0 END AS rate FROM fu",
)
def cache_extend(spark, sf):
    """A cached series to January 20 and overlapping fresh rows: the cached value wins where both exist."""
    f = rounded(T.funding(spark, sf).select("symbol", "ts", "rate"))
    cache = f.filter("ts < timestamp_ntz'2024-01-20'")
    fresh = f.filter("ts >= timestamp_ntz'2024-01-18'").withColumn("rate", F.col("rate") + 1)
    return rounded(U.extend_cache(cache, fresh, ["symbol", "ts"], "ts").select("symbol", "ts", "rate"))


@query(
    "cache_newer",
    f"WITH {FUND}, c AS (SELECT symbol, max(ts) AS top FROM fu WHERE ts < TIMESTAMP '2024-01-20' AND symbol <> 'view' GROUP BY 1) SELECT fu.symbol, fu.ts, rate FROM fu LEFT JOIN c USING (symbol) WHERE top IS NULL OR ts > top",
)
def cache_newer(spark, sf):
    f = rounded(T.funding(spark, sf).select("symbol", "ts", "rate"))
    return U.newer_than_cache(f.filter("ts < timestamp_ntz'2024-01-20' and symbol <> 'view'"), f, "symbol", "ts")


@query(
    "gaps_to_fetch",
    """WITH h AS (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS day FROM events WHERE NOT (event_type = 'click' AND day(ts) % 4 = 0)), s AS (SELECT DISTINCT symbol FROM h)
    SELECT symbol, CAST(d AS TIMESTAMP) AS day FROM s, range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-04', INTERVAL 1 DAY) r(d) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.symbol = s.symbol AND h.day = CAST(d AS DATE))""",
)
def gaps_to_fetch(spark, sf):
    """Days of each symbol without data, from January 1 to February 3."""
    have = T.trades(spark, sf).filter(~((F.col("symbol") == "click") & (F.dayofmonth("ts") % 4 == 0)))
    d = U.missing_days(have, "symbol", F.col("ts"), "2024-01-01", "2024-02-03")
    return d.select("symbol", F.col("day").cast("timestamp_ntz").alias("day"))


# --- files ---------------------------------------------------------------------------------------------------
@query(
    "trade_dump",
    "SELECT event_type AS symbol, CASE WHEN day(ts) % 2 = 0 THEN date_trunc('millisecond', ts) ELSE ts END AS ts, round(value, 6) AS qty, user_id % 2 = 0 AS is_buyer_maker FROM events",
)
def trade_dump(spark, sf):
    """Write the trades as headerless dumps, milliseconds on even days and microseconds on odd ones, and read them."""
    path = fresh_dir(spark, "trade-dump")
    t = T.trades(spark, sf)
    stamp = F.when(F.dayofmonth("ts") % 2 == 0, F.floor(F.col("t") / 1000)).otherwise(F.col("t")).cast("long")
    one = F.lit(0).cast("long")
    t.select(
        "seq", "price", "qty", one.alias("f"), one.alias("l"), stamp.alias("x"), "is_buyer_maker", F.lit(True).alias("b"), "symbol"
    ).write.partitionBy("symbol").csv(path)
    d = FI.read_trade_dump(spark, path)
    return d.select("symbol", from_micros("t").alias("ts"), F.round("qty", 6).alias("qty"), "is_buyer_maker")


@query(
    "audit_log",
    f"""WITH {INPUTS}, d AS (SELECT k, CASE WHEN NOT has_production THEN 'bootstrap' WHEN NOT schema_matches AND sanity = false THEN 'schema_drift_rejected_sanity' WHEN NOT schema_matches THEN 'schema_drift_push_as_candidate'
    WHEN (production - candidate) / production >= 0.005 THEN 'pushed_to_candidate' ELSE 'rejected' END AS decision FROM g)
    SELECT decision, count(*) AS n, min(k) AS first_k FROM d GROUP BY 1""",
)
def audit_log(spark, sf):
    """Decisions appended in two runs as JSON lines, read back with a schema and counted."""
    path = fresh_dir(spark, "audit")
    d = gate_point(spark, sf)
    FI.append_audit(d.filter("k % 2 = 0"), path)
    FI.append_audit(d.filter("k % 2 = 1"), path)
    log = FI.read_table(spark, path, "k long, decision string, slot string", "json")
    return log.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_k"))


@query(
    "fold_csv",
    "SELECT o_orderstatus AS symbol, count(*) AS n, round(sum(o_totalprice), 2) AS total, 0 AS missing_rows FROM orders GROUP BY 1",
)
def fold_csv(spark, sf):
    """A report table through CSV; a report that was never written reads as an empty table."""
    path = fresh_dir(spark, "folds")
    schema = "symbol string, total double, ts timestamp_ntz"
    o = T.read(spark, sf, "orders")
    FI.append_csv(o.select(F.col("o_orderstatus").alias("symbol"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("ts")), path)
    none = FI.read_table(spark, path + "-none", schema)
    d = FI.read_table(spark, path, schema).withColumn("m", F.lit(0)).unionByName(none.withColumn("m", F.lit(1)))
    return d.groupBy("symbol").agg(
        F.sum(1 - F.col("m")).alias("n"), F.round(F.sum("total"), 2).alias("total"), F.sum("m").cast("int").alias("missing_rows")
    )


@query(
    "slot_metadata_json",
    "SELECT 's' || c_custkey AS symbol, 'v' || (c_custkey % 4) AS model_version, 1 + c_custkey % 3 AS n_horizons, round(c_acctbal, 2) AS mae, CASE WHEN c_custkey % 2 = 0 THEN 'rejected' END AS decision FROM customer",
)
def slot_metadata_json(spark, sf):
    """Nested slot metadata texts parsed with a schema; absent parts are NULL."""
    k = F.col("c_custkey")
    em = F.struct(F.col("c_acctbal").alias("mae"), F.when(k % 2 == 0, "rejected").alias("decision"))
    meta = F.to_json(
        F.struct(
            F.concat(F.lit("v"), (k % 4).cast("string")).alias("model_version"),
            F.sequence(F.lit(1).cast("long"), 1 + k % 3).alias("horizons"), em.alias("eval_metrics"),
        )
    )
    schema = "model_version string, horizons array<long>, eval_metrics struct<mae: double, decision: string>, feature_columns array<string>"
    d = T.read(spark, sf, "customer").select(F.concat(F.lit("s"), k.cast("string")).alias("symbol"), F.from_json(meta, schema).alias("m"))
    return d.select(
        "symbol", "m.model_version", F.size("m.horizons").cast("long").alias("n_horizons"), F.round("m.eval_metrics.mae", 2).alias("mae"),
        F.col("m.eval_metrics.decision").alias("decision"),
    )


# --- near duplicates ----------------------------------------------------------------------------------------
# A parameter of the operator: the function words the query leaves out.
STOP = "the a an and or of to in is it on for with as by at from that this was are be not but".split()


def _near_sql():
    stop = ", ".join(f"'{s}'" for s in STOP)
    return f"""WITH RECURSIVE
tk AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM documents) WHERE t NOT IN ({stop}) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents), df AS (SELECT t, count(*) AS df FROM tk GROUP BY 1),
w AS (SELECT doc_id, t, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tk JOIN df USING (t), n), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS nm FROM w GROUP BY 1),
v AS (SELECT doc_id, t, w / nm AS w FROM w JOIN nm USING (doc_id)),
p AS (SELECT doc_id, t FROM (SELECT v.doc_id, t, sum(v.w * v.w) OVER (PARTITION BY v.doc_id ORDER BY df DESC, t DESC ROWS UNBOUNDED PRECEDING) AS rest FROM v JOIN df USING (t)) WHERE rest >= 0.85 * 0.85 - 1e-9),
c AS (SELECT DISTINCT a.doc_id AS lo, b.doc_id AS hi FROM p a JOIN p b ON a.t = b.t AND a.doc_id < b.doc_id),
e AS (SELECT lo, hi FROM c JOIN v a ON a.doc_id = lo JOIN v b ON b.doc_id = hi AND b.t = a.t GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.85 - 1e-12),
nb AS (SELECT hi, list(lo) AS los, row_number() OVER (ORDER BY hi) AS i FROM e GROUP BY 1),
g AS (SELECT CAST(0 AS BIGINT) AS i, []::BIGINT[] AS gone UNION ALL SELECT nb.i, CASE WHEN len(list_filter(nb.los, lambda x: NOT list_contains(g.gone, x))) > 0 THEN list_append(g.gone, nb.hi) ELSE g.gone END FROM g JOIN nb ON nb.i = g.i + 1),
f AS (SELECT gone FROM g ORDER BY i DESC LIMIT 1)
SELECT doc_id, n_chars FROM documents WHERE NOT list_contains((SELECT gone FROM f), doc_id)"""


@query("near_dup", _near_sql())
def near_dup(spark, sf):
    """Documents that stay when later near copies of kept documents are dropped."""
    return DD.drop_near_duplicates(T.read(spark, sf, "documents"), "doc_id", "text", stop_words=STOP).select("doc_id", "n_chars")
