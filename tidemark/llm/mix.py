"""Mixing sources to target weights by exponential keys.

Every document draws a key -ln(u) / weight; the documents of a source in order of their keys are a weighted sample
without replacement, however long a prefix is taken. A source's token budget is spent on complete epochs first; the
rest goes down the key order until it is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.base import WORD
from tidemark.session import settle

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in order, repeating
MAX_EPOCHS = 3
SEED = "mix-1"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """Share of characters that are no markup or table symbols, 0.05 at least."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.length(F.regexp_replace(t, r"[#*$%&|<>]", "")) / n, F.lit(0.05)))


def exponential_key(doc_id: str, weight: str, seed: str = SEED) -> Column:
    """-ln(u) / weight with u from MD5 of seed and id: the same in every run."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("none"))).cast("binary"))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / F.col(weight)


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` over the earlier rows of the row's group in ``order``.

    Rows are ranged and sorted once; a group spreads over as many ranges as it needs. Each range adds up its own part,
    and the parts before it (one row per range and group) are added as an offset.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = settle(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    parts = ranged.groupBy("__part", group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = settle(parts.select("__part", group, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off")))
    inside = Window.partitionBy("__part", group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return ranged.join(parts, ["__part", group]).withColumn(out, own + F.col("__off")).drop("__part", "__at", "__off")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, sid, target) from one row (source, source_size) per source.

    All words are shared by weight; what a source gets beyond ``most`` times its size is shared again among the others,
    until none is above: every target is min(most * size, level * weight), with one level. Each round is one small
    aggregate over the sources.
    """
    ordered = sources.select("source", "source_size", F.lit(0).alias("all"), F.lit(1).alias("one"), F.col("source").isNull().alias("nul"))
    ordered = running_sum(ordered, "all", ["nul", "source"], "one", "sid").select("source", "source_size", "sid")
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    s = settle(ordered.select("*", cycle.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    total, weight = s.agg(F.sum("source_size"), F.sum("w")).first()
    level, full = (total or 0) / weight if weight else 0.0, -1
    while True:
        capped = F.lit(level) * F.col("w") > F.col("cap")
        n, spent, rest = s.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w")))).first()
        if n == full or not rest:
            break
        full, level = n, ((total or 0) - (spent or 0.0)) / rest
    return s.select("source", "source_size", "sid", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, weight, key, taken, twin): one row per row of ``docs``.

    ``taken`` is the number of words the mix takes from the document, repeats counted. The document in which the budget
    ends gives the words that still fit; with ``whole`` it is taken if at least half of it fits, else left out.
    ``twin`` tells rows of the same doc_id apart (a hash of text and source). NULL texts have size 0 and are taken
    0 words; NULL sources are one source, the last; equal keys go by doc_id and size; repeated rows are taken each;
    an empty table gives an empty mix. Only doc_id, text and source are read.
    """
    base = settle(
        docs.select("doc_id", "source", n_words().alias("size"), quality_weight().alias("weight"), F.xxhash64("text", "source").alias("twin"))
        .withColumn("key", exponential_key("doc_id", "weight", seed))
    )
    t = settle(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    named = base.join(t.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    run = running_sum(named, "sid", ["key", "doc_id", "size", "twin"], "size", "before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long") - F.col("before")
    part = F.greatest(F.lit(0), F.least(left, F.col("size")))
    if whole:
        part = F.when((left > 0) & (2 * left >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    return run.select("doc_id", "source", "size", "source_size", "target", "weight", "key", (epochs * F.col("size") + part).cast("long").alias("taken"), "twin")


def copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole documents only, with all their columns.

    Equal rows (doc_id, text and source) share what is taken of them: each gets as many copies as the others, or one
    more. Texts are moved once, to the rows' copies.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    key = F.xxhash64("__id", "__twin")
    m = mixed(docs, whole=True, **how).select(F.col("doc_id").alias("__id"), F.col("twin").alias("__twin"), times.alias("__times"))
    m = m.groupBy("__id", "__twin").agg(F.sum("__times").alias("__all"), F.count(F.lit(1)).alias("__rows")).where("__all > 0").withColumn("__key", key)
    d = docs.select(docs["*"], F.col("doc_id").alias("__id"), F.xxhash64("text", "source").alias("__twin")).withColumn("__key", key)
    on = (d["__key"] == m["__key"]) & d["__id"].eqNullSafe(m["__id"]) & (d["__twin"] == m["__twin"])
    j = d.join(m, on).select(*(d[c] for c in docs.columns), d["__key"], d["__id"], d["__twin"], m["__all"], m["__rows"])
    n = F.row_number().over(Window.partitionBy("__key", "__id", "__twin").orderBy(F.lit(0)))
    mine = (F.floor(F.col("__all") / F.col("__rows")) + (n <= F.col("__all") % F.col("__rows")).cast("long")).cast("int")
    return j.withColumn("__mine", mine).where("__mine > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__mine")))).select(*docs.columns)


SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN coalesce(text, '') = '' THEN 1.0::DOUBLE
              ELSE greatest(length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))::DOUBLE / length(text), 0.05::DOUBLE) END AS weight,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'none')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM base GROUP BY source),
cap AS (SELECT *, [5.0, 2.0, 1.0][sid % 3 + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM src),
cum AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS before_cap, coalesce(sum(w) OVER o, 0) AS before_w, row_number() OVER (ORDER BY cap / w, sid) AS k,
         (SELECT sum(source_size) FROM src)::DOUBLE AS total, (SELECT sum(w) FROM cap) AS weight
  FROM cap WINDOW o AS (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT arg_min((total - before_cap) / (weight - before_w), k) FILTER (WHERE (total - before_cap) / (weight - before_w) * w <= cap) AS level FROM cum),
tgt AS (SELECT source, source_size, least(cap, level * w) AS target FROM cap, lev),
run AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, -ln(u) / weight AS key,
         coalesce(sum(b.size) OVER (PARTITION BY t.source ORDER BY -ln(u) / weight, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
  FROM base b JOIN tgt t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(floor(target - epochs * source_size)::BIGINT - before, size)))::BIGINT AS taken
FROM run"""
