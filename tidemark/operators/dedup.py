"""Near-duplicate removal: an item is dropped when it is too similar to an earlier *kept* item.

Similarity is TF-IDF cosine. The answer is that of walking the items in order, found without a walk:

1. Items with the same token multiset collapse to the first; the copies only count in the IDF.
2. Prefix filter: with terms in one global order (rare first), two vectors of cosine >= threshold share a term before
   the point where the rest of either vector is shorter than the threshold. Only those head terms make pairs, and only
   where the rests of both, multiplied, can still matter; a bound on what is left discards most pairs before the full
   cosine is taken, so no pair is lost and few are computed.
3. Items are dealt to blocks of bounded size, and every pair of blocks is a cell of its own: what its items share is added
   up inside the task, so disk holds heads and candidates, never the meetings on single terms. A vector is one row of
   arrays wherever it is moved, cells are worked off block by block, and tables and shuffle files go when they are read.
4. Items are decided in order, in batches as long as their own term lists make a number of pairs in proportion to the
   entries of all lists. The first-come rule is resolved inside the batch; what it keeps is kept for good and drops the
   later items it is similar to. A group of near copies is met by its first member only, so it never makes all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.session import discard, mark, settle, tidy, written_since

# Similarity bar and token shape (runs of two or more word characters).
THRESHOLD = 0.85
TOKEN = r"[\p{L}\p{N}_]{2,}"
REST = 0.96  # what terms that are left out, from lists or from meetings, can add to a cosine, as a share of the threshold
ROWS = 2048  # documents whose terms are looked up together
DICTIONARY = {"parquet.dictionary.page.size": 8 << 20}  # so that Parquet writes the terms of many documents once
BLOCK = 8192  # items that one cell holds from either side, ...
ENTRIES = 96  # ... at so many head terms each; longer heads make more blocks
MEETINGS = 1 << 18  # of items on single terms that a cell adds up at a time, and pairs of items it adds up for
SLACK = 1e-6  # more than the rounding of weights to floats; candidates are checked in double precision
PAIRS = 65536  # that one task compares in full
BATCH_LOAD = 64  # pairs per list entry that a batch may make
FIRST = 256  # items of the smallest batch


def default_stop_words(spark: SparkSession) -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text, stop_words: Sequence[str]):
    t = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(t, lambda x: ~x.isin(*stop_words)) if stop_words else t


def coded(items: DataFrame, order: str, text: str, stop_words: Sequence[str]) -> DataFrame:
    """(ord, terms, block): 64-bit hashes of all tokens in ascending order (two of them meet in a table of 10^8 terms with
    a chance of 3e-4); a block is a run of rows of one task. A NULL text has no tokens."""
    toks = F.coalesce(tokens(F.col(text), stop_words), F.array().cast("array<string>"))
    block = F.floor(F.monotonically_increasing_id() / ROWS)
    return items.select(F.col(order).alias("ord"), F.sort_array(F.transform(toks, lambda x: F.xxhash64(x))).alias("terms"), block.alias("block"))


def counted(rows: DataFrame) -> DataFrame:
    """(part, term, n) of rows (part, terms): counts inside an Arrow batch, to be summed afterwards. Exploding the terms for
    a groupBy took 37 s of tasks on 0.51 GB and one more shuffle, this 21 s."""

    def count(batches):
        for b in batches:
            for part, terms in b.groupby("part")["terms"]:
                term, n = np.unique(np.concatenate(terms.to_numpy()), return_counts=True)
                yield pd.DataFrame({"part": part, "term": term, "n": n})

    return rows.mapInPandas(count, "part long, term long, n long")


def seen(docs: DataFrame) -> DataFrame:
    """(block, term, df): the document frequency of every term, once or twice for each block that has the term."""
    per = counted(docs.select(F.col("block").alias("part"), F.array_distinct("terms").alias("terms")))
    return per.select(F.col("part").alias("block"), "term", F.sum("n").over(W.partitionBy("term")).alias("df"))


def weights(tf: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    return tf * (np.log((1 + n_docs) / (1 + df)) + 1)


def vectors(docs: DataFrame, n_docs: int, bound: float) -> DataFrame:
    """(ord, terms, tf, df, ws, s): a row per document, its terms rare first.

    ``ws`` are the weights of the head, the first terms of the unit-length tf * (ln((1+n)/(1+df)) + 1) vector. It ends
    where the rest of the vector, of length ``s``, is shorter than ``bound``. Any bound below the threshold loses no
    pair; a smaller one gives longer lists and a sharper test in ``candidates``. Frequencies are looked up once per
    block of documents, so entries are moved as one array per document and only distinct terms of a block as rows.
    """

    def block(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.drop_duplicates("term").sort_values(["df", "term"], ignore_index=True)
        found, term = pd.factorize(np.concatenate(x["terms"].to_numpy()))
        place = pd.Index(y["term"]).get_indexer(term)[found]
        key, tf = np.unique(np.repeat(np.arange(len(x)), x["terms"].str.len()) * len(y) + place, return_counts=True)
        doc, place = key // len(y), key % len(y)
        df = y["df"].to_numpy()[place]
        w = weights(tf, df, n_docs)
        w = w / np.sqrt(np.bincount(doc, w * w))[doc]
        left = 1 - before(w, np.bincount(doc))
        head = left >= bound * bound - 1e-9
        ends = np.cumsum(np.bincount(doc))[:-1]
        heads = np.bincount(doc, head).astype(int)
        s = np.sqrt(np.maximum(1 - np.bincount(doc, np.where(head, w * w, 0)), 0))
        out = {"ord": x["ord"], "terms": np.split(y["term"].to_numpy()[place], ends), "tf": np.split(tf.astype(np.int32), ends), "df": np.split(df.astype(np.int32), ends)}
        return pd.DataFrame({**out, "ws": [v[:h] for v, h in zip(np.split(w.astype(np.float32), ends), heads)], "s": s})

    full = docs.filter(F.size("terms") > 0)
    terms = settle(seen(full))
    return full.groupBy("block").cogroup(terms.groupBy("block")).applyInPandas(
        block, "ord long, terms array<long>, tf array<int>, df array<int>, ws array<float>, s double"
    )


def before(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The squares of an item's weights before each of them, summed; ``n`` are the items' numbers of weights."""
    total = np.concatenate([[0.0], np.cumsum(w * w)])
    return total[:-1] - np.repeat(total[np.cumsum(n) - n], n)


def packed(lists: DataFrame) -> DataFrame:
    """(ord, s, terms, ws): a row per item of lists that have a row (ord, term, w, s) per entry."""
    # Terms go as 64-bit hashes, weights as floats.
    return lists.groupBy("ord").agg(F.first("s").alias("s"), F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list(F.col("w").cast("float")).alias("ws"))


def dealt(c: str, blocks: int):
    """The block that an item belongs to."""
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def in_cells(lists: DataFrame, blocks: int, left: bool, same: bool) -> DataFrame:
    """(i, j, ord, s, terms, ws): a row per item and cell it takes part in.

    Items are dealt to ``blocks`` blocks, and every pair of blocks is a cell; of a table against itself only i <= j.
    """
    rows = lists if "terms" in lists.columns else packed(lists)
    mine = dealt("ord", blocks)
    none, last = F.lit(0), F.lit(blocks - 1)
    there = F.sequence(mine, last) if same and left else F.sequence(none, mine) if same else F.sequence(none, last)
    ij = (mine.alias("i"), F.explode(there).alias("j")) if left else (F.explode(there).alias("i"), mine.alias("j"))
    return rows.select(*ij, "ord", "s", "terms", "ws")


def entries(d: pd.DataFrame, ordered: bool) -> tuple[np.ndarray, ...]:
    """(item, term, weight, r) of lists: r is what the vector has left from a term on, 1 if the order is not known."""
    n = d["terms"].str.len().to_numpy(np.int64)
    w = np.concatenate(d["ws"].to_numpy())
    r = np.sqrt(np.clip(1 - before(w.astype(float), n), 1e-9, 1)) if ordered else np.ones(len(w))
    return np.repeat(np.arange(len(d)), n), np.concatenate(d["terms"].to_numpy()), w, r


def met(x: pd.DataFrame, y: pd.DataFrame, threshold: float, same: bool, ordered: bool) -> pd.DataFrame:
    """Pairs (lo, hi) of a cell that can reach the threshold: head products are added up for a run of items at a time.

    Along the terms that two items share, rare first, the r of both fall, so terms whose r multiply to less than ``cut``
    come last and add less than ``cut`` in all: they need not be met.
    """
    cut = max(REST * threshold if ordered else 0.0, x["s"].max(), y["s"].max())
    (xi, xt, xw, xr), (yi, yt, yw, yr) = (entries(d, ordered) for d in (x, y))
    term, known = pd.factorize(np.concatenate([yt, xt]))
    yt, xt = term[: len(yt)], term[len(yt) :]
    both = (np.bincount(yt, minlength=len(known)) > 0) & (np.bincount(xt, minlength=len(known)) > 0)
    (xi, xt, xw, xr), (yi, yt, yw, yr) = ([v[both[t]] for v in (i, t, w, r)] for i, t, w, r in ((xi, xt, xw, xr), (yi, yt, yw, yr)))
    # Lengths are 1 at most: 2 * term - r puts terms in order, and inside a term the longest first.
    key = 2.0 * yt - yr
    order = np.argsort(key)
    key, yi, yw = key[order], yi[order], yw[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(yt, minlength=len(known)))])[xt]
    size = np.maximum(np.searchsorted(key, 2.0 * xt - (cut - SLACK) / xr, side="right") - at, 0)
    ends = np.concatenate([[0], np.cumsum(np.bincount(xi, minlength=len(x)))])
    load = np.concatenate([[0], np.cumsum(size)])[ends]  # meetings before each item
    xo, yo = x["ord"].to_numpy(), y["ord"].to_numpy()
    lo, hi, k = [], [], 0
    while k < len(x):
        stop = min(int(np.searchsorted(load, load[k] + MEETINGS, side="right")) - 1, k + MEETINGS // len(y))
        stop = max(k + 1, stop)
        part = slice(ends[k], ends[stop])
        n = size[part]
        f = np.repeat(at[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row = np.repeat((xi[part] - k) * len(y), n)
        shared = np.bincount(row + yi[f], np.repeat(xw[part], n) * yw[f], (stop - k) * len(y))
        good = np.flatnonzero(shared >= threshold - cut - SLACK)
        lo.append(xo[k + good // len(y)])
        hi.append(yo[good % len(y)])
        k = stop
    a, b = np.concatenate(lo), np.concatenate(hi)
    if same and x["i"].iat[0] != x["j"].iat[0]:
        a, b = np.minimum(a, b), np.maximum(a, b)
    return pd.DataFrame({"lo": a, "hi": b})[a < b]


def candidates(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Pairs (lo, hi) of an item of ``a`` and a later one of ``b`` that can still reach the threshold.

    Lists have a row per item with its terms rare first, or a row per entry in any order. Pairs are found inside a cell,
    a pair of blocks of items: meetings on single terms are neither shuffled nor written, whatever their number. The
    cells of one block of ``a`` are a job, so disk holds two copies of the lists at most, whatever the number of blocks.
    """
    same, ordered = a is b, "terms" in a.columns
    x = a if ordered else settle(packed(a))
    y = x if same else b if ordered else settle(packed(b))
    most = max(d.agg(F.sum(F.size("terms"))).first()[0] or 0 for d in ([x] if same else [x, y]))
    blocks = int(most // (BLOCK * ENTRIES)) + 1
    xs, ys = (in_cells(d, blocks, left, same) for d, left in ((x, True), (y, False)))

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return met(x, y, threshold, same, ordered) if len(x) and len(y) else pd.DataFrame({"lo": [], "hi": []}, dtype="int64")

    found = [settle(xs.filter(F.col("i") == k).groupBy("i", "j").cogroup(ys.filter(F.col("i") == k).groupBy("i", "j")).applyInPandas(cell, "lo long, hi long")) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def groups(cands: DataFrame, blocks: int) -> DataFrame:
    """(i, part, ord, his): the items that are compared in a task and the later ones each of them is compared with.

    Pairs go where the first partner of their earlier item goes, so a group of near copies comes together and an item is
    needed in few places. Groups of very many pairs are cut into parts by the later item.
    """
    first = cands.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("first"))
    pairs = cands.join(first, "lo", "left").withColumn("first", F.coalesce("first", "lo"))
    parts = F.ceil(F.count(F.lit(1)).over(W.partitionBy("first")) / PAIRS)
    pairs = pairs.select(dealt("first", blocks).alias("i"), F.pmod(F.xxhash64("hi"), parts).alias("part"), "lo", "hi")
    roles = F.array(F.struct(F.col("lo").alias("ord"), F.col("hi").alias("hi")), F.struct(F.col("hi").alias("ord"), F.lit(None).cast("long").alias("hi")))
    return pairs.select("i", "part", F.inline(roles)).groupBy("i", "part", "ord").agg(F.collect_list("hi").alias("his"))


def verified(cands: DataFrame, vec: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """Candidate pairs (lo, hi) whose cosine reaches the threshold; only vectors that a pair asks for are moved."""
    asked = cands.select(F.explode(F.array("lo", "hi")).alias("ord")).distinct()
    some = settle(vec.select("ord", "terms", "tf", "df").join(asked, "ord", "left_semi"), **DICTIONARY)
    blocks = int((some.agg(F.sum(F.size("terms"))).first()[0] or 0) // (BLOCK * ENTRIES)) + 1

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        vectors, out = {}, []
        for r in x.itertuples():
            w = weights(r.tf, r.df, n_docs)
            vectors[r.ord] = r.terms, w / np.sqrt((w * w).sum())
        for lo, his in zip(x["ord"], x["his"]):
            terms, w = vectors[lo]
            order = np.argsort(terms)
            terms, w = terms[order], w[order]
            for hi in his:
                theirs, v = vectors[hi]
                at = np.minimum(np.searchsorted(terms, theirs), len(terms) - 1)
                if (w[at] * v * (terms[at] == theirs)).sum() >= threshold - 1e-12:
                    out.append((lo, hi))
        return pd.DataFrame(out, columns=["lo", "hi"], dtype="int64")

    return groups(cands, blocks).join(some, "ord").groupBy("i", "part").applyInPandas(compare, "lo long, hi long")


def batch_end(lists: DataFrame, load: int = BATCH_LOAD, first: int = FIRST) -> int | None:
    """The last item of the next batch, None for all: the longest tried whose lists make few enough pairs.

    Batches are tried at doubling numbers of items; entries are counted per term and step, so a list is a few rows.
    """
    n, entries = lists.agg(F.count("ord"), F.sum(F.size("terms"))).first()
    steps = max(0, math.ceil(math.log2(max(n, 1) / first)))
    if not steps:
        return None
    shares = [2.0 ** (k - steps) for k in range(steps)]
    ends = lists.agg(F.percentile_approx("ord", shares, 10_000)).first()[0]
    level = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("ord")))
    per = counted(lists.select(level.cast("long").alias("part"), "terms")).groupBy("term", F.col("part").alias("level")).agg(F.sum("n").alias("m"))
    upto = F.sum("m").over(W.partitionBy("term").orderBy("level"))
    before = per.withColumn("all", upto).withColumn("before", F.col("all") - F.col("m"))
    pairs = before.groupBy("level").agg(F.sum((F.col("all") * (F.col("all") - 1) - F.col("before") * (F.col("before") - 1)) / 2).alias("pairs"))
    made, end = 0.0, 0
    got = {r.level: r.pairs for r in pairs.collect()}  # one row per step
    for k in range(steps + 1):
        made += got.get(k, 0.0)
        if made > load * max(entries, 1):
            break
        end = k
    return None if end == steps else ends[end]


def first_come(edges: DataFrame) -> DataFrame:
    """Dropped items of the similarity graph ``edges`` (lo earlier than hi) under the first-come rule.

    An item without an undecided earlier neighbour is kept, its later neighbours are dropped. Each
    round is one job that writes the edges with what it decided; the edges shrink from round to round.
    """
    e, dropped = edges, None
    while not e.isEmpty():
        later = e.select(F.col("hi").alias("lo")).distinct().withColumn("_later", F.lit(True))
        d = e.join(later, "lo", "left").select("lo", "hi", F.col("_later").isNull().alias("safe"))
        hit = d.filter("safe").select("hi").distinct().withColumn("_hit", F.lit(True))
        d = d.join(hit, "hi", "left").join(hit.select(F.col("hi").alias("lo"), F.col("_hit").alias("_gone")), "lo", "left")
        d = settle(d.select("lo", "hi", "safe", (~F.col("safe") & F.col("_hit").isNull() & F.col("_gone").isNull()).alias("open")))
        won = d.filter("safe").select(F.col("hi").alias("ord"))
        dropped = won if dropped is None else dropped.unionByName(won)
        e = d.filter("open").select("lo", "hi")
    return edges.select(F.col("hi").alias("ord")).limit(0) if dropped is None else dropped.distinct()


def drop_near_duplicates(
    items: DataFrame, order: str, text: str, threshold: float = THRESHOLD, stop_words: Sequence[str] | None = None,
    load: int = BATCH_LOAD, first: int = FIRST,
) -> DataFrame:
    """Items that stay. ``order`` is a unique long; earlier reference texts simply come first.

    ``load`` and ``first`` set the length of the batches. They change the work, not the answer.
    """
    spark = items.sparkSession
    stop = default_stop_words(spark) if stop_words is None else list(stop_words)
    at = mark()
    with tidy(spark):
        stay = settle(_stay(items, order, text, threshold, stop, load, first))
    discard(spark, written_since(at), stay)
    return items.join(stay.withColumnRenamed("ord", order), order, "left_semi")


def _stay(items: DataFrame, order: str, text: str, threshold: float, stop: Sequence[str], load: int, first: int) -> DataFrame:
    spark, at = items.sparkSession, mark()
    docs = settle(coded(items, order, text, stop), **DICTIONARY)
    n_docs = docs.count()
    stay = settle(docs.filter(F.size("terms") == 0).select("ord"))
    # Equal multisets, by two hashes of 64 and 32 bits and their size, are one item; the copies only count in the IDF.
    sig = F.size("terms"), F.xxhash64("terms"), F.hash("terms")
    firsts = settle(docs.filter(F.size("terms") > 0).groupBy(*sig).agg(F.min("ord").alias("ord")).select("ord"))
    vec = settle(vectors(docs, n_docs, REST * threshold), **DICTIONARY)
    heads = vec.select("ord", "s", F.slice("terms", 1, F.size("ws")).alias("terms"), "ws")
    lists = settle(heads.join(firsts, "ord", "left_semi"), **DICTIONARY)
    ids = lambda *tables: reduce(DataFrame.unionByName, (t.select("ord") for t in tables))
    old = discard(spark, written_since(at), ids(stay, vec, lists))

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        return settle(verified(candidates(a, b, threshold), vec, n_docs, threshold))

    while True:
        at = mark()
        end = batch_end(lists, load, first)
        batch = lists if end is None else lists.filter(F.col("ord") <= end)
        dropped = settle(first_come(near(batch, batch)))
        kept = batch.join(dropped, "ord", "left_anti")
        stay = stay.unionByName(settle(kept.select("ord")))
        if end is None:
            return stay
        later = lists.filter(F.col("ord") > end)
        gone = settle(near(settle(kept, **DICTIONARY), later).select(F.col("hi").alias("ord")).distinct())
        lists = settle(later.join(gone, "ord", "left_anti"), **DICTIONARY)
        old = discard(spark, old + written_since(at), ids(stay, vec, lists))
