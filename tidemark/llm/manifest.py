"""Merkle manifest of a dataset with octopus multiproofs.

Rows are leaves; the leaves of a language form a tree of arity 8, and the roots of these trees form one more tree, whose
root names the dataset. Proofs are not fetched leaf by leaf: leaves stand in order, a partition of neighbouring leaves
computes the smallest set of nodes that it cannot derive from its own leaves (the edges of its range, level by level),
fetches those once, derives the interiors its leaves share, and expands the single proofs from them.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.base import fold
from tidemark.llm.crc import TABLE_SQL, crc32_sql
from tidemark.llm.mix import running_sum
from tidemark.session import settle

ARITY = 8  # a fixed value, like the leaf format
_BITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALIGNED = 512  # leaves in the smallest whole subtree that a partition holds
PARTITION = 4096  # leaves of a partition, about
TOP = -1  # the tree of the languages' roots
TAMPER = 3  # every third checksum
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(text: str | Column = "text") -> Column:
    """SHA-256 of a row's fields: "-" for NULL, else the UTF-8 byte count, ":" and the value."""
    cols = [F.col(c).cast("string") for c in FIELDS[:-1]] + [text if isinstance(text, Column) else F.col(text)]
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in cols]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hashed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, seen): each row's leaf, and the leaf as a verifier sees it, tampered or not."""
    changed = F.coalesce(fold("doc_id", TAMPER) == 0, F.lit(False))
    seen = F.when(changed, leaf_hash(F.translate("text", _UPPER, _LOWER)))
    return docs.select("doc_id", "lang", leaf_hash().alias("leaf"), seen.alias("seen"), F.monotonically_increasing_id().alias("__row"))


def _up(level: DataFrame) -> DataFrame:
    """The nodes above (tree, idx, hash); of each, its at most eight children are put together in order."""
    kids = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    joined = F.concat_ws("", F.transform(kids, lambda k: k["hash"]))
    return level.groupBy("tree", F.shiftright("idx", _BITS).alias("idx")).agg(F.sha2(joined.cast("binary"), 256).alias("hash"))


def grow(leaves: DataFrame, lowest: int = 0) -> tuple[DataFrame | None, DataFrame]:
    """Nodes (tree, level, idx, hash) of level ``lowest`` and above, and the roots (tree, hash), from (tree, idx, hash).

    One pass over a level's nodes makes the next; a tree leaves the loop once one node of it is left.
    """
    parts, roots, level, at = [], [], leaves, 0
    while True:
        if at >= lowest:
            parts.append(level.withColumn("level", F.lit(at)))
        sizes = level.groupBy("tree").agg(F.max("idx").alias("last"))
        state = settle(level.where("idx = 0").join(sizes, "tree"))
        roots.append(state.where("last = 0").select("tree", "hash"))
        open_trees = state.where("last > 0").select("tree")
        if open_trees.isEmpty():
            break
        level = settle(_up(level.join(open_trees, "tree", "left_semi")))
        at += 1
    nodes = None
    for p in parts:
        nodes = p if nodes is None else nodes.unionByName(p)
    top = roots[0]
    for r in roots[1:]:
        top = top.unionByName(r)
    return nodes, settle(top)


def missing(ranges: DataFrame) -> DataFrame:
    """(part, tree, level, idx): the nodes a partition must fetch, from (part, tree, lo, hi, n).

    ``lo`` to ``hi`` are its leaves of a tree with n leaves. On every level the derived nodes are again one range; what
    fills up the first and the last group of eight is missing, nothing else.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(21))).alias("level")
    r = ranges.select("*", levels)
    at = lambda c: F.expr(f"shiftright({c}, {_BITS} * level)")
    r = r.select("part", "tree", "level", at("lo").alias("a"), at("hi").alias("b"), at("n - 1").alias("last")).where("last > 0")
    first = F.col("a") - F.col("a") % ARITY
    final = F.least(F.col("b") - F.col("b") % ARITY + ARITY - 1, F.col("last"))
    left = F.when(first < F.col("a"), F.sequence(first, F.col("a") - 1)).otherwise(F.array().cast("array<bigint>"))
    right = F.when(F.col("b") < final, F.sequence(F.col("b") + 1, final)).otherwise(F.array().cast("array<bigint>"))
    return r.select("part", "tree", "level", F.explode(F.concat(left, right)).alias("idx"))


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class _Shared:
    """One tree as a partition knows it: level by level the hashes of a range of nodes, own, derived and fetched."""

    def __init__(self, own: dict[int, str], fetched: dict[tuple[int, int], str], n: int):
        self.levels = [dict(own)]
        last = n - 1
        while last > 0:
            at = len(self.levels) - 1
            here = self.levels[at]
            here.update({i: h for (k, i), h in fetched.items() if k == at})
            up = {}
            for g in sorted({i >> _BITS for i in own}):
                up[g] = _h("".join(here[i] for i in range(g * ARITY, min(g * ARITY + ARITY, last + 1))))
            self.levels.append(up)
            own, last = up, last >> _BITS
        self.last = [(n - 1) >> (_BITS * k) for k in range(len(self.levels))]
        self.root = self.levels[-1][0]
        self._proofs: dict[tuple[int, int], list[str]] = {}

    def siblings(self, level: int, idx: int) -> tuple[list[str], list[str]]:
        g = idx - idx % ARITY
        here = self.levels[level]
        end = min(g + ARITY, self.last[level] + 1)
        return [here[i] for i in range(g, idx)], [here[i] for i in range(idx + 1, end)]

    def proof(self, idx: int, level: int = 0) -> list[str]:
        """Hashes beside the path from a node up to the root, left to right, level by level; shared by what lies below."""
        if level == len(self.levels) - 1:
            return []
        left, right = self.siblings(level, idx)
        key = (level + 1, idx >> _BITS)
        above = self._proofs.get(key)
        if above is None:
            above = self._proofs[key] = self.proof(idx >> _BITS, level + 1)
        return left + right + above

    def folded(self, idx: int, leaf: str) -> str:
        """The root that ``leaf`` in this place leads to, with the siblings as they are."""
        for level in range(len(self.levels) - 1):
            if self.levels[level].get(idx) == leaf:
                return self.root  # from here on the path is the derived one
            left, right = self.siblings(level, idx)
            leaf = _h("".join([*left, leaf, *right]))
            idx >>= _BITS
        return leaf


def expand(leaves: pd.DataFrame, fetched: pd.DataFrame, trees: int, with_path: bool) -> pd.DataFrame:
    """The proofs of one partition: (doc_id, sid, pos, leaf, seen, n) and the nodes it fetched, over ``trees`` languages."""
    by_tree: dict[int, dict[tuple[int, int], str]] = {}
    for t, k, i, h in zip(fetched["tree"], fetched["level"], fetched["idx"], fetched["hash"]):
        by_tree.setdefault(t, {})[k, i] = h
    shared = {}
    for sid, g in leaves.groupby("sid", sort=True):
        shared[sid] = _Shared(dict(zip(g["pos"], g["leaf"])), by_tree.get(sid, {}), int(g["n"].iloc[0]))
    top = _Shared({s: t.root for s, t in shared.items()}, by_tree.get(TOP, {}), trees)
    above = {s: top.proof(s) for s in shared}
    out = []
    for sid, pos, leaf, seen in zip(leaves["sid"], leaves["pos"], leaves["leaf"], leaves["seen"]):
        t = shared[sid]
        path = t.proof(pos) + above[sid]
        folded = top.folded(sid, t.folded(pos, seen or leaf))
        out.append((t.root, top.root, _h("".join(path)), folded, folded == top.root, *([path] if with_path else [])))
    names = ["subroot", "root", "proof_sha256", "folded_root", "verified"] + ["path"] * with_path
    done = pd.DataFrame(out, columns=names)
    done.insert(0, "leaf", leaves["leaf"].to_numpy())
    done.insert(0, "doc_id", leaves["doc_id"].to_numpy())
    return done


def manifest(docs: DataFrame, partition: int = PARTITION, aligned: int = ALIGNED, with_path: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row per row; with ``path``, the proof itself.

    ``aligned``, a power of eight, is the number of leaves at whose multiples a partition may begin or end, so a
    partition has at most ``partition + aligned`` leaves and fetches no node below that subtree's. Leaves of a language
    ascend by doc_id (NULL first), then by leaf; equal rows are leaves each. NULL fields are written "-", a NULL lang is
    the first tree, and a NULL doc_id is not tampered with. A lone leaf is its own subroot, a lone subroot the root,
    both without siblings. Empty and very long texts are hashed whole; an empty table gives no rows. Other columns are
    not read, whatever their names.
    """
    lowest = int(np.log2(aligned)) // _BITS
    leaves = settle(hashed_rows(docs).withColumn("one", F.lit(1)))
    langs = leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumns({"all": F.lit(0), "nul": F.col("lang").isNotNull()})
    langs = running_sum(langs.withColumn("one", F.lit(1)), "all", ["nul", "lang"], "one", "sid")
    langs = settle(running_sum(langs, "all", ["nul", "lang"], "n", "start").select(F.col("lang").alias("__lang"), "n", "sid", "start"))
    trees = langs.count()
    named = leaves.join(langs, F.col("lang").eqNullSafe(F.col("__lang"))).drop("lang", "__lang")
    placed = running_sum(named, "sid", ["doc_id", "leaf", "__row"], "one", "pos")
    part = F.floor((F.col("start") + F.col("pos") - F.col("pos") % aligned) / F.lit(partition)).cast("long")
    placed = settle(placed.select("doc_id", "sid", "pos", "leaf", "seen", "n", part.alias("part")))
    nodes, roots = grow(placed.select(F.col("sid").alias("tree"), F.col("pos").alias("idx"), F.col("leaf").alias("hash")), lowest)
    tops, _ = grow(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash"))
    known = tops.unionByName(nodes) if nodes is not None else tops
    own = placed.groupBy("part", F.col("sid").alias("tree")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("n").alias("n"))
    own = settle(own)
    upper = own.groupBy("part").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).select("part", F.lit(TOP).cast("long").alias("tree"), "lo", "hi", F.lit(trees).cast("long").alias("n"))
    fetched = missing(own.unionByName(upper)).join(known, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "hash")
    types = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return expand(a, b, trees, with_path)

    return placed.groupBy("part").cogroup(fetched.groupBy("part")).applyInPandas(one, types + ", path array<string>" * with_path)


def root_of(docs: DataFrame) -> str | None:
    """The hash that names the whole dataset; None for an empty one."""
    row = manifest(docs).select("root").first()
    return row and row.root


def _tree_sql(name: str, leaves: str, levels: int = 8) -> str:
    """CTEs ``{name}0..`` (tree, idx, hash, n), {name}_root and {name}_sib (tree, pos, level, before, after) over ``leaves``."""
    out = [f"{name}0 AS (SELECT tree, idx, hash, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(1, levels + 1):
        out.append(
            f"{name}{k} AS (SELECT tree, idx // {ARITY} AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash, (any_value(n) + {ARITY - 1}) // {ARITY} AS n "
            f"FROM {name}{k - 1} WHERE n > 1 GROUP BY tree, idx // {ARITY})"
        )
    roots = " UNION ALL ".join(f"SELECT tree, hash FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    sides = " UNION ALL ".join(
        f"SELECT p.tree, p.idx AS pos, {k} AS level, coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (WHERE s.idx < p.idx // {ARITY**k}), '') AS before, "
        f"coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (WHERE s.idx > p.idx // {ARITY**k}), '') AS after "
        f"FROM {name}0 p JOIN {name}{k} s ON p.tree = s.tree AND p.idx // {ARITY ** (k + 1)} = s.idx // {ARITY} AND s.n > 1 GROUP BY p.tree, p.idx"
        for k in range(levels)
    )
    return ", ".join(out) + f", {name}_root AS ({roots}), {name}_sib AS ({sides})"


def _leaf_sql(text: str) -> str:
    cols = [f"{c}::VARCHAR" for c in FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}))::VARCHAR || ':' || {c} END" for c in cols) + ")"


SQL = f"""
WITH crc AS ({TABLE_SQL}),
seen AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         CASE WHEN coalesce({crc32_sql("doc_id::VARCHAR")} % {TAMPER}, 1) = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other
  FROM documents, crc),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS sid FROM (SELECT DISTINCT lang FROM seen)),
rows_ AS (
  SELECT s.*, l.sid AS tree, row_number() OVER (PARTITION BY l.sid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM seen s JOIN langs l ON s.lang IS NOT DISTINCT FROM l.lang),
a AS (SELECT tree, pos AS idx, leaf AS hash FROM rows_),
{_tree_sql("x", "a")},
b AS (SELECT {TOP} AS tree, tree AS idx, hash FROM x_root),
{_tree_sql("y", "b")},
steps AS (
  SELECT tree, pos, level, before, after FROM x_sib
  UNION ALL SELECT r.tree, r.pos, 100 + s.level, s.before, s.after FROM rows_ r JOIN y_sib s ON s.pos = r.tree),
paths AS (
  SELECT tree, pos, string_agg(before || after, '' ORDER BY level) AS path, list([before, after] ORDER BY level) AS sides
  FROM steps GROUP BY tree, pos),
done AS (
  SELECT r.doc_id, r.leaf, x.hash AS subroot, y.hash AS root, sha256(coalesce(p.path, '')) AS proof_sha256,
         list_reduce(list_prepend([coalesce(r.other, r.leaf), ''], coalesce(p.sides, [])), lambda h, s: [sha256(s[1] || h[1] || s[2]), ''])[1] AS folded_root
  FROM rows_ r JOIN x_root x ON r.tree = x.tree CROSS JOIN y_root y LEFT JOIN paths p ON p.tree = r.tree AND p.pos = r.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done"""
