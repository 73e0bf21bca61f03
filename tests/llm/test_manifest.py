from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(row, text):
    def cell(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return h("".join(map(cell, (row.doc_id, row.source, row.lang, row.n_chars, text))))


def tree(nodes):
    """Root, and each leaf's siblings as (before, after) per level."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            g = i - i % 8
            sides[k].append((nodes[g:i], nodes[i + 1 : g + 8]))
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], sides


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in order:
        by[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id, leaf(r, r.text)))
        made[lang] = tree([leaf(r, r.text) for r in by[lang]])
    root, above = tree([made[x][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        sub, sides = made[lang]
        for r, s in zip(by[lang], sides):
            path = s + above[k]
            tampered = r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if tampered else r.text
            got = leaf(r, text)
            for left, right in path:
                got = h("".join([*left, got, *right]))
            flat = [x for left, right in path for x in left + right]
            out.append((r.doc_id, leaf(r, r.text), sub, root, h("".join(flat)), got, got == root))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def same(got, rows):
    return sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = manifest.manifest(docs)
    assert same(got, docs.collect())
    assert 0 < got.where("verified").count() < docs.count()


@pytest.mark.parametrize(("partition", "aligned"), [(1, 1), (7, 1), (20, 8), (64, 64), (4096, 512)])
def test_partitions_of_any_size(spark, make_docs, partition, aligned):
    docs = make_docs([(i * 3 % 1000, f"Text {i}", None if i % 9 == 0 else f"l{i % 5 if i > 40 else i}", "s") for i in range(300)])
    got = manifest.manifest(docs, partition, aligned, with_path=True)
    assert same(got.drop("path"), docs.collect())
    assert got.where(F.sha2(F.concat_ws("", "path").cast("binary"), 256) != F.col("proof_sha256")).count() == 0


def test_a_language_per_row(spark, make_docs):
    docs = make_docs([(i, "T", f"lang{i}", "s") for i in range(150)])
    assert same(manifest.manifest(docs, 16, 8), docs.collect())


def test_fetches_only_edges(spark):
    own = spark.createDataFrame([(0, 5, 9, 20, 100), (1, 5, 64, 99, 100), (2, 6, 0, 0, 1)], "part long, tree long, lo long, hi long, n long")
    got = {(r.part, r.level, r.idx) for r in manifest.missing(own).collect()}
    first = {(0, 0, 8), (0, 0, 21), (0, 0, 22), (0, 0, 23), (0, 1, 0), *((0, 1, i) for i in range(3, 8)), (0, 2, 1)}
    assert got == first | {(1, 2, 0)}


def test_odd_rows(spark, make_docs):
    rows = [(1, "A", "en", "x"), (1, "A", "en", "x"), (None, "B", "en", "x"), (None, "B", "en", "x"), (2, None, None, None), (3, "", "de", "x"), (4, "Word " * 50_000, "de", "x")]
    extra = {"leaf": F.lit("l"), "pos": F.lit(1), "tree": F.lit(2), "n": F.lit(0), "sid": F.lit(0)}
    docs = make_docs(rows, extra)
    assert same(manifest.manifest(docs), docs.collect())
    one = docs.where("doc_id = 2")
    got = manifest.manifest(one).collect()[0]
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == h("") and got.verified
    assert manifest.manifest(docs.limit(0)).collect() == [] and manifest.root_of(docs.limit(0)) is None


def test_root_follows_content(spark, make_docs):
    docs = make_docs([(i, f"t{i}") for i in range(50)])
    assert manifest.root_of(docs) == manifest.root_of(docs.repartition(7))
    assert manifest.root_of(docs) != manifest.root_of(docs.withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") == 7).cast("long")))
