"""Corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, piece encoding.

Every stage takes what its predecessor kept, and its decisions take effect. All but the last return the columns of
``documents``; the last adds the piece ids. NULL and empty texts fail the quality rules, repeated rows of a doc_id are
one document, empty tables pass through empty, and further columns of ``documents`` are carried along.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mix, nbest, nearcopies, passages, rules
from tidemark.llm.base import table
from tidemark.session import discard, mark, settle, written_since

_left: list[str] = []  # tables of the stages before, deleted once their results have been read back


def stage(fn):
    """A stage's own tables live until the next stage begins, whose ``docs`` are read from what this one wrote."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = discard(spark, _left, docs)
        at = mark()
        out = fn(spark, docs, sf_dir)
        _left.extend(written_since(at))
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rule and isolation forest keep."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word Jaccard similarity of 0.8 or more."""
    return nearcopies.keep_first(docs)


@stage
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document."""
    return passages.without_repeats(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the source mix takes them."""
    return mix.copies(docs)


@stage
def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation."""
    return nbest.with_pieces(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("piece_encoding", piece_encoding),
]

ORACLE_SQL = None  # forest, posted shingles and piece search have no SQL form; tests hold each stage against plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, fn in STAGES:
        docs = settle(fn(spark, docs, sf_dir))
    return docs
