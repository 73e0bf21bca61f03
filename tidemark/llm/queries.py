"""One query per operator, with its production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import langid, manifest, maxent, mix, nbest, passages, permindex, permuterm, prefixcount, rules, simhash, slots, toxicity
from tidemark.llm.base import table
from tidemark.llm.registry import ORACLES, QUERIES, query


@query("op1_permutation_index")
def op1(spark, sf):
    """The nearest neighbours of every fiftieth vector."""
    return permindex.search(table(spark, sf, "embeddings"))


@query("op2_language_ftrl")
def op2(spark, sf):
    """Language of every document."""
    return langid.languages(table(spark, sf, "documents"))


@query("op3_toxicity_kneser_ney")
def op3(spark, sf):
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_source_mix", mix.SQL)
def op4(spark, sf):
    """Words that a mix of weighted sources takes from every document."""
    return mix.mixed(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


LIMIT = 4096  # tokens of a context window


@query("op5_prefix_token_counts")
def op5(spark, sf):
    """Exact token counts, and how much of a text fits the window."""
    return prefixcount.token_counts(table(spark, sf, "documents"), LIMIT)


@query("op6_quality_forest")
def op6(spark, sf):
    """Rule statistics and the verdict of base rule and forest."""
    out = rules.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query("op7_nbest_pieces")
def op7(spark, sf):
    """The n best segmentations of every text with their scores, and whether all of them decode to the text."""
    return nbest.encoded(table(spark, sf, "documents")).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_paths", "ids", "others", "scores", "digests", "round_trip")


@query("op8_simhash_near_dedup")
def op8(spark, sf):
    """Fingerprint and near-duplicate group of every document."""
    g = simhash.near_groups(table(spark, sf, "documents"))
    return g.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


@query("op9_passage_dedup")
def op9(spark, sf):
    """Repeated passages: spans cut from every document, and its text without them."""
    return passages.spans(table(spark, sf, "documents")).select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


@query("op10_maxent_scores")
def op10(spark, sf):
    """Unigram and maximum-entropy log10 probability of every document."""
    return maxent.scores(table(spark, sf, "documents"))


@query("op11_virtual_slots")
def op11(spark, sf):
    """Shard and place of every document."""
    return slots.sharded(table(spark, sf, "documents")).select("doc_id", "size", "text_crc32", "shard", "slot", "vslot", *slots.law())


@query("op12_permuterm_variants", permuterm.SQL)
def op12(spark, sf):
    """Words, their spelling variants and the word these lead to."""
    return permuterm.variants(table(spark, sf, "documents"))


@query("op13_octopus_manifest", manifest.SQL)
def op13(spark, sf):
    """Merkle root of the documents, every row's proof, and whether the row as seen still leads to the root."""
    return manifest.manifest(table(spark, sf, "documents"))


def load():
    return QUERIES, ORACLES
