"""Spelling variants by permuterm rotations.

A word with a terminator is posted under all its rotations. Words that differ by one replaced code point share the
rotation that starts behind it, up to its last code point; a word with one more code point than another has the other's
whole rotation as such a prefix. So with the rotations sorted, every prefix ``after + terminator + before`` is a range
that holds at most one word as a whole (``before + after``) and at most one word per code point in the skipped place.
Ranges are scanned as groups: their length is bounded by the alphabet, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.crc import TABLE_SQL, crc32_sql
from tidemark.session import settle

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5  # code points of a word
MIN_COUNT = 3  # occurrences of a word
STRIKE = 97  # a run whose checksum this divides loses a code point
STRONGER = 2  # a form has at least this many times the word's occurrences
END = "$"  # stands in no word
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """(word): every letter run of every whole text, A-Z lower-cased, one code point struck where the rule says so."""
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    struck = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return each.select(F.when(h % STRIKE == 0, struck).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words long and frequent enough; occurrences are added up before the shuffle."""
    return runs(docs).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, whole, first): the postings of each word.

    ``prefix`` is a rotation without the code point it ends in, or, where ``whole``, a full rotation of word and
    terminator. ``first`` is false where the skipped code point repeats the one before it: skipping either gives the
    same shorter word, which must count once.
    """
    n = F.length("word")
    at = F.explode(F.sequence(F.lit(0), n)).alias("at")
    p = words.select("word", "n", at)
    before = F.substring("word", F.lit(1), F.col("at"))
    after = lambda skip: F.substring(F.col("word"), F.col("at") + 1 + skip, F.length("word"))
    repeats = (F.col("at") > 0) & (F.substring("word", F.col("at"), F.lit(1)) == F.substring("word", F.col("at") + 1, F.lit(1)))
    whole = F.struct(F.concat(after(0), F.lit(END), before).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first"))
    skipped = F.struct(F.concat(after(1), F.lit(END), before).alias("prefix"), F.lit(False).alias("whole"), (~repeats).alias("first"))
    both = F.when(F.col("at") < n, F.array(whole, skipped)).otherwise(F.array(whole))
    return p.select("word", "n", F.explode(both).alias("r")).select("r.prefix", "word", "n", "r.whole", "r.first")


def ranges(words: DataFrame) -> DataFrame:
    """(prefix, members): the ranges with at least two words, each list bounded by the alphabet plus one."""
    member = F.struct("word", "n", "whole", "first")
    g = rotations(words).groupBy("prefix").agg(F.collect_list(member).alias("members"), F.count(F.lit(1)).alias("size"))
    return g.where("size > 1").select("prefix", "members")


def _near(a: Column, b: Column) -> Column:
    """Whether two members of a range make a link that this range is the one to report."""
    return (a["word"] != b["word"]) & F.when(a["whole"], b["first"]).when(b["whole"], a["first"]).otherwise(F.lit(True))


def linked(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): per word its near words counted, and the best of them (n, word) or NULL.

    Every range is scanned once and gives each member one row, its count and best within the range; the rows of a word
    are then added up. A pair of near words meets in one range only, so nothing is counted twice.
    """
    m = ranges(words).select(F.explode("members").alias("m"), "members")
    near = F.filter("members", lambda x: _near(F.col("m"), x))
    m = m.select(F.col("m.word").alias("word"), near.alias("near")).where(F.size("near") > 0)
    # largest n first, then the smallest word: of negated counts the least pair
    best = F.array_min(F.transform("near", lambda x: F.struct((-x["n"]).alias("minus"), x["word"].alias("word"))))
    per = m.select("word", F.size("near").cast("long").alias("k"), best.alias("best"))
    sums = per.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return words.join(sums, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of near words, both ways round."""
    m = ranges(words).select(F.explode("members").alias("m"), "members")
    near = F.explode(F.filter("members", lambda x: _near(F.col("m"), x)))
    return m.select(F.col("m.word").alias("word"), near.alias("x")).select("word", F.col("x.word").alias("near"), F.col("x.n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of (word, form): the last word that forms lead to.

    Counts at least double along a form, so paths have at most some forty steps; each round doubles the steps taken.
    """
    step = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        new = settle(step.join(ahead, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        step = new.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, stronger: int = STRONGER) -> DataFrame:
    """(word, form, root, n, n_near, form_n): spelling variants and the words they lead to.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is at least
    ``stronger`` times its own; ``root`` follows forms to the last. NULL and empty texts have no words; a NULL doc_id is
    written as nothing where runs are struck; repeated rows count each; words of any length take part, with as many
    rotations as code points; an empty table gives no words. Only doc_id and text are read.
    """
    words = settle(vocabulary(docs, min_length, min_count))
    ok = F.col("best").isNotNull() & (-F.col("best.minus") >= stronger * F.col("n"))
    w = settle(linked(words).select("word", F.when(ok, F.col("best.word")).alias("form"), "n", "n_near", F.when(ok, -F.col("best.minus")).alias("form_n")))
    roots = _roots(w.where("form is not null"))
    return w.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def groups(found: DataFrame) -> DataFrame:
    """(root, words, n): how many spellings each root gathers, and their occurrences."""
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))


SQL = rf"""
WITH RECURSIVE crc AS ({TABLE_SQL}),
tok AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run
  FROM documents),
per_doc AS (SELECT id, run, count(*) AS c FROM tok GROUP BY id, run),
hashed AS (SELECT run, c, {crc32_sql("(id || ':' || run)")} AS h FROM per_doc, crc),
struck AS (
  SELECT CASE WHEN h % {STRIKE} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c
  FROM hashed),
voc AS (SELECT word, sum(c)::BIGINT AS n FROM struck WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
cut AS (
  SELECT word, n, left(word, i::INT) || chr(1) || substr(word, i::INT + 2) AS gap, left(word, i::INT) || substr(word, i::INT + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM voc)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM cut a JOIN voc v ON a.rest = v.word
  UNION SELECT v.word, a.word, a.n FROM cut a JOIN voc v ON a.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.near_n >= {STRONGER} * v.n THEN b.near END AS form, CASE WHEN b.near_n >= {STRONGER} * v.n THEN b.near_n END AS form_n
  FROM voc v LEFT JOIN best b ON v.word = b.word),
walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON w.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM walk w JOIN formed f ON w.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM formed f JOIN ends e ON f.word = e.word"""
