"""How filters interact: every order of applying them, enumerated by a recursive common table expression.

Each document fails some filters, which is a mask of bits. Documents are folded into cells (part, mask) with their
counts before anything is enumerated, so what the recursion works on doesn't grow with the documents: from the empty
prefix it extends filter prefixes by each unused letter, carries the applied bits and the mask cells, and each level
of it is a step whose metrics follow from the mask and the bits applied before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: The filters of the audit, in their bits' order.
LETTERS = "ABCDE"
COPY = 1 << 4
SHORTEST, VARIETY, CAPITALS = 200, 50, 3
MARKS = "#$%&*|"

WALK = """
WITH RECURSIVE walk(prefix, step, letter, bit, before, mask) AS (
  SELECT CAST('' AS STRING), 0, CAST('' AS STRING), 0, 0, mask FROM {masks}
  UNION ALL
  SELECT concat(prefix, f.letter), step + 1, f.letter, f.bit, before | bit, mask
  FROM (SELECT prefix, step, bit, before, mask, explode(filter({letters}, l -> instr(prefix, l.letter) = 0)) AS f FROM walk WHERE step < {n})
),
steps AS (
  SELECT c.part, w.prefix, w.step, w.letter,
         sum(if(mask & (before | bit) = 0, n, 0)) AS kept,
         sum(if(mask & before = 0 AND mask & bit <> 0, n, 0)) AS removed,
         sum(if(mask & before <> 0 AND mask & bit <> 0, n, 0)) AS redundant,
         sum(if(mask = bit, n, 0)) AS unique_fails,
         sum(if(mask & before = 0 AND mask & bit <> 0, good, 0)) AS good_lost,
         sum(if(mask & before = 0 AND mask & bit <> 0, toxic, 0)) AS toxic_lost
  FROM walk w JOIN {cells} c USING (mask) WHERE w.step > 0 GROUP BY c.part, w.prefix, w.step, w.letter
),
orders AS (
  SELECT prefix AS filter_order, step, substring(prefix, 1, step) AS prefix
  FROM (SELECT prefix, explode(sequence(1, {n})) AS step FROM (SELECT DISTINCT prefix FROM walk WHERE step = {n}))
)
SELECT s.part, o.filter_order, o.step, s.kept, s.removed, s.redundant, s.unique_fails, s.good_lost, s.toxic_lost,
       sum(s.removed) OVER (PARTITION BY s.part, s.letter) AS shapley
FROM orders o JOIN steps s USING (prefix)
"""


def failures(text: Column) -> Column:
    """Mask of what a whole text fails by itself: A under 200 words, B fewer than half of them distinct, C capitals over 3 %, D a mark."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < SHORTEST, 100 * distinct < VARIETY * n, 100 * capitals > CAPITALS * F.length(text), F.length(F.translate(text, MARKS, "")) < F.length(text))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each language that fail the same filters.

    Texts are met once, as a digest and a mask. Whether a row copies a smaller doc_id is told from counts of each
    digest: all its rows fail E but those of the smallest doc_id, so no document meets its copies and a text that a
    third of all rows share is a few rows after the map side.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("sha"), failures(text).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    kinds = rows.groupBy("sha", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), first.alias("first"))
    texts = kinds.groupBy("sha", "mask").agg(F.min("first.doc_id").alias("least"), F.collect_list(F.struct("part", "good", "toxic", "n", "no_id", "first")).alias("kinds"))
    each = texts.select("mask", "least", F.inline("kinds"))
    own = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - own).alias("n")))
    split = each.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order.

    ``cells`` is (part, mask, n, good, toxic), where bit i of the mask is letter i. The recursion starts from the masks
    that occur, at most 2^letters, whatever the number of parts; metrics are joined to it by mask. Its result and the
    cells are written, since each level reads them. With n letters it
    has n levels and at most 2^n times the number of prefixes rows, which is 10,432 for five; up to six letters fit.
    """
    if not 1 <= len(letters) <= 6:
        raise ValueError("one to six filters")
    pairs = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(letters))
    sql = WALK.format(masks="{masks}", cells="{cells}", letters=f"array({pairs})", n=len(letters))
    return cells.sparkSession.sql(sql, masks=cells.select("mask").distinct(), cells=cells)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of five filters over whole texts, for each language, zeros included.

    A null text is empty, a null language the empty string. Rows without a doc_id copy nothing and are copied by
    nothing that has one; repeated rows count each, and those that have the smallest doc_id of their text don't fail E.
    A document without labels is in neither loss; one with several is good, or toxic, if one of them says so. Long
    texts are one row's arrays of words. An empty table has no part, so no row. Further columns are ignored.
    """
    return interactions(cut(cells(docs, labels), "cells"))
