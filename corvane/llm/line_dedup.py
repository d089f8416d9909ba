"""Line dedup over content-defined chunks of lines, by DataFrame and SQL functions only.

A text is cut at line feeds. At every line a rolling hash is taken over the hashes of a window of two lines, the line and its
next one. Where that hash has no earlier place in the whole corpus is a boundary; the lines between two boundaries are a chunk, a
maximal run that goes on as it did before. A boundary depends on the two lines beside it only, so an insertion elsewhere moves
none, and a passage is found from its first line to its last, whatever stands around it. A line of ``LONG`` words or more is
a chunk by itself too.

Windows and long lines of equal hash count as equal only if their bytes are (the least and the greatest text of the hash are
the same; in a window a long line stands as its hash, since its bytes are compared by itself). The first place of each, in order
of document and line, stays. A chunk of other places goes if its lines have ``LONG`` words or more together.

The places are counted by aggregations with map-side combine; a passage that a third of all documents hold is one key
of a join, whose hot side adaptive execution splits. Texts are shuffled once to compare the windows and once to meet
what is to be removed from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LONG = 25


def windows_of(text: Column) -> Column:
    """array<struct<at: first line from 0, n: 1 (a long line) or 2 lines, w1, w2: their words, key, chunk: text>>."""

    def let(value: Column, body) -> Column:
        """``body(value)`` with ``value`` worked out once, also where lambdas use it."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def words(line: Column) -> Column:
        return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)

    def cut(lines: Column) -> Column:
        facts = F.transform(lines, lambda x: F.struct(F.md5(x).alias("h"), words(x).alias("w")))
        return let(facts, lambda fact: F.concat(F.filter(F.transform(fact, lambda f, i: long_line(lines, f, i)), lambda c: c.isNotNull()), pairs(lines, fact)))

    def long_line(lines: Column, f: Column, i: Column) -> Column:
        return F.when(f["w"] >= LONG, window(i, 1, f["w"], F.lit(0), f["h"], F.get(lines, i)))

    def pairs(lines: Column, fact: Column) -> Column:
        def pair(f: Column, i: Column) -> Column:
            after = F.get(fact, i + 1)
            inner = after.isNotNull() & ((f["w"] < LONG) | (after["w"] < LONG))
            shown = F.concat(shorter(f, F.get(lines, i)), F.lit("\n"), shorter(after, F.get(lines, i + 1)))
            return F.when(inner, window(i, 2, f["w"], after["w"], F.md5(F.concat(f["h"], after["h"])), shown))

        return F.filter(F.transform(fact, pair), lambda c: c.isNotNull())

    def shorter(f: Column, line: Column) -> Column:
        return F.when(f["w"] >= LONG, f["h"]).otherwise(line)

    def window(at: Column, n: int, w1: Column, w2: Column, key: Column, chunk: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(n).alias("n"), w1.alias("w1"), w2.alias("w2"), F.unhex(key).alias("key"), chunk.alias("chunk"))

    return let(F.split(text, "\n", -1), cut)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with text cleaned, n_lines (before) and lines_removed, which replace columns of these names.

    Null text is empty: one line, nothing removed. The order of places is doc_id (null first), then the MD5 of the text,
    then the line; rows with equal doc_id and text are one place each and are treated alike: both keep or both lose a
    passage. Unlike windows of one MD5 are left alone. An empty table gives no rows. Other columns are carried along, whatever
    their names: they travel in one struct."""
    names = [n for n in docs.columns if n not in ("n_lines", "lines_removed")]
    body, carried = F.coalesce(F.col("text").cast("string"), F.lit("")), F.struct(*[F.col(f"`{n}`") for n in names if n != "text"])
    source = docs.select(body.alias("body"), F.col("doc_id").cast("long").alias("id"), F.md5(body).alias("mark"), carried.alias("carried"))
    found = source.select("id", "mark", F.explode(windows_of(F.col("body"))).alias("c")).select("id", "mark", "c.*")
    place = F.struct("id", "mark", "at")
    groups = found.groupBy("key").agg(F.count("*").alias("times"), F.min(place).alias("first"), F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    repeated = common.staged(groups.where("times > 1 AND low = high").select("key", "first"), "repeated")
    later = found.select("id", "mark", "at", "n", "w1", "w2", "key").join(repeated, "key").where(~place.eqNullSafe(F.col("first"))).select("id", "mark", "at", "n", "w1", "w2").distinct()
    order = W.partitionBy("id", "mark", "n").orderBy("at")
    runs = later.withColumn("run", F.when(F.col("n") == 2, F.col("at") - F.row_number().over(order)).otherwise(F.col("at")))
    chunks = runs.groupBy("id", "mark", "n", "run").agg(F.min("at").alias("a"), (F.max("at") + F.col("n") - 1).alias("b"), (F.min_by("w1", "at") + F.sum("w2")).alias("words")).where(F.col("words") >= LONG)
    marks = chunks.groupBy(F.col("id").alias("id2"), F.col("mark").alias("mark2")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    met = source.join(marks, (F.col("mark") == F.col("mark2")) & F.col("id").eqNullSafe(F.col("id2")), "left")
    lines = F.split("body", "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda g: F.sequence(g["a"], g["b"]))))
    kept = F.element_at(F.transform(F.array(F.struct(lines.alias("l"), F.col("gone").alias("g"))), lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["l"]) - 1), s["g"]), lambda i: F.get(s["l"], i)), "\n")), 1)
    met = met.withColumn("gone", gone)
    text = F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept).alias("text")
    removed = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long")
    return met.select(*[text if n == "text" else F.col("carried").getField(n).alias(n) for n in names], F.size(lines).cast("long").alias("n_lines"), removed.alias("lines_removed"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents`` without repeated passages: doc_id, n_lines, lines_removed, text."""
    return dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "lines_removed", "text")


ORACLE_SQL = f"""
WITH source AS (
  SELECT doc_id, md5(coalesce(text, '')) AS mark, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, mark, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM source
), facts AS (
  SELECT *, CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, ' ', '')) + 1 END AS words FROM numbered
), paired AS (
  SELECT *, lead(line) OVER w AS line2, lead(words) OVER w AS words2 FROM facts WINDOW w AS (PARTITION BY doc_id, mark ORDER BY pos)
), windows AS (
  SELECT doc_id, mark, pos, 1 AS n, words AS w1, 0 AS w2, line AS chunk FROM paired WHERE words >= {LONG}
  UNION ALL
  SELECT doc_id, mark, pos, 2, words, words2, line || chr(10) || line2 FROM paired WHERE line2 IS NOT NULL AND (words < {LONG} OR words2 < {LONG})
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, chunk ORDER BY doc_id, mark, pos) AS place FROM windows) WHERE place > 1
), runs AS (
  SELECT *, CASE WHEN n = 1 THEN pos ELSE pos - row_number() OVER (PARTITION BY doc_id, mark, n ORDER BY pos) END AS run FROM later
), chunks AS (
  SELECT doc_id, mark, min(pos) AS a, max(pos) + n - 1 AS b FROM runs GROUP BY doc_id, mark, n, run HAVING arg_min(w1, pos) + sum(w2) >= {LONG}
), gone AS (
  SELECT DISTINCT doc_id, mark, unnest(range(a, b + 1)) AS pos FROM chunks
), verdict AS (
  SELECT f.*, g.pos IS NOT NULL AS gone FROM facts f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.mark = g.mark AND f.pos = g.pos
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS lines_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM verdict GROUP BY doc_id, mark
"""
