"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions alone.

Every source has a weight and a ramp: its share of the training stream grows or falls linearly over the run. The integral of
that schedule is the source's cumulative demand for words; its inverse turns a document's place in its source's queue of words
into a training position between 0 and 1, and the mix is the documents, sorted by range of that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import WORD, ordered, spread_join, written

WEIGHTS, RAMPS = (5.0, 2.0, 1.0), (-0.5, 0.0, 0.5)


def n_words(text: Column) -> Column:
    """How many words a text has; none if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycled(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, least: float = 0.0) -> DataFrame:
    """sizes (source, size): a row for each source with its words, weight, and target.

    Sources in order of code points, null last, take `weights` in turn. Targets are `share` of all words, split by weight; none
    is over `most` or under `least` times its source's words, and what that leaves or takes is split by weight among the
    others. That is a level L with target = min(max(weight * L, least * size), most * size): its value is found where the
    sum over sources, linear between the sources' own corners, meets the total. Two rows for each source are all that windows
    without a partition see here. rank is a source's place in the order, start the words of the sources before it.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by = ordered(by, [F.col("source").asc_nulls_last()], "source_size").withColumnsRenamed({"_rn": "rank", "_before": "start"})
    by = by.withColumn("weight", _cycled(weights, F.col("rank")))
    corner = lambda k: F.col("source_size") * k / F.col("weight")
    # A source's target rises with the level from its lower corner to its upper one: changes of slope and of constant there.
    low = F.struct(corner(F.lit(float(least))).alias("level"), F.col("weight").alias("slope"), (-F.lit(float(least)) * F.col("source_size")).alias("fixed"))
    high = F.struct(corner(F.lit(float(most))).alias("level"), (-F.col("weight")).alias("slope"), (F.lit(float(most)) * F.col("source_size")).alias("fixed"))
    corners = by.where("source_size > 0").select(F.explode(F.array(low, high)).alias("c")).select("c.*")
    corners = corners.groupBy("level").agg(F.sum("slope").alias("slope"), F.sum("fixed").alias("fixed"))
    total = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"))
    upto = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    corners = corners.select("level", F.sum("slope").over(upto).alias("slope"), F.sum("fixed").over(upto).alias("fixed"), F.lead("level").over(Window.orderBy("level")).alias("next"))
    start = total.withColumn("floor", F.col("words") * float(least))
    held = corners.crossJoin(F.broadcast(start))  # one row beside each corner
    at = (F.col("words") * share - F.col("floor") - F.col("fixed")) / F.col("slope")
    level = held.where(F.col("slope") > 1e-9).select(F.when((at >= F.col("level") - 1e-9) & (at <= F.col("next") + 1e-9), at).alias("at"))
    level = level.agg(F.min("at").alias("at")).crossJoin(total)
    target = F.least(F.greatest(F.col("weight") * F.coalesce("at", F.lit(float("inf"))), F.col("source_size") * float(least)), F.col("source_size") * float(most))
    return by.crossJoin(F.broadcast(level)).withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0)).drop("at", "words")


def position(demand: Column, ramp: Column) -> Column:
    """The training time, 0 to 1, at which a source whose share runs from 1 - ramp to 1 + ramp has used this part of its target.

    The integral of the schedule is x + ramp * (x * x - x); this is its inverse."""
    root = F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * demand)
    return F.when(F.abs(ramp) < 1e-9, demand).otherwise((root - (1 - ramp)) / (2 * ramp)) + 0.0  # no negative zero


def mixture(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, share: float = 1.5, most: int = 2, least: float = 0.0) -> DataFrame:
    """sizes (doc_id, source, size): each row with its source's figures, the words taken in each pass, and their positions.

    A source's documents queue in an order fixed by a hash of doc_id. The source's target is taken from that queue, pass after
    pass, `most` passes at most; the row at which the target is reached is taken in part. taken_by_pass and positions have
    one entry a pass; row is a row's place in all queues. Null doc_ids and repeated rows queue like any other; documents without
    words take none; a null source is a source of its own.
    """
    of = targets(sizes, weights, share, float(most), least)
    docs = sizes.select("doc_id", "source", "size")
    keyed = docs.withColumn("_turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col("source").asc_nulls_last(), F.col("_turn"), F.col("doc_id"), F.col("size")]
    queued = ordered(keyed, order, "size")
    named = lambda df: df.withColumns({"_none": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    both = spread_join(named(queued), named(of).drop("source"), ["_none", "_name"], F.col("_rn"), how="inner")
    goal, place = F.round("target").cast("long"), F.col("_before") - F.col("start")
    first = [place + F.col("source_size") * r for r in range(most)]
    taken = [F.greatest(F.lit(0), F.least(F.col("size"), goal - x)).cast("long") for x in first]
    at = [F.when(t > 0, position(x / F.col("target"), _cycled(ramps, F.col("rank")))) for x, t in zip(first, taken, strict=True)]
    figures = ["doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), F.col("_rn").alias("row")]
    return both.select(*figures, sum(taken[1:], taken[0]).alias("taken"), F.array(*taken).alias("taken_by_pass"), F.array(*at).alias("positions"))


def _takings(mixed: DataFrame) -> DataFrame:
    """A row for each time that the mix takes a document: row, doc_id, source, size, pass, words, position."""
    passes = F.posexplode(F.arrays_zip("taken_by_pass", "positions")).alias("pass", "p")
    each = mixed.select("row", "doc_id", "source", "size", passes).where("p.taken_by_pass > 0")
    return each.select("row", "doc_id", "source", "size", "pass", F.col("p.taken_by_pass").alias("words"), F.col("p.positions").alias("position"))


def curriculum(mixed: DataFrame) -> DataFrame:
    """A row for each time that the mix takes a document, range-sorted by training position: doc_id, source, words, position."""
    each = _takings(mixed).select("doc_id", "source", "words", "position")
    return each.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def scheduled(mixed: DataFrame) -> DataFrame:
    """Every row of a mixture with what the training stream, numbered by range of position, has of it: taken, the words, and how
    often (passes), the first and the last position, and the place of the first one in the stream (null: not taken).

    Equal positions go by doc_id (null first), pass, size and source (null first)."""
    order = [F.col("position"), F.col("doc_id").asc_nulls_first(), F.col("pass"), F.col("size"), F.col("source").asc_nulls_first()]
    stream = ordered(_takings(mixed), order)
    found = stream.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("passes"), F.round(F.min("position"), 9).alias("first_position"), F.round(F.max("position"), 9).alias("last_position"), F.min("_rn").alias("first_place"))
    out = mixed.select("row", "doc_id", "size", "source_size", "target").join(found, "row", "left").drop("row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("taken", "passes")})


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in the mix and its places in the training stream. Repeated rows, null doc_ids, null sources and
    documents without words are rows like any other; the last are never taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return scheduled(mixture(written(docs, "sizes")))


ORACLE = f"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size / [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS corner FROM b),
c AS (SELECT DISTINCT corner FROM w WHERE source_size > 0),
l AS (SELECT c.corner, coalesce(sum(w.weight) FILTER (w.corner >= c.corner), 0) AS slope, coalesce(sum(2.0::DOUBLE * w.source_size) FILTER (w.corner < c.corner), 0) AS fixed
      FROM c, w WHERE w.source_size > 0 GROUP BY c.corner),
m AS (SELECT corner, (1.5::DOUBLE * (SELECT sum(source_size) FROM b) - fixed) / slope AS level FROM l),
v AS (SELECT arg_min(level, corner) FILTER (level <= corner * (1 + 1e-12)) AS level FROM m),
t AS (SELECT source, source_size, k, round(CASE WHEN source_size > 0 THEN least(weight * level, 2.0::DOUBLE * source_size) ELSE 0 END, 6) AS target,
      CASE WHEN source_size > 0 THEN least(weight * level, 2.0::DOUBLE * source_size) ELSE 0 END AS exact FROM w, v),
q AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.exact, [-0.5, 0.0, 0.5][t.k % 3 + 1]::DOUBLE AS ramp, round(t.exact)::BIGINT AS goal,
      row_number() OVER (ORDER BY t.k, md5(coalesce(doc_id::VARCHAR, '')), doc_id, size) AS r,
      (sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, before + source_size * pass AS x, greatest(0, least(size, goal - before - source_size * pass)) AS words FROM q, (SELECT unnest([0, 1])::BIGINT AS pass)),
-- The share of a source at time y is 1 - ramp + 2 * ramp * y of its mean; its integral, inverted.
p AS (SELECT *, x / exact AS d FROM e WHERE words > 0),
y AS (SELECT *, CASE WHEN abs(ramp) < 1e-9 THEN d ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * d) - (1 - ramp)) / (2 * ramp) END + 0.0::DOUBLE AS position FROM p),
n AS (SELECT *, row_number() OVER (ORDER BY position, doc_id NULLS FIRST, pass, size, encode(source) NULLS FIRST) - 1 AS place FROM y),
g AS (SELECT r, sum(words)::BIGINT AS taken, count(*) AS passes, round(min(position), 9) AS first_position, round(max(position), 9) AS last_position, min(place) AS first_place FROM n GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(passes, 0)::BIGINT AS passes, first_position, last_position, first_place FROM q LEFT JOIN g USING (r)
"""
