"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its share of the mix, held to ``most`` times what the
source has; the excess is shared out again by weight. Target over source size is
a document's mean number of copies. The whole part of that is given to every
document with certainty. The words still missing are drawn by Pareto order
sampling without replacement, with probability proportional to size: a
document's inclusion probability is c times its words, where those that would
exceed 1 enter with certainty and c is raised for the rest until the expected
words are the missing ones. A document's rank is the odds of its random number
over its inclusion odds, and the lowest ranks enter until the budget of words is
filled. Long documents (over LONG of their source) are drawn first, so that the
short ones, whose c follows from what is left, can meet the target closely.

No step orders a source in one task: c follows from the counts of documents by
size; ranks are summed in bins, and only the bin that the budget cuts is split
into finer ones, until it has FEW rows or less to be ordered. Only the sources
themselves, a row each, are numbered in one task.

Defined cases: a null text has size 0; a null source is a source of its own,
last; null ids are allowed and hash as empty text; rows of one id and source are
taken or left together; a source without words has target 0
and takes nothing; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.llm.common import cut, n_words

#: Documents over this share of their source's words are drawn first.
LONG = 0.005
#: Bins of each source's ranks, and again of the bin that the budget cuts while it has more than FEW rows, LEVELS times at most.
BINS, FEW, LEVELS = 1024, 50_000, 4
#: The design is broadcast where it has so many sources at most; beyond that it is joined by a shuffle.
MANY = 20_000


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source (columns source, source_size) its weight and target.

    The level at which the capped sources stop is found in closed form: with
    the sources in the order of cap over weight, the first whose cap is not
    below the level of the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    one = sizes.select("source", "source_size", F.get(F.array(*[F.lit(w).cast("long") for w in weights]), at).alias("weight"), F.row_number().over(by_name).alias("nth"))
    everything = Window.partitionBy()
    one = one.withColumns({"total": share * F.sum("source_size").over(everything).cast("double"), "cap": (most * F.col("source_size")).cast("double"), "level": (most * F.col("source_size")).cast("double") / F.col("weight")})
    before = Window.orderBy("level", "nth").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("level", "nth").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    one = one.withColumn("stop", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    one = one.withColumn("level", F.min(F.when(F.col("stop") <= F.col("level"), F.struct("level", "nth", "stop"))).over(everything)["stop"])
    return one.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _random(id_: Column, seed: int) -> Column:
    """A number inside (0, 1) from the id, the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def _last(rows: DataFrame) -> DataFrame:
    """Per source the last (rank, doc_id) that its budget of words takes in rank order; rows: source, size, rank, doc_id, budget.

    A row is taken if the words before it and half of its own lie below the
    budget, so the taken ones are the first ones. Words are summed by bins of
    the rank; only the bin which the budget cuts is looked into.
    """
    rows = rows.withColumns({"ahead": F.lit(0).cast("long"), "x": F.col("rank") / (1 + F.col("rank"))})
    ends = None
    for level in range(1, LEVELS + 1):
        rows = rows.withColumn("bin", F.floor(F.col("x") * BINS**level))
        bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_words"), F.max(F.struct("rank", "doc_id")).alias("end"), F.max("budget").alias("budget"), F.max("ahead").alias("ahead"), F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = cut(bins.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("bin_words").over(before), F.lit(0))))
        full = bins.filter(F.col("ahead") + F.col("bin_words") <= F.col("budget")).groupBy("source").agg(F.max("end").alias("end"))
        ends = full if ends is None else ends.unionByName(full)
        torn = bins.filter((F.col("ahead") < F.col("budget")) & (F.col("ahead") + F.col("bin_words") > F.col("budget"))).select("source", "bin", "ahead", "n")
        rows = _joined(rows.drop("ahead"), torn.select("source", F.col("bin").alias("cut"), "ahead"), "inner").filter(F.col("bin") == F.col("cut")).drop("cut")
        if (torn.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
    order = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    inside = inside.filter(F.col("before") + F.col("size") / 2 < F.col("budget")).groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("end"))
    return ends.unionByName(inside).groupBy("source").agg(F.max("end").alias("end"))


def _scales(counts: DataFrame) -> DataFrame:
    """Per source c, from rows (source, size, n, budget) with n documents of a size.

    The largest sizes are certain; after k of them c is the budget that they
    leave over the rest's sum of squares, and the first k holds for which no
    further size times c is over 1. c is 1 where every document is certain.
    """
    words, squares = F.col("n") * F.col("size"), F.col("n").cast("double") * F.col("size") * F.col("size")
    above = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum(squares).over(Window.partitionBy("source")) - F.coalesce(F.sum(squares).over(above), F.lit(0.0))
    rows = counts.withColumn("c", (F.col("budget") - F.coalesce(F.sum(words).over(above), F.lit(0))) / rest)
    good = F.when(F.col("c") * F.col("size") <= 1, F.struct("size", "c"))
    return rows.groupBy("source").agg(F.greatest(F.lit(0.0), F.coalesce(F.max(good)["c"], F.lit(1.0))).alias("c"))


def _joined(rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """rows with the columns of a table that has one row a source; broadcast only after its count."""
    right = table.withColumnRenamed("source", "__source")
    if table.count() <= MANY:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, source, size, target, source_size, ...) with the certain copies, the words missing and the odds of the random number."""
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).otherwise(0.0)
    rows = rows.withColumns({"whole": F.floor(mean).cast("long"), "part": mean - F.floor(mean), "u": _random(F.col("doc_id"), seed)})
    return rows.withColumns({"missing": F.col("target") - F.col("whole") * F.col("source_size"), "odds": F.col("u") / (1 - F.col("u")), "long": F.col("size") > LONG * F.col("source_size")})


def _rank(c: Column) -> tuple[Column, Column]:
    """Inclusion probability, and the random odds over the inclusion odds; 0 for what is certain."""
    p = F.least(F.lit(1.0), c * F.col("size"))
    return p, F.when(p >= 1, 0.0).otherwise(F.col("odds") / F.greatest(p / (1 - p), F.lit(1e-300)))


def design(base: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """The sampling design, a row a source: source, source_size, target and, for long and short documents, c and the last rank taken."""
    sums = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    rows = _ranked(_joined(base, sums), seed).filter((F.col("part") > 0) & (F.col("size") > 0))
    counts = cut(rows.groupBy("source", "size", "long").agg(F.count(F.lit(1)).alias("n"), F.max("missing").alias("missing")))
    every = counts.groupBy("source", "size").agg(F.sum("n").alias("n"), F.max("missing").alias("budget"))
    # Long documents: 1 / LONG a source at most.
    large = _joined(rows.filter("long"), cut(_scales(every)))
    p, rank = _rank(F.col("c"))
    large = large.withColumns({"p": p, "rank": rank})
    own = Window.partitionBy("source")
    large = large.withColumns({"large_size": F.sum("size").over(own), "expected": F.sum(F.col("p") * F.col("size")).over(own.orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    large = large.withColumn("budget", F.least("missing", F.greatest(F.col("expected"), F.col("missing") - (F.col("source_size") - F.col("large_size")))))
    order = own.orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 < F.col("budget")
    large = large.withColumn("hit", hit).groupBy("source").agg(F.sum(F.when(F.col("hit"), F.col("size")).otherwise(0)).alias("got"), F.max("c").alias("c_large"), F.max(F.when(F.col("hit"), F.struct("rank", "doc_id"))).alias("large_end"))
    plan = sums.alias("a").join(large.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "a.source_size", "a.target", F.coalesce("b.got", F.lit(0)).alias("got"), "b.c_large", "b.large_end")
    plan = cut(plan)
    small = _joined(counts.filter(~F.col("long")), plan.select("source", "got")).withColumn("budget", F.greatest(F.lit(0.0), F.col("missing") - F.col("got")))
    scales = cut(_scales(small))
    small = _joined(small, scales).withColumn("sure", F.when(F.col("c") * F.col("size") >= 1, F.col("n") * F.col("size")).otherwise(0))
    left = cut(small.groupBy("source").agg(F.max("c").alias("c_small"), (F.max("budget") - F.sum("sure")).alias("budget")))
    p, rank = _rank(F.col("c_small"))
    drawn = _joined(rows.filter(~F.col("long")).select("doc_id", "source", "size", "odds"), left).withColumns({"p": p, "rank": rank})
    ends = _last(drawn.filter("p < 1").drop("p", "c_small", "odds"))
    plan = plan.alias("a").join(left.alias("l"), F.col("a.source").eqNullSafe(F.col("l.source")), "left").join(ends.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return cut(plan.select("a.source", "a.source_size", "a.target", "a.c_large", "a.large_end", "l.c_small", F.col("b.end").alias("small_end")))


def _copies(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, source, size, ...) with source_size, target and copies; no shuffle where the sources are few."""
    rows = _ranked(_joined(rows, plan), seed)
    p, rank = _rank(F.when(F.col("long"), F.col("c_large")).otherwise(F.col("c_small")))
    here = F.struct(rank.alias("rank"), F.col("doc_id").alias("doc_id"))
    taken = F.when(F.col("long"), here <= F.col("large_end")).otherwise((p >= 1) | F.coalesce(here <= F.col("small_end"), F.lit(False)))
    hit = F.coalesce((F.col("part") > 0) & (F.col("size") > 0) & taken, F.lit(False))
    return rows.withColumn("copies", F.col("whole") + hit.cast("long")).drop("whole", "part", "missing", "u", "odds", "long", "large_end", "small_end", "c_large", "c_small")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (0 to ``most``), taken."""
    base = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")))
    return _copies(base, design(base, weights, share, most, seed), seed).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """The documents as the mix has them: each row as often as it is taken, columns as they came.

    The design is broadcast to the documents; their texts are not shuffled.
    """
    own = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")]
    base = cut(docs.select(*own))
    rows = _copies(docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), design(base, weights, share, most, seed), seed)
    rows = rows.filter("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("row.*")


#: The mix as SQL, for checks.
ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s0),
s2 AS (SELECT *, CAST(CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight,
  CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS total, CAST(2 * source_size AS DOUBLE) AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS lev FROM s2),
s4 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY lev, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / CAST(sum(weight) OVER (ORDER BY lev, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS stop FROM s3),
s5 AS (SELECT *, (SELECT stop FROM s4 WHERE stop <= lev ORDER BY lev, nth LIMIT 1) AS height FROM s4),
s AS (SELECT source, source_size, least(cap, coalesce(height * weight, cap)) AS target FROM s5),
m AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / CAST(s.source_size AS DOUBLE) ELSE 0 END AS mean,
  (CAST(('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
r AS (SELECT *, floor(mean) AS whole, mean - floor(mean) AS part, u / (1 - u) AS odds, size > CAST(0.005 AS DOUBLE) * source_size AS long, target - floor(mean) * source_size AS missing FROM m),
w AS (SELECT * FROM r WHERE part > 0 AND size > 0),
n0 AS (SELECT source, size, long, CAST(count(*) AS DOUBLE) AS n, max(missing) AS missing FROM w GROUP BY source, size, long),
n1 AS (SELECT source, size, sum(n) AS n, max(missing) AS budget FROM n0 GROUP BY source, size),
c1 AS (SELECT source, size, (budget - coalesce(sum(n * size) OVER o, 0)) / (sum(n * size * size) OVER (PARTITION BY source) - coalesce(sum(n * size * size) OVER o, 0)) AS c
  FROM n1 WINDOW o AS (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k1 AS (SELECT source, greatest(CAST(0 AS DOUBLE), coalesce(max_by(c, size) FILTER (WHERE c * size <= 1), CAST(1 AS DOUBLE))) AS c FROM c1 GROUP BY source),
l0 AS (SELECT w.*, k1.c, least(CAST(1 AS DOUBLE), k1.c * size) AS p FROM w JOIN k1 ON w.source IS NOT DISTINCT FROM k1.source WHERE long),
l1 AS (SELECT *, CASE WHEN p >= 1 THEN CAST(0 AS DOUBLE) ELSE odds / greatest(p / (1 - p), CAST(1e-300 AS DOUBLE)) END AS rank, CAST(sum(size) OVER (PARTITION BY source) AS DOUBLE) AS large_size FROM l0),
l2 AS (SELECT *, sum(p * size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS expected FROM l1),
l3 AS (SELECT *, least(missing, greatest(expected, missing - (source_size - large_size))) AS budget FROM l2),
l AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / CAST(2 AS DOUBLE) < budget AS hit FROM l3),
g AS (SELECT source, CAST(sum(CASE WHEN hit THEN size ELSE 0 END) AS DOUBLE) AS got FROM l GROUP BY source),
n2 AS (SELECT n0.source, size, n, greatest(CAST(0 AS DOUBLE), missing - coalesce(g.got, 0)) AS budget FROM n0 LEFT JOIN g ON n0.source IS NOT DISTINCT FROM g.source WHERE NOT long),
c2 AS (SELECT *, (budget - coalesce(sum(n * size) OVER o, 0)) / (sum(n * size * size) OVER (PARTITION BY source) - coalesce(sum(n * size * size) OVER o, 0)) AS c
  FROM n2 WINDOW o AS (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k2 AS (SELECT source, greatest(CAST(0 AS DOUBLE), coalesce(max_by(c, size) FILTER (WHERE c * size <= 1), CAST(1 AS DOUBLE))) AS c FROM c2 GROUP BY source),
b2 AS (SELECT c2.source, max(k2.c) AS c, max(budget) - sum(CASE WHEN k2.c * size >= 1 THEN n * size ELSE 0 END) AS budget FROM c2 JOIN k2 ON c2.source IS NOT DISTINCT FROM k2.source GROUP BY c2.source),
q0 AS (SELECT w.*, b2.budget, least(CAST(1 AS DOUBLE), b2.c * size) AS p FROM w JOIN b2 ON w.source IS NOT DISTINCT FROM b2.source WHERE NOT long),
q1 AS (SELECT *, odds / greatest(p / (1 - p), CAST(1e-300 AS DOUBLE)) AS rank FROM q0 WHERE p < 1),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / CAST(2 AS DOUBLE) < budget AS hit FROM q1),
h AS (SELECT doc_id, source, size, source_size, target, whole, hit FROM l UNION ALL SELECT doc_id, source, size, source_size, target, whole, hit FROM q
  UNION ALL SELECT doc_id, source, size, source_size, target, whole, TRUE FROM q0 WHERE p >= 1
  UNION ALL SELECT doc_id, source, size, source_size, target, whole, FALSE FROM r WHERE NOT (part > 0 AND size > 0))
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN hit THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM h
"""
