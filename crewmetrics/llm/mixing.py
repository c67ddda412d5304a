"""Mixing sources to target weights: how often each document is taken.

Sizes are aggregated per source, targets are shared out by weight under a cap, and a document is
taken floor(rate) times and once more with probability rate - floor(rate), which a hash of its
doc_id decides. Built-in expressions only.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewmetrics.llm.common import Scratch, n_words

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2
SEED = "mix"


def source_ranks(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``sizes`` (source, source_size) with ``place``: 0, 1, ... by code point, null last.

    Sources are sorted over many tasks; only rows per task and the places where tasks begin are windowed.
    """
    spark = sizes.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last("source")]
    part = F.spark_partition_id().alias("part")
    ranged = scratch.save(sizes.repartitionByRange(n_tasks, *order).select("*", part))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(starts, "part").select(
        "source", "source_size", (F.col("start") + F.col("inside") - 1).alias("place")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: ``share`` times all sizes, shared by weight, at most ``most`` times a source's size.

    The level is the target per unit of weight. Sources whose cap lies below it get their cap, the others
    share the rest at a higher level; that is repeated until no cap lies below. Each step is one
    aggregate over the sources, of which two whole numbers come back.
    """
    scratch = Scratch(sizes.sparkSession)
    ranked = source_ranks(sizes, scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = scratch.save(ranked.select("source", "source_size", weight.cast("long").alias("w")))
    share = Fraction(share)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    over, under = share.numerator * total, 1  # the level as a fraction of whole numbers
    capped_before = None
    while True:
        if capped_before is None:
            capped = F.lit(False)
        else:
            # cap <= w * over / (under * denominator), in whole numbers
            cap = F.col("source_size").cast("decimal(38,0)") * F.lit(most * share.denominator) * F.lit(under)
            capped = cap <= F.col("w").cast("decimal(38,0)") * F.lit(over).cast("decimal(38,0)")
        row = weighed.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0)).alias("w"),
            F.count_if(capped).alias("n"),
        ).first()
        if row.n == capped_before or row.w == 0:
            break
        over, under, capped_before = share.numerator * total - most * share.denominator * row["size"], row["w"], row.n
    level = F.lit(float(over)) / F.lit(float(under * share.denominator))
    target = F.when(capped, F.col("source_size") * F.lit(float(most))).otherwise(F.col("w") * level)
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the seed and the doc_id; a null counts as an empty string."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies of every row of ``docs`` (doc_id, text, source).

    A null text has size 0; a null source is a source of its own, the last; a source without words has
    target 0 and is not taken. Rows with one doc_id fall alike. No documents give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = scratch.save(targets(sizes, **options))
    sized, goals = sized.alias("d"), goals.alias("s")
    rows = sized.join(goals, F.col("d.source").eqNullSafe(F.col("s.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.select("doc_id", "size", "source_size", "target", rate.alias("rate"))
    whole = F.floor("rate")
    copies = whole + (coin(F.col("doc_id")) < F.col("rate") - whole).cast("long")
    return rows.withColumn("copies", copies)


def report(docs: DataFrame, **options) -> DataFrame:
    return mix(docs, **options).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix`` takes it.

    A source's rate is all that a row needs, so rows are joined with the sources, not with each other.
    """
    scratch = Scratch(docs.sparkSession)
    sizes = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    goals = scratch.save(targets(sizes, **options))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    fresh = "goal"
    while fresh in docs.columns:
        fresh += "_"
    goal = goals.select(F.struct("source", rate.alias("rate")).alias(fresh))
    rows = docs.join(goal, docs["source"].eqNullSafe(F.col(f"{fresh}.source")))
    whole = F.floor(f"{fresh}.rate")
    copies = whole + (coin(docs["doc_id"]) < F.col(f"{fresh}.rate") - whole).cast("long")
    return rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias(fresh)).drop(fresh)


ORACLE = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size,
    [3, 1, 2][cast((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as int)] as w
  from d group by source
), t as (
  select cast(sum(source_size) as bigint) as total from s
), o as (
  select *, 4 * source_size / w as r, row_number() over (order by source_size / w, w, source) as k from s
), p as (
  select *, 3 * (select total from t) - 4 * coalesce(sum(source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as over_,
    sum(w) over (order by k rows between current row and unbounded following) as under_ from o
), f as (
  select over_, under_ from p where 4 * source_size * under_ > w * over_ order by k limit 1
), g as (
  select source, source_size, case when under_ is null or 4 * source_size * under_ <= w * over_ then source_size * 2.0::double
    else w * (cast(over_ as double) / cast(under_ * 2 as double)) end as target
  from s left join f on true
), r as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
    cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) / 4503599627370496.0::double as u
  from d join g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target, size * cast(floor(rate) + case when u < rate - floor(rate) then 1 else 0 end as bigint) as taken
from r
"""
