"""Mixing sources to target weights, by hash-threshold histograms.

Sizes are summed by source and hash bucket; each source's budget falls into one bucket, whose rows alone are summed
again by the next bits of the hash, and after LEVELS such steps by the hash itself. A row is taken if its hash lies
under its source's threshold: budgets are nested (a larger budget of the same source keeps what a smaller one took),
nothing is sorted but at most 2^BITS sums of one source, and no source is gathered in a task. Only DataFrame functions.

Targets: sources in code-point order, null last, weigh WEIGHTS in turn and share `share` times all sizes; none gets
more than `most` times its size, what is over is dealt again by weight. That fixed point is min(most * size, L * weight)
with one level L for all, found by sums over the sources in order of size / weight. One row a source is gathered there.

Each source takes its rows floor(target / size) times whole, and the rest of the target by threshold; the row at the
threshold is taken if that brings the source nearer to its target.

Defined results. Null text has size 0; rows of size 0 are taken 0 words. Rows of one source that agree in id and text
share a hash and are taken together. A null source is a source. Sources without a word have target 0. Extra columns
are ignored by `plan` and returned by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.base import SPACE, materialize

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Hash bits of a histogram, and how many histograms come before the last, by the whole hash.
BITS, LEVELS = 10, 3
HASH_BITS = 60


def row_hash(*columns: str) -> Column:
    """60 bits that SQL engines agree on."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from sizes (source, source_size); one row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = sizes.select("source", "source_size", weight.alias("w"))
    # size / w ascending: the sources that stop at `most` come first
    rising = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    below = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    twice = int(2 * SHARE)
    sums = ranked.select(
        "source", "source_size", "w",
        F.sum("source_size").over(everything).alias("all"), F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("source_size").over(below), F.lit(0)).alias("done"), F.coalesce(F.sum("w").over(below), F.lit(0)).alias("done_w"),
    )
    # twice the level, as a fraction, if all sources before this one stop and this one doesn't
    top, low = F.col("all") * twice - F.col("done") * (2 * MOST), F.col("all_w") - F.col("done_w")
    fits = top * F.col("w") <= F.col("source_size") * (2 * MOST) * low
    chosen = sums.withColumn("top", top).withColumn("low", low)
    level = F.min(F.when(fits, F.struct(F.col("done_w"), F.col("top"), F.col("low")))).over(everything)
    out = chosen.withColumn("level", level)
    share = F.col("level.top") * F.col("w") / (F.col("level.low") * 2.0)
    full = (F.col("source_size") * MOST).cast("double")
    return out.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("done_w") < F.col("level.done_w")), full).otherwise(share).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, most: rows (source, size, h) of a source with h <= most make up its budget (source, budget), as near as can be."""
    now = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    done = None
    for level in range(LEVELS + 1):
        last = level == LEVELS
        shift = 0 if last else HASH_BITS - BITS * (level + 1)
        # `prefix` is the boundary bucket of the level before
        before = HASH_BITS - BITS * level
        inside = rows if level == 0 else rows.join(now.select(F.col("source").alias("s"), F.col("prefix").alias("p")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", before) == F.col("p"))).select("source", "size", "h")
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        known = now.select(F.col("source").alias("s"), "left")
        run = sums.withColumn("upto", upto).join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        # the bucket in which the budget is reached
        cross = run.filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
        cut = cross.groupBy("source").agg(F.min(F.struct("b", "upto", "n", "left")).alias("c"))
        if last:
            nearer = F.col("c.upto") - F.col("c.left") <= F.col("c.left") - (F.col("c.upto") - F.col("c.n"))
            done = cut.select("source", F.when(nearer, F.col("c.b")).otherwise(F.col("c.b") - 1).alias("most"))
        else:
            now = materialize(cut.select("source", (F.col("c.left") - (F.col("c.upto") - F.col("c.n"))).alias("left"), F.col("c.b").alias("prefix")), "bounds")
    return done


def facts_of(sized: DataFrame) -> DataFrame:
    """s, source_size, target, whole, most of every source of sized (source, size, h): one row a source."""
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goal = targets(sizes).withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("long"))
    goal = materialize(goal.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    cuts = thresholds(sized.filter("size > 0").select("source", "size", "h"), goal.filter("budget > 0").select("source", "budget"))
    return materialize(goal.join(cuts.select(F.col("source").alias("s"), "most"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("most", F.lit(-1)).alias("most")), "cuts")


def copies() -> Column:
    """How often a row (h) of a source (whole, most) is taken."""
    return F.col("whole") + F.when((F.col("h") <= F.col("most")) & (F.col("whole") < MOST), 1).otherwise(0)


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source)."""
    sized = materialize(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), row_hash("doc_id", "text").alias("h")), "sized")
    # one row a source: Spark broadcasts it below its own limit, and splits hot partitions beyond
    rows = sized.join(facts_of(sized), F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns kept, as often as the mix takes them."""
    facts = facts_of(materialize(docs.select("source", word_count(F.col("text")).alias("size"), row_hash("doc_id", "text").alias("h")), "sized"))
    # the user's columns travel in one struct, so that no name of theirs can meet one of ours
    rows = docs.select(row_hash("doc_id", "text").alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    taken = rows.join(facts, F.col("row.source").eqNullSafe(F.col("s"))).withColumn("n", copies().cast("int")).filter("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


#: DuckDB's words for plan() over documents.
ORACLE = r"""
with s as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(concat_ws(chr(31), coalesce(doc_id::varchar, chr(1)), coalesce(text, chr(1)))), 1, 15))::bigint as h
  from documents),
z as (select source, sum(size)::bigint as source_size from s group by source),
r as (select *, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w from z),
c as (
  select *, (sum(source_size) over ())::bigint * 3 - coalesce(sum(source_size) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint * 4 as top,
         (sum(w) over ())::bigint - coalesce(sum(w) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as low
  from r),
l as (select top, low from c where top * w <= source_size * 4 * low order by low desc limit 1),
t as (
  select c.source, c.source_size,
         case when l.low is null or c.low > l.low then (c.source_size * 2)::double else l.top * c.w / (l.low * 2.0::double) end as target
  from c left join l on true),
g as (select *, case when source_size > 0 then least(floor(target / source_size), 2) else 0 end::bigint as whole from t),
b as (select *, target - whole * source_size as budget from g),
u as (select source, h, sum(size)::bigint as n from s where size > 0 group by source, h),
v as (select *, (sum(n) over (partition by source order by h))::bigint as upto from u),
x as (select v.source, v.h, v.n, v.upto, b.budget from v join b on v.source is not distinct from b.source where b.budget > 0 and v.upto >= b.budget and v.upto - v.n < b.budget),
m as (select source, case when upto - budget <= budget - (upto - n) then h else h - 1 end as most from x)
select s.doc_id, s.size, b.source_size, b.target,
       (s.size * (b.whole + case when b.whole < 2 and s.h <= coalesce(m.most, -1) then 1 else 0 end))::bigint as taken
from s join b on s.source is not distinct from b.source left join m on s.source is not distinct from m.source
"""
