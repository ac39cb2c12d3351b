"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import settle, word_count
from tarnfold.tables import table

#: Targets and copies stop at this many times what there is.
CAP = 3
#: Sources in order of their code points, null last, weigh these, repeating.
WEIGHTS = (1, 2, 3)
#: Hash ranges that a (source, size) group is split into, so that no window holds a hot group in one task.
SPLITS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, offset, place) for rows (source, size).

    Sources in code point order, null last, weigh `weights` in turn and share all sizes. A target stops at `cap`
    times its source's size, and the excess is shared by weight among the others until none is above. The level of
    that water-filling is the largest level that the first k saturated sources can leave, in order of cap * size /
    weight. All windows here run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.select("source", "source_size", turn.alias("place"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight.cast("long"))
    order = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("weight")).asc(), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(order), F.lit(0))
    open_ = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    per = per.withColumn("level", left.cast("double") / open_.cast("double"))
    level = F.max("level").over(whole)
    target = F.least((cap * F.col("source_size")).cast("double"), level * F.col("weight"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.col("place").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return per.select("source", "source_size", target.alias("target"), offset.alias("offset"), "place")


def systematic_mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, splits: int = SPLITS) -> DataFrame:
    """How many copies of each document the mix takes: (doc_id, source, size, source_size, target, copies, taken).

    Every document of a source expects the same copies, target / source_size. The documents of a source stand in
    order of size, then of a hash of the id; along this order the expected copies are summed up, one offset of the
    source is added, and a document is emitted once for each integer that its stretch crosses. Standing by size,
    the emitted documents are spread evenly over the sizes, so that the words taken come within about one document
    of the target. The running sum is a document's rank times a constant; ranks come from counts of (source, size,
    hash range) groups, so no task sees a whole source.

    A null text has size 0, a null source is a source of its own (the last). Documents of size 0 have copies too but
    take no words; a source whose sizes are all 0 has target 0 and no copies. Repeated rows count as separate
    documents; an empty table gives no rows. Columns other than doc_id, text and source are not looked at.
    """
    size = word_count(F.col("text")) if size is None else size
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    split = F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % splits
    sized = settle(docs.select("doc_id", "source", size.cast("long").alias("size"), mark.alias("mark"), split.alias("split")), "mix")
    groups = sized.groupBy("source", "size", "split").agg(F.count("*").alias("n"))
    same_size = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = same_size.select("source", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "size").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    starts = groups.join(starts, same(groups, starts, "source", "size")).select(groups["source"], groups["size"], "split", (F.col("start") + F.col("inner")).alias("first"))
    targets = source_targets(sized, weights, cap)
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ranked = sized.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "split").orderBy("mark", "doc_id")))
    rows = ranked.join(starts, same(ranked, starts, "source", "size", "split")).drop(starts["source"], starts["size"], starts["split"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("first") + F.col("nth") - 1
    copies = F.floor(each * (rank + 1) + F.col("offset")) - F.floor(each * rank + F.col("offset"))
    copies = F.least(copies, F.lit(cap).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, each as many times as it takes it, with the columns of `docs`.

    doc_id must be unique; should it not be, rows of one doc_id get the copies of that doc_id together, shared out by
    the order of their texts' hashes. Other columns may have any name.
    """
    salt = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "source")))
    taken = systematic_mix(docs.select("doc_id", "text", "source"), **options).select(F.col("doc_id").alias("_id"), "copies")
    taken = taken.withColumn("_m", F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("copies")))).where("copies > 0")
    left = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", salt.alias("_n"))
    joined = left.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_m")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = systematic_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


ORACLE = rf"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(cast(doc_id as varchar)) as mark
  from documents),
split_up as (select *, cast(concat('0x', substr(mark, 1, 8)) as bigint) % {SPLITS} as split from sized),
per as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as place from sized group by source),
weighed as (select *, (place - 1) % 3 + 1 as weight from per),
levels as (
  select *, cast(sum(source_size) over () - 3 * coalesce(sum(source_size) over w, 0) as double)
            / cast(sum(weight) over () - coalesce(sum(weight) over w, 0) as double) as level
  from weighed
  window w as (order by 3.0 * cast(source_size as double) / cast(weight as double), place rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, least(cast(3 * source_size as double), max(level) over () * weight) as target,
         cast(concat('0x', substr(md5(concat('offset:', cast(place as varchar))), 1, 8)) as bigint) / 4294967296.0::double as shift
  from levels),
ranked as (
  select *, row_number() over (partition by source order by size, split, mark, doc_id) - 1 as rank from split_up),
crossed as (
  select r.doc_id, r.size, r.source, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0 end as each, r.rank, t.shift
  from ranked r join targets t on r.source is not distinct from t.source),
counted as (
  select *, least(cast(floor(each * (rank + 1) + shift) - floor(each * rank + shift) as bigint), 3) as copies from crossed)
select doc_id, size, source_size, target, copies * size as taken, copies, source from counted
"""
