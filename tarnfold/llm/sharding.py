"""Balanced label propagation: linked documents gather in shards of near-equal bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import forget, settle
from tarnfold.tables import table

SHARDS = 24
#: Share of its fair part of all bytes that linked documents may fill in a shard while labels move.
FILL = 0.98
#: Hash ranges for running sums and slots, so that no window holds a whole shard or group.
RANGES = 256


def _ranges(first: Column, second: Column) -> Column:
    """A range of the first hash, cut up by the second: what shares the first stands close together, hot or not."""
    return (F.pmod(first, F.lit(RANGES)) * RANGES + F.pmod(second, F.lit(RANGES))).cast("int")


def _running(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`rows` plus _before: the sum of `value` over rows of the same keys that stand before, by (_range, mark, place)."""
    sums = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*keys, "_range").orderBy("mark", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(sums, [*keys, "_range"]).withColumn("_before", F.col("_start") + F.col("_inner")).drop("_start", "_inner")


def propagate(linked: DataFrame, capacity: float) -> DataFrame:
    """Label propagation over linked rows (place, group, size, mark, shard, _range).

    In a round each group's members vote for shards with their bytes; the group's goal is the shard with most votes
    that has room for a member with fewer (a hash breaks ties). Members in a shard with fewer votes ask to move to the goal, which grants
    requests, group by group in hash order, while a running sum of bytes stays within its quota. A group too large
    for a shard thus fills one shard a round. Rounds end when no request is granted; every move goes where the group has
    more bytes, so the sum of squares of votes grows and the rounds come to an end. Per round: an aggregation to at most one vote a group and shard, an
    equi-join with the votes, and one to the quotas, of which there is one row a shard.
    """
    spark = linked.sparkSession
    while True:
        load = linked.groupBy("shard").agg(F.sum("size").alias("load"))
        votes = linked.groupBy("group", "shard").agg(F.sum("size").alias("weight"), F.min("size").alias("least"))
        rank = F.struct("weight", F.pmod(F.xxhash64("group", "shard"), F.lit(1 << 20)).alias("tie"), "shard")
        votes = votes.join(F.broadcast(load), "shard").select("group", "shard", "load", "least", rank.alias("vote"))
        fewer = Window.partitionBy("group").orderBy("vote").rowsBetween(Window.unboundedPreceding, -1)
        goals = votes.withColumn("least", F.min("least").over(fewer)).where(F.col("load") + F.col("least") <= capacity).groupBy("group").agg(F.max("vote").alias("goal"))
        moves = votes.join(goals, "group").where("vote < goal").select("group", "shard", F.col("goal.shard").alias("to"))
        asks = linked.join(moves, ["group", "shard"]).select("place", "size", "mark", "_range", F.col("to").alias("shard"))
        asks = asks.join(F.broadcast(load), "shard").where(F.col("size") + F.col("load") <= capacity)
        asks = _running(asks, ["shard"], "size")
        granted = asks.where(F.col("_before") + F.col("size") + F.col("load") <= capacity)
        granted = granted.select("place", F.col("shard").alias("to"))
        new = settle(linked.join(granted, "place", "left"), "shards")
        forget(spark, linked)
        linked = new.withColumn("shard", F.coalesce("to", "shard")).drop("to")
        if new.where("to is not null and size > 0").isEmpty():
            return linked


def _filled(rows: DataFrame, rooms: list[float]) -> DataFrame:
    """(place, shard): `rows` put, along one running sum of bytes, into shards that have this room."""
    edges = [sum(rooms[: s + 1]) for s in range(len(rooms))]
    mid = F.col("_before") + F.col("size") / 2
    shard = reduce(lambda rest, s: F.when(mid < edges[s], F.lit(s)).otherwise(rest), reversed(range(len(edges) - 1)), F.lit(len(edges) - 1))
    return _running(rows, ["_key"], "size").select("place", shard.alias("shard"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`docs`, which has doc_id, group and size (bytes), plus shard and slot: near-equal bytes, few links cut.

    Documents of one `group` value are linked; a group is a hub that its members vote through, so a group of n
    documents counts n links, never n squared. Linked documents start in a shard by hash and move by propagate();
    what then lies above a shard's fair part is taken out again. Documents without links and those taken out fill
    the shards up along running sums of bytes, the large ones first, so that sizes differ by about one small
    document. Slots count 0, 1, 2 ...
    in each shard, in order of a hash.

    A null group is a group like another. Repeated rows are separate documents with slots of their own; an empty
    table gives no rows. A group larger than a shard is cut. Columns shard and slot are replaced if `docs` has them;
    others stay, whatever their names.
    """
    spark = docs.sparkSession
    row = F.struct(*[c for c in docs.columns if c.lower() not in ("shard", "slot")]).alias("_row")
    base = docs.select(row, "doc_id", "group", "size", F.monotonically_increasing_id().alias("place"), F.xxhash64("doc_id", "group").alias("mark"))
    base = settle(base, "shards")
    total = base.agg(F.sum("size")).first()[0]
    if total is None:
        return base.select("_row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    fair = total / shards
    group = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("")).alias("group")
    grouped = base.select("place", group, "size", "mark")
    several = grouped.groupBy("group").agg(F.count("*").alias("_n")).where("_n > 1").select("group")
    start = F.pmod(F.xxhash64("mark", F.lit(1)), F.lit(shards)).cast("int")
    kin = F.xxhash64("group", F.lit(2))
    linked = grouped.join(several, "group", "left_semi")
    linked = linked.select("place", "group", "size", "mark", start.alias("shard"), _ranges(kin, F.col("mark")).alias("_range"))
    linked = propagate(settle(linked, "shards"), fair * FILL)
    ranked = _running(linked, ["shard"], "size")
    held = settle(ranked.where(F.col("_before") + F.col("size") <= fair).select("place", "shard", "size"), "held")
    free = base.select("place", "size", "mark").join(held.select("place"), "place", "left_anti")
    free = settle(free.withColumn("_key", F.lit(0)).withColumn("_range", _ranges(F.col("mark"), F.xxhash64("mark"))), "free")
    small = F.col("size") < (free.agg(F.avg("size")).first()[0] or 0)
    sharded = held.select("place", "shard")
    for some, share in ((free.where(~small), None), (free.where(small), 1.0)):
        loads = {r["shard"]: r["load"] for r in base.join(sharded, "place").groupBy("shard").agg(F.sum("size").alias("load")).collect()}
        room = [max(0.0, fair - loads.get(s, 0)) for s in range(shards)]
        share = share or (some.agg(F.sum("size")).first()[0] or 0) / max(1.0, sum(room))
        sharded = settle(sharded.unionByName(_filled(some, [share * x for x in room])), "sharded")
    rows = base.join(sharded, "place").withColumn("_range", _ranges(F.col("mark"), F.xxhash64("mark")))
    rows = _running(rows.withColumn("_one", F.lit(1).cast("long")), ["shard"], "_one")
    return rows.select("_row.*", "shard", F.col("_before").cast("long").alias("slot"))


def op8_shard_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(F.encode("text", "UTF-8")).alias("group"))
    out = balanced_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
