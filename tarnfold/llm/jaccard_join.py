"""N-gram Jaccard join with token-combination prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import components, forget, mix64, settle, small_batches, trim_memory
from tarnfold.llm.shingles import difference_at_least, folded, parity_bits, set_id, shingle_sets
from tarnfold.tables import table

WORDS = 5
#: Bits of a hash that pick a cell of the frequency sketch, and cells in one of its blocks. The sketch, 2**BITS
#: counters, becomes the only thing that is broadcast, a byte a cell; its size never changes.
BITS, CELLS = 23, 1 << 16
#: Frequent shingles of a band fall into about set size / SPREAD classes.
SPREAD = 16
#: Groups up to this size are compared whole in one round; larger ones by a growing number of hubs.
SMALL = 6
#: Hubs of a group in the first round, and how many times as many each round has.
HUBS, GROWTH = 8, 32
#: Bytes of the bitmaps that groups are compared by, members of a block on the average, pairs and members looked at at
#: once (a pair takes about 1.6 KB, in each Python worker of an executor), and signatures that a set brings to a meeting
#: so that a pair is reported in the first of the groups that it shares.
BRIEF, BLOCK, AT_ONCE, MEMBERS, FIRST = 256, 64, 1 << 14, 1 << 13, 32


def linked(inter: int, a: int, b: int) -> bool:
    """100 * intersection >= 75 * union, in whole numbers."""
    return inter > 0 and 7 * inter >= 3 * (a + b)


def profiles(docs: DataFrame) -> DataFrame:
    """One pass over all texts: rows (doc_id, n, node, more, bitmap, brief), and the sketch's rows (block, part, counts).

    `node` and `more` are the fingerprint of the shingle set, null if it is empty; `brief` is the bitmap folded to
    BRIEF bytes. The sketch counts, over all sets that a task meets, those with a shingle in each cell; a task emits
    it once, in blocks, with a null doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, seen = np.zeros(1 << BITS, np.uint32), set()
        names = ["doc_id", "n", "node", "more", "bitmap", "brief", "block", "part", "counts"]

        def rows(ids: pa.Array, n: list, node: list, bits: list, block: list, part: list, blobs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *(pa.array([x and x[i] for x in node], pa.int64()) for i in (0, 1)), pa.array(bits, pa.binary()), pa.array([b and folded(b, BRIEF).tobytes() for b in bits], pa.binary()), pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], names=names)

        for batch in small_batches(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), WORDS)
            nodes = [set_id(s) if len(s) else None for s in sets]
            for s, node in zip(sets, nodes, strict=True):
                if node is not None and node not in seen:
                    seen.add(node)
                    counts[(s >> np.uint64(64 - BITS)).astype(np.int64)] += 1
            none = [None] * len(sets)
            yield rows(batch.column("doc_id").cast(pa.int64()), [len(s) for s in sets], nodes, [parity_bits(s) if len(s) else None for s in sets], none, none, none)
        if seen:
            blocks = range(len(counts) // CELLS)
            none = [None] * len(blocks)
            blobs = [zlib.compress(counts[b * CELLS : (b + 1) * CELLS].tobytes(), 1) for b in blocks]
            yield rows(pa.array(none, pa.int64()), none, none, none, list(blocks), [TaskContext.get().partitionId()] * len(blocks), blobs)
        del counts, seen
        trim_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, more long, bitmap binary, brief binary, block int, part int, counts binary")


def frequency_classes(sketch: DataFrame) -> np.ndarray:
    """Class of each cell: 0 is rare; above, the cell stands out of the mean by powers of two.

    Blocks are added up in two levels, so no task adds more than about the square root of what the tasks emitted.
    Classes only order shingles; whatever they are, the join's result is the same.
    """

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.uint64)
        for x in rows.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32 if rows.column("wide")[0].as_py() == 0 else np.uint64)
        return pa.table({"block": rows.column("block")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    first = sketch.withColumn("some", F.floor(F.col("part") / 64)).withColumn("wide", F.lit(0)).groupBy("block", "some").applyInArrow(add, "block int, counts binary")
    rows = first.withColumn("wide", F.lit(1)).groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    counts = np.zeros(1 << BITS, np.float32)
    for r in rows:
        counts[r["block"] * CELLS : (r["block"] + 1) * CELLS] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint64)
    usual = float(np.median(counts[::64]))
    classes = np.zeros(1 << BITS, np.uint8)
    for lo in range(0, len(counts), CELLS):
        excess = counts[lo : lo + CELLS] - usual - 3 * np.sqrt(usual + 1)
        classes[lo : lo + CELLS] = np.where(excess > 0, np.minimum(30, 1 + np.floor(np.log2(np.maximum(excess, 1)))), 0)
    return classes


def signatures(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Signatures of a set such that two sets that link share one.

    Shingles stand in one order for all sets: rare before frequent, then by hash. A set of n shingles misses at most
    m = n // 4 of its shingles in a partner. Its prefix must hold more evidence than m: a rare shingle counts one and
    is a signature itself. If the rare ones don't suffice, the prefix is extended into the frequent ones, which fall
    into classes by hash; a class with k of them in the prefix counts k - 1, and each pair of them is a signature.
    Were no signature shared, each counted piece of evidence would be a miss. The number of classes depends on the
    sets' size band; a set takes part in every band that a partner can be in, so partners share one.
    """
    n = len(h)
    rank = classes[(h >> np.uint64(64 - BITS)).astype(np.int64)]
    h = h[np.argsort(rank, kind="stable")]
    rare = int((rank == 0).sum())
    need = n // 4 + 1
    if rare >= need:
        return h[:need]
    out = [h[:rare]]
    frequent = h[rare:]
    for band in range((max(1, -(-3 * n // 4))).bit_length() - 1, (4 * n // 3).bit_length()):
        spread = max(1, (1 << band) // SPREAD)
        part = (mix64(frequent + np.uint64(band)) % np.uint64(spread)).astype(np.int64)
        first = np.zeros(len(part), bool)
        first[np.unique(part, return_index=True)[1]] = True
        evidence = np.cumsum(~first)
        k = int(np.searchsorted(evidence, need - rare)) + 1
        order = np.argsort(part[:k], kind="stable")
        part, member = part[:k][order], frequent[:k][order]
        for d in range(1, k):
            same = np.flatnonzero(part[d:] == part[:-d])
            if not len(same):
                break
            out.append(mix64(member[same] * np.uint64(0xD6E8FEB86659FD93) + mix64(member[same + d] + np.uint64(band))))
    return np.concatenate(out)


def index_rows(docs: DataFrame, classes) -> DataFrame:
    """(sig, node) of every set of more than one shingle; a task emits a set once, so copies cost next to nothing.

    The first half of the fingerprint will do here: a set that shares it with another is in the other's groups too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in small_batches(batches):
            sigs, nodes = [], []
            for s in shingle_sets(batch.column("text").to_pylist(), WORDS):
                if len(s) < 2 or (node := set_id(s)) in seen:
                    continue
                seen.add(node)
                sigs.append(signatures(s, classes.value))
                nodes.append(np.full(len(sigs[-1]), node[0], np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])
        seen.clear()
        trim_memory()

    return docs.select("text").mapInArrow(run, "sig long, node long")


def _blocks(rows: DataFrame, size: str, name: str) -> DataFrame:
    """Rows (sig, rep, label, n, brief, sigs) as arrays `name`, of about BLOCK rows each whatever the group's size, by (sig, chunk)."""
    chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.expr(size) / BLOCK).cast("long"))
    return rows.withColumn("chunk", chunk).groupBy("sig", "chunk").agg(F.collect_list(F.struct("rep", "label", "n", "brief", "sigs")).alias(name)).drop("chunk")


def _first_sigs(rows: DataFrame) -> DataFrame:
    """(rep, sigs): the least FIRST signatures of each set of rows (sig, rep), in order."""
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("sig"))
    few = rows.select("rep", "sig", nth.alias("nth")).where(F.col("nth") <= FIRST)
    return few.groupBy("rep").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))


def _entries(column: pa.Array) -> tuple:
    """Of a column of blocks: where each begins, its length, and ids, labels, sizes, bitmap lengths, bitmaps and signatures of all members.

    The bitmaps are matrices by length, in which a longer bitmap stands folded to half its length. Signatures are a
    matrix whose rows end in the largest number.
    """
    flat, lengths = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rep, label, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    bits = flat.field(3).to_pylist()
    wide = np.array([len(b) for b in bits], np.int64)
    tables = {}
    for size in np.unique(wide).tolist():
        at = np.flatnonzero(wide == size)
        rows = np.frombuffer(b"".join(bits[i] for i in at.tolist()), np.uint8).reshape(len(at), size)
        for part, of in ((rows, size), (rows[:, : size // 2] ^ rows[:, size // 2 :], size // 2)):
            if of >= 8:
                tables.setdefault(of, np.zeros((len(bits), of // 8), np.uint64))[at] = np.ascontiguousarray(part).view(np.uint64)
    lists = flat.field(4)
    count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    sigs = np.full((len(bits), FIRST), np.iinfo(np.int64).max)
    sigs[np.arange(FIRST) < count[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.cumsum(lengths) - lengths, lengths, rep, label, n, wide, tables, sigs


def _sooner(x: np.ndarray, y: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Of pairs of rows of signatures, whether both lists have one smaller than `sig`: the pair meets there."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < sig[:, None])).any(axis=1)


def _close_pairs(sig: np.ndarray, many: pa.Array, hubs: pa.Array) -> np.ndarray:
    """Of each row, the pairs (a, b) of a member and a hub with different labels whose sizes and bitmaps let them link.

    A pair that meets in a group of a smaller signature as well is left to that one.
    """
    start, p, rep, label, n, wide, bits, lists = _entries(many)
    first, q, hub, other, m, broad, marks, turns = _entries(hubs)
    work, found, lo = np.cumsum(p * q), [np.zeros((0, 2), np.int64)], 0
    while lo < len(p):
        done = work[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(work, done + AT_ONCE, "right")))
        row = np.repeat(np.arange(lo, hi), (p * q)[lo:hi])
        within = np.arange(len(row)) - (work[row] - (p * q)[row] - done)
        i, j = start[row] + within // q[row], first[row] + within % q[row]
        keep = (label[i] != other[j]) & (4 * np.minimum(n[i], m[j]) >= 3 * np.maximum(n[i], m[j]))
        i, j, row = i[keep], j[keep], row[keep]
        least = np.minimum(wide[i], broad[j])
        for size in np.unique(least).tolist():
            at = np.flatnonzero(least == size)
            x, y = i[at], j[at]
            differ = np.bitwise_count(bits[size][x] ^ marks[size][y]).sum(axis=1, dtype=np.int64)
            near = 7 * ((n[x] + m[y] - differ) // 2) >= 3 * (n[x] + m[y])
            x, y, s = x[near], y[near], sig[row[at[near]]]
            new = ~_sooner(lists[x], turns[y], s)
            x, y = rep[x[new]], hub[y[new]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        lo = hi
    return np.unique(np.concatenate(found), axis=0)


def _member_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows of blocks cut into slices of about MEMBERS members, or of one row that has more."""
    for batch in batches:
        ends = np.cumsum(sum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("many", "hubs")))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MEMBERS, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _meetings(open_: DataFrame, hubs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set of `open_` (sig, rep, n, label, size) and one of `hubs` (sig, rep, turns) of its group that may link.

    Both sides meet block by block. Pairs that sizes or bitmaps rule out, and those that meet elsewhere too, are never
    made into rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        for batch in _member_batches(batches):
            pairs = _close_pairs(batch.column("sig").to_numpy(), batch.column("many"), batch.column("hubs"))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        trim_memory()

    met = open_.join(hubs.select("sig").distinct(), "sig", "left_semi")
    met = met.join(nodes.select("rep", "brief"), "rep").join(_first_sigs(met), "rep")
    turns = hubs.join(nodes.select("rep", "brief"), "rep").join(_first_sigs(hubs), "rep")
    return _blocks(met, "size", "many").join(_blocks(turns, "turns", "hubs"), "sig").select("sig", "many", "hubs").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives that link: bounds from sizes and bitmaps first, then the whole texts' sets."""
    one = lambda c: nodes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"bits{c}"))
    rows = pairs.distinct().join(one("a"), "a").join(one("b"), "b").where((4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "bitsa", "bitsb"))
            keep = [i for i in range(len(a)) if linked((na[i] + nb[i] - difference_at_least(x[i], y[i])) // 2, na[i], nb[i])]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            x = shingle_sets(batch.column("ta").to_pylist(), WORDS)
            y = shingle_sets(batch.column("tb").to_pylist(), WORDS)
            keep = [i for i in range(len(a)) if linked(len(np.intersect1d(x[i], y[i], assume_unique=True)), len(x[i]), len(y[i]))]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    close = settle(rows.mapInArrow(bound, "a long, b long"), "close")
    whole = close.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    links = settle(whole.mapInArrow(exact, "a long, b long"), "links")
    forget(pairs.sparkSession, close)
    return links


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: sets of five-word shingles that are similar to 0.75 link.

    Sets are equal for copies, so all work after the first pass is on distinct sets, each standing for the smallest
    doc_id that has it. Signatures that several sets share form groups; groups with the same members are one. Each
    set is compared with the smallest one of all its groups; links join components. While a group's sets are in
    several components, its sets outside the largest are hubs in turn, all at once in small groups, GROWTH times as
    many each round in large ones, each in as many times more of its groups, and are compared
    with the sets in other components, until no group has a pair that is neither compared nor joined. Members and
    hubs of a group meet in blocks of bounded size, and only pairs that may link become rows, in the first group that
    they share. So no link between components is lost, and a group of n similar copies costs about n comparisons.
    Comparison bounds the overlap by sizes and bitmaps and then intersects the whole sets. A very long text is one set
    like another; its signatures are about a quarter of its words.

    Null or empty texts, and texts without a word, have 0 shingles and are components of their own. Rows of one
    doc_id that have several texts are linked by each. A null doc_id has a null component unless its text is linked.
    No rows give no rows. doc_id must be a whole number; other columns are not looked at.
    """
    spark = docs.sparkSession
    pass_one = settle(profiles(docs), "profiles")
    classes = spark.sparkContext.broadcast(frequency_classes(pass_one.where("block is not null").select("block", "part", "counts")))
    rows = pass_one.where("block is null").select("doc_id", "n", "node", "more", "bitmap", "brief")
    best = F.min(F.struct("doc_id", "n", "bitmap", "brief"))
    nodes = rows.where("node is not null and doc_id is not null").groupBy("node", "more").agg(best.alias("x"))
    nodes = settle(nodes.select("node", "more", F.col("x.doc_id").alias("rep"), "x.n", "x.bitmap", "x.brief"), "nodes")
    index = index_rows(docs, classes).repartition("sig")  # both uses read the one exchange
    groups = index.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("sig")
    members = index.join(groups, "sig").join(nodes.select("node", "rep"), "node").select("sig", "rep").distinct()
    all_members = settle(members, "members")
    prints = all_members.groupBy("sig").agg(F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("print"), F.min("rep").alias("hub"))
    groups = settle(prints.where("size > 1").groupBy("size", "print", "hub").agg(F.min("sig").alias("sig")), "groups")
    sizes = nodes.select("rep", "n")
    members = settle(all_members.join(groups.select("sig", "hub"), "sig").join(sizes, "rep"), "members")
    forget(spark, all_members, groups)
    wanted = members.select("rep").distinct()
    # A doc_id with several texts: the text whose set stands for the id can't be told here; all are compared.
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep")
    texts = settle(texts.distinct(), "texts")
    near = "4 * least(n, m) >= 3 * greatest(n, m)"
    first = members.join(sizes.select(F.col("rep").alias("hub"), F.col("n").alias("m")), "hub").where(f"hub < rep and {near}")
    found = _verify(first.groupBy(F.col("rep").alias("b")).agg(F.min("hub").alias("a")), nodes, texts)
    several = rows.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.countDistinct("node", "more").alias("k")).where("k > 1").select("doc_id")
    same = rows.join(several, "doc_id", "left_semi").join(nodes.select("node", "more", "rep"), ["node", "more"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = settle(found.unionByName(same), "links", clean=False)
    done, left, hubs = [found, members], members.select("sig", "rep", "n"), HUBS
    while True:
        label = components(links)
        member = left.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("sig", "rep", "n", F.coalesce("component", "rep").alias("label"))
        counts = member.groupBy("sig", "label").agg(F.count("*").alias("k"))
        broken = counts.groupBy("sig").agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
        open_ = settle(member.join(broken.select("sig", "size", F.col("most.label").alias("largest")), "sig"), "open")
        forget(spark, *done)
        if open_.isEmpty():
            break
        # About `hubs` sets of a group, by a hash that changes from round to round; all of a small one.
        turn = F.pmod(F.xxhash64("rep", "sig", F.lit(hubs)), F.col("size"))
        some = open_.where("label <> largest").where((F.col("size") <= SMALL) | (turn < hubs))
        # A set takes part in a few groups a round: once it is linked, its other groups need no comparison.
        some = some.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("sig"))).where(F.col("nth") <= hubs)
        turns = F.least("size", F.lit(hubs))
        some = settle(some.select("sig", "rep", "n", "label", turns.alias("turns")), "hubs", clean=False)
        found = _verify(_meetings(open_, some, nodes), nodes, texts)
        more = settle(links.unionByName(found), "links", clean=False)
        forget(spark, links, found, label)
        left = open_.select("sig", "rep", "n").join(some.select("sig", "rep"), ["sig", "rep"], "left_anti")
        links, done = more, [open_, some]
        hubs *= GROWTH
    forget(spark, texts, links, open_)
    found = nodes.select("node", "more", "rep").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", "more", F.coalesce("component", "rep").alias("found"))
    return rows.select("doc_id", "n", "node", "more").join(found, ["node", "more"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from docs where len(w) > 0))),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as other from docs union select r.doc_id, b.y from reach r join both_ways b on b.x = r.other)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id
from docs d left join sizes s on s.doc_id = d.doc_id join (select doc_id, min(other) as component_id from reach group by doc_id) r on r.doc_id = d.doc_id
"""
