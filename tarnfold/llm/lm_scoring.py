"""LM scoring: a causal self-attention model over subword ids, trained and run in numpy."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.llm.common import batch_bytes, byte_batches, forget, lean, settle, small_batches, trim_memory
from tarnfold.llm.packing import Ids, default_tokenizer
from tarnfold.llm.shingles import word_hashes
from tarnfold.tables import table

#: Width of the model, classes of ids, rows of the hashed embedding, positions of a window and positions of a window
#: that are only context of the others.
WIDTH, CLASSES, EMBEDDED, WINDOW, OVERLAP = 16, 64, 4096, 32, 8
#: Windows of a step and of a block of its arithmetic; the first id of a text and the end; how many ids there are.
STEP, BLOCK, BEGIN, END, VOCABULARY = 128, 128, 50256, 2, 50257
#: Ids of a logical shard about, rounds in which shards train from the mean of the round before, and weight of an id's
#: share of its class against what followed the class before it.
SHARD_IDS, ROUNDS, PRIOR = 8 << 20, 3, 50.0
#: The most frequent words whose counts are broadcast; all others are joined.
HEAD = 1 << 18
#: Bytes of an Arrow batch and of the texts that are cut at once; hashes of words that a task holds before it counts them.
BATCH, WORDS = 4 << 20, 1 << 20


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def _lines(texts: list[str | None]) -> list[str]:
    """Texts with A-Z lower-cased and one blank before each word."""
    return [(b" " + b" ".join(w)).decode("utf-8", "replace") if (w := (t or "").encode("utf-8", "surrogatepass").lower().split()) else "" for t in texts]


def init(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    shapes = {"e": (EMBEDDED, WIDTH), "p": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "u": (WIDTH, CLASSES)}
    model = {n: (r.standard_normal(s) * (0.3 if n in "ep" else 0.35)).astype(np.float32) for n, s in shapes.items()}
    return model | {"b": np.zeros(CLASSES, np.float32)}


#: What a position may look at, and the bound of logits: they are cut to it, so that no exponential overflows and no
#: largest logit has to be found.
_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_BOUND = np.float32(60.0)
_ONES = np.ones((max(WINDOW, CLASSES), 1), np.float32)


class Room:
    """Arrays that are made once and written again by each step; without a room of their own, calls share nothing."""

    def __init__(self) -> None:
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size, have = math.prod(shape), self.kept.get(name)
        if have is None or have.dtype != kind or have.size < size:
            have = self.kept[name] = np.empty(size, kind)
        return have[:size].reshape(shape)


def _folded(m: dict[str, np.ndarray]) -> np.ndarray:
    """With one head, logits need only the product of queries and keys and outputs only that of values and the last
    matrix: what positions are multiplied by, side by side."""
    return np.concatenate([m["q"] * np.float32(WIDTH**-0.5) @ m["k"].T, m["v"] @ m["o"]], axis=1)


def attended(m: dict[str, np.ndarray], ids: np.ndarray, room: Room, skip: int = 0) -> tuple[np.ndarray, ...]:
    """One masked attention and a residual at the positions of windows (n, WINDOW) from `skip` on: what led to it and,
    last, its output, a row a position."""
    n, kind = len(ids), m["e"].dtype
    x = m["e"].take(ids % EMBEDDED, axis=0, out=room("x", kind, n, WINDOW, WIDTH), mode="clip")
    x += m["p"]
    qv = np.matmul(x.reshape(-1, WIDTH), _folded(m), out=room("qv", kind, n * WINDOW, 2 * WIDTH)).reshape(n, WINDOW, 2 * WIDTH)
    q, v = qv[:, skip:, :WIDTH], qv[..., WIDTH:]
    s = np.matmul(q, x.transpose(0, 2, 1), out=room("s", kind, n, WINDOW - skip, WINDOW))
    np.clip(s, -_BOUND, _BOUND, out=s)
    np.exp(s, out=s)
    s *= _MASK[skip:]
    s /= s @ _ONES[:WINDOW]
    h = np.matmul(s, v, out=room("h", kind, n, WINDOW - skip, WIDTH))
    return x, q, v, s, h, np.add(h, x[:, skip:], out=room("y", kind, *h.shape)).reshape(-1, WIDTH)


def class_scores(m: dict[str, np.ndarray], y: np.ndarray, room: Room) -> np.ndarray:
    """Scores of the next id's class from outputs of the attention."""
    z = np.matmul(y, m["u"], out=room("z", y.dtype, len(y), CLASSES))
    z += m["b"]
    return np.clip(z, -_BOUND, _BOUND, out=z)


def forward(m: dict[str, np.ndarray], ids: np.ndarray, room: Room | None = None) -> tuple[np.ndarray, tuple]:
    """Scores of the next id's class at each position of windows (n, WINDOW), a row a position: one masked attention and
    a residual, whose softmax is the class's probability. Both results lie in `room`."""
    room = room or Room()
    seen = attended(m, ids, room)
    return class_scores(m, seen[-1], room), seen


def gradients(m: dict[str, np.ndarray], ids: np.ndarray, goals: np.ndarray, weight: np.ndarray, room: Room | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log-likelihood over positions of weight 1, within the bound of logits.

    Windows go by blocks that fit the processor's cache, and their gradients are added.
    """
    room = room or Room()
    kind, mean, folded = m["e"].dtype, np.float32(1 / max(1.0, float(weight.sum()))), _folded(m).T
    back = room("back", kind, ids.size, WIDTH)
    g: dict[str, np.ndarray] = {}
    for lo in range(0, len(ids), BLOCK):
        part = slice(lo, lo + BLOCK)
        n = len(ids[part])
        z, (x, q, v, s, h, y) = forward(m, ids[part], room)
        d = np.exp(z, out=z)
        total = (d @ _ONES[:CLASSES]).ravel()
        d.reshape(-1)[np.arange(0, d.size, CLASSES) + goals[part].ravel()] -= total
        share = (weight[part].ravel() * mean / total).astype(kind, copy=False)[:, None]
        y *= share
        got = {"u": y.T @ d, "b": share[:, 0] @ d}
        dx = np.matmul(d, m["u"].T, out=back[lo * WINDOW : (lo + n) * WINDOW])
        dx *= share
        dy = dx.reshape(n, WINDOW, WIDTH)
        ds = np.matmul(dy, v.transpose(0, 2, 1), out=room("ds", kind, n, WINDOW, WINDOW))
        ds -= np.einsum("nid,nid->ni", dy, h)[..., None]
        ds *= s
        dz = room("dz", kind, n, WINDOW, 2 * WIDTH)
        np.matmul(ds, x, out=dz[..., :WIDTH])
        np.matmul(s.transpose(0, 2, 1), dy, out=dz[..., WIDTH:])
        dz = dz.reshape(-1, 2 * WIDTH)
        got["folded"] = x.reshape(-1, WIDTH).T @ dz
        dy += np.matmul(ds.transpose(0, 2, 1), q, out=h)
        dx += np.matmul(dz, folded, out=y)
        got["p"] = dy.sum(0)
        g = {k: g[k] + x for k, x in got.items()} if g else got
    qk, vo = np.split(g.pop("folded"), 2, axis=1)
    g["v"], g["o"] = vo @ m["o"].T, m["v"].T @ vo
    qk = qk * np.float32(WIDTH**-0.5)
    g["q"], g["k"] = qk @ m["k"], qk.T @ m["q"]
    # Each part of each position's gradient goes to its place in the embedding's, all in one count by weights.
    at = room("at", np.dtype(np.int64), ids.size, WIDTH)
    np.add((ids % EMBEDDED * WIDTH).reshape(-1, 1), np.arange(WIDTH), out=at)
    g["e"] = np.bincount(at.ravel(), back.ravel(), EMBEDDED * WIDTH).reshape(m["e"].shape)
    return g


class Adam:
    """A model in training; its sums lie in one vector for all parts of the model and last as long as the task."""

    def __init__(self, m: dict[str, np.ndarray], rate: float = 0.01) -> None:
        self.names, self.rate, self.step = sorted(m), rate, 0
        self.flat = np.concatenate([m[k].ravel() for k in self.names])
        self.ends = np.cumsum([m[k].size for k in self.names])
        self.model = {k: self.flat[end - m[k].size : end].reshape(m[k].shape) for k, end in zip(self.names, self.ends, strict=True)}
        self.one, self.two, self.g, self.by = (np.zeros_like(self.flat) for _ in range(4))
        self.room = Room()

    def learn(self, ids: np.ndarray, goals: np.ndarray, weight: np.ndarray) -> None:
        one, two, g, by = self.one, self.two, self.g, self.by
        for lo in range(0, len(ids), STEP):
            self.step += 1
            part = slice(lo, lo + STEP)
            got = gradients(self.model, ids[part], goals[part], weight[part], self.room)
            for k, end in zip(self.names, self.ends, strict=True):
                g[end - got[k].size : end] = got[k].ravel()
            np.subtract(g, one, out=by)
            by *= 0.1
            one += by
            g *= g
            g -= two
            g *= 0.01
            two += g
            # Both means are corrected for their start by numbers: one factor and a larger or smaller least divisor.
            two_part = math.sqrt(1 - 0.99**self.step)
            np.sqrt(two, out=g)
            g += 1e-8 * two_part
            np.divide(one, g, out=by)
            by *= self.rate * two_part / (1 - 0.9**self.step)
            self.flat -= by


def windows(seqs: list[np.ndarray], overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of sequences that overlap by `overlap`: ids, next ids, 1 where a position is scored (once in all windows), and whose it is."""
    stride = WINDOW - overlap
    lengths = np.array([len(s) + 1 for s in seqs], np.int64)
    edge = np.array([END, BEGIN], np.int32)
    full = np.concatenate([edge[1:], *(part for s in seqs for part in (s, edge))], dtype=np.int32)
    offset = np.cumsum(lengths + 1) - lengths - 1
    count = np.maximum(1, -(-(lengths - overlap) // stride))
    owner = np.repeat(np.arange(len(seqs)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * stride
    left = np.minimum(lengths[owner] - start, WINDOW)
    place = np.arange(WINDOW)
    real = place < left[:, None]
    at = (offset[owner] + start)[:, None] + place
    at *= real
    weight = real.astype(np.float32)
    weight[nth > 0, :overlap] = 0
    ids = full.take(at)
    at += real
    return ids, full.take(at), weight, owner


def class_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id, classes having about equal shares of all counts, and the share of the id in its class."""
    smooth = counts + 0.5
    order = np.argsort(-smooth, kind="stable")
    share = np.cumsum(smooth[order]) / smooth.sum()
    of = np.empty(len(counts), np.int64)
    of[order] = np.minimum(CLASSES - 1, ((share - smooth[order] / smooth.sum() / 2) * CLASSES).astype(np.int64))
    return of, smooth / np.bincount(of, smooth, CLASSES)[of]


def inner_table(pairs: np.ndarray, of: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log10 of the probability of an id in its class behind an id of each class, from counts (class before, id)."""
    out = np.empty((CLASSES, len(of)), np.float32)
    for c in range(CLASSES):
        total = np.bincount(of, pairs[c], CLASSES)[of]
        out[c] = np.log10((pairs[c] + PRIOR * share) / (total + PRIOR))
    return out


_IDS: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    return _IDS.get(path) or _IDS.setdefault(path, Ids(path))


def _sum_vectors(rows: DataFrame) -> np.ndarray | None:
    """The sum of vectors (part long, vector binary) of one fixed length, by a tree of sums of 64 that `part` orders."""

    def add(group: pa.Table) -> pa.Table:
        trim_memory()
        group = group.sort_by("part")
        total = np.zeros(1)
        for x in group.column("vector"):
            one = np.frombuffer(zlib.decompress(x.as_py()), np.float64)
            total = total if len(total) == len(one) else np.zeros(len(one))
            total += one
        out = pa.table({"part": group.column("some")[:1], "vector": pa.array([zlib.compress(total, 1)], pa.binary())})
        del group, total, one
        trim_memory()
        return out

    rows = settle(rows, "vectors", clean=False)
    while (n := rows.agg(F.max("part")).first()[0]) is not None:
        if n < 64:
            got = [np.frombuffer(zlib.decompress(bytes(r["vector"])), np.float64) for r in rows.withColumn("some", F.lit(0).cast("long")).groupBy("some").applyInArrow(add, "part long, vector binary").collect()]
            forget(rows.sparkSession, rows)
            return got[0]
        more = rows.withColumn("some", F.floor(F.col("part") / 64).cast("long")).groupBy("some").applyInArrow(add, "part long, vector binary")
        rows, old = settle(more, "vectors", clean=False), rows
        forget(rows.sparkSession, old)
    return None


def line_ids(cutter: Ids, texts: pa.Array) -> list[bytes]:
    """The ids of each text's line, two bytes each, as the line as a whole has them.

    A word and the blank before it are cut apart from all others, so each distinct word is cut once. Lines with words
    that may not be cut apart are cut as a whole.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().dictionary_encode()
    ids, bounds, apart = cutter.of_words(words.dictionary)
    nth = words.indices.to_numpy(zero_copy_only=False)
    sizes = np.diff(bounds)[nth]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    place = np.repeat((bounds[nth] - ends[:-1]).astype(np.int32), sizes)
    place += np.arange(ends[-1], dtype=np.int32)
    data = ids.astype("<u2").take(place).tobytes()
    word = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    edges = (2 * ends[word]).tolist()
    out = [data[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    for row in np.unique(np.searchsorted(word, np.flatnonzero(~apart[nth]), "right") - 1).tolist():
        out[row] = np.frombuffer(cutter.of(_lines([texts[row].as_py()])[0]), "<u4").astype("<u2").tobytes()
    return out


def cut(docs: DataFrame, path: str) -> DataFrame:
    """`docs` plus ids: the ids of each text, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_batches(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(line_ids(_ids(path), some.column("text")), pa.binary())], names=[*some.schema.names, "ids"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType())]))


def _counted(rows: DataFrame, size: int, codes) -> np.ndarray:
    """How often each number is among codes(ids of a batch of texts, one behind the other with begin and end); a task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(size)
        begin, end = np.array([BEGIN], "<u2").tobytes(), np.array([END], "<u2").tobytes()
        for batch in small_batches(batches, 500):
            whole = np.frombuffer(b"".join(begin + x + end for x in batch.column("ids").to_pylist()), "<u2").astype(np.int64)
            counts += np.bincount(codes(whole), minlength=size)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([zlib.compress(counts, 1)], pa.binary())], names=["part", "vector"])

    got = _sum_vectors(rows.select("ids").mapInArrow(lean(run), "part long, vector binary"))
    return got if got is not None else np.zeros(size)


def id_counts(rows: DataFrame) -> np.ndarray:
    """How often each id is in the texts of `rows` (ids), the end included."""
    counts = _counted(rows, VOCABULARY, lambda whole: whole[whole != BEGIN])
    return counts


def pair_counts(rows: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often each id stands behind one of each class in the texts of `rows` (ids), as a matrix."""

    def codes(whole: np.ndarray) -> np.ndarray:
        inside = whole[1:] != BEGIN
        return of[whole[:-1][inside]] * VOCABULARY + whole[1:][inside]

    return _counted(rows, CLASSES * VOCABULARY, codes).reshape(CLASSES, VOCABULARY)


def model_of(rows: DataFrame, shard_ids: int = SHARD_IDS, rounds: int = ROUNDS) -> dict:
    """The model learned from the texts of `rows` (mark, ids).

    Classes come from counts of ids in all texts, and what an id's class holds from counts behind each class. Texts
    are dealt by `mark`, a hash, to logical shards of about `shard_ids` ids, whatever their number, and to rounds. In
    a round every shard trains, from the mean of the models of the round before, on all windows of its texts; the
    means are weighed by windows. So the model depends on the texts alone, not on partitions. The driver gets a
    model's size, no more.
    """
    counts = id_counts(rows)
    of, share = class_table(counts)
    inner = inner_table(pair_counts(rows, of), of, share)
    shards = max(1, -(-int(counts.sum()) // shard_ids))
    model = init()
    names = sorted(model)
    dealt = rows.select("mark", "ids").withColumn("part", F.pmod(F.xxhash64("mark", F.lit(1)), F.lit(shards)))
    for turn in range(rounds):
        start = model

        def run(group: pa.Table, start=start) -> pa.Table:
            trim_memory()
            adam, n = Adam(start), 0
            for batch in small_batches(group.sort_by([("mark", "ascending"), ("ids", "ascending")]).to_batches(), 256):
                ids, goals, weight, _ = windows([np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column("ids").to_pylist()], 0)
                adam.learn(ids, of[goals], weight)
                n += len(ids)
            flat = np.concatenate([[1.0], *(adam.model[k].ravel() for k in names)]).astype(np.float64) * n
            del adam
            trim_memory()
            return pa.table({"part": group.column("part")[:1], "vector": pa.array([zlib.compress(flat.tobytes(), 1)], pa.binary())})

        some = dealt.where(F.pmod(F.xxhash64("mark", F.lit(2)), F.lit(rounds)) == turn)
        mean = _sum_vectors(some.groupBy("part").applyInArrow(lambda group: run(group), "part long, vector binary"))
        if mean is not None:
            mean, at, model = mean[1:] / mean[0], 0, {}
            for k in names:
                model[k] = mean[at : at + start[k].size].reshape(start[k].shape).astype(np.float32)
                at += start[k].size
    return {"model": model, "of": of, "inner": inner}


def log10_scores(m: dict, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence with its end: the class by attention, the id in it behind the class before.

    Positions that are context only, or behind the end, have no score: nothing is made of them but what others look at.
    """
    ids, goals, weight, owner = windows(seqs)
    out, room, of, inner = np.zeros(len(seqs)), Room(), m["of"], m["inner"].ravel()
    begins = weight[:, 0] > 0
    for skip, some in ((0, np.flatnonzero(begins)), (OVERLAP, np.flatnonzero(~begins))):
        for lo in range(0, len(some), BLOCK):
            part = some[lo : lo + BLOCK]
            here = ids[part]
            at = np.flatnonzero(weight[part, skip:])
            y = attended(m["model"], here, room, skip)[-1]
            z = class_scores(m["model"], y if len(at) == len(y) else y.take(at, axis=0), room)
            before, goal = here[:, skip:].ravel().take(at), goals[part, skip:].ravel().take(at)
            chosen = z.ravel().take(np.arange(0, z.size, CLASSES) + of.take(goal)) - np.log((np.exp(z, out=z) @ _ONES[:CLASSES]).ravel())
            p = chosen * np.float32(0.4342944819032518) + inner.take(of.take(before) * VOCABULARY + goal)
            out += np.bincount(owner[part].take(at // (WINDOW - skip)), p, minlength=len(seqs))
    return out


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c): hashes and counts of all words of the texts of `batches`; a word comes once for each `WORDS` words."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        words, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c, pa.int64())], names=["h", "c"])

    held, n = [], 0
    for batch in small_batches(batches, 256):
        with np.errstate(over="ignore"):
            h, _ = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()])
        held.append(h)
        n += len(h)
        if n >= WORDS:
            yield counted(held)
            held, n = [], 0
    if n:
        yield counted(held)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): hashes and counts of all words of the texts of `docs`."""
    return docs.select("text").mapInArrow(lean(counted_words), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def gains(h: np.ndarray, known: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10(c + 1) and c of each hash, c being its count, 0 if it isn't among the sorted `known`; a hash is searched once."""
    if not len(known):
        return np.zeros(len(h)), np.zeros(len(h), np.int64)
    kinds, which = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(known, kinds), len(known) - 1)
    c = np.where(known[at] == kinds, count[at], 0)
    return np.log10(c + 1.0).take(which), c.take(which)


def scored(docs: DataFrame, tokenizer: str | None = None, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Base counts are of all words of all training texts, by 64-bit hashes. The most frequent words, at most `head`, are
    broadcast; what a text has of the others goes through one join. The model's score is of the text's whole
    sequence of ids in overlapping windows, each position scored once.

    A null or empty text is the end token alone. Without training texts all counts are 0 and the model is as it
    starts. Rows that are equal get equal scores; a null doc_id is not held out. Other columns are not looked at.
    Workers get batches of `BATCH` bytes and give back what a task has freed, as the JVM may fill its heap beside them.
    """
    with batch_bytes(docs.sparkSession, BATCH):
        return _scored(docs, tokenizer, head)


def _scored(docs: DataFrame, tokenizer: str | None, head: int) -> DataFrame:
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    kind = dict(docs.dtypes)["doc_id"]
    mark = F.xxhash64(F.col("doc_id").cast("string"), "text").alias("mark")
    base = settle(cut(docs.select("doc_id", "text", held_out().alias("held_out"), mark), path), "texts")
    train = base.where("not held_out").select("text", "mark", "ids")
    counts = settle(word_counts(train), "words")
    ends = train.count()
    total = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    # The words of the largest counts that are no more than `head` together; a row a count is ordered, never all words.
    kinds = counts.groupBy("c").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy(F.desc("c"))))
    edge = kinds.where(F.col("upto") <= head).agg(F.min("c")).first()[0]
    top = counts.where(F.lit(False) if edge is None else F.col("c") >= edge).toPandas()
    hashes = top["h"].to_numpy(np.int64)
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast({"h": hashes[order], "c": top["c"].to_numpy(np.int64)[order], "lm": model_of(train)})
    floor = np.log10(n + v + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, lm = shared.value["h"], shared.value["c"], shared.value["lm"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.column("text").slice(lo, 256).to_pylist()
                with np.errstate(over="ignore"):
                    h, per = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in part])
                h = h.view(np.int64)
                gain, found = gains(h, known, count)
                hit = found > 0
                text = np.repeat(np.arange(len(part)), per)
                base = np.bincount(text[hit], gain[hit], minlength=len(part)) + np.log10(ends + 1.0)
                seen = np.bincount(text[hit], minlength=len(part)) + (ends > 0)
                scores = log10_scores(lm, [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column("ids").slice(lo, len(part)).to_pylist()])
                rest, where = h[~hit], np.searchsorted(text[~hit], np.arange(len(part) + 1))
                tails = [rest[a:b].tobytes() for a, b in zip(where[:-1], where[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(part)), batch.column("held_out").slice(lo, len(part)), pa.array(per + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(scores), pa.array(tails, pa.binary())], names=["doc_id", "held_out", "n_tokens", "seen", "base", "score", "tail"])

    rows = base.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, n_tokens long, seen long, base double, score double, tail binary")
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    forget(spark, base)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            tails = [np.frombuffer(x, np.int64) for x in batch.column("tail").to_pylist()]
            row = np.repeat(np.array(batch.column("row").to_pylist(), np.int64), [len(x) for x in tails])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate(tails) if tails else [], pa.int64())], names=["row", "h"])

    tail = rows.select("row", "tail").where("length(tail) > 0").mapInArrow(lean(spread), "row long, h long")
    more = tail.join(counts, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("gain"))
    out = rows.drop("tail").join(more, "row", "left")
    whole = F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(floor))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), whole.alias("base_score"), "score")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
