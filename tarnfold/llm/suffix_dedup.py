"""Removing repeated byte strings: the triggers of prefix-free parsing, and the corpus's suffixes sorted around them.

Adapted: neither a dictionary of all phrases nor a suffix array of the whole parse is made, as both need the phrases of
all texts joined and sorted globally, several times the input in shuffles. A repeated string of LENGTH bytes has a
trigger at one place wherever it stands, so the corpus order is needed only among suffixes that share a trigger, which
are dealt to buckets by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.common import byte_batches, forget, free_names, mix64, powers, settle, small_batches
from tarnfold.tables import table

#: Bytes of a repeated string, of a trigger, and places for a trigger in such a string.
LENGTH, TRIGGER = 50, 16
PLACES = LENGTH - TRIGGER + 1
#: Bits of a place in a block, places handled at once, and triggers that a task sorts about.
PLACE_BITS, BLOCK, TASK_ROWS = 22, 1 << 19, 400_000
#: Bytes of texts that a task handles at once; a longer text is handled alone.
BATCH_BYTES = 10 << 20
_BYTES = mix64(np.arange(301, 557, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def trigger_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the triggers in texts that stand one behind the other up to `ends`, and the triggers' hashes.

    A trigger is a string of TRIGGER bytes whose rolling hash is the least, the leftmost of equals, among the PLACES
    in some string of LENGTH bytes of one text. Every string of LENGTH bytes thus has a trigger, at the same place in
    it wherever it stands; triggers cut the texts into phrases.
    """
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        found, values = [], []
        for lo in range(0, n - LENGTH + 1, BLOCK):
            part = data[lo : lo + BLOCK + LENGTH - 1]
            p, q = powers(len(part) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[part] * p[: len(part)], dtype=np.uint64)])
            h = mix64((sums[TRIGGER:] - sums[:-TRIGGER]) * q[: len(part) - TRIGGER + 1])
            low = np.uint64((1 << PLACE_BITS) - 1)
            v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= PLACES:
                v = np.minimum(v[:-width], v[width:])
                width *= 2
            rest = PLACES - width
            v = np.minimum(v[: len(v) - rest], v[rest:]) if rest else v
            start = np.arange(len(v)) + lo
            inside = ends[np.searchsorted(ends, start, side="right")] - start >= LENGTH
            mark = np.zeros(len(h), bool)
            mark[(v[inside] & low).astype(np.int64)] = True
            at = np.flatnonzero(mark)
            found.append(at + lo)
            values.append(h[at])
        places, first = np.unique(np.concatenate(found), return_index=True)
        return places, np.concatenate(values)[first]


def _texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a column of binary values, and where each begins and ends."""
    values = [x if x is not None else b"" for x in column.to_pylist()]
    ends = np.cumsum([len(x) for x in values], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return np.frombuffer(b"".join(values), np.uint8), starts, ends


def _blobs(bucket: np.ndarray, columns: list[np.ndarray], kind: int) -> list[tuple[int, int, list[bytes]]]:
    """Rows dealt to their buckets, each bucket's as the bytes of its columns."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[part[0]]), kind, [c[part].tobytes() for c in columns]) for part in np.split(order, cuts)]


def _batch(rows: list[tuple[int, int, list[bytes]]], width: int) -> pa.RecordBatch:
    cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())]
    cols += [pa.array([r[2][i] if i < len(r[2]) else None for r in rows], pa.binary()) for i in range(width)]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "kind", *[f"c{i}" for i in range(width)]])


def _spread(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(x.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _column(group: pa.Table, kind: int, name: str, dtype) -> np.ndarray:
    """One column's values of all blobs of a kind."""
    kinds = group.column("kind").to_pylist()
    parts = [np.frombuffer(x, dtype) for k, x in zip(kinds, group.column(name).to_pylist(), strict=True) if k == kind]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _found(keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.Table:
    """Rows dealt to buckets by key: the bytes of the keys and of the columns."""
    rows = _blobs(_spread(keys, buckets), [keys, *columns], 0)
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), **{f"c{i}": pa.array([r[2][i] for r in rows], pa.binary()) for i in range(len(columns) + 1)}})


def _by_key(found: DataFrame, kinds: list) -> DataFrame:
    """(key, c0, ...): for each key in rows of _found() the bytes of its columns, which have the given types."""

    def gather(group: pa.Table) -> pa.Table:
        keys, *columns = (np.concatenate([np.frombuffer(x, d) for x in group.column(f"c{i}").to_pylist()]) for i, d in enumerate([np.int64, *kinds]))
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        parts = np.split(order, cuts)
        return pa.table({"key": pa.array([int(keys[p[0]]) for p in parts], pa.int64()), **{f"c{i}": pa.array([c[p].tobytes() for p in parts], pa.binary()) for i, c in enumerate(columns)}})

    return found.groupBy("bucket").applyInArrow(gather, "key long" + "".join(f", c{i} binary" for i in range(len(kinds))))


def repeated_triggers(texts: DataFrame, buckets: int) -> DataFrame:
    """(key, c0): places, 32-bit, in the text `key` of triggers that another text has too; from rows (tid, data).

    Equal texts have one tid and count as one. A task sends each trigger to the trigger's bucket. One that several
    texts of a batch have is known to be repeated; its places go to buckets by text, and its own bucket only learns
    that it is there. So no bucket gets more rows of one trigger than there are batches and places in one text.
    """

    gathered = max(4, buckets // 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "data", BATCH_BYTES):
            tids = np.array(batch.column("tid").to_pylist(), np.int64)
            pick = np.sort(np.unique(tids, return_index=True)[1])
            batch, tids = batch.take(pa.array(pick)), tids[pick]
            data, starts, ends = _texts(batch.column("data"))
            places, h = trigger_places(data, ends)
            text = np.searchsorted(ends, places, side="right")
            order = np.argsort(h, kind="stable")
            hs, who = h[order], text[order]
            new = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            several = (np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)) if len(first) else np.zeros(0, bool)
            known = np.zeros(len(h), bool)
            known[order] = several[np.cumsum(new) - 1] if len(first) else False
            tid, at = tids[text], (places - starts[text]).astype(np.uint32)
            rows = _blobs(_spread(h[~known], buckets), [h[~known], tid[~known], at[~known]], 0)
            rows += _blobs(_spread(tid[known], buckets), [tid[known], at[known]], 1)
            there = hs[first[several]]
            rows += _blobs(_spread(there, buckets), [there], 2)
            if rows:
                yield _batch(rows, 3)

    def judge(group: pa.Table) -> pa.Table:
        h, tid, at = (_column(group, 0, c, d) for c, d in (("c0", np.uint64), ("c1", np.int64), ("c2", np.uint32)))
        order = np.argsort(h, kind="stable")
        hs, who = h[order], tid[order]
        new = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        if len(first):
            several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
            several |= np.isin(hs[first], _column(group, 2, "c0", np.uint64))
            keep = order[several[np.cumsum(new) - 1]]
        else:
            keep = order
        return _found(np.concatenate([tid[keep], _column(group, 1, "c0", np.int64)]), [np.concatenate([at[keep], _column(group, 1, "c1", np.uint32)])], gathered)

    dealt = texts.select("tid", "data").mapInArrow(deal, "bucket long, kind int, c0 binary, c1 binary, c2 binary")
    return _by_key(dealt.groupBy("bucket").applyInArrow(judge, "bucket long, c0 binary, c1 binary"), [np.uint32])


def _classes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common prefix of each with its predecessor in that order."""
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{strings.shape[1]}").ravel(), kind="stable")
    s = strings[order]
    differs = s[1:] != s[:-1]
    lcp = np.where(differs.any(1), differs.argmax(1), strings.shape[1])
    return order, np.concatenate([[0], lcp])


def covered(doc: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each trigger the span, relative to it, that strings around it cover which stand in a smaller document too.

    `context` has PLACES - 1 bytes before a trigger and LENGTH bytes from it on; `left` and `right` say how many are of
    the text. Only a bucket's part of the corpus order is made: the suffixes that begin at its triggers, so at phrase
    boundaries, are sorted as far as LENGTH bytes, with common prefixes, and what stands before them, read backwards,
    likewise. Cut by common prefixes, the two orders give numbers to the parts of a string before and after its
    trigger, and equal pairs of numbers are equal strings. Empty spans begin at 0 and end at 0.
    """
    n = len(doc)
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return lo, hi
    after, lcp_after = _classes(context[:, PLACES - 1 :])
    before, lcp_before = _classes(context[:, PLACES - 2 :: -1] if PLACES > 1 else context[:, :0])

    def number(order: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(lcp < length)
        return out

    # Triggers that no other row has in common, as far as the shortest part goes, can't be in a repeated string.
    least = number(after, lcp_after, TRIGGER)
    active = np.flatnonzero(np.bincount(least)[least] > 1)
    for a in range(PLACES):
        rows = active[(left[active] >= a) & (right[active] >= LENGTH - a)]
        if not len(rows):
            continue
        key = number(after, lcp_after, LENGTH - a)[rows] * (n + 1)
        if a:
            key += number(before, lcp_before, a)[rows]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        smallest = np.minimum.reduceat(doc[rows][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = rows[order[smallest < doc[rows][order]]]
        hi[hit] = np.where(hi[hit] == lo[hit], LENGTH - a, hi[hit])
        lo[hit] = -a
    return lo, hi


def repeated_spans(texts: DataFrame, buckets: int) -> DataFrame:
    """(key, c0, c1): starts and ends, 64-bit, of covered spans of document `key`; from rows (doc_id, data, places).

    Around every place a task cuts out the context and sends it to its trigger's bucket. Of the rows of a batch with
    one context only that of the smallest document goes there; the others are covered as far as the context goes,
    and their spans go to buckets by document. So a passage that a third of all texts have is a row a batch.
    """
    width, gathered = PLACES - 1 + LENGTH, max(4, buckets // 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "data", BATCH_BYTES // 2):
            docs = np.array(batch.column("doc_id").to_pylist(), np.int64)
            data, starts, ends = _texts(batch.column("data"))
            places = [np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in lists])) for lists in batch.column("places").to_pylist()]
            text = np.repeat(np.arange(len(docs)), [len(x) for x in places])
            at = (np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)) + starts[text]
            padded = np.concatenate([np.zeros(PLACES - 1, np.uint8), data, np.zeros(LENGTH, np.uint8)])
            rows = []
            for lo in range(0, len(at), 1 << 18):
                spot, who = at[lo : lo + (1 << 18)], text[lo : lo + (1 << 18)]
                context = np.lib.stride_tricks.sliding_window_view(padded, width)[spot]
                left = np.minimum(spot - starts[who], PLACES - 1)
                right = np.minimum(ends[who] - spot, LENGTH)
                column = np.arange(width)
                context = np.where((column >= PLACES - 1 - left[:, None]) & (column < PLACES - 1 + right[:, None]), context, 0).astype(np.uint8)
                doc, pos = docs[who], spot - starts[who]
                whole = np.concatenate([context, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
                kinds, group = np.unique(np.ascontiguousarray(whole).view(f"S{width + 2}").ravel(), return_inverse=True)
                best = np.full(len(kinds), np.iinfo(np.int64).max)
                np.minimum.at(best, group, doc)
                later = (doc > best[group]) & (left + right >= LENGTH)
                h = powers(TRIGGER)[0]
                with np.errstate(over="ignore"):
                    sig = mix64((_BYTES[context[:, PLACES - 1 : PLACES - 1 + TRIGGER]] * h).sum(1, dtype=np.uint64))
                keep = ~later
                rows += _blobs(_spread(sig[keep], buckets), [doc[keep], pos[keep], left[keep].astype(np.uint8), right[keep].astype(np.uint8), context[keep]], 0)
                rows += _blobs(_spread(doc[later], buckets), [doc[later], (pos - left)[later], (pos + right)[later]], 1)
                if len(rows) > 256:
                    yield _batch(rows, 5)
                    rows = []
            if rows:
                yield _batch(rows, 5)

    def judge(group: pa.Table) -> pa.Table:
        doc, pos = _column(group, 0, "c0", np.int64), _column(group, 0, "c1", np.int64)
        left, right = _column(group, 0, "c2", np.uint8), _column(group, 0, "c3", np.uint8)
        context = _column(group, 0, "c4", np.uint8).reshape(-1, width)
        lo, hi = covered(doc, context, left, right)
        hit = hi > lo
        known = [_column(group, 1, c, np.int64) for c in ("c0", "c1", "c2")]
        return _found(np.concatenate([doc[hit], known[0]]), [np.concatenate([(pos + lo)[hit], known[1]]), np.concatenate([(pos + hi)[hit], known[2]])], gathered)

    dealt = texts.select("doc_id", "data", "places").mapInArrow(deal, "bucket long, kind int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary")
    return _by_key(dealt.groupBy("bucket").applyInArrow(judge, "bucket long, c0 binary, c1 binary, c2 binary"), [np.int64, np.int64])


def _union(starts: list[bytes] | None, ends: list[bytes] | None) -> np.ndarray:
    """Maximal spans, as rows (start, end), of spans given in parts."""
    if not starts:
        return np.zeros((0, 2), np.int64)
    s, e = (np.concatenate([np.frombuffer(x, np.int64) for x in part]) for part in (starts, ends))
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return np.stack([s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(e) - 1]])]], axis=1)


def spans_to_remove(docs: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, starts, ends, copy): byte spans of each document that a document with a smaller doc_id has too.

    A span is covered by strings of LENGTH bytes that also start in a smaller document, as the texts came in. `copy`
    says that the whole text is that of a smaller document; no spans are listed then. Documents without either are not listed. Null texts and doc_ids are left out.
    """
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("data"))
    ids = settle(docs.select("doc_id", F.md5("data").alias("digest"), F.xxhash64("data").alias("tid"), F.octet_length("data").alias("n")), "ids")
    total = ids.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(total * 2 / (PLACES + 1) / task_rows) + 1)
    marked = docs.withColumn("tid", F.xxhash64("data"))
    found = settle(repeated_triggers(marked.where(F.octet_length("data") >= LENGTH), buckets), "triggers")
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    owners = ids.join(first, "digest").select("doc_id", "tid", (F.col("rep") < F.col("doc_id")).alias("copy"))
    owners = settle(owners.distinct(), "owners")
    per_text = found.select(F.col("key").alias("tid"), F.array("c0").alias("places"))
    wanted = owners.where("not copy").join(per_text, "tid").select("doc_id", "tid", "places")
    spans = settle(repeated_spans(marked.join(wanted, ["doc_id", "tid"]), buckets), "spans")
    forget(docs.sparkSession, found)
    whole = spans.select(F.col("key").alias("doc_id"), F.array("c0").alias("starts"), F.array("c1").alias("ends"))
    return whole.join(owners.groupBy("doc_id").agg(F.max("copy").alias("copy")).where("copy"), "doc_id", "full_outer").select("doc_id", "starts", "ends", F.coalesce("copy", F.lit(False)).alias("copy"))


def without_repeats(docs: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """`docs`, its text without repeated spans, plus n_bytes, n_removed, n_spans, kept_sha256 (all of UTF-8 bytes).

    What is left of a text is decoded again; a cut may fall into a character, whose rest then becomes a replacement
    character in the text, while the digest is of the bytes themselves. A null text is empty; so are texts without
    words. Of rows with one doc_id none is smaller than another, so equal rows keep their texts alike. A null doc_id
    is never cut. Other columns stay, whatever their names; n_bytes, n_removed, n_spans and kept_sha256 are replaced if `docs`
    has them.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256")
    names = docs.columns
    key, *extra = free_names(names, "_id", "starts", "ends", "copy")
    spans = settle(spans_to_remove(docs.select("doc_id", "text"), task_rows), "cuts").toDF(key, *extra)
    joined = docs.join(spans, docs["doc_id"].cast("long") == F.col(key), "left").drop(key)
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for text, starts, ends, copy in zip(*(batch.column(c).to_pylist() for c in ("text", *extra)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = _union(starts, ends)
                if copy and len(data) >= LENGTH:
                    spans = np.array([[0, len(data)]])
                edges = np.concatenate([[0], spans.ravel(), [len(data)]]).reshape(-1, 2).tolist()
                kept = b"".join(data[a:b] for a, b in edges)
                rows.append((text if len(kept) == len(data) else kept.decode("utf-8", "replace"), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            own = [batch.column(c) for c in names]
            own[at] = pa.array(cols[0], pa.string())
            found = [pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*own, *found], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    more = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())]
    return joined.mapInArrow(cut, StructType([*docs.schema.fields, *more]))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
