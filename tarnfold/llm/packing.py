"""Packing token pieces into sequences: bounded-space online best fit."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.common import settle
from tarnfold.tables import table

CAPACITY = 1024
END_ID = 2
#: Open sequences that a task holds at most, and pieces that a task packs about.
OPEN_BINS, TASK_PIECES = 64, 100_000

#: The pre-token pattern of byte-level vocabularies, and the bytes that stand for themselves in them; the
#: others stand for themselves plus 256, in order.
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of any kind, and what some programs take for it.
_WHITE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, the same as the tokenizer file gives.

    A byte-level BPE file is run by its merges' ranks, which is several times faster; texts that may hold a special
    token, and all texts of other files, go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        self.path, self.whole, self.core = path, None, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        cut, model = file["pre_tokenizer"] or {}, file["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and file["normalizer"] is None
        rules = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if plain and model["type"] == "BPE" and not any(model.get(x) for x in rules):
            self._rank(model, [t["content"] for t in file["added_tokens"]])
        else:
            self.added = []

    def _rank(self, model: dict, added: list[str]) -> None:
        import tiktoken

        rest = [b for b in range(256) if b not in set(_SELF)]
        sign = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {c: b for b, c in sign.items()}
        ranks = {bytes([b]): b for b in range(256)}
        ids = [model["vocab"][sign[b]] for b in range(256)]
        for merge in model["merges"]:
            token = "".join(merge if isinstance(merge, list) else merge.split(" "))
            if ranks.setdefault(bytes(byte[c] for c in token), len(ranks)) == len(ids):
                ids.append(model["vocab"][token])
        self.ids, self.added = np.array(ids, "<u4"), added
        self.sizes = np.array([len(t) for t in ranks], np.int64)
        self.core = tiktoken.Encoding("ranks", pat_str=_PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def of(self, text: str) -> bytes:
        if self.core is not None and not any(t in text for t in self.added):
            return self.ids[np.frombuffer(self.core.encode_to_tiktoken_buffer(text, set()), np.uint32)].tobytes()
        if self.whole is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, each with a blank before it, where they begin and end, and which words are apart.

        The pre-token pattern goes over a blank only into white space behind it or from white space before it, so words
        without white space of any kind and without special tokens are cut alike whatever stands beside them. Others,
        and empty words, have no ids here; the first are not apart.
        """
        if self.core is None or any(t.split() != [t] for t in self.added):
            return np.zeros(0, "<u4"), np.zeros(len(words) + 1, np.int64), pc.equal(words, "").to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(words, _WHITE)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(words, token))
        some = pc.replace_with_mask(words, odd, pa.scalar("", words.type))
        sizes = pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes += sizes > 0
        some = some.filter(pc.not_equal(some, ""))
        joined = b"".join([b" ", b" ".join(some.cast(pa.binary()).to_numpy(zero_copy_only=False))]).decode() if len(some) else ""
        ranks = np.frombuffer(self.core.encode_to_tiktoken_buffer(joined, set()), np.uint32)
        ends = np.concatenate([[0], np.cumsum(self.sizes[ranks])])
        return self.ids[ranks], np.searchsorted(ends, np.concatenate([[0], np.cumsum(sizes)])), ~odd.to_numpy(zero_copy_only=False)


_IDS: dict[str, Ids] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of every whole text, the end id behind, cut if too long.

    Only documents of more than `capacity` ids are cut; all pieces but the first have `capacity` ids then. A null or
    empty text is one piece, the end id. The file of the tokenizer must be there on every machine.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _IDS.get(path) or _IDS.setdefault(path, Ids(path))
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                data = ids.of(text.as_py() or "") + end
                n = len(data) // 4
                edge = n if n <= capacity else n % capacity or capacity
                begin, k = 0, 0
                while begin < n:
                    rows.append(row)
                    piece.append(k)
                    start.append(begin)
                    length.append(edge - begin)
                    crc.append(zlib.crc32(data[4 * begin : 4 * edge]))
                    begin, edge, k = edge, edge + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(kind=kind))


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given, with `open_bins` bins open at most.

    Open bins stand in stacks by free space; bit f of an integer says whether the stack for free space f has one. A
    piece goes to the bin with the least free space that holds it, the one used last of several. If none does, a bin
    is opened, and when `open_bins` are open already, the fullest closes first. A full bin is closed at once.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = n_open = n_bins = 0
    bins, offsets = [], []
    for length in lengths:
        fit = bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            here = stacks[free].pop()
            if not stacks[free]:
                bits ^= 1 << free
            n_open -= 1
        else:
            if n_open >= open_bins:
                fullest = (bits & -bits).bit_length() - 1
                stacks[fullest].pop()
                if not stacks[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
            free, here = capacity, n_bins
            n_bins += 1
        bins.append(here)
        offsets.append(capacity - free)
        if free := free - length:
            stacks[free].append(here)
            bits |= 1 << free
            n_open += 1
    return bins, offsets


def packed(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """`pieces` of token_pieces() plus sequence_id and offset, in few sequences of at most `capacity` ids.

    Pieces are dealt by hash to lots of about `task_pieces`, whatever their number, so a task's memory is bounded;
    each lot is packed online in hash order, with `open_bins` open, and that is all: about 1 % more sequences than
    the ids need. Lots and orders depend on ids and contents alone, so a task that runs again after a loss gives the
    same rows. Repeated rows are pieces of their own; the order of equal ones is free, as they are alike. A null
    doc_id is an id like another. No rows give none.
    """
    pieces = settle(pieces.withColumn("mark", F.xxhash64("doc_id", "piece", "ids_crc32")), "pieces")
    lots = max(1, -(-pieces.count() // task_pieces))
    kind = dict(pieces.dtypes)["doc_id"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("mark", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(group.column("length").to_pylist(), capacity, open_bins)
        base = group.column("lot")[0].as_py() << 32
        return pa.table({
            **{c: group.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
            "sequence_id": pa.array([base + b for b in bins], pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
        })

    schema = PIECES.format(kind=kind) + ", sequence_id long, offset long"
    return pieces.withColumn("lot", F.pmod(F.xxhash64("mark"), F.lit(lots))).groupBy("lot").applyInArrow(run, schema)


def op2_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(token_pieces(table(spark, sf_dir, "documents")))
