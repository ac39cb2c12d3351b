"""Word shingles of texts as 64-bit hashes, computed over whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tarnfold.llm.common import mix64, powers

#: ASCII white space; every other byte belongs to a word.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Scrambled values of the 256 bytes, so that the rolling hash of a word isn't a polynomial in small numbers.
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLOCK = 1 << 20


def _blocks(data: bytes) -> Iterator[bytes]:
    """`data` in parts of about 1 MB, cut at spaces."""
    at = 0
    while at < len(data):
        end = at + _BLOCK
        end = len(data) if end >= len(data) else (data.find(b" ", end) + 1 or len(data))
        yield data[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z lower-cased, one text after the other, and the number in each text.

    A hash is the difference of two prefix sums of a rolling polynomial, moved back to the word's start.
    """
    joined = b"\n\0\n".join(texts).lower() if texts else b""
    # A word of one zero byte stands between texts; it is told from one in a text by its place.
    hashes, marks = [], []
    edges = np.cumsum([len(t) + 3 for t in texts]) - 2 if texts else np.zeros(0, np.int64)
    at = 0
    for block in _blocks(joined):
        a = np.frombuffer(block, np.uint8)
        inside = np.concatenate([[False], ~_SPACE[a], [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turns[::2], turns[1::2]
        p, q = powers(len(a) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[a] * p[: len(a)], dtype=np.uint64)])
        hashes.append(mix64((sums[end] - sums[start]) * q[start]))
        marks.append(start + at)
        at += len(block)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h, place = np.concatenate(hashes), np.concatenate(marks)
    between = np.searchsorted(place, edges[:-1])
    keep = np.ones(len(h), bool)
    keep[between] = False
    bounds = np.concatenate([[0], between - np.arange(len(between)), [keep.sum()]])
    return h[keep], np.diff(bounds)


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than `words` are one shingle, none is none."""
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for lo, hi in _groups(texts):
            h, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]])
            factors, _ = powers(words + 1)
            rolled = np.zeros(len(h), np.uint64)
            for j in range(words):
                rolled[: max(0, len(h) - j)] += h[j:] * factors[j + 1]
            rolled = mix64(rolled + np.uint64(words))
            at = 0
            for n in counts.tolist():
                if n >= words:
                    some = np.sort(rolled[at : at + n - words + 1])
                    out.append(some[np.concatenate([[True], some[1:] != some[:-1]])])
                elif n:
                    out.append(mix64((h[at : at + n] * factors[1 : n + 1]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
                else:
                    out.append(np.zeros(0, np.uint64))
                at += n
    return out


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= 4 * _BLOCK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def set_id(h: np.ndarray) -> tuple[int, int]:
    """A fingerprint of a set of hashes, whatever their order, as two signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        mixed = mix64(h ^ np.uint64(0x632BE59BD9B4E019))
        sums = [mixed.sum(dtype=np.uint64), (mixed * mixed).sum(dtype=np.uint64)]
        one, two = mix64(np.array(sums, np.uint64) + np.uint64(len(h))).view(np.int64).tolist()
    return one, two


def parity_bits(h: np.ndarray) -> bytes:
    """A bitmap of a set: bit i is the parity of its hashes that are i modulo the size, the least power of two from 2n and 64."""
    size = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def difference_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements that only one of two sets has, from their bitmaps.

    The longer bitmap is folded to the other's size; each differing bit needs a differing element.
    """
    least = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, least) ^ folded(b, least)).sum())


def folded(bits: bytes, most: int) -> np.ndarray:
    """The bitmap of the same set in at most `most` bytes, a power of two."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > most:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x
