"""The pipeline on a small odd table: each stage against a brute-force version of itself, on its own input."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tarnfold.llm import langid, packing
from tarnfold.llm.common import trim_memory

SYLLABLES = {"en": "the and ing tion er st".split(), "fr": "que eux ment ai ou ê".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(70):
        lang = ("en", "fr")[i % 2]
        rows.append([i, prose(rng, lang, int(rng.integers(1, 120))), lang, f"s{i % 3}"])
    passage = prose(rng, "en", 40)
    for i in (5, 9, 21, 33):
        rows[i][1] = f"{rows[i][1]} {passage} {prose(rng, 'en', 20)}"
    for i in (60, 61, 62):
        rows[i][1] = rows[7][1]
    rows[63][1] = rows[5][1] + " tail"
    rows[64][1:3] = [prose(rng, "en", 3000), "en"]
    rows[65][1], rows[66][1], rows[67][1], rows[68][1:3] = None, "", "12 34 !!", ["漢字 " * 40, None]
    rows[69][3] = None
    rows += [list(rows[3]), list(rows[65])]
    rows = [(*r, len(r[1] or ""), 1, 2.0, "x", i, r[1]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int, score double, copy string, starts long, shard string").cache()


def sets_of(rows):
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) for _, t in rows]
    return [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in words]


def test_language_stage(spark, docs):
    """Nearest centroid by plain loops over trigrams' weights."""
    stage = corpus_pipeline.STAGES[0][1]
    kept = Counter(r.doc_id for r in stage(spark, docs, "").collect())
    m = langid.fitted(docs)
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        if not any(c.isalpha() for c in text):
            continue
        v = langid.grams(text).astype(float) * m["idf"]
        sims = [float(sum(a * b for a, b in zip(v, c, strict=True) if a)) / math.sqrt(float(v @ v)) for c in m["centroids"]]
        best = int(np.argmax(sims))
        if sims[best] >= langid.SLACK * m["least"][best] - 1e-6:
            want[r.doc_id] += 1
    assert kept == want and not {65, 66, 67, 68} & set(kept) and set(range(60)) <= set(kept) and kept[3] == 2
    assert stage(spark, docs, "").columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0


def test_language_stage_sends_texts_alone(spark, docs):
    """Python gets every text once and no other column, and gives back no text: what it holds doesn't grow with the row."""
    out = corpus_pipeline.STAGES[0][1](spark, docs, "")
    out.collect()
    plans, moved = [out._jdf.queryExecution().executedPlan()], Counter()
    while plans:
        plan = plans.pop()
        plans += [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.children().apply(i) for i in range(plan.children().size())]
        for name in ("pythonDataSent", "pythonDataReceived"):
            if plan.metrics().contains(name):
                moved[name] += plan.metrics().apply(name).value()
    texts = sum(len((r.text or "").encode()) for r in docs.collect())
    assert texts < moved["pythonDataSent"] < 1.5 * texts and 0 < moved["pythonDataReceived"] < 0.25 * texts


def test_freed_memory_goes_back():
    """Blocks freed between ones that stay are kept by the allocator until it is asked."""
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10
    blocks = [bytes(9_000 + i % 7) for i in range(20_000)]
    blocks = blocks[::100]
    full = held()
    trim_memory()
    assert len(blocks) == 200 and held() < full - 100


def test_join_stage(spark, docs):
    stage = corpus_pipeline.STAGES[1][1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, label = sets_of(rows), {i: i for i, _ in rows}
    for _ in rows:
        for (a, _), x in zip(rows, sets, strict=True):
            for (b, _), y in zip(rows, sets, strict=True):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    got = stage(spark, docs, "")
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, _ in rows if label[i] == i)
    assert got.columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0


def test_repeats_stage(spark, docs):
    stage = corpus_pipeline.STAGES[2][1]
    first: dict[bytes, int] = {}
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.where("text is not null").collect()]
    for i, b in sorted(rows, key=lambda x: x[0]):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = Counter()
    for i, b in rows:
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                cut[p : p + 50] = True
        want[i, bytes(x for x, c in zip(b, cut, strict=True) if not c).decode("utf-8", "replace")] += 1
    want[65, None] += 2
    got = stage(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert all(r.n_chars == len(r.text or "") for r in got.collect())
    assert got.columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0


def levels(sizes, weights, total):
    """Targets by filling step by step: shares by weight, excess over three times the size shared again."""
    target, full = {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        for s in open_:
            target[s] = left * weights[s] / sum(weights[x] for x in open_)
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target
        for s in over:
            full.add(s)
            target[s] = 3.0 * sizes[s]


def test_mixing_stage(spark, docs):
    """Targets step by step, and one document after the other along the running sum of expected copies."""
    stage = corpus_pipeline.STAGES[3][1]
    rows = [(r.source, len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")), r.doc_id, hashlib.md5(str(r.doc_id).encode()).hexdigest()) for r in docs.collect()]
    names = sorted({s for s, *_ in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r[1] for r in rows if r[0] == s) for s in names}
    target = levels(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()))
    want, taken = Counter(), Counter()
    for place, s in enumerate(names, 1):
        offset = int(hashlib.md5(f"offset:{place}".encode()).hexdigest()[:8], 16) / 2**32
        each = target[s] / sizes[s] if sizes[s] else 0.0
        for rank, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], int(r[3][:8], 16) % 4096, r[3], r[2]))):
            n = min(3, math.floor(each * (rank + 1) + offset) - math.floor(each * rank + offset))
            want[r[2]] += n
            taken[s] += n * r[1]
    got = stage(spark, docs, "")
    assert Counter(r.doc_id for r in got.collect()) == +want and got.columns == docs.columns
    assert stage(spark, docs.limit(0), "").count() == 0


def test_packing_stage(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    stage = corpus_pipeline.STAGES[4][1]
    rows = stage(spark, docs, "").collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tk.encode(r.text or "", add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert len(sequences) <= 1.1 * sum(r.length for r in rows) / 1024 + 1 and stage(spark, docs.limit(0), "").count() == 0


def test_run_is_its_stages(spark):
    data = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert out and {r.doc_id for r in out} <= ids and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "mixing_to_targets", "best_fit_packing"]
