"""The ten operators on odd tables: nulls, empty, very long and repeated texts, ties, no rows, clashing names."""

import hashlib
import html
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import html_extract, jaccard_join, langid, lm_scoring, media, mixing, packing, quality, sharding, suffix_dedup
from tarnfold.llm.shingles import shingle_sets

WORDS = [f"w{i}é" if i % 7 == 0 else f"Word{i}," for i in range(400)]
BASE = " ".join(WORDS)
TEXTS = [
    None, "", " \n\t ", "one", "one  two\nthree", "ONE two three", BASE, BASE, BASE.replace("Word5,", "changed"), " ".join(WORDS[50:] + ["tail"] * 3),
    "x" * 5000, "ab " * 3000, BASE[:300] + " other words that follow " + BASE[900:1400], "### *** $$$ %%% &&&", "éèê " * 60, "the 50-byte passage that several documents of this table share, whole", "before the 50-byte passage that several documents of this table share, whole after",
    " ".join(f"u{i}" for i in range(30000)), "12345 67890", "same line\nsame line\nother",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], None if i == 4 else f"s{i % 4}", i, 1.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6], rows[0]], "doc_id long, text string, lang string, source string, size long, score double").cache()


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_jaccard_join(docs):
    got = by_id(jaccard_join.jaccard_components(docs))
    words = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    sets = {i: ({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for i, t in enumerate(TEXTS)}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {i: {(r.n_shingles, r.component_id) for r in rows} for i, rows in got.items()} == {i: {(len(sets[i]), label[i])} for i in sets}
    assert len(got[6]) == 2 and jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_join_of_sets_around_one_passage(spark):
    """300 sets share a long passage, which makes groups of many blocks, and link only with their near copies."""
    rng = np.random.default_rng(1)
    some = lambda k: [f"w{x}" for x in rng.integers(0, 400, k)]
    passage = some(60)
    texts = [" ".join(some(5) + passage + some(18)) for _ in range(300)]
    texts += [texts[int(i)].rsplit(" ", 1)[0] + f" z{i}" for i in rng.integers(0, 300, 40)]
    sets, label = shingle_sets(texts), list(range(len(texts)))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    for _ in range(5):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), label[i]) for i, s in enumerate(sets)}


def test_signatures_never_miss():
    rng = np.random.default_rng(1)
    for trial in range(300):
        n = int(rng.integers(2, 200))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        b = a.copy()
        for k in rng.choice(len(b), int(rng.integers(0, max(1, len(b) // 7) + 1)), replace=False):
            b[k] = np.uint64(rng.integers(0, 1 << 63))
        b = np.unique(b)
        classes = (rng.random(1 << jaccard_join.BITS) < [0, 0.5, 1][trial % 3]).astype(np.uint8) if trial < 30 else classes
        if jaccard_join.linked(len(np.intersect1d(a, b)), len(a), len(b)) and min(len(a), len(b)) > 1:
            with np.errstate(over="ignore"):
                assert set(jaccard_join.signatures(a, classes).tolist()) & set(jaccard_join.signatures(b, classes).tolist())


def test_shingles_ignore_space():
    a, b, c = shingle_sets(["A b\tc  d e f", "a B c\nd E F ", "a b c d e g"])
    assert a.tolist() == b.tolist() != c.tolist()


def test_packing(docs):
    rows = packing.packed(packing.token_pieces(docs)).collect()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i in [*range(len(TEXTS)), 6, 0]:
        ids = [*tk.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    assert pieces == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed(packing.token_pieces(docs.limit(0))).count() == 0


def test_special_and_odd_texts_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    ids, tk = packing.Ids(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    parts = ["a", "b1", "'s", " ", "\n", "\t", "\r", "é", "–", ".", " x", "<|", "\xa0", "ж", "\u3000", "漢", "٣", "\x1c", "\x85", "\u200b", "😀", "\x00", "<|endoftext|>", "½"]
    rng = np.random.default_rng(2)
    odd = ["".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(0, 10, 3000)]
    for t in [*odd, "héllo wörld  x y", "日本語 text", "don't 1 2½ \x1c z", "  lead\n\n trail  ", "ſt ß", "﻿a", "ab " * 4000]:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, t


def plain_best_fit(lengths, capacity, most):
    """Open bins as a list; the least free space that holds the piece, the one used last of equals; the fullest closes."""
    open_, at, out, n = [], [], [], 0
    for length in lengths:
        fits = [b for b in open_ if b[1] >= length]
        if fits:
            least = min(b[1] for b in fits)
            here = [b for b in fits if b[1] == least][-1]
            open_.remove(here)
        else:
            if len(open_) >= most:
                least = min(b[1] for b in open_)
                open_.remove([b for b in open_ if b[1] == least][-1])
            here, n = [n, capacity], n + 1
        out.append(here[0])
        at.append(capacity - here[1])
        here = [here[0], here[1] - length]
        if here[1]:
            open_.append(here)
    return out, at


def test_best_fit_is_the_plain_bounded_best_fit():
    assert packing.best_fit([6, 5, 7, 3, 4], 10, 2) == ([0, 1, 2, 2, 1], [0, 0, 0, 7, 5])
    rng = np.random.default_rng(3)
    for bound in (1, 2, 8, 64):
        lengths = rng.integers(1, 101, 600).tolist()
        assert packing.best_fit(lengths, 100, bound) == plain_best_fit(lengths, 100, bound)
    lengths = rng.lognormal(6, 1, 4000).astype(int).clip(1, 1024).tolist()
    assert packing.best_fit(lengths, 1024, packing.OPEN_BINS) != packing.best_fit(lengths, 1024, 10**6)  # the bound binds


def test_suffix_dedup(docs):
    got = by_id(suffix_dedup.without_repeats(docs))
    first: dict[bytes, int] = {}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        cut = bytearray(len(b))
        grams = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, g in enumerate(grams):
            if first.get(g, i) < i:
                cut[p : p + 50] = b"\1" * 50
        for g in grams:
            first.setdefault(g, i)
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        spans = len(re.findall(b"\1+", bytes(cut)))
        for r in got[i]:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


def test_html(spark):
    page = lambda body, tail="</body></html>": f'<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1>{body}</article><footer>&copy; foot</footer>{tail}'
    pages = [(i, f"http://h.example/{i}", page(f"<p>Para {i}\n a&nbsp;b <b>bold</p><p><b>Next{i}<br>line<p>Last<div class='comments'><p>me too</p></div>", "" if i == 2 else "</body></html>")) for i in range(6)]
    pages += [(6, None, None), (7, "http://x.example", ""), (8, "http://h.example/8", '<p title="a>b">loose text &am <a'), (8, "http://h.example/8", '<p title="a>b">loose text &am <a')]
    plain = "<div class=box><div id=top>Site name</div><div id=body><p>Story {0} goes on for a while here.</p><p>More {0}</p></div><div id=end>Contact us</div></div>"
    pages += [(20 + i, "http://plain.example/a", plain.format(i)) for i in range(6)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extracted(rows).collect()}
    for i in range(6):
        assert got[i].text == f"Head & line\n\nPara {i} a b bold\n\nNext{i} line\n\nLast"
    assert got[6].text == got[7].text == "" and got[8].text == "loose text &am" and got[6].url is None
    assert got[21].text == "Story 1 goes on for a while here.\n\nMore 1" and got[21].n_chars == len(got[21].text)
    assert html_extract.extracted(rows).count() == len(pages) and html_extract.extracted(rows.limit(0)).count() == 0
    assert html.unescape("&am") == "&am"


def test_media(docs):
    for i, rows in by_id(media.media_columns(docs)).items():
        data = (TEXTS[i] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        for r in rows:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert media.from_image(media.to_image(payload)) == payload and r.media_sha256 == hashlib.sha256(media.to_image(payload)).hexdigest()
            assert (r.width, r.height) == (192, len(payload) // 192)
    assert media.media_columns(docs.limit(0)).count() == 0


def test_language(spark, docs):
    train = [(i, " ".join(np.random.default_rng(i).choice(["the", "and", "of", "this"] if i % 2 else ["le", "une", "dans", "être"], 30)), "en" if i % 2 else "fr") for i in range(400)]
    rows = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.fitted(rows)
    out = langid.identify(rows, model).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.99 and not any(r.rejected for r in out)
    odd = by_id(langid.identify(docs, model))
    assert all(odd[i][0].lang_pred == "und" and odd[i][0].rejected and odd[i][0].score == 0 for i in (0, 1, 2, 13, 18))
    assert all(0 <= r.score <= 1 for rows in odd.values() for r in rows) and odd[3][0].size == 3
    assert langid.identify(docs, langid.fitted(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_quality(docs):
    got = by_id(quality.judged(docs))
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        for r in got[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
            assert r.base_failed == (len(w) < 50 or 2 * len(covered) > len(w)) and not (r.base_failed and r.kept)
    assert got[6][0].kept and quality.judged(docs.limit(0)).count() == 0


def test_rules_stand_by_measured_rejection_per_cost(spark):
    rows = spark.createDataFrame([(i, f"{i} " * 200) for i in range(2000)], "doc_id long, text string")
    heavy = F.length(F.regexp_replace(F.concat(*[F.reverse(F.col("text"))] * 40), "(a|b|1)+x?", "")) >= 0
    rules = [quality.Rule("heavy", heavy & (F.col("doc_id") % 2 == 0)), quality.Rule("light", F.col("doc_id") % 2 == 1), quality.Rule("none", F.col("doc_id") < 0)]
    worth = quality.worth_of(quality.sampled(rows, 500), rules)
    assert [r.name for r in quality.ordered_rules(rules, worth)] == ["light", "heavy", "none"] and worth["none"] == 0
    assert quality.ordered_rules(rules, {"heavy": 1.0, "light": 1.0, "none": 2.0})[0].name == "none"
    sample = quality.sampled(rows, 500).count()
    assert 300 <= sample <= 500 and quality.sampled(rows, 10**6).count() == 2000
    kept = lambda worth: {r.doc_id for r in rows.where(quality.cascade(rules, worth)).collect()}
    assert kept(worth) == kept({"heavy": 3.0, "light": 2.0, "none": 1.0}) == set()
    # The first rule that rejects ends the evaluation: a later one would raise.
    fatal = quality.Rule("fatal", F.raise_error(F.lit("evaluated")).cast("boolean"))
    always = quality.Rule("always", F.col("doc_id") >= 0)
    assert rows.where(quality.cascade([fatal, always], {"fatal": 0.0, "always": 1.0})).count() == 0


def test_sharding(docs):
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.md5("text").alias("group"))
    many = rows.unionAll(rows.withColumn("doc_id", F.col("doc_id") + 100).withColumn("group", F.lit("hot")).where("size < 100"))
    got = sharding.balanced_shards(many, shards=4).collect()
    assert len(got) == many.count()
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.balanced_shards(many.withColumns({"place": F.lit(1), "Slot": F.lit(2), "mark": F.lit(3), "_before": F.lit(4)}), shards=4).count() == len(got)
    assert sharding.balanced_shards(rows.limit(0)).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    """Balance and cut links against shards by hash alone."""
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(20, 400)), f"g{i // 6}" if i < 600 else f"one{i}") for i in range(3000)]
    rows += [(5000 + i, 50, None) for i in range(40)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, size long, group string"), shards=8).collect()
    load, where = Counter(), {}
    for r in got:
        load[r.shard] += r.size
        where.setdefault(r.group, Counter())[r.shard] += 1
    assert len(got) == len(rows) and max(load.values()) - min(load.values()) <= 400 and len(load) == 8
    cut = sum(sum(c.values()) - max(c.values()) for g, c in where.items() if g is None or g.startswith("g"))
    assert cut < 0.1 * 640 and len(where[None]) == 1


def test_scores(docs):
    got = by_id(lm_scoring.scored(docs, head=50))
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i in [*range(len(TEXTS)), 6, 0] if not held(i) for w in words(TEXTS[i]))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(TEXTS):
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), abs=1e-6) and r.score < 0
    assert lm_scoring.scored(docs.limit(0)).count() == 0


def direct_score(lm, seq):
    """One position after the other, one head in plain loops: the score of a sequence with its end."""
    m, full, total = lm["model"], [lm_scoring.BEGIN, *seq, lm_scoring.END], 0.0
    stride, size = lm_scoring.WINDOW - lm_scoring.OVERLAP, lm_scoring.WINDOW
    for at in range(len(full) - 1):
        k = 0 if at < size else (at - size) // stride + 1
        window = full[k * stride : at + 1]
        x = [m["e"][i % lm_scoring.EMBEDDED].astype(float) + m["p"][j] for j, i in enumerate(window)]
        q = x[-1] @ m["q"]
        weights = np.exp([q @ (y @ m["k"]) / math.sqrt(lm_scoring.WIDTH) for y in x])
        h = sum(w * (y @ m["v"]) for w, y in zip(weights / weights.sum(), x, strict=True))
        z = (h @ m["o"] + x[-1]) @ m["u"] + m["b"]
        c, goal = lm["of"][full[at + 1]], full[at + 1]
        total += (z[c] - math.log(np.exp(z).sum())) / math.log(10) + lm["inner"][lm["of"][full[at]], goal]
    return total


def test_model_learns_is_causal_and_scores_as_a_direct_loop(spark):
    rng = np.random.default_rng(3)
    seqs = [np.tile([5, 900, 40, 7], 30)[: int(rng.integers(3, 110))] for _ in range(300)]
    counts = np.bincount(np.concatenate(seqs), minlength=lm_scoring.VOCABULARY).astype(float)
    of, share = lm_scoring.class_table(counts)
    inner = lm_scoring.inner_table(np.zeros((lm_scoring.CLASSES, lm_scoring.VOCABULARY)), of, share)
    assert all(np.allclose(np.bincount(of, 10.0 ** inner[c], lm_scoring.CLASSES)[np.unique(of)], 1, atol=1e-3) for c in (0, 5))
    for overlap in (0, lm_scoring.OVERLAP):
        ids, goals, weight, owner = lm_scoring.windows(seqs, overlap)
        assert weight.sum() == sum(len(s) + 1 for s in seqs)
    start = lm_scoring.init()
    adam = lm_scoring.Adam(start)
    for _ in range(8):
        adam.learn(ids, of[goals], weight)
    lm = lambda m: {"model": m, "of": of, "inner": inner}
    assert lm_scoring.log10_scores(lm(adam.model), seqs).sum() > 0.7 * lm_scoring.log10_scores(lm(start), seqs).sum()
    some = [*seqs[:6], np.zeros(0, np.int64), rng.integers(0, 50000, 90)]
    assert np.allclose(lm_scoring.log10_scores(lm(adam.model), some), [direct_score(lm(adam.model), s) for s in some], rtol=1e-4)
    a, b = ids[:1].copy(), ids[:1].copy()
    b[0, 20:] = 17
    assert np.allclose(lm_scoring.forward(adam.model, a)[0][:20], lm_scoring.forward(adam.model, b)[0][:20], atol=1e-5)


def test_gradients_are_slopes():
    rng = np.random.default_rng(4)
    m = {k: v.astype(np.float64) for k, v in lm_scoring.init().items()}
    ids, goals = rng.integers(0, 5000, (2, lm_scoring.WINDOW)), rng.integers(0, lm_scoring.CLASSES, (2, lm_scoring.WINDOW))
    weight = (rng.random(ids.shape) < 0.7).astype(np.float32)

    def loss(x):
        z = lm_scoring.forward(x, ids)[0]
        return -((z[np.arange(len(z)), goals.ravel()] - np.log(np.exp(z).sum(1))) * weight.ravel()).sum() / weight.sum()

    g = lm_scoring.gradients(m, ids, goals, weight)
    for name, at in (("u", (3, 5)), ("b", 7), ("o", (1, 2)), ("q", (4, 4)), ("k", (2, 9)), ("v", (8, 1)), ("p", (6, 3)), ("e", (int(ids[0, 3]) % lm_scoring.EMBEDDED, 2))):
        up, down = ({k: v.copy() for k, v in m.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-5), name


def test_model_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(1, 60))))) for i in range(200)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    scores = [{r.doc_id: r.score for r in lm_scoring.scored(rows.repartition(n)).collect()} for n in (1, 7)]
    assert all(scores[0][i] == pytest.approx(scores[1][i], rel=1e-6) for i in scores[0])


def test_mixing(docs):
    rows = mixing.systematic_mix(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    total = sum(r.size for r in rows)
    sources = {r.source: r for r in rows}
    assert sum(r.target for r in sources.values()) == pytest.approx(total)
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    assert json.dumps(sorted(map(str, rows))) == json.dumps(sorted(map(str, mixing.systematic_mix(docs).collect())))
    copies = mixing.mixed_documents(docs)
    assert copies.count() == sum(r.copies for r in rows) and copies.columns == docs.columns
    assert mixing.systematic_mix(docs.limit(0)).count() == 0
