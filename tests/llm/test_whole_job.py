"""Operators do the whole job: no samples, lost texts or unfinished moves."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tarnfold.llm import common, html_extract, jaccard_join, lm_scoring, sharding
from tarnfold.llm.packing import Ids, default_tokenizer


def test_lm_learns_from_every_text(spark):
    path = default_tokenizer()
    texts = [f"{a} {b}" for a in ("river", "stone", "window", "letter") for b in ("green", "quiet", "seven", "paper")]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text) as mark")
    some = [r.text for r in rows.where("pmod(mark, 8) <> 0").collect()]
    assert len(some) > 8
    lm = lm_scoring.model_of(lm_scoring.cut(rows.where("pmod(mark, 8) <> 0"), path))
    ids = [np.frombuffer(lm_scoring._ids(path).of(line), "<u4") for line in lm_scoring._lines(some)]
    counts = np.bincount(np.concatenate(ids), minlength=lm_scoring.VOCABULARY).astype(float)
    counts[lm_scoring.END] += len(some)
    of, share = lm_scoring.class_table(counts)
    pairs = np.zeros((lm_scoring.CLASSES, lm_scoring.VOCABULARY))
    for seq in ids:
        for before, after in zip([lm_scoring.BEGIN, *seq], [*seq, lm_scoring.END], strict=True):
            pairs[of[before], after] += 1
    assert (lm["of"] == of).all() and np.allclose(lm["inner"], lm_scoring.inner_table(pairs, of, share))
    one = rows.where(rows.text == some[0])
    assert all(not np.array_equal(lm_scoring.model_of(lm_scoring.cut(x, path))["model"]["b"], lm_scoring.init()["b"]) for x in (rows, one))


def test_lines_are_cut_by_distinct_words_as_a_whole():
    cutter, rng = Ids(default_tokenizer()), np.random.default_rng(8)
    pieces = [*"aZ9'é,\u3000\xa0\x85\x1c\x00\u200b😀", " ", " ", "\n", "\t", "'s", "<|endoftext|>", "River"]
    texts = [*("".join(rng.choice(pieces, int(rng.integers(0, 25)))) for _ in range(1500)), None, "", "  "]
    whole = [np.frombuffer(cutter.of(line), "<u4").astype("<u2").tobytes() for line in lm_scoring._lines(texts)]
    assert lm_scoring.line_ids(cutter, pa.array(texts)) == whole and lm_scoring.line_ids(cutter, pa.array([], pa.string())) == []

    class Counting:
        seen = 0

        def __init__(self, core):
            self.core = core

        def encode_to_tiktoken_buffer(self, text, special):
            self.seen += len(text)
            return self.core.encode_to_tiktoken_buffer(text, special)

    cutter.core = Counting(cutter.core)
    lm_scoring.line_ids(cutter, pa.array(["River stone river"] * 50))
    assert cutter.core.seen == len(" river stone")


def test_nothing_is_made_of_positions_without_a_score(monkeypatch):
    made, real = [], lm_scoring.class_scores
    monkeypatch.setattr(lm_scoring, "class_scores", lambda m, y, room: (made.append(len(y)), real(m, y, room))[1])
    of, share = lm_scoring.class_table(np.zeros(lm_scoring.VOCABULARY))
    lm = {"model": lm_scoring.init(), "of": of, "inner": np.tile(np.log10(share), (lm_scoring.CLASSES, 1))}
    seqs = [np.arange(n) for n in (0, 3, 31, 32, 100, 4000)]
    assert (lm_scoring.log10_scores(lm, seqs) < 0).all() and sum(made) == sum(len(s) + 1 for s in seqs)


def test_gradients_of_blocks_are_added():
    rng = np.random.default_rng(9)
    n = 2 * lm_scoring.BLOCK + 7
    m = {k: v.astype(np.float64) for k, v in lm_scoring.init().items()}
    ids, goals = rng.integers(0, 5000, (n, lm_scoring.WINDOW)), rng.integers(0, lm_scoring.CLASSES, (n, lm_scoring.WINDOW))
    weight = (rng.random(ids.shape) < 0.7).astype(np.float32)
    whole = lm_scoring.gradients(m, ids, goals, weight)
    ones = [(lm_scoring.gradients(m, ids[i : i + 1], goals[i : i + 1], weight[i : i + 1]), weight[i].sum()) for i in range(n)]
    assert all(np.allclose(whole[k], sum(g[k] * w for g, w in ones) / weight.sum(), atol=1e-6) for k in m)


def test_gains_search_a_word_once(monkeypatch):
    rng = np.random.default_rng(11)
    known, searched = np.sort(rng.choice(5000, 400, replace=False)) - 2500, []
    count, h, real = rng.integers(1, 90, 400), rng.integers(-2600, 2600, 20000), np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: (searched.append(len(v)), real(a, v, *more))[1])
    gain, c = lm_scoring.gains(h, known, count)
    have = dict(zip(known.tolist(), count.tolist(), strict=True))
    assert c.tolist() == [have.get(x, 0) for x in h.tolist()] and np.array_equal(gain, np.log10(c + 1.0))
    assert searched == [len(set(h.tolist()))]
    assert all(len(x) == 0 for x in lm_scoring.gains(h[:0], known, count)) and not any(x.any() for x in lm_scoring.gains(h, known[:0], count[:0]))


def test_adam_is_the_plain_rule():
    rng = np.random.default_rng(12)
    ids, goals = rng.integers(0, 5000, (3 * lm_scoring.STEP, lm_scoring.WINDOW)), rng.integers(0, lm_scoring.CLASSES, (3 * lm_scoring.STEP, lm_scoring.WINDOW))
    weight = np.ones(ids.shape, np.float32)
    adam = lm_scoring.Adam({k: v.astype(np.float64) for k, v in lm_scoring.init().items()})
    plain = {k: v.copy() for k, v in adam.model.items()}
    one, two = ({k: np.zeros_like(v) for k, v in plain.items()} for _ in range(2))
    for step in (1, 2, 3):
        part = slice((step - 1) * lm_scoring.STEP, step * lm_scoring.STEP)
        for k, g in lm_scoring.gradients(plain, ids[part], goals[part], weight[part]).items():
            one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.99 * two[k] + 0.01 * g * g
        for k in plain:
            plain[k] -= adam.rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
    adam.learn(ids, goals, weight)
    assert all(np.allclose(adam.model[k], plain[k], rtol=0, atol=1e-6) for k in plain)


def test_words_of_a_large_batch_are_counted_in_little_memory():
    rng = np.random.default_rng(13)
    kinds = np.array([f"word{i}" for i in range(30000)])
    texts = [*(" ".join(kinds[rng.integers(0, 30000, 350)]) for _ in range(8000)), None, "", " River river\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(lm_scoring.counted_words(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    h, per = lm_scoring.word_hashes([(t or "").encode() for t in texts])
    want = dict(zip(*(x.tolist() for x in np.unique(h.view(np.int64), return_counts=True)), strict=True))
    total = {r["h"]: r["c_sum"] for r in got.group_by("h").aggregate([("c", "sum")]).to_pylist()}
    assert total == want and sum(want.values()) == 8000 * 350 + 2 and per[-1] == 2
    assert peak < 64 << 20
    assert list(lm_scoring.counted_words(iter([batch.slice(8000, 2)]))) == []


def test_scores_reach_workers_in_small_batches(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('w', id % 7, ' '), 1000) as text")
    name, seen, real = "spark.sql.execution.arrow.maxBytesPerBatch", [], lm_scoring.settle
    before = spark.conf.get(name)

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    def settle(df, *more, **named):
        seen.append(int(spark.conf.get(name).rstrip("b")))
        return real(df, *more, **named)

    with common.batch_bytes(spark, 1 << 18):
        assert max(r.n for r in rows.mapInArrow(largest, "n long").collect()) < 1 << 19
    monkeypatch.setattr(lm_scoring, "settle", settle)
    got = lm_scoring.scored(rows)
    assert seen and set(seen) == {lm_scoring.BATCH} and spark.conf.get(name) == before
    assert got.where("n_tokens = 1001").count() == 3000


def test_workers_give_back_memory_around_a_task(monkeypatch):
    done = []
    monkeypatch.setattr(common, "trim_memory", lambda: done.append("trim"))
    assert list(common.lean(lambda batches: (done.append(x) or x for x in batches))([1, 2])) == [1, 2] and done == ["trim", 1, 2, "trim"]


def test_groups_of_near_copies_meet_in_little_memory():
    rng, groups, size = np.random.default_rng(10), 60, 80
    kind = pa.list_(pa.struct([("rep", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("brief", pa.binary()), ("sigs", pa.list_(pa.int64()))]))
    member = lambda i, brief: {"rep": i, "label": i, "n": 300, "brief": brief, "sigs": rng.integers(1, 1 << 60, jaccard_join.FIRST).tolist()}
    many = pa.array([[member(g * size + i, brief) for i in range(size)] for g in range(groups) for brief in [rng.bytes(jaccard_join.BRIEF)]], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(groups, np.int64)), many, many], names=["sig", "many", "hubs"])
    tracemalloc.start()
    try:
        found = [jaccard_join._close_pairs(*(x.column(c) if c != "sig" else x.column(c).to_numpy() for c in x.schema.names)) for x in jaccard_join._member_batches([batch])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [tuple(p) for p in np.concatenate(found).tolist()] == [(g * size + i, g * size + j) for g in range(groups) for i in range(size) for j in range(i + 1, size)]
    assert len(found) > 1 and peak < 64 << 20


def extracted(spark, pages, host="http://h.example/"):
    rows = spark.createDataFrame([(i, f"{host}{i}", f"<html><body>{p}</body></html>") for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extracted(rows).collect()}


def test_html_template_decides_beside_article_elements(spark):
    fixed = [f"<main><p>We are the best shop in town.</p></main><div id=text><p>Story {i} is a long one about page {i}.</p><p>End {i}</p></div><div id=end>Call us</div>" for i in range(6)]
    assert extracted(spark, fixed) == {i: f"Story {i} is a long one about page {i}.\n\nEnd {i}" for i in range(6)}
    beside = [f"<div id=top>Motto of all</div><article><h1>News</h1><p>Body {i}</p></article><div id=rest><p>Second part {i}</p></div><div id=end>Call us</div>" for i in range(6)]
    assert extracted(spark, beside) == {i: f"News\n\nBody {i}\n\nSecond part {i}" for i in range(6)}
    # A text of two pages in three is data unless it comes and goes with an element of the template.
    often = [f"<div id=top>Motto</div><div id=text><p>Story {i} is long.</p>{'<p>As they say.</p>' if i % 3 else '<p>Or not {i}.</p>'}</div>{'<div id=sale><b>Sale</b></div>' if i % 2 else ''}" for i in range(6)]
    assert all(("As they say." in t) == (i % 3 > 0) and "Sale" not in t and "Motto" not in t for i, t in extracted(spark, often).items())


def test_html_classes_are_ordered_and_nested():
    pages = [html_extract.events_of("<body><ul>" + "<li>Go</li>" * 3 + "</ul><div>" + "<h5>Go on</h5>" * 3 + f"</div><p>Text {i}</p><table>" + "<tr><td>Key</td></tr>" * (i + 1) + "</table></body>") for i in range(4)]
    tokens = [html_extract.tokens_of(e) for e in pages]
    template = html_extract.Template(None)
    number = lambda *path: (html_extract._slot(path), 0)
    one, two = number("body", "ul", "li"), number("body", "div", "h5")
    template.classes = [[one, two], [number("body", "table", "tr"), number("body", "table", "tr", "td")]]
    template.of = {t: i for i, c in enumerate(template.classes) for t in c}
    assert all(template.fixed(t) == set(template.classes[1]) for t in tokens)


def test_html_keeps_every_slot_of_a_split_body(spark):
    split = [f"<div id=top>Site name</div><div id=text>Lead {i}<section id=intro><p>Intro {i}</p></section><section id=methods><p>Methods of page {i}, a longer text.</p></section></div><div class=rest>Rest {i}</div><div id=end>Call us</div>" for i in range(5)]
    want = {i: f"Lead {i}\n\nIntro {i}\n\nMethods of page {i}, a longer text.\n\nRest {i}" for i in range(5)}
    assert extracted(spark, split) == want
    assert extracted(spark, [f"<div class=lead>Lead {i}</div><div class=rest>The rest {i}</div>" for i in range(2)]) == {i: f"Lead {i}\n\nThe rest {i}" for i in range(2)}


def test_html_class_words_of_wrappers_keep_the_article(spark):
    for n in (1, 5):
        for tag in ("div class='layout has-sidebar'", "div class=no-sidebar", "div class=with-comments", "form action='/x'"):
            for open_, close in (("<article>", "</article>"), ("<div id=text>", "</div>")):
                pages = [f"<{tag}>{open_}<p>Story {i} goes on for a good while.</p>{close}<div class=sidebar>Side {i}</div><div class=comments><article>Me too {i}</article></div><form>Your mail {i}</form></{tag.split()[0]}>" for i in range(n)]
                assert extracted(spark, pages) == {i: f"Story {i} goes on for a good while." for i in range(n)}, (n, tag, open_)


def test_shards_gather_large_and_null_groups(spark):
    rows = [(i, "big" if i < 480 else f"g{i}", 10) for i in range(960)] + [(i, None, 10) for i in range(960, 970)]
    docs = spark.createDataFrame(rows, "doc_id long, group string, size long")
    got = sharding.balanced_shards(docs).collect()
    big = [r.shard for r in got if r.group == "big"]
    assert len(got) == len(rows) and max(big.count(s) for s in set(big)) <= 41
    assert len(set(big)) <= 14  # 480 of 970 documents need 12 of 24 shards
    assert len({r.shard for r in got if r.group is None}) == 1
