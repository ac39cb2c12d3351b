"""Quality rules as a short-circuit cascade, in DataFrame expressions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.common import forget, settle
from tarnfold.tables import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities of rules are estimated, and how often each is timed.
SAMPLE, TIMES = 2000, 3


@dataclass(frozen=True)
class Rule:
    """A document that `fails` is true for is rejected; null counts as false. Cost and rejection are estimates."""

    name: str
    fails: Column


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) of the column `text`.

    Words are runs of anything but ASCII white space. n_repeat_words counts the words that lie in a window of three
    words found twice or more in the text: the windows' 64-bit hashes are sorted inside the row with their
    positions, equal neighbours mark the windows, and the marked positions, in order, give the words that they
    cover. That is n log n in the words of a text, needs no shuffle, and holds one text's words at a time. Null text
    has no words, lines or symbols. Columns of `docs` that bear one of the five names are replaced.
    """
    taken = set(docs.columns)
    w, g, p, t = ("_w", "_g", "_p", "_t")
    while taken & {w, g, p, t}:
        w, g, p, t = (f"_{x}" for x in (w, g, p, t))
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(w, F.filter(F.split(F.col(t), SPACE), lambda x: x != ""))
    grams = f"case when size({w}) > 3 then array_sort(transform(sequence(0, size({w}) - 3), i -> struct(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]) as h, i as i))) end"
    out = out.withColumn(g, F.expr(grams))
    marked = f"array_sort(transform(filter({g}, (x, j) -> coalesce(get({g}, j - 1).h = x.h, false) or coalesce(get({g}, j + 1).h = x.h, false)), x -> x.i))"
    out = out.withColumn(p, F.expr(marked))
    covered = f"coalesce(aggregate({p}, named_struct('at', -3, 'n', 0L), (a, x) -> named_struct('at', x, 'n', a.n + least(3, x - a.at)), a -> a.n), 0L)"
    lines = f"filter(split({t}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    chars = lambda c, drop: F.length(F.translate(c, drop, ""))
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": chars(F.col(t), " \t\n\x0b\x0c\r").cast("long"),
        "n_symbols": (F.length(t) - chars(F.col(t), SYMBOLS)).cast("long"),
        "n_dup_lines": F.expr(f"size({lines}) - size(array_distinct({lines}))").cast("long"),
        "n_repeat_words": F.expr(covered),
    })
    return out.drop(w, g, p, t)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules in whole numbers: too many symbols, repeated lines, words that are too short or too long on average, few
    letters, many addresses. The last two read the text themselves, so the cascade saves their cost on rows that an
    earlier rule rejects."""
    n, text = F.col("n_words"), F.coalesce(F.col("text"), F.lit(""))
    return [
        Rule("letters", 2 * F.length(F.regexp_replace(text, r"\P{L}+", "")) < F.col("word_chars")),
        Rule("addresses", 10 * F.regexp_count(text, F.lit("https?://")) > n),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("short words", F.col("word_chars") < 2 * n),
        Rule("long words", F.col("word_chars") > 25 * n),
        Rule("repeated lines", (10 * F.col("n_dup_lines") * 20 > 30 * n) & (F.col("n_dup_lines") >= 3)),
        Rule("repeated words", 100 * F.col("n_repeat_words") > 30 * n),
    ]


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows of `docs`, at most, by a hash of all columns, written to the shared folder."""
    total = docs.count()
    share = 1 << 30 if total <= rows else int((1 << 30) * rows / total)
    mark = F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30))
    return settle(docs.where(mark < share).limit(rows), "rules")


def worth_of(sample: DataFrame, rules: list[Rule]) -> dict[str, float]:
    """Rejection per second of each rule on a sample whose features are not computed yet.

    A rule's cost is the least of some times to evaluate it over the sample, with the features that it reads and
    nothing else, less the time that the sample alone takes. Its rejection is the share that it rejects.
    """

    def timed(value: Column) -> tuple[int, float]:
        took, n = [], 0
        for _ in range(TIMES):
            began = time.perf_counter()
            n = sample.select(F.count_if(value).alias("n"), F.count("*").alias("all")).first()["n"]
            took.append(time.perf_counter() - began)
        return n, min(took)

    rows, idle = timed(F.lit(True))
    return {rule.name: rejected / max(1, rows) / max(took - idle, 1e-4) for rule in rules for rejected, took in [timed(F.coalesce(rule.fails, F.lit(False)))]}


def ordered_rules(rules: list[Rule], worth: dict[str, float]) -> list[Rule]:
    """The rules by rejection per cost, largest first, then by name. The order changes what is evaluated, never what is kept."""
    return sorted(rules, key=lambda rule: (-worth[rule.name], rule.name))


def cascade(rules: list[Rule], worth: dict[str, float]) -> Column:
    """A Boolean column: no rule rejects the row. The first rule that rejects ends the evaluation (CASE WHEN).

    Without rules all rows are kept; a rule that is null counts as passed.
    """
    kept: Column = F.lit(True)
    for rule in reversed(ordered_rules(rules, worth)):
        kept = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(False)).otherwise(kept)
    return kept


def judged(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE) -> DataFrame:
    """measured() plus base_failed and kept: false if base_failed, else the verdict of the cascade.

    A bounded sample (`sample_rows`) serves only to order the rules, so ties in worth and an empty table change nothing.
    An empty or null text fails the base. Equal texts get equal verdicts; repeated rows stay, very long texts are read
    whole. Other columns stay, but for the names of results, which are replaced.
    """
    rules = default_rules() if rules is None else rules
    out = measured(docs).withColumn("base_failed", base_failed())
    sample = sampled(docs, sample_rows)
    verdict = cascade(rules, worth_of(measured(sample).withColumn("base_failed", base_failed()), rules))
    forget(docs.sparkSession, sample)
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
split_up as (
  select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from docs),
grams as (
  select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select rid, w, unnest(generate_series(1, len(w) - 2)) as i from split_up where len(w) >= 3)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from grams) where n > 1),
covered as (select rid, count(distinct i + d) as n from again, (values (0), (1), (2)) as x(d) group by rid),
base as (
  select s.doc_id, cast(len(w) as bigint) as n_words,
         cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
         cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
         length(regexp_replace(t, '\P{L}+', '', 'g')) as letters, len(regexp_extract_all(t, 'https?://')) as urls
  from split_up s left join covered c on c.rid = s.rid),
failed as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from base)
select * exclude (letters, urls), not base_failed and 2 * letters >= word_chars and 10 * urls <= n_words and not (10 * n_symbols > 3 * n_words) and not (word_chars < 2 * n_words)
          and not (word_chars > 25 * n_words) and not (200 * n_dup_lines > 30 * n_words and n_dup_lines >= 3)
          and not (100 * n_repeat_words > 30 * n_words) as kept
from failed
"""
