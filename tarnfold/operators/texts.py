"""Text cleaning, tokens, similarity, keywords and their analytics."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tarnfold.functions.exprs import trim_u

#: Entities that are decoded, in this order.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&ldquo;": "“", "&rdquo;": "”", "&middot;": "·"}


def strip_html(c: Column) -> Column:
    """Tags of up to 200 characters become a blank; a few entities are decoded."""
    c = F.regexp_replace(c, "<[^>]{1,200}>", " ")
    for entity, plain in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


#: What cleaning replaces, in this order: zero-width characters, line ends, bullets, numbered bullets, runs
#: of blanks and of line ends.
CLEANING = (
    (r"[\u200b-\u200f\u202a-\u202e\u2060\ufeff]", ""),
    (r"\r\n?", "\n"),
    (r"(?mdU)^[\s]*[·•●○◆◇■□▪◦*\-–—+]{1,2}[\s]*", ""),
    (r"(?mdU)^[\s]*(\d{1,2})[、.)）]", "$1、"),
    (r"[ \t\u00a0\u3000]{2,}", " "),
    (r"\n{3,}", "\n\n"),
)


def clean_text(c: Column) -> Column:
    """Markup, zero-width characters, line ends, bullets, numbers of points, blanks and empty lines; null is empty."""
    c = strip_html(F.coalesce(c, F.lit("")))
    for pattern, plain in CLEANING:
        c = F.regexp_replace(c, pattern, plain)
    return trim_u(F.array_join(F.transform(F.split(c, "\n"), trim_u), "\n"))


def drop_lines(c: Column, patterns: list[str]) -> Column:
    """T5: lines that a pattern is found in go."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: ~x.rlike("|".join(patterns))), "\n")


def remove_until_clean(c: Column, patterns: list[str], rounds: int = 3) -> tuple[Column, Column]:
    """Text after up to `rounds` rounds of all patterns, and the number of hits in the first."""
    hits = F.lit(0)
    for p in patterns:
        hits = hits + F.regexp_count(c, F.lit(p))
    for _ in range(rounds):
        for p in patterns:
            c = F.regexp_replace(c, p, " ")
    return c, hits


def latin_tokens(c: Column, stopwords: list[str] = ()) -> Column:
    """Lower-cased Latin tokens without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z0-9+#.]*)"), 1)
    return F.array_except(words, F.array(*map(F.lit, stopwords))) if stopwords else words


def cjk_bigrams(c: Column) -> Column:
    """Neighbouring pairs of all CJK characters of a text, across gaps."""
    chars = F.regexp_extract_all(c, F.lit("([一-鿿])"), 1)
    return F.when(F.size(chars) > 1, F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda x, y: F.concat(x, y))).otherwise(F.array().cast("array<string>"))


def split_tags(c: Column) -> Column:
    """T14."""
    return F.filter(F.transform(F.split(c, "[、,，|｜;；]+"), lambda x: trim_u(x)), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


@F.pandas_udf(DoubleType())
def edit_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio; another metric than Levenshtein's."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def first_rule(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the first rule one of whose words is in the text."""
    out = F.lit(default)
    for label, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(c), F.lit(w))
        out = F.when(hit, label).otherwise(out)
    return out


def sections(c: Column, headings: dict[str, list[str]]) -> Column:
    """A struct of the lines under each kind of heading; lines before the first are under `lead`."""
    lines = F.split(F.concat(F.lit("\n"), c), "\n")
    kinds = list(headings)

    def of(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for k in reversed(kinds):
            out = F.when(line.rlike(rf"(?i)^\s*(?:{'|'.join(map(re.escape, headings[k]))})\s*[:：]?"), k).otherwise(out)
        return out

    start = F.struct(F.lit("lead").alias("now"), F.map_from_arrays(F.array(*map(F.lit, ["lead", *kinds])), F.array(*[F.lit("")] * (len(kinds) + 1))).alias("parts"))

    def step(acc: Column, line: Column) -> Column:
        now = F.coalesce(of(line), acc["now"])
        rest = F.when(of(line).isNotNull(), F.regexp_replace(line, r"^[^:：]*[:：]?\s*", "")).otherwise(line)
        parts = F.transform_values(acc["parts"], lambda k, v: F.when(k == now, trim_u(F.concat(v, F.lit("\n"), rest))).otherwise(v))
        return F.struct(now.alias("now"), parts.alias("parts"))

    return F.aggregate(lines, start, step, lambda acc: acc["parts"])


def tfidf(rows: DataFrame, doc: str, tokens: Column, min_df: int = 2, max_features: int | None = 20000) -> DataFrame:
    """L2-normalised weights (doc, term, w) with smooth idf; the most frequent terms by total count."""
    tf = rows.select(doc, F.explode(tokens).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))
    n = rows.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if max_features is not None:
        df = df.orderBy(F.desc("total"), "term").limit(max_features)
    w = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.select(doc, "term", (F.col("w") / norm).alias("w"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors within [-1, 1]; null if one is missing or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.least(F.greatest(F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))), F.lit(-1.0)), F.lit(1.0))


def boundary(word: str) -> str:
    """K2: a pattern for the word between characters that are no Latin letters, digits or one of _+#; CJK neighbours are allowed."""
    return rf"(?<![A-Za-z0-9_+#]){re.escape(word)}(?![A-Za-z0-9_+#])"


def keyword_rows(rows: DataFrame, doc: str, text: str, words: list[str]) -> DataFrame:
    """K5, K8: one row a document and keyword found in it."""
    low = F.lower(F.col(text))
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)) & low.rlike(boundary(w)), F.lit(w)) for w in words]))
    return rows.select(doc, F.explode(hits).alias("skill"))


class Matcher:
    """K1-K4: longest match from the left over a dictionary of aliases, with blocked phrases and words that must or
    must not stand within a window; built once a worker, dictionary size bounds its memory."""

    def __init__(self, aliases: dict[str, str], blocked: list[str] = (), context: dict[str, dict] | None = None, span: int = 30) -> None:
        self.aliases = {a.lower(): c for a, c in aliases.items()}
        order = sorted(self.aliases, key=lambda a: (-len(a), a))
        self.pattern = re.compile("|".join(boundary(a) if re.search("[a-z0-9]", a) else re.escape(a) for a in order)) if order else None
        self.blocked = re.compile("|".join(re.escape(b.lower()) for b in blocked)) if blocked else None
        self.context, self.span = context or {}, span

    def counts(self, text: str | None) -> dict[str, int]:
        low = (text or "").lower()
        shut = [m.span() for m in self.blocked.finditer(low)] if self.blocked else []
        out: dict[str, int] = {}
        for m in self.pattern.finditer(low) if self.pattern else ():
            name = self.aliases[m[0]]
            if any(a < m.end() and m.start() < b for a, b in shut):
                continue
            rule, near = self.context.get(m[0]), low[max(0, m.start() - self.span) : m.end() + self.span]
            if rule and (rule.get("require") and not any(w in near for w in rule["require"]) or any(w in near for w in rule.get("exclude", ()))):
                continue
            out[name] = out.get(name, 0) + 1
        return out


def match_skills(rows: DataFrame, doc: str, text: str, matcher: Matcher) -> DataFrame:
    """K4, K8: (doc, skill, hits) by a Matcher, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(d, s, n) for d, t in zip(b[doc], b[text], strict=True) for s, n in matcher.counts(t).items()]
            yield pd.DataFrame(got, columns=[doc, "skill", "hits"])

    return rows.select(doc, text).where(F.col(doc).isNotNull()).mapInPandas(run, f"{doc} {dict(rows.dtypes)[doc]}, skill string, hits long")


def ranked_demand(members: DataFrame, doc: str, universe: int | DataFrame) -> DataFrame:
    """Documents per skill, the place by count and the share of a fixed universe."""
    n = members.groupBy("skill").agg(F.countDistinct(doc).alias("n"))
    total = universe.agg(F.count("*").alias("total"))
    out = n.crossJoin(F.broadcast(total)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "skill")))
    return out.select("skill", "n", "place", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def cooccurrence(members: DataFrame, doc: str, least: int = 1) -> DataFrame:
    """Joint counts, Jaccard and lift of skill pairs; the base is documents with a skill at all.

    One aggregation of every document's pairs; a skill with itself counts the skill, and no skill the documents.
    """
    sets = members.groupBy(doc).agg(F.array_sort(F.collect_set("skill")).alias("s"))
    both = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    counts = sets.select(F.explode(F.concat(none, both)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("joint"))
    single = counts.where("a = b")
    total = counts.where("a is null").select(F.col("joint").alias("total"))
    pairs = counts.where((F.col("a") < F.col("b")) & (F.col("joint") >= least))
    pairs = pairs.join(single.select("a", F.col("joint").alias("na")), "a").join(single.select("b", F.col("joint").alias("nb")), "b").crossJoin(F.broadcast(total))
    return pairs.select("a", "b", "joint", F.round(F.col("joint") / (F.col("na") + F.col("nb") - F.col("joint")), 6).alias("jaccard"), F.round(F.col("joint") * F.col("total") / (F.col("na") * F.col("nb")), 6).alias("lift"))


def share_matrix(members: DataFrame, doc: str, category: str, sizes: DataFrame) -> DataFrame:
    """Share of a category's documents that have a skill, in long form."""
    n = members.groupBy(category, "skill").agg(F.countDistinct(doc).alias("n"))
    return n.join(sizes, category).select(category, "skill", "n", F.round(F.col("n") / F.col("size"), 6).alias("share"))
