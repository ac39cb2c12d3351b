"""Tables behind charts, scans of wording and lines, validation of raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.exprs import trim_u


def top_values(rows: DataFrame, column: str, k: int, without: tuple[str, ...] = ()) -> DataFrame:
    """the k most frequent trimmed values that are neither blank nor in `without`; of equal ones the first in order."""
    some = rows.select(trim_u(F.col(column)).alias("value")).where((F.col("value") != "") & ~F.col("value").isin(*without))
    return some.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def pattern_counts(rows: DataFrame, column: str, words: dict[str, list[str]]) -> DataFrame:
    """in how many rows a text has any word of each list, in one pass; case counts."""
    hits = [F.count_if(reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(w)) for w in ws])) for ws in words.values()]
    one = rows.agg(F.array(*[F.struct(F.lit(name).alias("name"), n.alias("n")) for name, n in zip(words, hits, strict=True)]).alias("all"))
    return one.select(F.inline("all"))


def flag_rate_of_top(rows: DataFrame, column: str, flag: Column, k: int) -> DataFrame:
    """rows, flagged rows and their percentage for the k most frequent filled values."""
    per = rows.select(trim_u(F.col(column)).alias("value"), flag.cast("long").alias("f")).where("value <> ''").groupBy("value")
    top = per.agg(F.count("*").alias("total"), F.coalesce(F.sum("f"), F.lit(0)).alias("flagged")).orderBy(F.desc("total"), "value").limit(k)
    return top.withColumn("rate", F.round(F.col("flagged") / F.col("total") * 100, 2))


def tag_counts(rows: DataFrame, column: str, separators: str = r"[,，;；|、]") -> DataFrame:
    """how often each tag occurs; a text is a JSON list or else cut at separators. Blank tags don't count."""
    text = trim_u(F.col(column))
    tags = F.coalesce(F.when(text.rlike(r"^\["), F.from_json(text, "array<string>")), F.split(text, separators))
    return rows.select(F.explode(F.transform(tags, trim_u)).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def wording_scan(rows: DataFrame, columns: list[str], forbidden: list[str], allowed: list[str], shown: int = 80) -> DataFrame:
    """Q10: distinct cells with a forbidden word, the words, and whether one of `allowed` makes the cell compliant."""
    cells = rows.unpivot([], [F.col(c) for c in columns], "field", "text").where("text is not null").distinct()
    found = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(w)), F.lit(w)) for w in forbidden]))
    fine = reduce(lambda a, b: a | b, [F.contains("text", F.lit(w)) for w in allowed], F.lit(False))
    out = cells.withColumn("_found", found).where(F.size("_found") > 0)
    return out.select("field", F.array_join("_found", "、").alias("words"), F.substring("text", 1, shown).alias("start"), fine.cast("int").alias("compliant"))


def line_scan(rows: DataFrame, key: str, text: str, word: str) -> DataFrame:
    """Q11: (key, line, content) of every line with the word; lines count from 1 and are shown trimmed."""
    lines = rows.where(F.contains(text, F.lit(word))).select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("_at", "_line"))
    return lines.where(F.contains("_line", F.lit(word))).select(key, (F.col("_at") + 1).cast("long").alias("line"), trim_u(F.col("_line")).alias("content"))


def raw_validation(rows: DataFrame, mapping: dict[str, str], required: list[str], key: str) -> DataFrame:
    """One row: rows, columns that the mapping lacks or names in vain, required ones that lack, null and repeated keys."""
    names = set(rows.columns)
    odd = {"unmapped": names - set(mapping), "unused": set(mapping) - names, "missing": set(required) - names}
    per = rows.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        *[F.lit(",".join(sorted(v))).alias(k) for k, v in odd.items()],
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("repeated_keys"),
    )
