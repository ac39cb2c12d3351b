"""Corpus of posting texts: every derived text, section, flag and skill of a version in one select."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.postings import FLAGGED, HEADINGS, by_family, skills_in, split_sections, text_counts
from tarnfold.operators.texts import clean_text, cjk_bigrams, drop_lines, latin_tokens, remove_until_clean, split_tags

#: Pattern of a pay, which must not be left in a text that a model of the pay reads.
PAY = [r"\d+(?:\.\d+)?(?:\s*[-~至]\s*\d+(?:\.\d+)?)?\s*元?\s*/\s*[天日月]"]


def build_corpus(rows: DataFrame, text: str, tags: str, families: dict[str, str], boilerplate: list[str], pay: list[str] = PAY) -> DataFrame:
    """`rows` plus, from `text` and `tags`: clean, semantic (no boilerplate lines) and safe (no pay) texts, hits and
    residue of pay, a text and a flag per section, the status of the split, counts, skills and their families.

    Nothing is shuffled and the raw columns stay as they are. A null text is empty: no sections, skills or counts.
    """
    out = rows.withColumn("clean", clean_text(F.col(text))).withColumn("semantic", drop_lines(F.col("clean"), boilerplate))
    safe, hits = remove_until_clean(F.col("semantic"), pay)
    out = out.withColumns({"safe": safe, "pay_hits": hits, "_s": split_sections(F.col("clean")), "skills": skills_in(F.col("semantic"), sorted(families)), "tag_list": F.coalesce(split_tags(F.col(tags)), F.array().cast("array<string>"))})
    residue = sum((F.regexp_count("safe", F.lit(p)) for p in pay), F.lit(0))
    parts = {f"section_{k}": F.coalesce(F.element_at("_s.parts", F.lit(k)), F.lit("")) for k in HEADINGS}
    flags = {f"has_{k}": F.map_contains_key("_s.parts", k).cast("int") for k in FLAGGED}
    counts = text_counts(F.col("semantic"), F.concat(latin_tokens(F.col("semantic")), cjk_bigrams(F.col("semantic"))))
    counts["n_paragraphs"] = text_counts(F.col("clean"), F.array())["n_paragraphs"]
    grouped = by_family(F.col("skills"), families)
    groups = F.array_sort(F.map_keys(F.map_filter(grouped, lambda _, v: F.size(v) > 0)))
    return out.withColumns({**parts, **flags, **counts, "status": F.col("_s.status"), "residue": residue, "n_skills": F.size("skills"), "groups": groups}).drop("_s")


def corpus_report(corpus: DataFrame) -> DataFrame:
    """(measure, n) of a corpus in one aggregation: rows, empty texts, flags, rows with pay and with residue, and
    rows by status of the split."""
    sums = {"rows": F.count("*"), "empty": F.count_if(F.col("clean") == ""), "with_pay": F.count_if(F.col("pay_hits") > 0), "with_residue": F.count_if(F.col("residue") > 0), "skills": F.coalesce(F.sum("n_skills"), F.lit(0))}
    sums |= {f"has_{k}": F.coalesce(F.sum(f"has_{k}"), F.lit(0)) for k in FLAGGED}
    sums |= {f"status_{s}": F.count_if(F.col("status") == s) for s in ("完整", "部分", "未识别")}
    one = corpus.agg(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("long").alias("n")) for k, v in sums.items()]).alias("all"))
    return one.select(F.inline("all"))
