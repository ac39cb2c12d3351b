"""Language identification by nearest centroids of character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfold.llm.common import free_names, trim_memory
from tarnfold.tables import table

#: Dimensions of the hashed trigram space; centroids a language; labelled rows that the classifier is fitted on at
#: most, in all and of one language.
DIMS, CENTROIDS, SAMPLE, PER_LANGUAGE = 4096, 4, 4000, 600
#: A text is rejected if its similarity is under this part of a low quantile of those of its centroid's training rows.
SLACK, LOW = 0.5, 0.01
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def grams(text: str) -> np.ndarray:
    """Counts of the text's byte trigrams (A-Z lower-cased, a blank at either end) in DIMS hashed dimensions, as log(1 + n)."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").lower() + b" ", np.uint8).astype(np.uint32)
    code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
    return np.log1p(np.bincount(code >> np.uint32(32 - 12), minlength=DIMS).astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(vectors: np.ndarray, langs: list[str], k: int = CENTROIDS) -> dict:
    """IDF, and for each language up to k unit centroids of its rows by spherical k-means, with a low quantile of its rows' similarities."""
    idf = (np.log((1 + len(vectors)) / (1 + (vectors > 0).sum(0))) + 1).astype(np.float32)
    vectors = _unit(vectors * idf)
    centroids, owners, least = [], [], []
    for lang in sorted(set(langs)):
        x = vectors[[i for i, y in enumerate(langs) if y == lang]]
        c = [_unit(x.mean(0))]
        while len(c) < min(k, len(x)):  # the row that is furthest from all so far
            c.append(x[int(np.argmin((x @ np.array(c).T).max(1)))])
        c = np.array(c)
        for _ in range(12):
            near = (x @ c.T).argmax(1)
            c = np.array([_unit(x[near == j].sum(0)) if (near == j).any() else c[j] for j in range(len(c))])
        centroids.append(c)
        owners += [lang] * len(c)
        sims = x @ c.T
        near = sims.argmax(1)
        whole = float(np.quantile(sims.max(1), LOW))
        least += [float(np.quantile(sims[near == j, j], LOW)) if (near == j).sum() >= 20 else whole for j in range(len(c))]
    return {"idf": idf, "centroids": np.concatenate(centroids) if centroids else np.zeros((0, DIMS), np.float32), "owners": owners, "least": least}


def training_rows(labelled: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Vectors and languages of a bounded sample of rows (doc_id, text, lang), evenly over the languages, by hash of the id.

    The first rows in hash order of 64 hash ranges a language are ranked, so no task ranks a whole language, and the
    first of those are taken, at least one of every language. At most `sample` vectors of DIMS floats reach the driver,
    or one a language if there are more of those.
    """
    labelled = labelled.where("lang is not null and text is not null")
    langs = max(1, labelled.select("lang").distinct().count())
    each = max(1, min(per_language, sample // langs))
    mark = F.xxhash64("doc_id")
    salted = labelled.select("doc_id", "lang", mark.alias("mark"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(64)).alias("salt"))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("mark", "doc_id"))
    ranked = salted.withColumn("nth", nth("lang", "salt")).where(F.col("nth") <= -(-each // 64))
    chosen = ranked.withColumn("nth", nth("lang")).where(F.col("nth") <= each).select("doc_id", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        for batch in batches:
            keep = [(t, lang) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in keep], pa.string()), pa.array([grams(t).tobytes() for t, _ in keep], pa.binary())], names=["lang", "vector"])

    texts = labelled.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    rows = texts.drop("doc_id").mapInArrow(run, "lang string, vector binary").collect()
    rows = sorted((r["lang"], bytes(r["vector"])) for r in rows)
    vectors = np.array([np.frombuffer(v, np.float32) for _, v in rows]) if rows else np.zeros((0, DIMS), np.float32)
    return vectors, [x for x, _ in rows]


def judge(spark: SparkSession, model: dict, slack: float = SLACK) -> Callable[[Column], Column]:
    """What gives each text of a column its lang_pred, score and rejected, as one struct.

    Every whole text's unit TF-IDF vector is compared with all centroids; the nearest one's language is predicted and
    the cosine is the score. `rejected` says that the text has no letter or lies too far from every language: under
    `slack` of the low quantile of its centroid. Null texts, texts without a letter, and all texts if the model
    has no centroid are `und` with score 0. Ties go to the first language in order. Only the texts go to Python and only
    the three values come back.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trim_memory()
        m = shared.value
        table_ = (m["centroids"] * m["idf"]).T.astype(np.float32)
        for texts in batches:
            pred, score, rejected, text = [], [], [], None
            for text in texts:
                text = text.as_py()
                if not text or not m["owners"] or not has_letter(text):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    rejected.append(True)
                    continue
                v = grams(text)
                sims = (v @ table_) / max(float(np.linalg.norm(v * m["idf"])), 1e-12)
                best = int(sims.argmax())
                pred.append(m["owners"][best])
                score.append(float(min(1.0, max(0.0, sims[best]))))
                rejected.append(score[-1] < slack * m["least"][best])
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])
            del texts, text
        trim_memory()

    return judged


def identify(docs: DataFrame, model: dict, slack: float = SLACK) -> DataFrame:
    """`docs` plus lang_pred, score and rejected, as judge() gives them.

    The columns lang_pred, score and rejected are replaced if `docs` has them; other columns stay as they are.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    [found] = free_names(docs.columns, "found")
    out = docs.withColumn(found, judge(docs.sparkSession, model, slack)(F.col("text")))
    return out.select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns), f"{found}.lang_pred", f"{found}.score", f"{found}.rejected")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame) -> dict:
    """The model learned from labelled rows of `docs` that are not held out."""
    return fit(*training_rows(docs.where(~held_out()).select("doc_id", "text", "lang")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fitted(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
