"""Sources and sinks: databases, verified Parquet, CSV, JSON, vectors, records in Markdown, list pages."""

from __future__ import annotations

import html.parser
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jdbc(spark: SparkSession, options: dict[str, str], table: str, key: str, low: int, high: int, parts: int = 32, fetch: int = 20_000) -> DataFrame:
    """A table in ranges of a whole-number key; connection options come from the caller."""
    return spark.read.format("jdbc").options(**options, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), fetchsize=str(fetch)).load()


def write_jdbc(rows: DataFrame, options: dict[str, str], table: str, mode: str = "overwrite") -> None:
    """S16."""
    rows.write.format("jdbc").options(**options, dbtable=table).mode(mode).save()


def normalized(rows: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema, in order and type; a missing or surplus column is an error."""
    odd = set(rows.columns) ^ set(schema.names)
    if odd:
        raise ValueError(f"columns that only one side has: {sorted(odd)}")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_checked(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet with the wanted columns only; an empty table is an error."""
    rows = spark.read.parquet(path)
    rows = rows.select(*columns) if columns else rows
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def write_checked(rows: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write Parquet, read it back and compare columns and rows; rows are counted as they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("compression", "snappy").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    if back.columns != rows.columns or back.count() != seen.get["n"]:
        raise ValueError(f"{path} isn't what was written")
    return seen.get["n"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that its scheme names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_or_export(spark: SparkSession, path: str, export: Callable[[], DataFrame], reuse: bool = True, force: bool = False) -> tuple[DataFrame, str]:
    """The table at `path` and whether it was reused or exported.

    With `force`, or with neither `reuse` nor a table there, it is exported first; `reuse` without a table is an error.
    """
    there = path_exists(spark, path)
    if force or not (reuse or there):
        write_checked(export(), path, "overwrite")
        return read_checked(spark, path), "exported"
    if not there:
        raise FileNotFoundError(f"{path} isn't there and no export was asked for")
    return read_checked(spark, path), "reused"


def write_vectors(rows: DataFrame, key: str, vector: str, path: str, about: dict[str, str]) -> dict:
    """(key, vector) as Parquet and a description beside it; all vectors must have one length."""
    n = write_checked(rows.select(key, F.col(vector).cast("array<float>").alias("vector")), f"{path}/vectors", "overwrite")
    spark = rows.sparkSession
    sizes = [r[0] for r in spark.read.parquet(f"{path}/vectors").where("vector is not null").select(F.size("vector")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"{path} has vectors of several lengths")
    meta = {**about, "key": key, "rows": n, "dims": sizes[0] if sizes else 0}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return meta


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/vectors"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def with_section(record: str, title: str, body: str) -> str:
    """A Markdown record whose section `title` is `body`; doing so twice changes nothing more, others stay as they are."""
    section = f"## {title}\n\n{body.strip()}\n"
    found = re.search(rf"^## {re.escape(title)}[ \t]*$.*?(?=^## |\Z)", record, re.M | re.S)
    if not found:
        return f"{record.rstrip()}\n\n{section}" if record.strip() else section
    rest = record[found.end() :]
    return record[: found.start()] + section + ("\n" + rest if rest else "")


def write_csv(rows: DataFrame, path: str) -> None:
    """S9."""
    rows.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def write_json(rows: DataFrame, path: str) -> None:
    """S11."""
    rows.write.mode("overwrite").json(path)


def write_sheets(sheets: dict[str, DataFrame], folder: str, longest: int = 32_000) -> None:
    """A Parquet table a sheet; lists are joined and long cells cut as spreadsheets need it."""
    for name, rows in sheets.items():
        cells = [F.concat_ws("|", c) if k.startswith("array") else F.substring(c, 1, longest) if k == "string" else F.col(c) for c, k in rows.dtypes]
        rows.select(*[x.alias(c) for x, c in zip(cells, rows.columns, strict=True)]).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines by a stated schema; a line that doesn't fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_sheets(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables that write_sheets() left."""
    return {name: read_checked(spark, f"{folder}/{name}") for name in names}


class _Links(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.links: list[tuple[str, str]] = []
        self.href: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.text).split())))
            self.href = None


def page_links(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, place, href, label) of every link of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b[key], b[page], strict=True):
                p = _Links()
                p.feed(text or "")
                rows += [(k, i, h, t) for i, (h, t) in enumerate(p.links)]
            yield pd.DataFrame(rows, columns=[key, "place", "href", "label"])

    return pages.select(key, page).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, place long, href string, label string")
