"""What several operators of this package share: word rules, the shared folder, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word in a regular expression of Java or RE2: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in spark.checkpoint.dir. Only where that is unset, as in local tests,
    a folder of this machine is made, once for the process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tarnfold-"))
    return f"file://{_OWN[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, clean: bool = True) -> DataFrame:
    """Write `df` to the shared folder and read it again: the lineage ends there, and losing an executor costs nothing.

    With `clean` the JVM is asked to collect garbage afterwards, so that shuffle files that only the written plan
    needed go; steps that shuffle little do without.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    schema = df.schema
    if clean:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what settle() wrote for frames that no later step reads."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim_memory() -> None:
    """Give memory that this process has freed back to the system.

    A Python worker lives on from step to step, and its allocators keep what earlier steps needed.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """`run`, a function of batches, with freed memory given back before its first batch and after its last."""

    def task(batches):
        trim_memory()
        yield from run(batches)
        trim_memory()

    return task


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int):
    """Jobs that run inside send Python Arrow batches of about `most` bytes, not of 10,000 rows however long they are.

    Both the JVM and the worker hold whole batches. The session's own setting comes back afterwards.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """`wanted`, each with as many underscores behind as it takes not to clash with one of `taken`, whatever the case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(batches, rows: int = 1000):
    """Arrow batches cut into slices of `rows`, so that what Python makes of one stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def byte_batches(batches, column: str, most: int):
    """Arrow batches cut into slices of at most `most` bytes of a binary column, or of one row that has more."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64, fixed multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers of an odd multiplier modulo 2**64 and their inverses, grown on demand: base for rolling hashes.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base and of its inverse modulo 2**64."""
    if len(_POWERS.get("p", ())) < n:
        m = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
                out = np.full(m, np.uint64(base), dtype=np.uint64)
                out[0] = 1
                _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph given as rows (a long, b long); returns (node, component).

    The component is its smallest node. Every round gives each node the smallest label among its neighbours and
    itself and then lets it jump to the label of that label; a round is one aggregation with partial sums on the map
    side and two equi-joins whose skewed side Spark can split, so a hub with a third of all edges is fine. Nothing
    but one count a round reaches the driver. Nodes without an edge don't appear. No edges: no rows. Nulls are
    ignored, repeated edges and loops are harmless.
    """
    spark = edges.sparkSession
    edges = edges.where("a is not null and b is not null")
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name, clean=False)
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name, clean=False)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = settle(step, name, clean=False)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = settle(step.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), name, clean=False)
        changed = new.where("label < old").limit(1).count()
        forget(spark, labels, step)
        labels = new
        if not changed:
            forget(spark, both)
            return labels.select("node", F.col("label").alias("component"))
