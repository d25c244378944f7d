"""What the corpus operators share: reading tables, cutting lineage, words, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java pattern: the blank, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


_memories: dict[str, Callable[[], None]] = {}


def alone(name: str, forget: Callable[[], None]) -> None:
    """Begin work whose words a Python worker remembers, and forget what other work remembered in it.

    Spark uses a worker for one stage after the other. Each operator bounds what it remembers, but not what those before
    it left behind, and an executor holds several workers. Results do not depend on it.
    """
    others = [_memories.pop(k) for k in list(_memories) if k != name]
    _memories[name] = forget
    for other in others:
        other()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, TypeError, AttributeError):  # only some C libraries can give memory back
            ctypes.CDLL(None).malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one the session names in ``spark.checkpoint.dir``. Only a session whose executors live in the driver's
    own process may go without; it gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="burnish-llm-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: a lost executor costs reading a file again, and later passes read only what they need.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(text: Column) -> Column:
    """The UTF-8 bytes of a text; none for a missing one."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for a missing one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name like the one given that ``df`` does not have."""
    taken = {n.lower() for n in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(links: DataFrame, left: str = "a", right: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of links between ids: rows (id, component_id), the smallest id that links reach.

    Alternates two steps until nothing changes: every id hands the smallest id it knows to its larger neighbours,
    then to its smaller ones. Both are joins and grouped minima, so no list of neighbours is ever gathered, and the
    number of rounds grows with the logarithm of the longest chain. Ids without links are not in the result.
    """
    a, b = F.col("a"), F.col("b")
    edges = keep(
        links.select(F.col(left).alias("a"), F.col(right).alias("b"))
        .where("a <> b")
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # To larger neighbours, and the id itself: (v, m(u)) for each neighbour v > u.
        out = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u")
        large = keep(out.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        # To smaller neighbours and itself: each id's smallest neighbour becomes that of all its smaller neighbours.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = keep(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return found.union(roots)
