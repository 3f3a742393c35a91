"""Helpers that several operators share: tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one where it is unset on a local master, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="meshweave-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshweave/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # nothing reads the shuffle files of this query once it is written
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._meshweave_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._meshweave_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges(a long, b long)``.

    Returns (node, root), root being the smallest node of the component, for the nodes
    that have an edge. Null ends and loops are ignored; repeated edges don't matter; no
    edges give no rows. Every round hooks each node to its smallest neighbour, shortens
    the pointers until they are stars, and keeps the edges between different stars, so
    the number of rounds is logarithmic. Each step is a join of two written tables,
    which the adaptive planner may split where one root is hot.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    stars = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = written(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            .select("node", F.least("node", "root").alias("root")),
            "hook",
        )
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = written(
                hook.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")),
                "jump",
            )
            moved = not jumped.where("moved").isEmpty()
            dropped(hook)
            hook = written(jumped.drop("moved"), "hook") if moved else jumped
            if not moved:
                break
            dropped(jumped)
        hook = hook.select("node", "root")
        a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        halfway = written(left.join(a, "a").select("ra", "b"), "halfway")
        rest = written(halfway.join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        dropped(halfway, left)
        left = rest
        if stars is None:
            stars = written(hook, "stars")
        else:
            new = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            stars = written(stars.join(new, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "stars")
    dropped(left)
    if stars is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return stars
