"""Exact document fingerprints: a wide digest of the canonical text, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written


def _icu(owner: str, method: str, text: Column) -> Column:
    return F.java_method(F.lit(f"com.ibm.icu.{owner}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """Compatibility composition, full case folding, composition again, white space runs as one blank, none at the ends; null as ''."""
    composed = _icu("text.Normalizer", "compose", F.coalesce(text, F.lit("")))
    folded = _icu("text.Normalizer", "compose", _icu("lang.UCharacter", "foldCase", composed))
    return F.btrim(F.regexp_replace(folded, r"[\s\x{85}\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits: of the text, and of its length and reversal."""
    second = F.xxhash64(F.length(canon), F.reverse(canon))
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(canon), second))))


def following(ids: DataFrame) -> DataFrame:
    """(*ids, next) for ``ids(k, ...)`` with distinct k: the next greater k, after the last the first.

    The rows are dealt by range into a written table; its blocks find their own neighbours,
    and a table of one row for each block links them.
    """
    ranged = written(ids.repartitionByRange("k").withColumn("block", F.spark_partition_id()), "ranged")
    order = Window.orderBy("block")
    heads = ranged.groupBy("block").agg(F.min("k").alias("head"))
    heads = heads.select("block", F.coalesce(F.lead("head").over(order), F.min("head").over(Window.partitionBy())).alias("after"))
    inside = Window.partitionBy("block").orderBy("k")
    return (
        ranged.withColumn("within", F.lead("k").over(inside))
        .join(heads, "block")
        .withColumn("next", F.coalesce("within", "after"))
        .drop("block", "within", "after")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of ``docs(doc_id long, text)``: its fingerprint, and how it fares when the text is edited.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text has its last quarter replaced by the start of the next
    document's. A likeness is 1.0 for equal canonical texts and 0.0 otherwise. Documents
    whose digests are equal have their canonical bytes compared; should they differ, an
    ordinal in the bucket follows the digest. An edited text is compared by bytes with its
    own document; that it equals another one's fingerprint rests on the digest's 128 bits.

    A null text is ''. A null id comes before all others. Rows that share an id all have
    the same next document, and stand before it with the least (hash, text) among them.
    A single document is its own next one. Other columns are not read.
    """
    texts = docs.select(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = F.xxhash64("text").alias("h")
    plain = written(texts.select("k", hashed, F.length("text").alias("n"), canonical(F.col("text")).alias("c")).select("k", "h", "n", digest(F.col("c")).alias("d")), "digests")
    # Rows in buckets with others keep their canonical text for the comparison of bytes.
    alike = written(plain.groupBy("d").agg(F.count("*").alias("m")).where("m > 1").select("d"), "alike")
    suspects = plain.join(alike, "d").select("k").distinct().withColumn("suspect", F.lit(True))
    order = following(plain.groupBy("k").agg(F.max(F.expr("n div 4")).alias("need")))
    order = written(order.join(suspects, "k", "left").withColumn("suspect", F.coalesce("suspect", F.lit(False))), "next")

    # The texts are shuffled by id once; both uses below share that exchange.
    starts = (
        texts.select("k", "text").join(order.select(F.col("next").alias("k"), F.col("k").alias("owner"), "need", "suspect"), "k")
        .select(F.col("owner").alias("k"), hashed, F.expr("left(text, cast(need as int))").alias("start"), "suspect")
        .groupBy("k").agg(F.min(F.struct("h", "start"))["start"].alias("start"), F.max("suspect").alias("suspect"))
    )
    edited = (
        texts.select("k", "text").join(starts, "k")
        .select("k", "suspect", hashed, F.length("text").alias("n"), "text", F.expr("concat(left(text, length(text) - length(text) div 4), left(start, length(text) div 4))").alias("edited"))
        .select("k", "suspect", "h", "n", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("e"))
        .select("k", "h", "n", "edited_sha256", digest(F.col("c")).alias("d"), digest(F.col("e")).alias("ed"), (F.col("c") == F.col("e")).alias("same"), F.when(F.col("suspect"), F.col("c")).alias("c"))
    )
    with_text = written(edited, "edited")

    # Equal buckets: equal texts collapse where they lie before they move, so copies cost nothing more.
    distinct = with_text.where("c is not null").groupBy("d", "c").agg(F.count("*").alias("m"))
    clashing = written(distinct.groupBy("d").agg(F.count("*").alias("m")).where("m > 1").select("d"), "clashing")
    done = with_text.drop("c")
    if not clashing.isEmpty():
        ordinals = with_text.join(clashing, "d").select("d", "h", "c").distinct().select("d", "h", (F.dense_rank().over(Window.partitionBy("d").orderBy("c")) - 1).alias("ordinal"))
        done = done.join(ordinals, ["d", "h"], "left").withColumn("d", F.when(F.col("ordinal") > 0, F.concat("d", F.lit("-"), F.col("ordinal"))).otherwise(F.col("d"))).drop("ordinal")
    after = done.groupBy("k").agg(F.min(F.struct("h", "d"))["d"].alias("nd"))
    after = order.join(after.withColumnRenamed("k", "next"), "next").select("k", "nd")
    out = done.join(after, "k").select(
        F.when(F.col("k.known"), F.col("k.id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        F.col("d").alias("fingerprint"),
        F.when(F.col("same"), F.col("d")).otherwise(F.col("ed")).alias("edited_fingerprint"),
        F.when(F.col("same"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("near_edited"),
        F.when(F.col("d") == F.col("nd"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("near_next"),
    )
    dropped(plain, alike)
    return out
