"""Mixing sources by a time-varying curriculum. DataFrame functions only.

Each source has a weight schedule ``w(t) = base * (1 + tilt * (2 t - 1))`` over training time t in [0, 1]. Its demand is its share of all
sizes by base weights, limited to ``max_epochs`` times its size, the excess reshared by weight. The integral of
the schedule times the demand is the cumulative demand in words; inverting it at the words that stand before a document (in a keyed
order of its source, over again in each epoch) gives the document's training position, and documents are range-sorted by it.

Sums before a document are taken in two steps, since a source may hold a third of all rows: rows are dealt by (source, bucket of the
keyed order), buckets are summed (map-side), and the running sum over a source's buckets is added to one within the bucket.

Defined results: null text has size 0 and is taken 0 times; the null source is a source and comes last in order; repeated rows and
equal ids are documents of their own, told apart by a content key, and rows equal in all of it are interchangeable; null ids are
allowed; a source of size 0 has target 0; an empty table gives an empty result; other columns are carried by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

#: Rows that a bucket of a source may hold on average if all rows are of one source, and least number of buckets. A bucket is a group of the
#: window that sums within it, and a row of the one that sums over a source.
BUCKET_ROWS, BUCKETS = 1 << 16, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, h): all that mixing needs of a document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size), one row per source.

    target = min(max_epochs * size, L * weight) with L such that targets add up to all sizes. In order of limit over weight the
    limited sources are a prefix, so L follows from running sums. These windows hold one row per source.
    """
    one = W.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    k = F.row_number().over(one) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (k % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    order = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = s.withColumns({"room": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # the first source in this order that is within its limit fixes the level for all after it
    s = s.withColumn("free", F.col("room") * F.col("weight") <= F.col("cap") * F.col("left"))
    level = F.first(F.when(F.col("free"), F.struct("room", "left")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise((F.col("level.room") * F.col("weight")).cast("double") / F.col("level.left"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def assign(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """Rows of :func:`sized` with source_size, weight, target, before (words of the source ahead of it) and copies."""
    b = sizes.withColumn("bucket", F.shiftright(F.col("h"), 32).cast("long") % buckets)
    b = b.withColumn("bucket", F.pmod("bucket", F.lit(buckets)).cast("int"))
    sums = b.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    own = W.partitionBy("source")
    sums = sums.withColumns({"bucket_before": F.sum("bucket_size").over(own.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("bucket_size"), "source_size": F.sum("bucket_size").over(own)})
    plan = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    plan = plan.select(F.col("source").alias("p_source"), "weight", "target")
    sums = sums.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source").select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "bucket_before", "source_size", "weight", "target")
    b = b.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket"))).drop("s_source", "s_bucket")
    inner = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    b = b.withColumn("before", F.col("bucket_before") + F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    # copy e (0, 1, ...) is taken if its middle lies below the target
    mid = F.col("before") + F.col("size") / 2
    copies = F.when(F.col("size") > 0, F.least(F.lit(max_epochs), F.greatest(F.lit(0), F.ceil((F.col("target") - mid) / F.col("source_size"))))).otherwise(0)
    return b.withColumn("copies", copies.cast("long"))


def position(u: Column, demand: Column, tilt: Column) -> Column:
    """Time in [0, 1] at which cumulative demand reaches u: inverse of demand * (t + tilt * (t² - t))."""
    x = F.least(F.lit(1.0), u / demand)
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - tilt) * (1 - tilt) + 4 * tilt * x))
    return F.when(F.abs(tilt) < 1e-9, x).otherwise(2 * x / (1 - tilt + root))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), tilts: tuple[float, ...] = (-0.5, 0.0, 0.5), max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each as often as it is taken, with a ``mix_position`` and ranges of it in the order of partitions.

    ``tilts`` go with ``weights``: early sources have a negative one. |tilt| < 1.
    """
    mixed = _mixed(docs, planned(docs, weights, max_epochs, seed, id_col, text_col, source_col), weights, tilts, seed, id_col, text_col, source_col)
    return mixed.select("row.*", "mix_position")


def planned(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of :func:`assign` for all documents, those equal in id and text numbered by ``nth``."""
    sizes = cut(sized(docs, seed, id_col, text_col, source_col))
    plan = assign(sizes, weights, max_epochs, max(BUCKETS, 1 << (max(1, sizes.count() // BUCKET_ROWS) - 1).bit_length()))
    return plan.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "h").orderBy("source", "before")))


def _mixed(docs: DataFrame, plan: DataFrame, weights: tuple[int, ...], tilts: tuple[float, ...], seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, mix_position, p_id, p_h, nth): a row for each copy, range-sorted by position."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").cast("string").alias("source"))
    tilt = F.element_at(F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*map(F.lit, tilts))), F.col("weight"))
    u = F.col("before") + F.col("epoch") * F.col("source_size")
    # rows equal in id, text and source are numbered alike on both sides
    plan = plan.where("copies > 0").select(F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"), "nth", "source_size", "target", "weight", "before", "copies")
    base = base.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("b_nth", F.row_number().over(W.partitionBy("doc_id", "h").orderBy("source")))
    j = base.join(plan, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")) & (F.col("b_nth") == F.col("nth")))
    j = j.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    j = j.withColumn("mix_position", position(u, F.greatest("target", F.lit(1.0)), tilt)).withColumn("id", F.col(f"row.`{id_col}`"))
    return j.select("row", "mix_position", "p_id", "p_h", "nth", "id").repartitionByRange("mix_position", "id").sortWithinPartitions("mix_position", "id")


def taken(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), tilts: tuple[float, ...] = (-0.5, 0.0, 0.5), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken, positions) for every document: what :func:`mix` makes of it.

    ``positions`` are those of its copies in the mix, ascending; a document that is not taken has none.
    """
    plan = planned(docs, weights, max_epochs, seed)
    mixed = _mixed(docs, plan, weights, tilts, seed, "doc_id", "text", "source")
    placed = mixed.groupBy("p_id", "p_h", "nth").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("mix_position")).alias("positions"))
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")) & (F.col("plan.nth") == F.col("placed.nth"))
    out = plan.alias("plan").join(placed.alias("placed"), same, "left")
    none = F.array().cast("array<double>")
    return out.select("doc_id", "size", "source_size", "target", (F.coalesce("n", F.lit(0)) * F.col("size")).alias("taken"), F.coalesce("positions", none).alias("positions"))
