"""Mates: joins of placements, orientation, labels and weights; insert sizes and their histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores

SIDE = ["strand", "seq_idx", "r_start", "r_end", "mapq", "prob"]


def mate_join(a: DataFrame, depth: int = 0, library: str = "pe", lo: int = 0, hi: int = 500) -> DataFrame:
    """Pairs of placements of both mates up to a rank: an equi-join on the read, then expressions."""
    side = lambda m, p: a.where((F.col("mate") == m) & (F.col("sw_rank") <= depth)).select("read_id", *[F.col(c).alias(p + c) for c in SIDE])
    j = side(1, "a_").join(side(2, "b_"), "read_id")
    j = j.withColumns({"same_ref": F.col("a_seq_idx") == F.col("b_seq_idx"), "isize": scores.insert_size(F.col("a_r_start"), F.col("a_r_end"), F.col("b_r_start"), F.col("b_r_end"))})
    proper = F.col("same_ref") & scores.is_proper(library, F.col("a_strand"), F.col("b_strand"), F.col("isize"))
    j = j.withColumn("proper", proper).withColumn("within", F.col("same_ref") & F.abs("isize").between(lo, hi))
    return j.withColumn("label", scores.label(F.lit(True), F.col("same_ref"), F.col("proper"), F.col("within")))


def weighted(p: DataFrame) -> DataFrame:
    """Weight of each pair, and its share among the read's."""
    prior = F.when(F.col("proper") & F.col("within"), 0.9999 * 0.997).when(F.col("proper"), 0.9999 * 0.003).otherwise(0.0001)
    w = p.withColumn("weight", F.col("a_prob") * F.col("b_prob") * prior)
    return w.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("read_id")))


#: Prior mass of proper pairs, of those within the insert limits among them, and of all others.
PROPER, INSIDE = 0.9999, 0.997
#: Written out: 1 - 0.997 and 1 - 0.9999 are other doubles, and a share that lies halfway would be rounded the other way.
OUTSIDE, IMPROPER = 0.003, 0.0001
#: Pairs of a read that are looked at when only proper ones are wanted.
MOST_PAIRS = 1028


def find_pairs(a: DataFrame, library: str = "pe", lo: int = 0, hi: int = 500) -> DataFrame:
    """Pairs of placements (read_id, mate 1 or 2, ord, strand, seq_idx, r_start, r_end, prob, single) of both mates, classified.

    An equi-join on the read, whose placements are few; ``isize`` is signed, ``proper`` and ``within`` need one sequence.
    """
    cols = ["ord", "strand", "seq_idx", "r_start", "r_end", "sw_score", "mapq", "prob", "single"]
    side = lambda m, p: a.where(F.col("mate") == m).select("read_id", *[F.col(c).alias(p + c) for c in cols])
    j = side(1, "a_").join(side(2, "b_"), "read_id")
    j = j.withColumns({"same_ref": F.col("a_seq_idx") == F.col("b_seq_idx"), "isize": scores.insert_size(F.col("a_r_start"), F.col("a_r_end"), F.col("b_r_start"), F.col("b_r_end")).cast("long")})
    proper = F.col("same_ref") & scores.is_proper(library, F.col("a_strand"), F.col("b_strand"), F.col("isize"))
    return j.withColumn("proper", proper).withColumn("within", F.col("same_ref") & F.abs("isize").between(lo, hi))


def proper_pairs(a: DataFrame, lo: int = 0, hi: int = 500, min_score: int = 0, most: int = MOST_PAIRS, library: str = "pe") -> DataFrame:
    """Proper pairs of best placements within the limits, ``most`` a read at most, by score, then place: the search that decides whether a rescue worked."""
    j = find_pairs(a.where("sw_rank = 0"), library, lo, hi).where((F.col("b_sw_score") >= min_score) & F.col("proper") & F.col("within"))
    order = Window.partitionBy("read_id").orderBy((F.col("a_sw_score") + F.col("b_sw_score")).desc(), "a_ord", "b_ord")
    return j.withColumn("pair_rank", F.row_number().over(order)).where(F.col("pair_rank") <= most)


def weights(p: DataFrame, hist: DataFrame | None = None) -> DataFrame:
    """Adds weight, and a_else and b_else: mass of the case that a mate's single placement is wrong, the other's right.

    p: of :func:`find_pairs`, with ``restricted`` (the mate that was only looked for near the other, or 0), which can't be surer than
    that one. With a smoothed histogram (lo, n_smooth, width) and several pairs, an insert counts by the share of smaller ones.
    """
    pa, pb = F.col("a_prob"), F.col("b_prob")
    p = p.withColumns({"a_prob": F.when((F.col("restricted") == 1) & (pa > pb), pb).otherwise(pa), "b_prob": F.when((F.col("restricted") == 2) & (pb > pa), pa).otherwise(pb)})
    inside = F.lit(PROPER * INSIDE)
    if hist is not None:
        below = cumulative_share(p.select("read_id", "a_ord", "b_ord", F.abs("isize").alias("size")), hist)
        p = p.join(below, ["read_id", "a_ord", "b_ord"], "left").withColumn("_n", F.count("*").over(Window.partitionBy("read_id")))
        s = F.coalesce("share_below", F.lit(1.0))
        inside = F.when(F.col("_n") < 2, inside).otherwise(F.when(s >= 0.5, 0.5 - s / 2).otherwise(PROPER) * (s * INSIDE + OUTSIDE))
    prior = F.when(F.col("proper") & F.col("within"), inside).when(F.col("proper"), PROPER * OUTSIDE).otherwise(IMPROPER)
    out = IMPROPER + PROPER * OUTSIDE
    p = p.withColumn("weight", F.col("a_prob") * F.col("b_prob") * prior)
    p = p.withColumns({"b_else": F.when(F.col("a_single"), (1 - F.col("a_prob")) * out * F.col("b_prob")).otherwise(0.0), "a_else": F.when(F.col("b_single"), F.col("a_prob") * out * (1 - F.col("b_prob"))).otherwise(0.0)})
    return p.drop("_n", "share_below")


def marginals(p: DataFrame) -> DataFrame:
    """Adds share (of the read's mass), and a_q and b_q: qualities of each mate's placement over all pairs that it is in."""
    per = Window.partitionBy("read_id")
    total = F.greatest(F.lit(1e-7), F.sum(F.col("weight") + F.col("a_else") + F.col("b_else")).over(per) + 1e-7)
    p = p.withColumns({"_t": total, "_a": F.sum("weight").over(Window.partitionBy("read_id", "a_ord")) + F.sum("a_else").over(per), "_b": F.sum("weight").over(Window.partitionBy("read_id", "b_ord")) + F.sum("b_else").over(per)})
    p = p.withColumns({"share": F.col("weight") / F.col("_t"), "a_q": scores.phred_of(F.col("_a") / F.col("_t")), "b_q": scores.phred_of(F.col("_b") / F.col("_t"))})
    return p.drop("_t", "_a", "_b")


def mate_windows(a: DataFrame, lo: int, hi: int) -> DataFrame:
    """Where the other mate of a placement may stand: (read_id, seq_idx, lo, hi), from 1."""
    left = F.when(F.col("strand") == "+", F.col("r_start") + lo).otherwise(F.col("r_end") - hi)
    right = F.when(F.col("strand") == "+", F.col("r_start") + hi).otherwise(F.col("r_end") - lo)
    return a.select("read_id", "seq_idx", F.greatest(F.lit(1), left).alias("lo"), right.alias("hi")).where("hi >= lo")


def in_windows(hits: DataFrame, windows: DataFrame, width: int = 1024) -> DataFrame:
    """Hits within windows: windows are laid on bins, so this is an equi-join, then exact."""
    w = windows.withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"hi div {width}"))))
    h = hits.withColumn("bin", F.expr(f"pos div {width}"))
    return h.join(w, ["read_id", "seq_idx", "bin"]).where("pos BETWEEN lo AND hi").drop("bin", "lo", "hi").distinct()


#: Pairs that a sample aims at.
SAMPLE = 4098


def sampling_interval(total: int, at_most: int | None = None) -> int:
    """Every how many-th pair is sampled: total / 4098, one at least, and no more than ``at_most`` if that is given."""
    n = max(1, total // SAMPLE)
    return min(n, max(1, at_most)) if at_most is not None else n


def every_nth(reads: DataFrame, n: int, key: str = "read_id") -> DataFrame:
    return reads.where(F.pmod(F.col(key), F.lit(n)) == 0)


def inferred_inserts(a: DataFrame, least_quality: int = 20, other_refs: bool = False) -> DataFrame:
    """(read_id, isize) of pairs whose best placements are both sure; of one sequence, unless ``other_refs``."""
    j = find_pairs(a.where((F.col("ord") == 0) & (F.col("mapq") >= least_quality)))
    return (j if other_refs else j.where("same_ref")).select("read_id", "isize")


def quartiles(sizes: DataFrame) -> DataFrame:
    """(n, q1, q2, q3): entries number floor(n q) of the sorted sizes, from counts per size and their running sum."""
    c = sizes.groupBy("isize").agg(F.count("*").alias("c"))
    run = c.withColumn("upto", F.sum("c").over(Window.orderBy("isize")))
    n = F.sum("c").over(Window.partitionBy())
    run = run.withColumn("n", n)
    pick = lambda k: F.min(F.when(F.col("upto") > F.expr(f"(n * {k}) div 4"), F.col("isize")))
    return run.groupBy("n").agg(pick(1).alias("q1"), pick(2).alias("q2"), pick(3).alias("q3"))


def derived_histogram(sizes: DataFrame) -> DataFrame:
    """(bin, lo, width, n, n_below, n_above): bins over six quartile ranges round the median, 3 sqrt(n) of them within 16 and 1028.

    A bin is at least 1 wide. Sizes out of this range are in no bin but counted, on every row, in n_below and n_above.
    """
    p = quartiles(sizes)
    p = p.withColumns({"range": 6 * (F.col("q3") - F.col("q1")), "bins": F.least(F.lit(1028), F.greatest(F.lit(16), F.floor(3 * F.sqrt("n")).cast("long")))})
    p = p.withColumn("width", F.greatest(F.lit(1), F.expr("range div bins")))
    p = p.withColumn("bins", F.greatest(F.lit(1), F.when(F.expr("range div bins") < 1, F.col("range")).otherwise(F.col("bins"))))
    p = p.select("width", "bins", (F.col("q2") - F.expr("(width * bins) div 2")).alias("first"))
    # p is one row
    b = sizes.groupBy("isize").agg(F.count("*").alias("c")).join(F.broadcast(p), how="cross")
    b = b.withColumn("bin", F.floor((F.col("isize") - F.col("first")) / F.col("width")).cast("int"))
    b = b.withColumn("bin", F.when(F.col("bin") < 0, -1).when(F.col("bin") >= F.col("bins"), F.col("bins").cast("int")).otherwise(F.col("bin")))
    b = b.groupBy("bin", "first", "width", "bins").agg(F.sum("c").alias("n"))
    every = Window.partitionBy()
    out = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0)).over(every)
    b = b.withColumns({"n_below": out(F.col("bin") < 0), "n_above": out(F.col("bin") >= F.col("bins"))})
    return b.where("bin >= 0 AND bin < bins").select("bin", (F.col("first") + F.col("bin") * F.col("width")).alias("lo"), "width", "n", "n_below", "n_above")


def bandwidth(sizes: DataFrame) -> float:
    """Of the smoothing, in bins: 0.9 n^-0.2 IQR / 1.34, three at least; the quartile range is counted in the histogram's bins."""
    q = quartiles(sizes).first()
    if q is None:
        return 3.0
    iqr = q["q3"] - q["q1"]
    bins = min(1028, max(16, int(3 * q["n"] ** 0.5)))
    width = max(1, 6 * iqr // bins)
    return max(3.0, 0.9 * q["n"] ** -0.2 * (iqr / width) / 1.34)


def smooth(hist: DataFrame, bandwidth: float, reach: float = 3.0) -> DataFrame:
    """Gaussian sums over bins within ``reach`` bandwidths: each bin is spread over its neighbours, then added up."""
    r = int(bandwidth * reach)
    s = hist.select(F.col("bin").alias("from"), "n", F.explode(F.sequence(F.col("bin") - r, F.col("bin") + r)).alias("bin"))
    s = s.withColumn("part", F.col("n") * F.exp(-F.pow((F.col("from") - F.col("bin")) / bandwidth, 2) / 2))
    return hist.select("bin", "n").join(s.groupBy("bin").agg(F.floor(F.round(F.sum("part"), 6) / bandwidth).cast("long").alias("n_smooth")), "bin")


def cumulative(hist: DataFrame) -> DataFrame:
    """Counts up to each bin; a histogram has at most some thousand bins."""
    return hist.withColumn("upto", F.sum("n").over(Window.orderBy("bin")))


def share_up_to(hist: DataFrame) -> DataFrame:
    """(lo, hi, upto, share): counts up to and with each bin of (lo, width, n_smooth), and their share of all."""
    w = Window.orderBy("lo")
    h = hist.withColumns({"upto": F.sum("n_smooth").over(w), "_all": F.sum("n_smooth").over(Window.partitionBy())})
    return h.select("lo", (F.col("lo") + F.col("width")).alias("hi"), "upto", (F.col("upto") / F.greatest("_all", F.lit(1))).alias("share"))


def cumulative_share(sizes: DataFrame, hist: DataFrame) -> DataFrame:
    """Sizes (…, size) with ``share_below``: of the smoothed histogram's inserts, how many are in the size's bin or a smaller one.

    0 under the range and 1 past it. A histogram has 1028 bins at most, so it is broadcast.
    """
    h = share_up_to(hist)
    edge = hist.agg(F.min("lo").alias("first"), F.max(F.col("lo") + F.col("width")).alias("last"), F.min("width").alias("w"))
    s = sizes.join(F.broadcast(edge), how="cross").withColumn("lo", F.when(F.col("size").between(F.col("first"), F.col("last") - 1), F.col("first") + F.expr("((size - first) div w) * w")))
    j = s.join(F.broadcast(h.select("lo", "share")), "lo", "left")
    # a bin without inserts has the share of the last one before it
    before = F.broadcast(h.select(F.col("lo").alias("h_lo"), F.col("share").alias("h_share")).agg(F.array_sort(F.collect_list(F.struct("h_lo", "h_share"))).alias("bins")))
    j = j.join(before, how="cross")
    last = F.aggregate("bins", F.lit(0.0), lambda a, x: F.when(x["h_lo"] <= F.col("size"), x["h_share"]).otherwise(a))
    share = F.when(F.col("size") < F.col("first"), 0.0).when(F.col("size") >= F.col("last"), 1.0).otherwise(F.coalesce("share", last))
    return j.withColumn("share_below", share).drop("first", "last", "w", "lo", "share", "bins", "size")
