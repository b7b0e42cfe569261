"""Words of reads, their filters, hits, diagonals, seeds and segments: equi-joins and gap-and-island windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import reverse_complement
from ..storage import cut
from . import index

READ = ["read_id", "mate", "strand"]


def query_words(reads: DataFrame, k: int, min_quality: int = 0) -> DataFrame:
    """(read_id, mate, n, strand, qoffs, word) of both strands; n is the read's length, offsets are those of the forward read.

    Words with another letter than ACGT are dropped, and with qualities those with a base under ``min_quality``.
    """
    n = F.length("seq")
    r = reads.where(n >= k).select("read_id", "mate", n.alias("n"), "seq", "qual", F.explode(F.sequence(F.lit(0), n - k)).alias("qoffs"))
    r = r.withColumn("word", F.substring("seq", F.col("qoffs") + 1, F.lit(k))).where("NOT word RLIKE '[^ACGT]'")
    if min_quality:
        worst = F.array_min(F.transform(F.split(F.substring("qual", F.col("qoffs") + 1, F.lit(k)), ""), F.ascii)) - 33
        r = r.where(F.col("qual").isNull() | (worst >= min_quality))
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("word").alias("word")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("word")).alias("word")))
    return r.select("read_id", "mate", "n", "qoffs", F.explode(both).alias("b")).select("read_id", "mate", "n", "b.strand", "qoffs", "b.word")


def drop_repeats(words: DataFrame, back: int = 4) -> DataFrame:
    """Without words equal to one of the ``back`` words before."""
    w = Window.partitionBy(*READ).orderBy("qoffs")
    same = F.lit(False)
    for i in range(1, back + 1):
        same = same | F.coalesce(F.lag("word", i).over(w) == F.col("word"), F.lit(False))
    return words.withColumn("_same", same).where("NOT _same").drop("_same")


def hit_counts(words: DataFrame, counts: DataFrame, max_hits: int) -> DataFrame:
    """Words with their number of places; unknown ones and those with too many are dropped before any place is fetched."""
    return words.join(counts.where(F.col("nhits") <= max_hits), "word")


def looked_up(words: DataFrame, ix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words with nhits, their number of places, and the part of the index that holds them.

    That part is made once, for both the counts and the places: of an index that is computed, not stored, one pass. Few enough
    different words are sent to the index; the index is dealt out only for more.
    """
    asked = cut(words.select("word").distinct())
    used = cut(ix.join(F.broadcast(asked) if asked.count() <= index.BROADCAST_ROWS else asked, "word", "left_semi"))
    return words.join(index.word_counts(used), "word"), used


def choose_seeds(counted: DataFrame, budget: int, at_least: int = 3, k: int | None = None, stride: int | None = None) -> DataFrame:
    """The rarest words of a read's strand whose hits add up to the budget, three at least; with ``seed_rank`` and ``running`` hits.

    With k and stride, a frame of the stride whose chosen words cover less than 2 k + stride bases (or four fifths of the read, if
    that is less) is given more of its words, in the same order.
    """
    w = Window.partitionBy(*READ).orderBy("nhits", "qoffs")
    r = counted.withColumns({"seed_rank": F.row_number().over(w), "running": F.sum("nhits").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    chosen = (F.col("running") <= budget) | (F.col("seed_rank") <= at_least)
    if k is None or stride is None:
        return r.where(chosen)
    wanted = 2 * k + stride
    own = Window.partitionBy(*READ, "_frame").orderBy("nhits", "qoffs")
    r = r.withColumn("_frame", F.pmod("qoffs", F.lit(stride))).withColumn("_nth", F.row_number().over(own))
    # every word adds a base at least, so only so many words of a frame can be wanted
    before = F.collect_list(F.when(F.col("_nth") <= wanted, F.col("qoffs"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    covered = F.size(F.array_distinct(F.flatten(F.transform(before, lambda q: F.sequence(q, q + (k - 1))))))
    short = (F.col("_nth") <= wanted) & (covered < F.least(F.lit(wanted), F.expr("n * 4 div 5")))
    return r.withColumn("_short", short).where(chosen | F.col("_short")).drop("_frame", "_nth", "_short")


def adaptive_cutoff(counted: DataFrame, max_hits: int = 10_000, floor: int = 16) -> DataFrame:
    """Words with at most ``cutoff`` places, the greatest halving of ``max_hits`` under which a read's strand has no more than max(8192, 32 n ln n) hits."""
    tries = [max_hits]
    while tries[-1] // 2 >= floor:
        tries.append(tries[-1] // 2)
    w = Window.partitionBy(*READ)
    cap = F.greatest(F.lit(8192.0), 32 * F.col("n") * F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")))
    cutoff = F.lit(tries[-1])
    for t in reversed(tries):
        cutoff = F.when(F.sum(F.when(F.col("nhits") <= t, F.col("nhits")).otherwise(0)).over(w) <= cap, t).otherwise(cutoff)
    return counted.withColumn("cutoff", cutoff).where("nhits <= cutoff")


def work(counted: DataFrame, chosen: DataFrame) -> DataFrame:
    """(read_id, mate, hits_used, hits_total) over both strands."""
    per = lambda c, n: c.groupBy("read_id", "mate").agg(F.sum("nhits").alias(n))
    return per(counted, "hits_total").join(per(chosen, "hits_used"), ["read_id", "mate"], "left").select("read_id", "mate", F.coalesce("hits_used", F.lit(0)).alias("hits_used"), "hits_total")


def rarer_mate(counted: DataFrame, max_hits: int) -> DataFrame:
    """(read_id, rare): the mate with fewer hits within the cut-off, the first if they tie."""
    per = counted.groupBy("read_id", "mate").agg(F.sum(F.when(F.col("nhits") <= max_hits, F.col("nhits")).otherwise(0)).alias("hits"))
    return per.groupBy("read_id").agg(F.min(F.struct("hits", "mate")).alias("r")).select("read_id", F.col("r.mate").alias("rare"))


def hits(seeds: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(read, seq_idx, shift, qoffs, pos): shift is the diagonal, pos - qoffs forward and pos + qoffs on the other strand."""
    j = seeds.join(index.select("word", "seq_idx", "pos"), "word")
    shift = F.when(F.col("strand") == "+", F.col("pos") - F.col("qoffs")).otherwise(F.col("pos") + F.col("qoffs"))
    return j.select(*READ, "seq_idx", shift.cast("long").alias("shift"), F.col("qoffs").cast("long").alias("qoffs"), "pos")


def _islands(df: DataFrame, by: list[str], order: list[str], new, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(new(w), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def regions(h: DataFrame, max_gap: int) -> DataFrame:
    """Adds region: a new one where the diagonal moves by more than ``max_gap``."""
    return _islands(h, [*READ, "seq_idx"], ["shift", "qoffs"], lambda w: F.coalesce(F.col("shift") - F.lag("shift").over(w) > max_gap, F.lit(True)), "region")


def exact_seeds(h: DataFrame, k: int, stride: int) -> DataFrame:
    """Overlapping hits in register on a diagonal, merged: (…, shift, q_start, q_len, n_hits)."""
    new = lambda w: ~F.coalesce((F.col("qoffs") - F.lag("qoffs").over(w) <= k) & ((F.col("qoffs") - F.lag("qoffs").over(w)) % stride == 0), F.lit(False))
    s = _islands(h, [*READ, "seq_idx", "shift"], ["qoffs"], new, "seed")
    return s.groupBy(*READ, "seq_idx", "shift", "seed").agg(F.min("qoffs").alias("q_start"), (F.max("qoffs") - F.min("qoffs") + k).alias("q_len"), F.count("*").alias("n_hits"))


def segments(seeds: DataFrame, stride: int) -> DataFrame:
    """Seeds of one diagonal and frame: (…, shift, frame, q_start, q_end, cover, n_seed)."""
    s = seeds.withColumn("frame", F.pmod("q_start", F.lit(stride)))
    return s.groupBy(*READ, "seq_idx", "shift", "frame").agg(F.min("q_start").alias("q_start"), F.max(F.col("q_start") + F.col("q_len")).alias("q_end"), F.sum("q_len").alias("cover"), F.count("*").alias("n_seed"))


def cover_deficit(words: DataFrame, k: int, stride: int) -> DataFrame:
    """Greatest less smallest number of bases covered among sampling frames, plus 1."""
    bases = words.withColumn("frame", F.col("qoffs") % stride).select(*READ, "frame", F.explode(F.sequence(F.col("qoffs"), F.col("qoffs") + k - 1)).alias("q")).distinct()
    per = bases.groupBy(*READ, "frame").agg(F.count("*").alias("n"))
    return per.groupBy(*READ).agg((F.max("n") - F.min("n") + 1).alias("deficit"))


def ungapped(reads: DataFrame, segs: DataFrame, refs: DataFrame, k: int, longest: int, match: int = 1, subst: int = -2) -> DataFrame:
    """Best ungapped local score on each segment's diagonal: (read, seq_idx, shift, score, q_start, q_end).

    The reference's bases along a diagonal are cut out once, and both strings are walked as arrays. ``longest``: bases of the longest read.
    """
    d = segs.select(*READ, "seq_idx", "shift").distinct().join(reads.select("read_id", "mate", "seq"), ["read_id", "mate"])
    d = d.withColumns({"q": F.when(F.col("strand") == "+", F.col("seq")).otherwise(reverse_complement(F.col("seq"))), "n": F.length("seq").cast("long")}).drop("seq")
    # the other strand's diagonals count forward offsets of words; of the turned read they are n - k less
    d = d.withColumn("shift", F.when(F.col("strand") == "-", F.col("shift") - (F.col("n") - k)).otherwise(F.col("shift")))
    d = d.withColumn("lo", F.greatest(F.lit(0), -F.col("shift"))).withColumns({"left": F.col("shift") + F.col("lo"), "size": F.col("n") - F.col("lo")})
    d = index.fetch(d, refs, longest)
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("from"), F.lit(0).alias("best"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("e"), F.lit(0).cast("bigint").alias("i"))
    letters = lambda c: F.split(c, "")
    q = F.substring("q", F.col("lo").cast("int") + 1, F.length("window"))
    same = F.zip_with(letters(q), letters(F.col("window")), lambda x, y: x == y)

    def step(a, hit):
        run = F.greatest(a["run"], F.lit(0)) + F.when(hit, match).otherwise(subst)
        frm = F.when(a["run"] > 0, a["from"]).otherwise(a["i"])
        better = run > a["best"]
        return F.struct(run.alias("run"), frm.alias("from"), F.when(better, run).otherwise(a["best"]).alias("best"), F.when(better, frm).otherwise(a["s"]).alias("s"), F.when(better, a["i"] + 1).otherwise(a["e"]).alias("e"), (a["i"] + 1).alias("i"))

    b = d.where(F.length("window") > 0).select(*READ, "seq_idx", "shift", "n", "lo", F.aggregate(same, zero, step).alias("b"))
    return b.select(*READ, "seq_idx", "shift", "n", F.col("b.best").alias("score"), (F.col("lo") + F.col("b.s")).alias("q_start"), (F.col("lo") + F.col("b.e")).alias("q_end"))


def best_hits(scored: DataFrame) -> DataFrame:
    """One row a read: the best score, ties to the forward strand, then sequence and diagonal; and how many share it."""
    w = Window.partitionBy("read_id", "mate")
    order = w.orderBy(F.col("score").desc(), "strand", "seq_idx", "shift")
    r = scored.withColumns({"rn": F.row_number().over(order), "best": F.max("score").over(w)})
    r = r.withColumn("n_best", F.sum(F.when(F.col("score") == F.col("best"), 1).otherwise(0)).over(w))
    return r.where("rn = 1").drop("rn", "best")
