"""Expressions for qualities of placements, labels and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phred_of(p: Column) -> Column:
    """Phred score of a probability of being right, cut to whole numbers from 0 to 60."""
    q = F.floor(-10 * F.log10(F.greatest(1 - p, F.lit(1e-7))))
    return F.least(F.lit(60), F.greatest(F.lit(0), q)).cast("int")


def random_draw_quality(n: Column) -> Column:
    q = F.least(F.lit(3), F.greatest(F.lit(0), F.round(-10 * F.log10((n - 1) / n)).cast("int")))
    return F.when((n < 1) | (n > 9), 0).when(n == 1, 4).otherwise(q)


def quality(s1: Column, s2: Column, n2: Column, read_length: Column, cap: Column) -> Column:
    """Quality of a placement of score s1 over n2 others of score s2 < s1."""
    q = F.floor(60 * (1 - F.exp(10 * (s2 - s1) / read_length)) - F.when(n2 > 0, F.floor(10 * F.log10(F.greatest(n2, F.lit(1))))).otherwise(0))
    q = F.when(q >= 0, q + 4).otherwise(q)
    return F.greatest(F.lit(0), F.least(F.lit(60), q, cap)).cast("int")


def insert_size(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Outer distance, negative when the second mate stands left."""
    d = F.greatest(e1, e2) - F.least(s1, s2) + 1
    return F.when(s2 < s1, -d).otherwise(d)


def is_proper(library: str, strand1: Column, strand2: Column, isize: Column) -> Column:
    fr = (strand1 == "+") & (strand2 == "-")
    rf = (strand1 == "-") & (strand2 == "+")
    ff = (strand1 == "+") & (strand2 == "+")
    rr = (strand1 == "-") & (strand2 == "-")
    left = isize >= 0
    table = {"pe": (fr, rf), "mp": (rf, fr), "pp": (ff, rr), "any": (F.lit(True), F.lit(True))}
    a, b = table[library]
    return F.when(left, a).otherwise(b)


def label(both: Column, same_ref: Column, proper: Column, within: Column, mapped: Column | None = None, partial: Column | None = None, multi: Column | None = None) -> Column:
    """A proper within the limits, B proper, C one reference, D two; S a mate alone; P a secondary part; R several places, none taken; N none."""
    t, f = F.lit(True), F.lit(False)
    mapped, partial, multi = t if mapped is None else mapped, f if partial is None else partial, f if multi is None else multi
    return F.when(~mapped & multi, "R").when(~mapped, "N").when(partial, "P").when(~both, "S").when(~same_ref, "D").when(~proper, "C").when(within, "A").otherwise("B")


def clip_lengths(strand: Column, q_start: Column, q_end: Column, n: Column) -> Column:
    """struct<before, after>: bases of a read of length n outside its aligned span, in the reference's direction."""
    left, right = q_start - 1, n - q_end
    minus = strand == "-"
    return F.struct(F.when(minus, right).otherwise(left).alias("before"), F.when(minus, left).otherwise(right).alias("after"))


def mate_fields(name: Column, pos: Column, both: Column, isize: Column, mate: Column) -> Column:
    """struct<rnext, pnext, tlen> given the other mate's reference and place: the full name, never an equals sign; signs of tlen differ between mates."""
    mapped = name.isNotNull()
    return F.struct(F.when(mapped, name).otherwise("*").alias("rnext"), F.when(mapped, pos).otherwise(0).alias("pnext"), F.when(both, F.when(mate == 1, isize).otherwise(-isize)).otherwise(0).alias("tlen"))


def identity_reached(n_match: Column, min_identity: float, n: Column) -> Column:
    """Whether matches reach a share of the read's length (up to 1), or a number of bases."""
    return n_match >= (F.floor(F.lit(min_identity) * n) if min_identity <= 1 else F.lit(int(min_identity)))


def work_cap(hits_used: Column, hits_total: Column, aligned: Column, candidates: Column, top: int = 60, added: int = 3) -> Column:
    """Highest quality that the work done leaves: of hits looked at and candidates aligned, the lesser share counts."""
    share = F.least(hits_used / (hits_total + added), aligned / (candidates + added))
    lost = F.when(share > 1e-7, -10 * F.log10(F.greatest(share, F.lit(1e-7)))).otherwise(top)
    return F.when(lost < top, top - F.floor(lost)).otherwise(0).cast("int")


def placement_probability(mapq: Column, n_best: Column, n_second: Column, sw_rank: Column) -> Column:
    """Probability of a placement: 1 - 10^(-mapq / 10) of a single best, the rest among the second best; of several best an equal share."""
    error = F.pow(F.lit(10.0), -mapq / 10)
    return F.when(n_best > 1, F.when(sw_rank == 0, 1 / n_best).otherwise(0.0)).when(sw_rank == 0, 1 - error).when(sw_rank == 1, error / F.greatest(n_second, F.lit(1))).otherwise(0.0)


def sam_flag(paired: Column, proper: Column, unmapped: Column, mate_unmapped: Column, reverse: Column, mate_reverse: Column, mate: Column, secondary: Column) -> Column:
    bit = lambda c, n: F.when(c, n).otherwise(0)
    return bit(paired, 1) + bit(proper, 2) + bit(unmapped, 4) + bit(mate_unmapped, 8) + bit(reverse, 16) + bit(mate_reverse, 32) + bit(paired & (mate == 1), 64) + bit(paired & (mate == 2), 128) + bit(secondary, 256)
