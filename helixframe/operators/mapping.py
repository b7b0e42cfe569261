"""Mapping of reads to references by their best placement alone: index lookup, seeds, segments, scores of all windows, one alignment.

:mod:`helixframe.operators.strategy` has the whole strategy, with qualities, pairs and split reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bases
from . import index, kernel, seeds
from .strategy import longest

BAND = ("band_l", "band_r")


def map_reads(reads: DataFrame, refs: DataFrame, ix: DataFrame, k: int = 13, stride: int = 13, max_hits: int = 10_000, pad: int = 16) -> DataFrame:
    """(read_id, mate, strand, seq_idx, pos, sw_score, cigar): the best gapped placement of each read that has one.

    reads (read_id, mate, qname, seq, qual), refs (seq_idx, name, length, bases), ix as of :func:`index.kmers`. ``max_hits`` is the mapper's stated
    limit of work: words more frequent make no seeds. Every segment counts: the windows of all are cut from reference pieces, within ``pad`` of its diagonal; those of a mate that
    are equal are folded into the first of them, all are scored, and the best one is aligned. Ties go to the plus strand, the
    first reference and the leftmost window.
    """
    words, used = seeds.looked_up(seeds.query_words(reads, k, 0), ix)
    h = seeds.hits(words.where(F.col("nhits") <= max_hits), used, k)
    c = h.select("read_id", "mate", "strand", "seq_idx", "shift").distinct()
    mates = reads.select("read_id", "mate", "seq")
    c = c.join(mates.select("read_id", "mate", F.length("seq").alias("n")), ["read_id", "mate"])
    n = F.col("n")
    diag = F.when(F.col("strand") == "+", F.col("shift")).otherwise(F.col("shift") - (n - k))
    left = F.greatest(F.lit(0), diag - pad)
    c = c.select("read_id", "mate", "strand", "seq_idx", left.alias("left"), (n + 2 * pad).alias("size"), (left - diag - pad).cast("int").alias("band_l"), (left - diag + pad).cast("int").alias("band_r"))
    c = index.fetch(c, refs, longest(reads) + 2 * pad)
    c = c.groupBy("read_id", "mate", "strand", "window", "band_l", "band_r").agg(F.min(F.struct("seq_idx", "left")).alias("at"))
    query = F.when(F.col("strand") == "+", F.col("seq")).otherwise(bases.reverse_complement(F.col("seq")))
    c = kernel.score_candidates(c.join(mates, ["read_id", "mate"]).select("read_id", "mate", "strand", "at", query.alias("q"), "window", "band_l", "band_r"), band=BAND)
    first = F.min(F.struct((-F.col("score")).alias("low"), "strand", "at.seq_idx", "at.left", "q", "window", "band_l", "band_r")).alias("b")
    a = kernel.align_candidates(c.where("score > 0").groupBy("read_id", "mate").agg(first).select("read_id", "mate", "b.strand", "b.seq_idx", "b.left", "b.q", "b.window", "b.band_l", "b.band_r"), band=BAND).where("sw_score > 0")
    return a.select("read_id", "mate", "strand", "seq_idx", (F.col("left") + F.col("r_start")).alias("pos"), "sw_score", "cigar")
