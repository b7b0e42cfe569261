"""Simulated reads of known places, and qualities from observed transitions. Every draw is a hash of the seed and the row's number, so reruns agree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import encode


@dataclass(frozen=True)
class SimParams:
    """variations: share of bases that differ; indels: share of these that are gaps; gap_p: of the geometric distribution of their lengths."""

    length: int = 100
    insert_mean: float = 0.0
    insert_sd: float = 0.0
    variations: float = 0.0
    indels: float = 0.0
    gap_p: float = 0.5
    longest_gap: int = 24
    prefix: str = "sim"
    seed: int = 1


def uniform(seed: int, *cols: str | Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def normal(u: Column, v: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """A normal draw of two uniform ones (Box and Muller)."""
    return mean + sd * F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)


def geometric(u: Column, p: float) -> Column:
    """Failures before the first success of probability p: floor(ln u / ln (1 - p))."""
    if not 0 <= p < 1:
        raise ValueError("p is 0 to 1, without 1")
    return F.floor(F.log(u) / min(-1e-15, float(np.log1p(-p)))).cast("int")


def simulate(spark: SparkSession, refs: DataFrame, n: int, p: SimParams = SimParams()) -> DataFrame:
    """(read_id, mate, qname, seq, qual): n reads, or pairs where there is an insert size, drawn evenly over all places of the sequences.

    Names hold the truth: prefix, number, reference, place (from 1), its number, strand, operations, and the mate. References shorter than a
    read or an insert give none. refs (seq_idx, name, length, bases) with offsets.
    """
    from . import index

    paired = p.insert_mean > 0
    fits = refs.select("seq_idx", "length", "offset")
    total = fits.agg(F.sum("length")).first()[0] or 0
    size = F.greatest(F.lit(p.length), F.round(normal(uniform(p.seed, "read_id", F.lit("u")), uniform(p.seed, "read_id", F.lit("v")), p.insert_mean, p.insert_sd)).cast("long")) if paired else F.lit(p.length).cast("long")
    r = spark.range(n).withColumnRenamed("id", "read_id").withColumns({"tpos": F.floor(uniform(p.seed, "read_id", F.lit("at")) * total).cast("long"), "span": size, "turned": uniform(p.seed, "read_id", F.lit("strand")) < 0.5})
    at = index.locate(r.select("tpos").distinct(), fits)
    r = r.join(at, "tpos").join(refs.select("seq_idx", "name", "length"), "seq_idx")
    # room for what deletions use up
    room = p.length + 4 * p.longest_gap
    r = r.withColumn("start", F.least(F.col("pos"), F.col("length") - F.col("span"))).where("start >= 0")
    sides = [F.struct(F.lit(1).alias("mate"), F.when(F.col("turned") & F.lit(paired), F.col("start") + F.col("span") - p.length).otherwise(F.col("start")).alias("left"), F.col("turned").alias("minus"))]
    if paired:
        sides.append(F.struct(F.lit(2).alias("mate"), F.when(F.col("turned"), F.col("start")).otherwise(F.col("start") + F.col("span") - p.length).alias("left"), (~F.col("turned")).alias("minus")))
    m = r.withColumn("m", F.explode(F.array(*sides))).select("read_id", "m.mate", "seq_idx", "name", "m.left", "m.minus", F.lit(room).alias("size"))
    w = index.fetch(m, refs, room).withColumn("window", encode(F.col("window")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for read, mate, idx, name, left, minus, window in zip(b["read_id"], b["mate"], b["seq_idx"], b["name"], b["left"], b["minus"], b["window"], strict=True):
                seq, ops = mutate(window, p, np.random.default_rng([p.seed, int(read), int(mate)]))
                if minus:
                    seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
                tail = f"/{mate}" if paired else ""
                out.append((read, mate, f"{p.prefix}_{read:09d}_{name}_{left + 1:09d}_{idx}_{'R' if minus else 'F'}_{ops}{tail}", seq, None))
            yield pd.DataFrame(out, columns=["read_id", "mate", "qname", "seq", "qual"])

    return w.select("read_id", "mate", "seq_idx", "name", "left", "minus", "window").mapInPandas(run, "read_id long, mate int, qname string, seq string, qual string")


def mutate(window: str, p: SimParams, rng: np.random.Generator) -> tuple[str, str]:
    """A read of the window's first bases with random variations, and its operations: runs of m, s, i, d along the forward strand."""
    out: list[str] = []
    ops: list[str] = []
    at = 0
    while len(out) < p.length and at < len(window):
        if p.variations and rng.random() < p.variations:
            if out and p.indels and rng.random() < p.indels:
                n = min(p.longest_gap, int(rng.geometric(1 - p.gap_p)) if p.gap_p < 1 else 1)
                if rng.random() < 0.5:
                    n = min(n, p.length - len(out))
                    out += [str(x) for x in rng.choice(list("ACGT"), n)]
                    ops += ["i"] * n
                else:
                    at += n
                    ops += ["d"] * n
                continue
            out.append("ACGT"[("ACGT".find(window[at]) + 1 + int(rng.integers(3))) % 4])
            ops.append("s")
        else:
            out.append(window[at])
            ops.append("m")
        at += 1
    while ops and ops[-1] == "d":
        ops.pop()
    from .kernel import run_lengths

    return "".join(out), run_lengths(ops)


def simulate_qualities(reads: DataFrame, transitions: DataFrame, seed: int = 1) -> DataFrame:
    """Reads with ``qual`` drawn from (pos, prev, cur, n), as quality_transitions counts them: a chain of each read's own.

    Where nothing was counted after a quality, it stays. The table of counts is at most places times 94 qualities squared, and a worker holds it whole.
    """
    rows = transitions.collect()
    start = _cumulative([(r["cur"], r["n"]) for r in rows if r["prev"] is None and r["pos"] == 0])
    table: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in rows:
        if r["prev"] is not None:
            table.setdefault((r["pos"], r["prev"]), []).append((r["cur"], r["n"]))
    cum = {k: _cumulative(v) for k, v in table.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            quals = []
            for read, mate, seq in zip(b["read_id"], b["mate"], b["seq"], strict=True):
                u = np.random.default_rng([seed, int(read), int(mate)]).random(len(seq or ""))
                q, chars = 0, []
                for i, x in enumerate(u):
                    own = start if i == 0 else cum.get((i, q))
                    if own is not None and len(own[0]):
                        q = int(own[0][int(np.searchsorted(own[1], x * own[1][-1], "right"))])
                    chars.append(chr(33 + q))
                quals.append("".join(chars))
            yield b.assign(qual=quals)

    return reads.mapInPandas(run, reads.schema)


def _cumulative(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted(pairs)
    return np.array([q for q, _ in pairs]), np.cumsum([n for _, n in pairs])


def mutate_by_quality(reads: DataFrame, seed: int = 1) -> DataFrame:
    """Reads whose bases are exchanged with the probability that their quality says, with ``changed``, the places (from 0); quality 0 and other letters stay."""
    at = F.sequence(F.lit(0), F.length("seq") - 1)

    def base(i: Column) -> Column:
        c, q = F.substring("seq", i + 1, F.lit(1)), F.ascii(F.substring("qual", i + 1, F.lit(1))) - 33
        u = uniform(seed, "read_id", "mate", i)
        k = F.instr(F.lit("ACGT"), F.upper(c)) - 1
        wrong = (q > 0) & (u <= F.exp(-F.log(F.lit(10.0)) * q / 10)) & (k >= 0)
        shift = F.pmod(F.xxhash64(F.lit(seed), "read_id", "mate", i, F.lit("to")), F.lit(3)).cast("int") + 1
        return F.struct(i.alias("i"), F.when(wrong, F.substring(F.lit("ACGT"), (k + shift) % 4 + 1, F.lit(1))).otherwise(c).alias("c"), wrong.alias("wrong"))

    r = reads.withColumn("_b", F.when(F.length("seq") > 0, F.transform(at, base)))
    changed = F.transform(F.filter("_b", lambda x: x["wrong"]), lambda x: x["i"])
    return r.withColumns({"seq": F.coalesce(F.array_join(F.transform("_b", lambda x: x["c"]), ""), F.col("seq")), "changed": F.coalesce(changed, F.array().cast("array<int>"))}).drop("_b")
