"""The command line: ``index``, ``map``, ``sample`` and ``check``, with short switches.

    python -m helixframe.cli index -k 13 -s 6 NAME references.fa
    python -m helixframe.cli map -f sam:x -o out NAME reads_1.fq reads_2.fq
    python -m helixframe.cli sample -o hist NAME reads_1.fq reads_2.fq
    python -m helixframe.cli check reads.fq [mates.fq]

NAME is a folder (of any file system): references and their word index as Parquet. Results go to a folder of part files.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, pairs, strategy, tools
from .params import MapParams, Penalties
from .sources import bam, fastx, formats, lines, sam

SCORES = {"match": "match", "subst": "subst", "gapopen": "gap_open", "gapext": "gap_extend"}
OUTPUTS = ("sam", "bam", "cigar", "gff", "ssaha")


def output_format(text: str) -> tuple[str, set[str]]:
    """("sam", {"nohead", "x", "clip"}) of ``sam:nohead,x,clip``."""
    name, _, rest = text.partition(":")
    more = {x for x in rest.split(",") if x}
    if name not in OUTPUTS or not more <= {"nohead", "x", "clip"} or (more and name not in ("sam", "bam")):
        raise argparse.ArgumentTypeError(f"unknown output format {text}")
    return name, more


def penalties(text: str) -> Penalties:
    """Penalties of ``match=1,subst=-2,gapopen=-4,gapext=-3``, any of them."""
    out = {}
    for item in text.split(","):
        key, eq, value = item.partition("=")
        if not eq or key not in SCORES:
            raise argparse.ArgumentTypeError(f"unknown penalty {item}")
        out[SCORES[key]] = int(value)
    try:
        return Penalties(**out)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("helixframe")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("index")
    c.add_argument("-k", type=int, default=13)
    c.add_argument("-s", type=int)
    c.add_argument("name")
    c.add_argument("references")
    for name in ("map", "sample"):
        c = commands.add_parser(name)
        c.add_argument("-F", dest="input", choices=formats.FORMATS)
        c.add_argument("-m", dest="min_score", type=int)
        c.add_argument("-n", dest="threads", type=int, help="accepted, without effect: the cluster's cores are used")
        c.add_argument("-o", dest="output", required=True)
        c.add_argument("-q", dest="quality", type=int, default=0)
        c.add_argument("-T", dest="temporary", help="accepted, without effect")
        c.add_argument("name")
        c.add_argument("reads")
        c.add_argument("mates", nargs="?")
        if name == "sample":
            c.add_argument("-t", dest="confident", type=int, default=20, help="least mapping quality of a pair that counts")
            c.add_argument("-u", dest="every", type=int, help="sample no rarer than every so many pairs")
            continue
        c.add_argument("-a", dest="explicit", action="store_true")
        c.add_argument("-c", dest="coverage", type=float, default=0.0)
        c.add_argument("-d", dest="drop", type=int, default=0)
        c.add_argument("-D", dest="folder", help="accepted, without effect")
        c.add_argument("-f", dest="format", type=output_format, default=("sam", set()))
        c.add_argument("-g", dest="histogram")
        c.add_argument("-i", dest="max_insert", type=int, default=500)
        c.add_argument("-j", dest="min_insert", type=int, default=0)
        c.add_argument("-l", dest="library", choices=("pe", "mp", "pp"), default="pe")
        c.add_argument("-O", dest="ordered", action="store_true")
        c.add_argument("-p", dest="split", action="store_true")
        c.add_argument("-r", dest="seed", type=int, default=0)
        c.add_argument("-S", dest="scores", type=penalties, default=Penalties())
        c.add_argument("-w", dest="weighted", action="store_true")
        c.add_argument("-x", dest="exhaustive", action="store_true")
        c.add_argument("-y", dest="identity", type=float, default=0.0)
    c = commands.add_parser("check")
    c.add_argument("reads")
    c.add_argument("mates", nargs="?")
    commands.add_parser("version")
    return top


def parsed(argv: list[str]) -> argparse.Namespace:
    p = parser()
    o = p.parse_args(argv)
    if getattr(o, "coverage", 0) and not o.exhaustive:
        p.error("-c goes with -x")
    return o


def params_of(o: argparse.Namespace, k: int, stride: int) -> MapParams:
    """Options of ``map``. A score drop overrides the choice among ties; a negative seed leaves ties unplaced, 0 takes one from the clock."""
    seed = getattr(o, "seed", 0)
    if o.command == "sample":
        return MapParams(k=k, stride=stride, min_base_quality=o.quality, min_score=o.min_score, exhaustive=True, ties="unmapped")
    return MapParams(
        k=k, stride=stride, min_base_quality=o.quality, coverage=o.coverage, min_score=o.min_score, score_drop=o.drop, min_identity=o.identity, min_insert=o.min_insert, max_insert=o.max_insert, library=o.library,
        ties="all" if o.drop else "unmapped" if seed < 0 else "random", seed=seed or int(time.time()), split=o.split, exhaustive=o.exhaustive, complexity=o.weighted, penalties=o.scores,
    )


def build(spark: SparkSession, o: argparse.Namespace) -> None:
    p = MapParams(k=o.k, stride=o.s)
    index.save_refs(index.refs_from_fastx(fastx.read_fastx(spark, o.references)), f"{o.name}/refs")
    refs = index.with_offsets(index.load_refs(spark, f"{o.name}/refs"))
    index.kmers(refs, p.k, p.step).sortWithinPartitions("word").write.mode("overwrite").parquet(f"{o.name}/words")
    spark.createDataFrame([(p.k, p.step)], "k int, stride int").write.mode("overwrite").parquet(f"{o.name}/params")


def opened(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, int, int]:
    k, stride = spark.read.parquet(f"{name}/params").first()
    return index.with_offsets(index.load_refs(spark, f"{name}/refs")), spark.read.parquet(f"{name}/words"), k, stride


def input_reads(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, bool]:
    """(reads, whether they are pairs)."""
    from .storage import stored

    if o.mates:
        a, b = (formats.read_any(spark, x, o.input).drop("mate") for x in (o.reads, o.mates))
        return stored(fastx.pair_up(a, b)), True
    if o.reads == "-":
        return stored(formats.read_stdin(spark).selectExpr("read_id", "0 AS mate", "qname", "seq", "qual")), False
    r = stored(formats.read_any(spark, o.reads, o.input))
    return r, not r.where("mate > 0").isEmpty()


def map_command(spark: SparkSession, o: argparse.Namespace) -> None:
    refs, words, k, stride = opened(spark, o.name)
    reads, paired = input_reads(spark, o)
    hist = None
    p = params_of(o, k, stride)
    if o.histogram:
        counts, head = lines.read_histogram(spark, o.histogram)
        hist = smoothed(counts, head)
        # the histogram's range widens the limits
        p = params_of(argparse.Namespace(**vars(o) | {"min_insert": min(o.min_insert, head["low"]), "max_insert": max(o.max_insert, head["high"])}), k, stride)
    if paired:
        both = reads.where("mate > 0")
        a, restricted = strategy.map_pairs(both, refs, words, p)
        out = strategy.report_pairs(a, both, restricted, p, hist)
        single = reads.where("mate = 0")
        write(spark, o, sam.records(out, both, refs, "x" in o.format[1], "clip" in o.format[1]), out, both, refs, o.output)
        if single.isEmpty():
            return
        out = strategy.report_single(strategy.map_single(single, refs, words, p), single, p)
        write(spark, o, sam.records(out, single, refs, "x" in o.format[1], "clip" in o.format[1]), out, single, refs, f"{o.output}-single")
        return
    out = strategy.report_single(strategy.map_single(reads, refs, words, p), reads, p)
    write(spark, o, sam.records(out, reads, refs, "x" in o.format[1], "clip" in o.format[1]), out, reads, refs, o.output)


def smoothed(counts: DataFrame, head: dict[str, int]) -> DataFrame:
    """(lo, width, n_smooth) of a stored histogram, by its own quartiles and total."""
    iqr = (head["q3"] - head["q1"]) / head["width"]
    bandwidth = max(3.0, 0.9 * max(1, head["total"]) ** -0.2 * iqr / 1.34)
    h = counts.withColumn("bin", F.expr(f"(lo - {head['low']}) div width").cast("int"))
    return pairs.smooth(h, bandwidth).join(h.select("bin", "lo", "width"), "bin").select("lo", "width", "n_smooth")


def placed_lines(reported: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """What lines other than SAM are made of: placements with names, lengths and operations."""
    from .functions import cigar

    a = reported.where("seq_idx IS NOT NULL").join(reads.select("read_id", "mate", F.split("qname", r"\s")[0].alias("qname"), F.length("seq").cast("long").alias("q_length")), ["read_id", "mate"])
    a = a.join(refs.select("seq_idx", F.split("name", r"\s")[0].alias("rname"), F.col("length").alias("r_length")), "seq_idx")
    return a.withColumns({"ops": cigar.parse(F.col("cigar")), **{c: F.col(c).cast("long") for c in ("q_start", "q_end", "r_start", "r_end", "sw_score")}})


def write(spark: SparkSession, o: argparse.Namespace, records: DataFrame, reported: DataFrame, reads: DataFrame, refs: DataFrame, folder: str) -> None:
    from .functions import cigar

    kind, more = o.format
    command = " ".join(sys.argv[1:])
    if kind == "bam":
        bam.write_bam(records.orderBy("read_id", "mate", "pair_no"), refs, folder, command)
        return
    if kind == "sam":
        r = lines.demote_primaries_by_flag(records) if o.drop else records
        r = r.orderBy("read_id", "mate", "pair_no") if o.ordered else r
        sam.sam_lines(r).select("line").write.mode("overwrite").text(folder)
        if "nohead" not in more:
            sam.sam_header(refs, command).coalesce(1).sortWithinPartitions("ord").select("line").write.mode("append").text(f"{folder}-header")
    else:
        a = placed_lines(reported, reads, refs)
        keys = ["read_id", "mate", "ord"]
        if kind == "ssaha":
            text = lines.ssaha_lines(a, keys)
        elif kind == "gff":
            text = lines.gff2_lines(a, keys)
        else:
            text = sam.cigar_lines(a.withColumn("ops", cigar.plain(F.col("ops"))))
        text.select("line").write.mode("overwrite").text(folder)
    if o.explicit:
        explicit_lines(reported, reads, refs).select("line").write.mode("overwrite").text(f"{folder}-alignments")


def explicit_lines(reported: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """(read_id, mate, ord, line): explicit alignments of placed reads, three lines at a time."""
    from .functions import cigar
    from .functions.bases import encode, reverse_complement

    a = reported.where("seq_idx IS NOT NULL").withColumns({"left": F.col("r_start").cast("long") - 1, "size": (F.col("r_end") - F.col("r_start") + 1).cast("long")})
    widest = a.agg(F.max("size")).first()[0] or 1
    a = index.fetch(a, refs, widest).drop("length").join(reads.select("read_id", "mate", "seq"), ["read_id", "mate"])
    q = F.substring("seq", F.col("q_start"), F.col("q_end") - F.col("q_start") + 1)
    q = encode(F.when(F.col("strand") == "-", reverse_complement(q)).otherwise(q))
    text = tools.explicit_alignment(q, F.col("window"), cigar.parse(F.col("cigar")), F.col("q_start"), F.col("r_start"), F.col("strand") == "-", F.col("q_end"))
    return a.select("read_id", "mate", "ord", F.posexplode(text).alias("no", "line")).orderBy("read_id", "mate", "ord", "no")


def sample_command(spark: SparkSession, o: argparse.Namespace) -> None:
    """Insert sizes of a part of the pairs, as a histogram: a file to be read again, and bars."""
    from .storage import cut

    refs, words, k, stride = opened(spark, o.name)
    reads, paired = input_reads(spark, o)
    if not paired:
        raise SystemExit("sample needs pairs")
    n = reads.where("mate = 1").count()
    part = pairs.every_nth(reads, pairs.sampling_interval(n, o.every))
    a, _ = strategy.map_pairs(part, refs, words, params_of(o, k, stride))
    sizes = cut(pairs.inferred_inserts(a, o.confident).select(F.abs("isize").alias("isize")))
    h = cut(pairs.derived_histogram(sizes).select("lo", "width", "n"))
    lines.histogram_text(h, sizes).coalesce(1).sortWithinPartitions("ord").select("line").write.mode("overwrite").text(o.output)
    lines.histogram_bars(h.select("lo", "n")).coalesce(1).sortWithinPartitions("lo").select("line").write.mode("overwrite").text(f"{o.output}-bars")


def check_command(spark: SparkSession, o: argparse.Namespace) -> dict:
    a = fastx.read_fastx(spark, o.reads)
    out = fastx.check(a).first().asDict()
    if o.mates:
        b = fastx.read_fastx(spark, o.mates)
        out |= {f"mates_{x}": y for x, y in fastx.check(b).first().asDict().items()} | fastx.check_pairs(a, b).first().asDict()
    out["ok"] = all(v is not False for v in out.values())
    return out


COMMANDS: dict[str, Callable] = {"index": build, "map": map_command, "sample": sample_command, "check": check_command, "version": lambda spark, o: sam.VERSION}


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    from .shipping import ship

    o = parsed(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    return COMMANDS[o.command](spark, o)


if __name__ == "__main__":
    result = main()
    if result is not None:
        print(result)
    sys.exit(0 if not isinstance(result, dict) or result["ok"] else 1)
