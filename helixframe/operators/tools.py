"""Helpers around reads and reports: splitting, interleaving, extraction, quality statistics, summaries of SAM records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import encode, phred, reverse_complement, segment
from ..storage import cut


def numbered(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 in an order, without sorting them in one task: ranges are sorted, their sizes summed, and numbers added up.

    The ranges are written to the shared folder: dealt a second time, for their sizes, they could be others.
    """
    d = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
    d = d.withColumn("_part", F.shiftright("_i", 33))
    size = d.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row a partition
    ahead = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    d = d.join(F.broadcast(ahead), "_part")
    return d.withColumn(name, F.col("_ahead") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).drop("_i", "_part", "_ahead")


def split_by_mate(reads: DataFrame, name: str = "qname") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mates 1, mates 2, records without a mate's label), by /1 and /2 at the end of names."""
    own = lambda m: F.col(name).endswith(f"/{m}")
    return reads.where(own(1)), reads.where(own(2)), reads.where(~(own(1) | own(2)) | F.col(name).isNull())


def slices(reads: DataFrame, size: int, ordinal: str = "read_id") -> DataFrame:
    """Adds slice: every so many records a new one. ``write.partitionBy("slice")`` then gives a folder each."""
    return reads.withColumn("slice", F.expr(f"{ordinal} div {size}"))


def part(reads: DataFrame, first: int, last: int, ordinal: str = "read_id") -> DataFrame:
    """Records number first to last."""
    return reads.where(F.col(ordinal).between(first, last))


def truncated(reads: DataFrame, n: int) -> DataFrame:
    return reads.withColumns({"seq": F.substring("seq", 1, n), "qual": F.substring("qual", 1, n)})


def interleaved(a: DataFrame, b: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """Records of two files, those of the smaller spread evenly among the other's: (source, ordinal) and ``place``, their order.

    ``ordinal`` counts records (pairs) from 0 in each, n_a and n_b say how many there are. After every larger / smaller records of
    the larger file, from its first on, comes one of the smaller; what is left of either follows.
    """
    big, small, names = (a, b, ("a", "b")) if n_a > n_b else (b, a, ("b", "a"))
    step = max(1, max(n_a, n_b) // max(1, min(n_a, n_b)))
    # record i of the larger one stands before record i / step of the smaller
    x = big.withColumns({"source": F.lit(names[0]), "place": F.struct(F.col("ordinal").alias("at"), F.lit(0).alias("second"))})
    y = small.withColumns({"source": F.lit(names[1]), "place": F.struct((F.col("ordinal") * step).alias("at"), F.lit(1).alias("second"))})
    return x.unionByName(y)


def region(refs: DataFrame, name: str, start: int, length: int) -> DataFrame:
    """(seq_idx, name, start, end, forward, reverse) of a named sequence's bases from ``start`` (from 1, at least 1), cut at its end; both strands.

    Names are compared up to the first blank; of several alike the first sequence counts.
    """
    start = max(1, start)
    r = refs.where(F.split("name", r"\s")[0] == name.split()[0]).orderBy("seq_idx").limit(1)
    fw = segment(F.col("bases"), F.lit(start - 1), F.lit(length))
    return r.select("seq_idx", "name", F.lit(start).alias("start"), (F.length(fw) + start - 1).alias("end"), fw.alias("forward"), reverse_complement(fw).alias("reverse"))


def find_record(reads: DataFrame, name: str) -> DataFrame:
    """Records of a name, compared up to the first blank."""
    return reads.where(F.split("qname", r"\s")[0] == name.split()[0])


def read_lengths(reads: DataFrame) -> DataFrame:
    return reads.select("qname", F.length("seq").cast("long").alias("length"))


# --- qualities ----------------------------------------------------------------------------------------------------


def quality_transitions(reads: DataFrame) -> DataFrame:
    """(pos, prev, cur, n): how often quality cur follows prev at a place; prev is null at the start. Reads without qualities count nowhere."""
    q = reads.where("qual IS NOT NULL").select("read_id", "mate", F.posexplode(F.split("qual", "")).alias("pos", "c")).where("c <> ''").withColumn("cur", phred(F.col("c")).cast("long"))
    q = q.withColumn("prev", F.lag("cur").over(Window.partitionBy("read_id", "mate").orderBy("pos")))
    return q.groupBy(F.col("pos").cast("long").alias("pos"), "prev", "cur").agg(F.count("*").alias("n"))


def quality_extrema(reads: DataFrame) -> DataFrame:
    """(n_reads, min_length, max_length, min_quality, max_quality), over the reads' own extrema: nothing is exploded."""
    own = F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), phred)
    r = reads.where("qual IS NOT NULL").select(F.length("seq").cast("long").alias("n"), F.array_min(own).alias("lo"), F.array_max(own).alias("hi"))
    return r.agg(F.count("*").alias("n_reads"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.min("lo").cast("long").alias("min_quality"), F.max("hi").cast("long").alias("max_quality"))


# --- summaries ------------------------------------------------------------------------------------------------------


def sam_summary(records: DataFrame, confident: int = 10) -> DataFrame:
    """One row over SAM records (qname, flag, rname, mapq): reads, shares that are mapped, of quality 4 and of ``confident`` at least (per cent),
    proper pairs, and pairs on different references. Secondary and partial records don't count.
    """
    bit = lambda n: F.col("flag").bitwiseAND(F.lit(n)) != 0
    r = records.where(~bit(0x900))
    share = lambda c: F.coalesce(F.round(100.0 * F.sum(c.cast("int")) / F.count("*"), 2), F.lit(0.0))
    both = r.where(bit(1) & ~bit(4) & ~bit(8)).groupBy("qname").agg(F.min("rname").alias("lo"), F.max("rname").alias("hi"))
    apart = both.agg(F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("n"))
    one = r.agg(F.count("*").alias("n_reads"), share(~bit(4)).alias("pct_mapped"), share(~bit(4) & (F.col("mapq") >= 4)).alias("pct_placed"), share(~bit(4) & (F.col("mapq") >= confident)).alias("pct_confident"), F.sum((bit(1) & bit(2) & bit(64)).cast("long")).alias("n_proper_pairs"))
    # one row each
    return one.crossJoin(apart.select(F.coalesce("n", F.lit(0)).alias("n_pairs_apart")))


# --- explicit alignments ---------------------------------------------------------------------------------------------


def mark(q: Column, r: Column) -> Column:
    """What stands between two bases that differ: i for one class, v for two, ? for an unknown base, ! for no standard letter."""
    kind = lambda c: F.when(c.isin("A", "G"), "purine").when(c.isin("C", "T", "U"), "pyrimidine").when(c == "N", "unknown").otherwise("other")
    a, b = kind(q), kind(r)
    return F.when((a == "other") | (b == "other"), "!").when((a == "unknown") | (b == "unknown"), "?").when(a == b, "i").otherwise("v")


def explicit_alignment(q: Column, r: Column, ops: Column, q_start: Column, r_start: Column, turned: Column, q_end: Column, width: int = 60) -> Column:
    """array of lines: query, marks, reference, ``width`` columns at a time, with the places of their first and last bases.

    q and r are the aligned bases in the reference's direction; of a turned read places count down from q_end.
    """
    from ..functions.cigar import each, let

    cols = F.transform(
        each(ops),
        lambda x: F.struct(
            F.when(x["op"] == "D", "-").otherwise(F.substring(q, x["q"] + 1, F.lit(1))).alias("q"),
            F.when(x["op"] == "M", " ").when(x["op"] == "X", mark(F.upper(F.substring(q, x["q"] + 1, F.lit(1))), F.upper(F.substring(r, x["r"] + 1, F.lit(1))))).otherwise("-").alias("m"),
            F.when(x["op"] == "I", "-").otherwise(F.substring(r, x["r"] + 1, F.lit(1))).alias("r"),
            x["op"].alias("op"), x["q"].alias("qi"), x["r"].alias("ri"),
        ),
    )
    def block(own: Column) -> Column:
        text = lambda f: F.array_join(F.transform(own, lambda c: c[f]), "")
        first, last = own[0], F.element_at(own, -1)
        end = lambda c, f, gap: c[f] - F.when(c["op"] == gap, 1).otherwise(0)
        place = lambda at: F.when(turned, q_end - at).otherwise(q_start + at)
        return F.array(
            F.format_string("%10d %s %-10d", place(first["qi"]).cast("long"), text("q"), place(end(last, "qi", "D")).cast("long")),
            F.concat(F.lit(" " * 11), text("m")),
            F.format_string("%10d %s %-10d", (r_start + first["ri"]).cast("long"), text("r"), (r_start + end(last, "ri", "I")).cast("long")),
        )

    def blocks(c: Column) -> Column:
        starts = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.floor((F.size(c) - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda i: let(F.slice(c, i * width + 1, F.lit(width)), block)))

    return let(cols, blocks)
