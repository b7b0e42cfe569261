"""Other lines of text about placements: SSAHA2 and GFF2 records, histogram bars; and the order in which records are written.

Null in any field of a line gives a null line, except in ``ops``, which counts as no operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cigar

PROGRAM = "helixframe"


def _query_ends() -> tuple[Column, Column]:
    """The query's span, turned on the other strand."""
    plus = F.col("strand") == "+"
    return F.when(plus, F.col("q_start")).otherwise(F.col("q_end")), F.when(plus, F.col("q_end")).otherwise(F.col("q_start"))


def _ops() -> Column:
    return F.coalesce(F.col("ops"), F.array().cast("array<struct<op:string,len:int>>"))


def ssaha_lines(a: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line) of placements with label, mapq, sw_score, qname, rname, spans, strand, ops, q_length, r_length.

    Identity is the percentage of aligned columns that match, rounded half up; 0 where nothing is aligned.
    """
    q1, q2 = _query_ends()
    match, ali = cigar.total(_ops(), "M").cast("long"), cigar.aligned_length(_ops()).cast("long")
    a = a.withColumns({"q1": q1, "q2": q2, "_match": match, "_ali": ali})
    hundredths = F.when(F.col("_ali") > 0, F.expr("(20000 * _match + _ali) div (2 * _ali)")).otherwise(F.lit(0))
    line = F.format_string(
        "alignment:%s:%02d %-5d %s %s %8d %8d %9d %9d   %s %7d %5.2f %d %d",
        "label", F.least(F.lit(99), F.col("mapq")), "sw_score", "qname", "rname", "q1", "q2", "r_start", "r_end", F.when(F.col("strand") == "+", "F").otherwise("C"), "_match", (hundredths / 100).cast("double"), "q_length", "r_length",
    )
    return a.select(*keys, line.alias("line"))


def gff2_lines(a: DataFrame, keys: list[str], program: str = PROGRAM) -> DataFrame:
    """(keys, line) with the ungapped blocks of each placement; without operations a block of zeros."""
    q1, q2 = _query_ends()
    width = F.col("q_end") - F.col("q_start")

    def block(x: Column) -> Column:
        q = F.when(F.col("strand") == "+", x["q"].cast("long")).otherwise(width - x["q"])
        return F.concat(F.lit(" Align "), (q + 1).cast("string"), F.lit(" "), (x["r"] + 1).cast("string"), F.lit(" "), x["len"].cast("string"), F.lit(";"))

    blocks = F.transform(cigar.blocks(_ops()), block)
    text = F.when(F.size(blocks) > 0, F.array_join(blocks, "")).otherwise(F.lit(" Align 0 0 0;"))
    a = a.withColumns({"q1": q1, "q2": q2})
    n = lambda c: F.col(c).cast("string")
    tab, blank = F.lit("\t"), F.lit(" ")
    line = F.concat(F.lit("gff: "), "qname", F.lit(f"\t{program}\tsimilarity\t"), n("q1"), tab, n("q2"), tab, n("sw_score"), tab, "strand", F.lit('\t.\tSubject "'), "rname", F.lit('" '), n("r_start"), blank, n("r_end"), F.lit(";\t"), text)
    return a.select(*keys, line.alias("line"))


def histogram_bars(h: DataFrame, width: int = 60) -> DataFrame:
    """(lo, line) of (lo, n): a bar of stars in proportion to the largest count. The window holds one row per bin."""
    bar = F.expr(f"repeat('*', cast(n * {width} div top AS int))")
    h = h.withColumn("top", F.max("n").over(Window.partitionBy()))
    return h.select("lo", F.concat(F.format_string("%8d %8d ", "lo", "n"), bar).alias("line"))


def histogram_text(h: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ord, line) of a histogram file that :func:`read_histogram` reads: a key, then (bins, width, low, high, total, three quartiles), then ``lo n`` a bin, empty bins too.

    h: (lo, width, n); at most some thousand rows.
    """
    from ..operators.pairs import quartiles

    one = h.agg(F.min("lo").alias("first"), F.max("lo").alias("last"), F.min("width").alias("w"), F.sum("n").alias("total")).crossJoin(quartiles(sizes).select("q1", "q2", "q3"))
    every = one.select("w", F.explode(F.expr("sequence(first, last, w)")).alias("lo"))
    rows = every.join(h.select("lo", "n"), "lo", "left").select(F.col("lo").alias("ord"), F.format_string("%d %d", "lo", F.coalesce("n", F.lit(0)).cast("long")).alias("line"))
    low = F.lit(-(1 << 40)).cast("long")
    head = one.select((low + 1).alias("ord"), F.concat_ws(" ", *[F.expr(e).cast("string") for e in ("(last - first) div w + 1", "w", "first", "last + w - 1", "total", "q1", "q2", "q3")]).alias("line"))
    ends = one.select(F.explode(F.array(F.struct(low.alias("ord"), F.lit(HISTOGRAM).alias("line")), F.struct((-low).alias("ord"), F.lit(HISTOGRAM_END).alias("line")))).alias("x")).select("x.*")
    return ends.unionByName(head).unionByName(rows)


HISTOGRAM, HISTOGRAM_END = "#insert histogram", "#end of histogram"


def read_histogram(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """((lo, width, n), the header's numbers) of a file as :func:`histogram_text` gives it; one whose counts don't add up is refused."""
    lines = [r["value"].strip() for r in spark.read.text(path, wholetext=False).collect()]
    try:
        a, z = lines.index(HISTOGRAM), lines.index(HISTOGRAM_END)
        keys = ("bins", "width", "low", "high", "total", "q1", "q2", "q3")
        head = dict(zip(keys, map(int, lines[a + 1].split()), strict=True))
        rows = [tuple(map(int, x.split())) for x in lines[a + 2 : z]]
    except ValueError as e:
        raise ValueError(f"{path} is no histogram") from e
    if len(rows) != head["bins"] or sum(n for _, n in rows) != head["total"] or [lo for lo, _ in rows] != list(range(head["low"], head["low"] + head["bins"] * head["width"], head["width"])):
        raise ValueError(f"the counts of {path} don't add up")
    return spark.createDataFrame([(lo, head["width"], n) for lo, n in rows], "lo long, width long, n long"), head


def in_input_order(r: DataFrame) -> DataFrame:
    """Records in the order of reads, mates and their own; sorted in ranges, so files by number are in order."""
    return r.orderBy("read_id", "mate", "ord")


def demote_primaries(r: DataFrame) -> DataFrame:
    """Where a mate has more than one primary record, none of them is primary."""
    n = F.count(F.when(F.col("is_primary"), 1)).over(Window.partitionBy("read_id", "mate"))
    return r.withColumn("is_primary", F.col("is_primary") & (n == 1))


def demote_primaries_by_flag(r: DataFrame) -> DataFrame:
    """SAM records where a mate with several primary ones keeps the best of them primary; the others, and only they, get the bit of secondary ones."""
    primary = F.col("flag").bitwiseAND(F.lit(0x100)) == 0
    nth = F.row_number().over(Window.partitionBy("read_id", "mate", primary).orderBy(F.col("as_score").desc(), F.col("mapq").desc(), "pair_no", "rname", "pos", "cigar"))
    r = r.withColumn("_nth", nth)
    return r.withColumn("flag", F.when(primary & (F.col("_nth") > 1), F.col("flag").bitwiseOR(F.lit(0x100))).otherwise(F.col("flag"))).drop("_nth")


def report_order(r: DataFrame) -> DataFrame:
    """Records once each, with ``out_group`` (0: pairs, then leftovers of mate 1 and 2) and ``ord`` within the read.

    ``pair_no`` is null for leftovers. Pairs come by number, the first mate before the second; leftovers by score, then place.
    """
    r = r.dropDuplicates().withColumn("out_group", F.when(F.col("pair_no").isNotNull(), 0).otherwise(F.col("mate")))
    rest = [c for c in r.columns if c not in ("read_id", "out_group", "pair_no", "mate", "sw_score")]
    w = Window.partitionBy("read_id").orderBy("out_group", "pair_no", "mate", F.col("sw_score").desc(), *rest)
    return r.withColumn("ord", F.row_number().over(w))
