"""FASTA and FASTQ: reading, checking, writing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bases import names_match

RECORD = "read_id long, qname string, seq string, qual string"


def parse_fastx(lines: Iterable[str]) -> Iterator[tuple[str, str, str | None]]:
    """Records of either format, any line width; a quality is read until it is as long as its sequence."""
    name: str | None = None
    seq: list[str] = []
    it = iter(lines)
    for line in it:
        line = line.rstrip("\r\n")
        if line.startswith((">", "@")):
            if name is not None:
                yield name, "".join(seq), None
            name, seq = " ".join(line[1:].split()), []
        elif line.startswith("+") and name is not None:
            n, qual = sum(map(len, seq)), ""
            while len(qual) < n:
                more = next(it, None)
                if more is None:
                    raise ValueError(f"quality of {name} ends early")
                qual += more.rstrip("\r\n")
            if len(qual) != n:
                raise ValueError(f"quality of {name} is longer than its sequence")
            yield name, "".join(seq), qual
            name, seq = None, []
        elif name is not None:
            seq.append("".join(line.split()))
    if name is not None:
        yield name, "".join(seq), None


def read_fastx(spark: SparkSession, path: str) -> DataFrame:
    """General form. A record has no marks to split a file by, so a file is the unit; give many files. gzip by its suffix."""

    def run(batches):
        import gzip
        import io
        from itertools import islice

        import pandas as pd

        for b in batches:
            for raw in b["content"]:
                # records are parsed as they are unpacked, AT_ONCE of them at a time
                file = io.BytesIO(raw)
                rows = enumerate(parse_fastx(io.TextIOWrapper(gzip.GzipFile(fileobj=file) if raw[:2] == b"\x1f\x8b" else file, "latin-1")))
                while some := [(i, *r) for i, r in islice(rows, AT_ONCE)]:
                    yield pd.DataFrame(some, columns=["read_id", "qname", "seq", "qual"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


#: Records that are held at once while a file is read.
AT_ONCE = 10_000


def read_fastq_lines(spark: SparkSession, path: str) -> DataFrame:
    """Four-line FASTQ of any size, a file or a folder of files that follow each other by name: lines numbered along parts of files, then dealt by four."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("from"), F.monotonically_increasing_id().alias("i"))
    # a row a part of a file, whose lines are numbered without gaps
    size = t.groupBy("file", "from").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    size = size.select("file", "from", "first", (F.sum("n").over(Window.orderBy("file", "from")) - F.col("n")).alias("ahead"))
    t = t.join(F.broadcast(size), ["file", "from"]).withColumn("line", F.col("ahead") + F.col("i") - F.col("first"))
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    g = t.groupBy(F.expr("line div 4").alias("read_id")).agg(part(0).alias("qname"), part(1).alias("seq"), part(3).alias("qual"))
    return g.select("read_id", F.regexp_replace(F.substring("qname", 2, 1 << 20), r"\s+", " ").alias("qname"), "seq", "qual")


def pair_up(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mates of two files in one order; a record without a partner fails the job when it is read."""
    j = a.alias("a").join(b.alias("b"), "read_id", "full_outer")
    lonely = F.col("a.seq").isNull() | F.col("b.seq").isNull()
    both = F.array(*[F.struct(F.lit(m).alias("mate"), F.col(f"{s}.qname").alias("qname"), F.col(f"{s}.seq").alias("seq"), F.col(f"{s}.qual").alias("qual")) for m, s in ((1, "a"), (2, "b"))])
    return j.select("read_id", F.explode(F.when(lonely, F.raise_error(F.lit("files of mates differ in length"))).otherwise(both)).alias("r")).select("read_id", "r.*")


def check(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(n_reads, max_length, max_name, all_letters), of all records or by group; null without records."""
    return reads.groupBy(*(by or [])).agg(F.count("*").alias("n_reads"), F.max(F.length("seq")).cast("long").alias("max_length"), F.max(F.length("qname")).cast("long").alias("max_name"), F.bool_and(letters_only(F.col("seq"))).alias("all_letters"))


def letters_only(seq: Column) -> Column:
    return seq.rlike(r"\A[A-Za-z]*\z")


def check_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("read_id", F.col("qname").alias("qa")).join(b.select("read_id", F.col("qname").alias("qb")), "read_id", "full_outer")
    return j.agg(F.bool_and(F.col("qa").isNotNull() & F.col("qb").isNotNull()).alias("same_count"), F.bool_and(names_match(F.col("qa"), F.col("qb"))).alias("names_match"))


def fastx_lines(reads: DataFrame, width: int | None = None) -> DataFrame:
    """(read_id, value): FASTQ with qualities, else FASTA; sequences and qualities in lines of ``width``, if given."""

    def lined(c: str) -> Column:
        if width is None:
            return F.col(c)
        return F.array_join(F.regexp_extract_all(F.col(c), F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), "\n")

    return reads.select("read_id", F.when(F.col("qual").isNotNull(), F.concat_ws("\n", F.concat(F.lit("@"), "qname"), lined("seq"), F.lit("+"), lined("qual"))).otherwise(F.concat_ws("\n", F.concat(F.lit(">"), "qname"), lined("seq"))).alias("value"))
