"""What a file of reads is, by its first bytes; and readers by format."""

from __future__ import annotations

import gzip
import zlib

from pyspark.sql import DataFrame, SparkSession

from . import bam, fastx, sam

FORMATS = ("fasta", "fastq", "sam", "bam")


def format_of(head: bytes) -> str:
    """The format of a file that begins so; gzip is looked into. An unknown one is an error."""
    if head[:2] == b"\x1f\x8b":
        inside = zlib.decompressobj(31).decompress(head)
        return "bam" if inside[:4] == b"BAM\x01" else format_of(inside)
    first = head.lstrip(b"\r\n\t ")[:1]
    if head[:4] == b"BAM\x01":
        return "bam"
    if first == b">":
        return "fasta"
    if first == b"@":
        # a header line of SAM: two capital letters, then a tab
        line = head.lstrip().split(b"\n", 1)[0]
        return "sam" if len(line) > 3 and line[1:3].isalpha() and line[1:3].isupper() and line[3:4] == b"\t" else "fastq"
    if head.split(b"\n", 1)[0].count(b"\t") >= 10:
        return "sam"
    raise ValueError("neither FASTA, FASTQ, SAM nor BAM")


def guess(spark: SparkSession, path: str) -> str:
    """Format of the first file under a path, from its first 64 KB, on whatever file system it is."""
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).collect()
    if not files:
        raise ValueError(f"no file under {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(files[0]["path"])
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(p)
    try:
        n = min(1 << 16, fs.getFileStatus(p).getLen())
        head = bytes(stream.readNBytes(n)) if n else b""
    finally:
        stream.close()
    return format_of(head)


def read_any(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """(read_id, mate, qname, seq, qual) of a file in a given or guessed format; mate is 0 where the format doesn't tell."""
    kind = format or guess(spark, path)
    if kind in ("fasta", "fastq"):
        return fastx.read_fastx(spark, path).selectExpr("read_id", "0 AS mate", "qname", "seq", "qual")
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    records = sam.read_sam(spark, path) if kind == "sam" else bam.read_bam(spark, path)
    return sam.collated(records)


def parse_stdin(data: bytes) -> list[tuple[int, str, str, str | None]]:
    """Records (read_id, qname, seq, qual) of FASTA or FASTQ from a pipe, plain or gzipped: for small inputs, as all of it is in the driver."""
    text = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    return [(i, *r) for i, r in enumerate(fastx.parse_fastx(text.decode("latin-1").splitlines()))]


def read_stdin(spark: SparkSession, limit: int = 256 << 20) -> DataFrame:
    """Records from standard input, as ``-`` means on a command line; more than ``limit`` bytes are refused, since a pipe can't be read by executors."""
    import sys

    data = sys.stdin.buffer.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"standard input is longer than {limit} bytes: put it in a file")
    return spark.createDataFrame(parse_stdin(data), fastx.RECORD)
