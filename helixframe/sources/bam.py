"""BAM: reading and writing records in its blocked gzip form, by the public specification.

A file's blocks are found from its bytes, and a file is read by one task (give many files); writing makes a file a partition, each whole
by itself, with the same header.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
#: Bytes of a block's content, and the empty block that ends a file.
BLOCK = 0xFF00
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
RECORD = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, nm int, as_score int"
_FIELDS = [x.split()[0] for x in RECORD.split(", ")]
_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_NIBBLE = [a + b for a in BASES for b in BASES]


def inflate(raw: bytes) -> bytes:
    """All blocks of a file."""
    out, at = [], 0
    while at < len(raw):
        if raw[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a blocked gzip file")
        extra = struct.unpack_from("<H", raw, at + 10)[0]
        fields, end, size = at + 12, at + 12 + extra, None
        while fields < end:
            tag, n = raw[fields : fields + 2], struct.unpack_from("<H", raw, fields + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", raw, fields + 4)[0] + 1
            fields += 4 + n
        if size is None or at + size > len(raw):
            raise ValueError("a block is cut short")
        out.append(zlib.decompress(raw[end : at + size - 8], -15))
        at += size
    return b"".join(out)


def deflate(data: bytes, level: int = 1) -> bytes:
    """Data as blocks, and the block that ends a file."""
    return b"".join(block(data[at : at + BLOCK], level) for at in range(0, len(data), BLOCK)) + END


def block(part: bytes, level: int = 1) -> bytes:
    """A block of at most BLOCK bytes; it ends with the high byte of their number, which is 0."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(part) + z.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


def decode(data: bytes) -> Iterator[tuple]:
    """Records (RECORD) of an uncompressed file."""
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n_ref = struct.unpack_from("<i", data, at)[0]
    at += 4
    names = []
    for _ in range(n_ref):
        n = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + n].decode())
        at += 8 + n
    name_of = lambda i: names[i] if i >= 0 else "*"
    while at < len(data):
        size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiiBBHHHiiii", data, at)
        end, p = at + 4 + size, at + 36
        qname = data[p : p + l_name - 1].decode()
        p += l_name
        ops = struct.unpack_from(f"<{n_cigar}I", data, p)
        p += 4 * n_cigar
        seq = "".join(map(_NIBBLE.__getitem__, data[p : p + (l_seq + 1) // 2]))[:l_seq]
        p += (l_seq + 1) // 2
        q = data[p : p + l_seq]
        qual = None if not l_seq or q[0] == 0xFF else "".join(chr(33 + x) for x in q)
        tags = _tags(data, p + l_seq, end)
        yield qname, flag, name_of(ref), pos + 1, mapq, "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*", name_of(next_ref), next_pos + 1, tlen, seq or "*", qual, tags.get("NM"), tags.get("AS")
        at = end


_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def _tags(data: bytes, at: int, end: int) -> dict[str, int]:
    """Whole-number tags; others are passed over."""
    out = {}
    while at + 3 <= end:
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.index(0, at) + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(data[at])] * struct.unpack_from("<I", data, at + 1)[0]
        else:
            if kind in _CODES:
                out[tag] = struct.unpack_from(_CODES[kind], data, at)[0]
            at += _SIZES[kind]
    return out


def _bin(lo: int, hi: int) -> int:
    """The smallest bin of the index that holds places lo to hi (from 0, hi past the end)."""
    hi -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if lo >> shift == hi >> shift:
            return first + (lo >> shift)
    return 0


def encode(record: tuple, ids: dict[str, int]) -> bytes:
    qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, nm, score = record
    ops = [] if cigar in (None, "*") else [(int(n), o) for n, o in _CIGAR.findall(cigar)]
    span = sum(n for n, o in ops if o in "MDN=X") or 1
    seq = "" if seq in (None, "*") else seq.upper()
    code = [max(0, BASES.find(c)) if c in BASES else 15 for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(code[i] << 4 | code[i + 1] for i in range(0, len(code), 2))
    q = bytes(ord(c) - 33 for c in qual) if qual not in (None, "*") and len(qual) == len(seq) else b"\xff" * len(seq)
    tags = b"".join(t + struct.pack("<i", int(v)) for t, v in ((b"NMi", nm), (b"ASi", score)) if v is not None)
    name = qname.encode() + b"\0"
    lo = (pos or 0) - 1
    body = struct.pack("<iiBBHHHiiii", ids.get(rname, -1), lo, len(name), mapq or 0, _bin(max(0, lo), max(0, lo) + span), len(ops), flag, len(seq), ids.get(rnext, -1), (pnext or 0) - 1, tlen or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in ops) + packed + q + tags
    return struct.pack("<i", len(body)) + body


def header(refs: list[tuple[str, int]], text: str) -> bytes:
    out = b"BAM\x01" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(refs))
    for name, length in refs:
        n = name.encode() + b"\0"
        out += struct.pack("<i", len(n)) + n + struct.pack("<i", length)
    return out


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows, and ``ordinal``, their number in the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                rows: list[tuple] = []
                for i, r in enumerate(decode(inflate(bytes(raw)))):
                    rows.append((*r, i))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=[*_FIELDS, "ordinal"]).astype({"nm": "Int32", "as_score": "Int32"})
                        rows = []
                yield pd.DataFrame(rows, columns=[*_FIELDS, "ordinal"]).astype({"nm": "Int32", "as_score": "Int32"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"{RECORD}, ordinal long")


def bam_blocks(records: DataFrame, refs: DataFrame, program: str = "") -> DataFrame:
    """(block): the blocks of a whole file for each partition's records (RECORD), in their order. Headers name all references, which the driver holds for that.

    Clips in ``cigar`` should be soft, as sequences are written whole.
    """
    from .sam import header_lines

    known = [(r["name"], int(r["length"])) for r in refs.select(F.split("name", r"\s")[0].alias("name"), "length", "seq_idx").orderBy("seq_idx").toLocalIterator()]
    text = "".join(line + "\n" for line in header_lines(known, program, version="1.4"))
    ids = {n: i for i, (n, _) in enumerate(known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = header(known, text)
        made = lambda blocks: pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])
        for b in batches:
            held += b"".join(encode(r, ids) for r in zip(*[b.column(c).to_pylist() for c in _FIELDS], strict=True))
            whole = len(held) // BLOCK * BLOCK
            if whole:
                yield made([block(held[at : at + BLOCK]) for at in range(0, whole, BLOCK)])
            held = held[whole:]
        yield made(([block(held)] if held else []) + [END])

    return records.select(*_FIELDS).mapInArrow(run, "block binary")


def write_bam(records: DataFrame, refs: DataFrame, folder: str, program: str = "") -> int:
    """Files part-N.bam in a folder of any Hadoop file system, each written by the executor that made it; returns how many."""
    spark = records.sparkSession
    # every block ends with a byte 0: as the separator of lines it is what Spark's writer of texts adds to the rest of the block, byte by byte the file
    rest = bam_blocks(records, refs, program).select(F.expr("cast(substring(block, 1, length(block) - 1) AS string)").alias("value"))
    rest.write.mode("overwrite").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 0).text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    made = sorted(f.getPath().getName() for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("part-"))
    for i, name in enumerate(made):
        fs.rename(path(f"{folder}/{name}"), path(f"{folder}/part-{i:05d}.bam"))
    return len(made)
