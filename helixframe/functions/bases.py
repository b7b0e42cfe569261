"""Expressions on bases, qualities and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AZ = "abcdefghijklmnopqrstuvwxyz"
ACGT = ("ACGT" * 7)[:26]


def dna(text: Column) -> Column:
    """Letters of a text as bases: the bridge from ordinary tables to sequences."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", ""), AZ, ACGT)


def encode(seq: Column) -> Column:
    """Upper case, U as T, everything that is no base as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def base_class(base: Column) -> Column:
    return F.when(base.isin("A", "G"), "purine").when(base.isin("C", "T"), "pyrimidine").when(base == "N", "unknown").otherwise("other")


def phred(c: Column) -> Column:
    return F.ascii(c) - 33


def short_name(name: Column) -> Column:
    """Up to the first blank, without a mate's suffix."""
    return F.regexp_replace(F.split(name, r"\s")[0], "/[12]$", "")


def names_match(a: Column, b: Column) -> Column:
    """Names of mates: equal, or equal but for /1 and /2 or .F and .R."""
    base = lambda c, s: F.regexp_replace(c, s, "")
    return (a == b) | (a.endswith("/1") & b.endswith("/2") & (base(a, "/1$") == base(b, "/2$"))) | (a.endswith(".F") & b.endswith(".R") & (base(a, r"\.F$") == base(b, r"\.R$")))


def word_code(word: Column) -> Column:
    """A word of A, C, G, T as a number, two bits a base."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a * 4 + (F.instr(F.lit("ACGT"), c) - 1))


def encode_alphabet(seq: Column, alphabet: str, unknown: str = "N") -> Column:
    """Letters of a user's alphabet in upper case, all else as ``unknown``."""
    letters = alphabet.upper()
    if not letters.isalpha() or len(set(letters)) != len(letters):
        raise ValueError("an alphabet is made of different letters")
    return F.regexp_replace(F.upper(seq), f"[^{letters}]", unknown)


def segment(seq: Column, start: Column, length: Column, turned: Column | None = None) -> Column:
    """Bases from ``start`` (from 0), as standard bases, cut at the end; reverse-complemented where ``turned``."""
    part = encode(F.substring(seq, start.cast("int") + 1, length.cast("int")))
    return part if turned is None else F.when(turned, reverse_complement(part)).otherwise(part)


def append_segment(seq: Column, other: Column, start: Column, length: Column, turned: Column | None = None) -> Column:
    return F.concat(seq, segment(other, start, length, turned))


def crop(seq: Column, start: Column, end: Column) -> Column:
    """Bases from start (from 0) up to but not with end."""
    return F.substring(seq, start.cast("int") + 1, F.greatest(F.lit(0), end - start).cast("int"))


def mixed(word: Column, seed: int = 0) -> Column:
    """A number of 32 bits that spreads word codes evenly: what deals words to buckets."""
    return F.xxhash64(F.lit(seed), word).bitwiseAND(F.lit((1 << 32) - 1))
