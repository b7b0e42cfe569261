"""What the operators of this package share: word rules and hashing of byte strings; and, from the library, tables in the shared folder."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, exists, forget_at_exit, remove, shared_dir, stored

__all__ = ["cut", "exists", "forget_at_exit", "remove", "shared_dir", "stored"]

#: Words are maximal runs of characters other than the six ASCII blanks; ``bytes.split()`` cuts alike.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
BLANK_BYTES = b" \t\n\x0b\x0c\r"
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
M64 = (1 << 64) - 1


def tidy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text), a null text read as empty; other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def h64(b: bytes, seed: int = 0) -> int:
    """Signed 64-bit hash of bytes."""
    x = xxhash.xxh3_64_intdigest(b, seed)
    return x - (1 << 64) if x >> 63 else x


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


SPACE_RE = re.compile(r"[\x20\x09-\x0D]+")
