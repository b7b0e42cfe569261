"""Token counts through a cache of digests.

A text's key is the SHA-256 of its (normalised) content together with the digest of the tokenizer file. Known keys are
joined to their stored counts; of the others, one text per distinct key is encoded, and the new counts are appended to the cache,
a Parquet folder that all executors share. Hot contents are folded map-side before the exchange, so a text that
a third of all rows share is encoded once and sent once per map task.

Defined results: null text counts as empty (0 tokens); null ids and repeated rows are passed through; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, exists, remove, shared_dir, tidy
from .tokens import byte_counter, version_digest

CACHE = "digest binary, version string, n_tokens long"


def _key(text: Column, normalise: Callable[[Column], Column]) -> Column:
    return F.unhex(F.sha2(F.encode(normalise(text), "UTF-8"), 256))


def encode_misses(misses: DataFrame, path: str, version: str) -> DataFrame:
    """(digest, version, n_tokens) of rows (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = byte_counter(path)
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "version", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, CACHE)


def store_counts(docs: DataFrame, path: str, cache: str, normalise: Callable[[Column], Column] = lambda c: c, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode one text of each key that ``cache`` has no count for, and append the counts."""
    spark = docs.sparkSession
    version = version_digest(path)
    t = tidy(docs, id_col, text_col)
    distinct = t.select(_key(F.col("text"), normalise).alias("digest"), "text").groupBy("digest").agg(F.first("text").alias("text"))
    if exists(spark, cache):
        known = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).select("digest")
        distinct = distinct.join(known, "digest", "left_anti")
    encode_misses(distinct, path, version).write.mode("append").parquet(cache)


def stored_counts(docs: DataFrame, path: str, cache: str, limit: int = 1024, normalise: Callable[[Column], Column] = lambda c: c, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) by the counts in ``cache`` as it is now; null where it has none."""
    version = version_digest(path)
    t = tidy(docs, id_col, text_col)
    # two runs at once may both have appended a key, with the same count
    counts = docs.sparkSession.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    narrow = t.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _key(F.col("text"), normalise).alias("digest"))
    return narrow.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 1024, normalise: Callable[[Column], Column] = lambda c: c, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit); new counts are in ``cache`` when this returns.

    ``normalise`` may only be something under which the tokenizer's count doesn't change; texts equal after it share a count.
    """
    store_counts(docs, path, cache, normalise, id_col, text_col)
    return stored_counts(docs, path, cache, limit, normalise, id_col, text_col)


def count_tokens_in_batches(docs: DataFrame, path: str, cache: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for a table taken as one that arrived in two batches: the later one finds the counts that the earlier one stored.

    Every row is in one batch, by a hash of its id. Without ``cache`` one is made that is removed afterwards.
    """
    spark = docs.sparkSession
    own = cache or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    earlier = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0
    store_counts(docs.where(earlier), path, own, id_col=id_col, text_col=text_col)
    store_counts(docs.where(~earlier), path, own, id_col=id_col, text_col=text_col)
    # one read of the cache: plans of two reads at different times would share the first one's files
    out = cut(stored_counts(docs, path, own, limit, id_col=id_col, text_col=text_col))
    if cache is None:
        remove(spark, own)
    return out
