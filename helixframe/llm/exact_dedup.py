"""Exact dedup by a sharded minimal perfect hash over distinct digests.

Texts are equal when they are after deleting ASCII blanks. Every row gets the SHA-256 of its normalised
text. An index is built over the distinct digests of the *history* (earlier runs, or the table itself): digests
are dealt to shards, and each shard gets a hash-and-displace minimal perfect hash whose slots hold the full
digest and the winner's locator. A row looks up its shard's displacement, goes to one slot and compares all
32 bytes: a member repeats its slot's winner; a nonmember is grouped among the nonmembers by digest.

The lookups are two equi-joins on numbers that the hash spreads evenly. Groups of copies are folded to one
row before them (map-side), so a group that holds a third of all rows puts no such weight on one slot; their rows meet
their group's row again in a join whose hot partitions AQE splits.

Defined results: null text counts as empty, and all texts of blanks only are one group; ties in length go to
the smallest doc_id (null ids last); repeated rows count each in ``group_size`` and share one result row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

#: Keys of a shard: what one task holds while it builds.
SHARD_KEYS = 20_000
#: Odd multiplier below 2^32: its products with 31-bit numbers fit a signed 64-bit one.
MIX = 0x9E3779B1
#: Mean keys of a displacement bucket.
BUCKET_KEYS = 4


def normalised(col):
    return F.translate(col, " \t\n\x0b\x0c\r", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest binary(32), n_cp): one narrow row per document."""
    t = tidy(docs, id_col, text_col)
    return t.select("doc_id", F.unhex(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)).alias("digest"), F.length("text").cast("long").alias("n_cp"))


def groups(keyed: DataFrame) -> DataFrame:
    """Per digest its winner (longest text, then smallest id) and size, combined map-side on fixed-width state."""
    low = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    first = F.min(F.struct((-F.col("n_cp")).alias("n"), low.alias("low"), F.col("doc_id").alias("keep_id")))
    return keyed.groupBy("digest").agg(first.alias("w"), F.count("*").alias("group_size")).select("digest", F.col("w.keep_id").alias("keep_id"), (-F.col("w.n")).alias("keep_cp"), "group_size")


# --- the hash: from the digest's own bits ---------------------------------------------------------------


def _part(pos: int):
    """Digest characters at pos as a number: 15 hexadecimal digits, 60 bits, never negative."""
    return F.conv(F.substring(F.hex(F.col("digest")), pos, 15), 16, 10).cast("long")


def addressed(df: DataFrame, n_shards: int, n_buckets: int) -> DataFrame:
    return df.withColumns({"shard": F.pmod(_part(1), F.lit(n_shards)).cast("int"), "bucket": F.pmod(_part(16), F.lit(n_buckets)).cast("int"), "h": _part(31)})


def slot_of(h, seed, n: int):
    """Slot of a 60-bit hash under a bucket's displacement seed, among n slots."""
    return ((((h >> 20) + seed * (h & 0xFFFFF | 1) & 0x7FFFFFFF) * MIX >> 20) & 0x7FFFFFFF) % n


def build_shard(h: np.ndarray, bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """Displacement seed of each bucket such that all keys of the shard get slots of their own, 0 to n - 1.

    The largest buckets choose first. Seeds go up until every key of the bucket falls on a free slot. Two different
    digests that agree in their first 180 bits could never part, and raise an error; none such are known.
    """
    n = len(h)
    seeds = np.zeros(n_buckets, np.int64)
    free = np.ones(n, bool)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    tries = np.arange(4096, dtype=np.int64)[:, None]
    for b in np.argsort(bounds[:-1] - bounds[1:], kind="stable"):
        keys = h[order[bounds[b] : bounds[b + 1]]]
        if not len(keys):
            break
        at, seed = 0, -1
        while seed < 0 and at < 1 << 30:
            span = tries[: 16 if at == 0 else 4096] + at
            s = slot_of(keys[None, :], span, n)
            ok = free[s].all(1)
            if len(keys) > 1:
                t = np.sort(s, 1)
                ok &= (t[:, 1:] != t[:, :-1]).all(1)
            hit = np.flatnonzero(ok)
            if len(hit):
                seed = int(span[hit[0], 0])
            at += len(span)
            if at > 64 * n + 65536:
                raise ValueError("no displacement found: two digests share 180 bits")
        seeds[b] = seed
        free[slot_of(keys, seed, n)] = False
    return seeds


class DigestIndex:
    """Displacements (shard, bucket, seed, n) and slots (shard, slot, digest, keep_id, keep_cp, group_size)."""

    def __init__(self, displace: DataFrame, slots: DataFrame, n_shards: int, n_buckets: int):
        self.displace, self.slots, self.n_shards, self.n_buckets = displace, slots, n_shards, n_buckets


def build_index(history: DataFrame) -> DigestIndex:
    """Index of distinct digests (digest, keep_id, keep_cp, group_size), a shard to a task."""
    n = history.count()
    n_shards = max(1, -(-n // SHARD_KEYS))
    n_buckets = max(1, -(-n // n_shards) // BUCKET_KEYS)
    addr = addressed(history, n_shards, n_buckets)

    def build(p: pd.DataFrame) -> pd.DataFrame:
        h, b = p["h"].to_numpy(np.int64), p["bucket"].to_numpy(np.int64)
        seeds = build_shard(h, b, n_buckets)
        return p.assign(seed=seeds[b], slot=slot_of(h, seeds[b], len(h)).astype(np.int64), n=len(h))[["shard", "bucket", "seed", "n", "slot", "digest", "keep_id", "keep_cp", "group_size"]]

    built = cut(addr.groupBy("shard").applyInPandas(build, "shard int, bucket int, seed long, n long, slot long, digest binary, keep_id long, keep_cp long, group_size long"))
    displace = built.select("shard", "bucket", "seed", "n").distinct()
    return DigestIndex(displace, built.select("shard", "slot", F.col("digest").alias("slot_digest"), "keep_id", "keep_cp", "group_size"), n_shards, n_buckets)


def lookup(distinct: DataFrame, index: DigestIndex) -> DataFrame:
    """(digest, keep_id, keep_cp, group_size, member): the slot's row where all bytes agree."""
    a = addressed(distinct, index.n_shards, index.n_buckets).select("digest", "shard", "bucket", "h")
    a = a.join(index.displace, ["shard", "bucket"], "left")
    low = lambda c, mask: c.bitwiseAND(F.lit(mask))
    x = low(F.shiftright("h", 20) + F.col("seed") * low(F.col("h"), 0xFFFFF).bitwiseOR(F.lit(1)), 0x7FFFFFFF)
    a = a.withColumn("slot", (low(F.shiftright(x * F.lit(MIX), 20), 0x7FFFFFFF) % F.col("n")).cast("long"))
    a = a.select("digest", "shard", "slot").join(index.slots, ["shard", "slot"], "left")
    same = F.coalesce(F.col("slot_digest") == F.col("digest"), F.lit(False))
    pick = lambda c: F.when(same, F.col(c)).alias(c)
    return a.select("digest", pick("keep_id"), pick("keep_cp"), pick("group_size"), same.alias("member"))


def dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Without ``history`` the table's own distinct digests are indexed. With one (digest, keep_id, keep_cp, group_size
    of earlier runs), its members repeat the historical winner and are dropped; nonmembers group separately.
    """
    keyed = cut(digests(docs, id_col, text_col))
    own = groups(keyed)
    if history is None:
        own = cut(own)
        index = build_index(own)
        found = lookup(own.select("digest"), index).select("digest", "keep_id", "group_size")
    else:
        found = lookup(own.select("digest"), build_index(history)).alias("f").join(own.alias("o"), "digest")
        found = found.select("digest", F.when(F.col("member"), F.col("f.keep_id")).otherwise(F.col("o.keep_id")).alias("keep_id"), (F.col("o.group_size") + F.coalesce(F.col("f.group_size"), F.lit(0))).alias("group_size"))
    out = keyed.join(found, "digest", "left")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def arrived_earlier(col_name: str = "doc_id"):
    """Whether a row belongs to the first of two batches, by a hash of its id: how a table is taken as one that arrived in two parts."""
    return F.pmod(F.xxhash64(col_name), F.lit(2)) == 0


def dedup_in_batches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of :func:`dedup` for a whole table, of which one part is the history of the other.

    The index is built over the distinct digests of the earlier batch alone. Groups of the later one are looked up in it: a member's winner and size
    are settled with those of its slot, nonmembers group separately; so no group is known before the index has been asked.
    """
    keyed = cut(digests(docs, id_col, text_col))
    index = build_index(cut(groups(keyed.where(arrived_earlier()))))
    late = cut(groups(keyed.where(~arrived_earlier())))
    seen = lookup(late.select("digest"), index).select("digest", F.col("keep_id").alias("old_id"), F.col("keep_cp").alias("old_cp"), F.col("group_size").alias("old_size"), "member")
    late = cut(late.join(seen, "digest"))
    low = lambda c: F.coalesce(F.col(c), F.lit(2**63 - 1))
    old_wins = F.col("member") & ((F.col("old_cp") > F.col("keep_cp")) | ((F.col("old_cp") == F.col("keep_cp")) & (low("old_id") <= low("keep_id"))))
    now = late.select("digest", F.when(old_wins, F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"), (F.col("group_size") + F.coalesce("old_size", F.lit(0))).alias("group_size"))
    untouched = index.slots.select(F.col("slot_digest").alias("digest"), "keep_id", "group_size").join(late.where("member").select("digest"), "digest", "left_anti")
    out = keyed.join(now.unionByName(untouched), "digest", "left")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def digest_of(text: str) -> bytes:
    """The digest of one text, for callers outside Spark."""
    return hashlib.sha256(text.encode().translate(None, b" \t\n\x0b\x0c\r")).digest()

