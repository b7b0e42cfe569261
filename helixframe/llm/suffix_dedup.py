"""Removal of long repeated byte strings by suffix arrays and longest-previous-factor matches.

A byte goes when a string of ``length`` bytes that covers it also starts elsewhere. One suffix array of a corpus isn't
distributable, so equal strings are first brought together:

1. Each window of ``length`` bytes has an anchor, the place of its least ``gram``-byte hash. Equal windows have equal anchors at equal places,
   so a window whose anchor's gram occurs once can't repeat. Per text some 2 / (length - gram + 2) of its places are anchors; they are counted
   in one exchange of hashes, combined map-side. Equal texts are one text from the start.
2. Texts with repeated grams are read again (the one exchange of texts) and give, per such anchor, the segment that holds its windows. A
   window that repeats within its own text is sent once. Equal segments are folded map-side.
3. Segments are dealt by gram into groups of bounded size, and each group's suffix array is built by doubling. In suffix order, previous and
   next smaller positions give the longest previous factor of each window start; at least ``length`` means it stands earlier.
4. A gram with more than ``HOT_SEGMENTS`` different segments would make too large a group. Each of its windows holds, next to the gram, half of what the
   window has besides on one of both sides; so the windows are dealt anew by the gram with that half added, each segment into two at
   most, and go through step 3. What isn't settled so is halved again: after eight rounds a key is a whole window.

Hashes only bring strings together; whether bytes go is always decided by the bytes.

``later`` mode keeps the first of each repeated string in the order (doc_id, place); ``all`` mode removes every one of them.

Defined results: null text counts as empty; texts under ``length`` bytes lose nothing; null ids come last in the order; repeated rows are
copies of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, h64, tidy
from .minhash import _lists, _mix

#: Bytes of segments in a group, and different segments of a gram beyond which it is split.
GROUP_BYTES = 1_000_000
HOT_SEGMENTS = 100
LAST = 2**63 - 1


@dataclass(frozen=True)
class RepeatParams:
    length: int = 400
    gram: int = 200
    mode: str = "later"


_TABLE = np.random.default_rng(23).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0] = 1
        at = 1
        while at < n:
            m = min(at, n - at)
            out[at : at + m] = out[:m] * np.uint64(pow(x, at, 1 << 64))
            at += m
        return out

    return run(_BASE), run(_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(14, (n - 1).bit_length()))


def prefix_hash(b: bytes) -> np.ndarray:
    x = _TABLE[np.frombuffer(b, np.uint8)] * powers(len(b))[0][: len(b)]
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of that size."""
    n = len(prefix) - size
    return _mix((prefix[size:] - prefix[:-size]) * powers(len(prefix))[1][:n])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by minima from both ends of blocks of w."""
    n = len(v)
    pad = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    pad[:n] = v
    blocks = pad.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(b: bytes, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, end of windows, place) of each anchor in order, and the prefix hash; windows are split among anchors."""
    prefix = prefix_hash(b)
    g = window_hash(prefix, p.gram)
    # the high half orders, the place breaks ties to the left
    v = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    at = (sliding_min(v, p.length - p.gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return g[at[first]], first, np.append(first[1:], len(at)), at[first], prefix


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def gram_sets(keyed: DataFrame, p: RepeatParams) -> DataFrame:
    """(doc_id, key, n_bytes, grams, own) of (doc_id, key, text); own: a gram repeats within the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, grams, own = [], [], []
            for t in b.column(2):
                x = t.as_py().encode("utf-8", "surrogatepass")
                g = anchors(x, p)[0] if len(x) >= p.length else np.empty(0, np.uint64)
                n.append(len(x))
                grams.append(np.unique(g))
                own.append(len(grams[-1]) < len(g))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), _lists(grams), pa.array(own, pa.bool_())], names=["doc_id", "key", "n_bytes", "grams", "own"])

    return keyed.mapInArrow(run, "doc_id long, key binary, n_bytes long, grams array<long>, own boolean")


SEGMENT = "gram long, key binary, place long, low long, n_windows long, multi boolean, seg binary, known int, known_to int"
_NAMES = [x.split()[0] for x in SEGMENT.split(", ")]
_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def segments(cand: DataFrame, p: RepeatParams) -> DataFrame:
    """Segments of candidate texts (key, low, text, grams), with where in them the gram stands; rows without a gram are windows that repeat in their own text."""

    def of(key: bytes, low: int, b: bytes, grams: set[int]) -> Iterator[tuple]:
        g, lo, hi, place, prefix = anchors(b, p)
        n = len(b) - p.length + 1
        local = np.zeros(n, bool)
        first = np.ones(n, bool)
        if len(np.unique(g)) < len(g):
            h = window_hash(prefix, p.length)
            _, index, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            local = count[inverse] > 1
            first[:] = False
            first[index] = True
            gone = local if p.mode == "all" else local & ~first
            for s, e in zip(*runs(gone), strict=True):
                yield None, key, int(s), low, int(e - s), True, None, None, None
        for x, s, e, at in zip(g.view(np.int64).tolist(), lo.tolist(), hi.tolist(), place.tolist(), strict=True):
            if x in grams:
                for flag in (False, True):
                    for a, z in zip(*runs(first[s:e] & (local[s:e] == flag)), strict=True):
                        yield x, key, s + int(a), low, int(z - a), flag, b[s + a : s + z - 1 + p.length], at - s - int(a), at - s - int(a) + p.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, low, text, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += of(key, low, text.encode("utf-8", "surrogatepass"), set(grams))
                if len(rows) > 4000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return cand.select("key", "low", "text", "grams").mapInArrow(run, SEGMENT)


# --- suffix arrays ---------------------------------------------------------------------------------------


def prefix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each place (missing bytes count as 0), by doubling from eight bytes."""
    n = len(text)
    pad = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    step = min(8, length)
    for k in range(step):
        word = (word << np.uint64(8)) | pad[k : k + n]
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    while step < length:
        ahead = min(step, length - step)
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - ahead)] = rank[ahead:]
        rank = np.unique(rank * (int(rank.max()) + 2) + nxt, return_inverse=True)[1].astype(np.int64)
        step += ahead
    return rank


def nearest_smaller(pos: list[int]) -> tuple[list[int], list[int]]:
    """Per entry of the suffix order, the indexes of the previous and next entry with a smaller position, or -1."""
    prev, nxt, stack = [-1] * len(pos), [-1] * len(pos), []
    for i, x in enumerate(pos):
        while stack and pos[stack[-1]] > x:
            nxt[stack.pop()] = i
        if stack:
            prev[i] = stack[-1]
        stack.append(i)
    return prev, nxt


def repeated(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per start, whether its ``length`` bytes also start at an earlier one (longest previous factor), and at a later one."""
    rank = prefix_ranks(text, length)[starts]
    order = np.lexsort((starts, rank))
    r, pos = rank[order], starts[order]

    def match(key: np.ndarray) -> np.ndarray:
        p, q = (np.array(x, np.int64) for x in nearest_smaller(key.tolist()))
        # the factor shared with the nearer of both reaches ``length`` just when the ranks are equal
        hit = ((p >= 0) & (r[p] == r)) | ((q >= 0) & (r[q] == r))
        out = np.zeros(len(r), bool)
        out[order] = hit
        return out

    return match(pos), match(-pos)


def group_repeats(p: RepeatParams):
    """applyInPandas over a group of different segments: ranges of their windows that go."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["low", "place", "seg_id"], kind="stable")
        segs, nw = g["seg"].tolist(), g["n_windows"].to_numpy(np.int64)
        base = np.concatenate([[0], np.cumsum([len(s) for s in segs])])[:-1]
        first = np.repeat(base - np.concatenate([[0], np.cumsum(nw)])[:-1], nw) + np.arange(nw.sum())
        earlier, later = repeated(np.frombuffer(b"".join(segs), np.uint8), first, p.length)
        gone = earlier if p.mode != "all" else earlier | later
        out, at = [], 0
        for gram, seg_id, n in zip(g["gram"], g["seg_id"], nw, strict=True):
            for s, e in zip(*runs(gone[at : at + n]), strict=True):
                out.append((gram, seg_id, int(s), int(e - s)))
            at += n
        return pd.DataFrame(out, columns=["gram", "seg_id", "at", "n"])

    return run


def split(segs: DataFrame, p: RepeatParams) -> DataFrame:
    """The windows of segments under longer keys: the known bytes and half of a window's others, on the side where the window holds that half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                rows = []
                for gram, key, place, low, n, multi, seg, known, known_to in zip(*(c.to_pylist() for c in b.slice(i, 2000).columns), strict=True):
                    other = p.length - (known_to - known)
                    half = (other + 1) // 2
                    # windows 0 to known - half hold the left half
                    left = max(0, min(n, known - half + 1))
                    if left:
                        x = seg[: left - 1 + p.length]
                        rows.append((h64(gram.to_bytes(8, "big", signed=True) + b"<" + seg[known - half : known]), key, place, low, left, multi, x, known - half, known_to))
                    if left < n:
                        more = other - half + 1
                        rows.append((h64(gram.to_bytes(8, "big", signed=True) + b">" + seg[known_to : known_to + more]), key, place + left, low, n - left, multi, seg[left:], known - left, known_to + more - left))
                yield _batch(rows)

    return segs.select(*_NAMES).mapInArrow(run, SEGMENT)


def repeat_ranges(segs: DataFrame, p: RepeatParams) -> DataFrame:
    """(key, at, n): ranges of windows that go, by text; segs as :func:`segments` gives them, in the shared folder."""
    out = segs.where("gram IS NULL").select("key", F.col("place").alias("at"), F.col("n_windows").alias("n"))
    occ = segs.where("gram IS NOT NULL")
    while True:
        occ = occ.withColumn("seg_id", F.unhex(F.sha2("seg", 256)))
        # digests, not bytes, tell how many different segments a gram has
        first = F.min(F.struct("low", "place", "key")).alias("f")
        kinds = cut(occ.groupBy("gram", "seg_id", "n_windows").agg(first, F.count("*").alias("c"), F.max("multi").alias("multi")).select("gram", "seg_id", "n_windows", F.col("f.low").alias("low"), F.col("f.place").alias("place"), F.col("f.key").alias("key"), "c", "multi"))
        n_of = cut(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"))
        hot = n_of.where(F.col("kinds") > HOT_SEGMENTS).select("gram")
        over = not hot.isEmpty()
        if over:
            kinds, own = kinds.join(hot, "gram", "left_anti"), occ.join(hot, "gram", "left_anti")
        else:
            own = occ
        out = out.unionByName(_settled(own, kinds, n_of.where(F.col("kinds") <= HOT_SEGMENTS), p))
        if not over:
            return out
        occ = cut(split(occ.join(hot, "gram", "left_semi"), p))


def _settled(occ: DataFrame, kinds: DataFrame, n_of: DataFrame, p: RepeatParams) -> DataFrame:
    """Ranges of the windows that go, of grams whose different segments fit into a group."""
    # the bytes of one of each
    many = cut(occ.select("gram", "key", "place", "seg").join(kinds.join(n_of, "gram").hint("shuffle_hash"), ["gram", "key", "place"]))
    total = many.agg(F.sum(F.length("seg"))).first()[0] or 0
    n_groups = max(1, -(-total // GROUP_BYTES))
    many = many.withColumn("grp", F.pmod(F.xxhash64("gram"), F.lit(n_groups)).cast("int"))
    found = many.select("grp", "gram", "seg_id", "seg", "n_windows", "low", "place").groupBy("grp").applyInPandas(group_repeats(p), "gram long, seg_id binary, at long, n long")
    by_kind = occ.select("gram", "seg_id", "key", "place").join(found, ["gram", "seg_id"]).select("key", (F.col("place") + F.col("at")).alias("at"), "n")
    # segments that stand in several places go whole
    whole = occ.select("gram", "seg_id", "key", "place", "n_windows").join(kinds.where("c > 1 OR multi").select("gram", "seg_id", F.col("key").alias("first_key"), F.col("place").alias("first_place"), "c", "multi"), ["gram", "seg_id"])
    if p.mode != "all":
        whole = whole.where((F.col("c") > 1) & ((F.col("key") != F.col("first_key")) | (F.col("place") != F.col("first_place"))))
    return by_kind.unionByName(whole.select("key", F.col("place").alias("at"), F.col("n_windows").alias("n")))


def remove(b: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of b, and the maximal removed spans, of ranges (first window, number of windows)."""
    d = np.zeros(len(b) + 1, np.int64)
    for at, n in ranges:
        d[at] += 1
        d[at + n - 1 + length] -= 1
    gone = np.cumsum(d[:-1]) > 0
    return np.frombuffer(b, np.uint8)[~gone].tobytes(), list(zip(*(x.tolist() for x in runs(gone)), strict=True))


def cut_texts(rows: DataFrame, p: RepeatParams) -> DataFrame:
    """(key, n_removed, spans, kept_sha256, kept_text) of (key, text, ranges). A cut may fall within a character; the text then has U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, ranges in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = text.encode("utf-8", "surrogatepass")
                kept, spans = remove(x, [(r["at"], r["n"]) for r in ranges], p.length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.binary()), pa.array([len(x) - len(kept)], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept.decode("utf-8", "replace")])],
                    names=["key", "n_removed", "spans", "kept_sha256", "kept_text"],
                )

    return rows.select("key", "text", "ranges").mapInArrow(run, "key binary, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, p: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept_text) per row; kept_text is null where nothing was removed."""
    keyed = tidy(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("key"), "text")
    sets = cut(gram_sets(keyed, p))
    low = F.coalesce(F.col("doc_id"), F.lit(LAST))
    texts = cut(sets.groupBy("key").agg(F.min(low).alias("low"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("own").alias("own")))
    pairs = texts.select("key", F.explode("grams").alias("gram"))
    common = pairs.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    wanted = pairs.join(common, "gram").groupBy("key").agg(F.collect_list("gram").alias("grams"))
    # and texts that may repeat themselves
    alone = texts.where("own").select("key", F.array().cast("array<long>").alias("grams"))
    wanted = wanted.unionByName(alone).groupBy("key").agg(F.flatten(F.collect_list("grams")).alias("grams"))
    wanted = wanted.join(texts.select("key", "low"), "key")
    cand = keyed.withColumn("low", low).drop("doc_id").join(wanted.hint("shuffle_hash"), ["key", "low"]).select("key", "low", "text", "grams")
    cand = cut(cand)
    segs = cut(segments(cand, p))
    ranges = repeat_ranges(segs, p).groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))
    done = cut_texts(cand.join(ranges, "key"), p).groupBy("key").agg(*(F.first(c).alias(c) for c in ("n_removed", "spans", "kept_sha256", "kept_text")))
    out = sets.select("doc_id", "key", "n_bytes").join(texts.select("key", "low", "copies"), "key").join(done, "key", "left")
    # of equal texts long enough, all go whole, but for the first in ``later`` mode
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= p.length)
    if p.mode != "all":
        copy = copy & ~F.coalesce(F.col("doc_id") == F.col("low"), F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
