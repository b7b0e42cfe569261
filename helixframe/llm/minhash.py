"""Near-duplicate components by circulant MinHash.

A document's set are its distinct shingles of ``k`` words, as 64-bit hashes. One permutation sends shingles to places in a
circle of ``D``; a second one is laid out along the circle, and signature coordinate j reads it j places back, so that all
coordinates of a shingle are one contiguous slice. Coordinates are cut into bands; documents that share a band's hash are candidates; links
are confirmed on the full sets, and components are found by passing the least id along links.

Nothing grows with the square of a group:
* equal sets are folded to one representative first;
* in each bucket, documents are compared with a pivot, the member that shares most buckets with others, then with the bucket's least
  member; what is in one component by then needs no further comparison;
* only buckets that still hold several components compare members of different ones, in blocks within a task: parity bitmaps (a lower bound
  of the symmetric difference) leave the suspects, whose full sets then meet. Rows are members of buckets, never pairs.

Defined results: null text counts as empty; an empty set has n_shingles 0 and is linked with nothing, as is a row with a null
id; repeated rows come out as often as they come in, with one result; an empty table gives an empty result; other columns are ignored.
Two different sets at the threshold miss each other with probability (1 - J^rows)^bands: 3e-6 at 0.8 by default.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, BLANK_BYTES, LOWER_AZ, cut, tidy

BITMAP_WORDS = 16
BLANK_AT = re.compile(rf"[{BLANK}]".encode())
#: Rows and shingles of a block of a bucket's members that meet at once, and mean bytes of a group of buckets.
BLOCK_ROWS = 8_192
BLOCK_SHINGLES = 2_000_000
GROUP_BYTES = 8_000_000
#: Bits of the finest parity bitmap.
WIDE_BITS = 1 << 17


@dataclass(frozen=True)
class MinHashParams:
    k: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    circle_bits: int = 20
    seed: int = 11


_ODD = np.random.default_rng(97).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANK_BYTES)] = True
#: Bytes of a text that are hashed at once; a cut falls on a blank.
BLOCK = 1 << 22


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: the mixed sum of a random number for each of its (byte, place in the word)."""
    b = np.frombuffer(raw, np.uint8)
    blank = _IS_BLANK[b]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64)
    b, blank, starts = b[starts[0] :], blank[starts[0] :], starts - starts[0]
    place = np.arange(len(b), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), np.diff(np.append(starts, len(b))))
    v = _mix((place << np.uint64(8)) + b + np.uint64(1))
    v[blank] = 0
    return _mix(np.add.reduceat(v, starts))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the whole sequence as one; of none, nothing."""
    raw = text.encode("utf-8", "surrogatepass").translate(LOWER_AZ)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw) and (m := BLANK_AT.search(raw, end)):
            end = m.start()
        elif end < len(raw):
            end = len(raw)
        parts.append(word_hashes(raw[at:end]))
        at = end
    h = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if not len(h):
        return h
    n = min(k, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        acc += h[j : len(h) - n + 1 + j] * _ODD[j]
    acc = np.sort(_mix(acc))
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


class Circulant:
    """Signatures from two permutations of a circle of 2^bits places."""

    def __init__(self, p: MinHashParams):
        rng = np.random.default_rng(p.seed)
        self.p, self.n = p, p.bands * p.rows
        d = 1 << p.circle_bits
        # the first permutation: an affine bijection of the places
        self.a, self.b, self.mask = np.uint64(int(rng.integers(0, d // 2)) * 2 + 1), np.uint64(int(rng.integers(0, d))), np.uint64(d - 1)
        second = rng.permutation(d).astype(np.uint32)
        # coordinate j of place s reads the second permutation j places back: a slice of this
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([second[d - self.n + 1 :], second]), self.n)

    def signature(self, s: np.ndarray) -> np.ndarray:
        at = ((s & self.mask) * self.a + self.b) & self.mask
        out = np.full(self.n, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(at), 2048):
            np.minimum(out, self.slices[at[i : i + 2048].astype(np.int64)].min(0), out=out)
        return out

    def bands(self, s: np.ndarray) -> np.ndarray:
        sig = self.signature(s).reshape(self.p.bands, self.p.rows).astype(np.uint64)
        acc = np.arange(1, self.p.bands + 1, dtype=np.uint64)
        for j in range(self.p.rows):
            acc = _mix(acc * _ODD[j] + sig[:, j])
        return acc.view(np.int64)


@functools.lru_cache(2)
def circulant(p: MinHashParams) -> Circulant:
    return Circulant(p)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles on each bit: the bits in which two sets differ are at most their symmetric difference."""
    bits = np.bincount((s % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_bitmap(s: np.ndarray) -> bytes:
    """The same on a power of two of bits, four a shingle at least where WIDE_BITS allows; its halves' XOR is the bitmap of half as many."""
    bits = min(WIDE_BITS, max(512, 1 << (4 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def sketch(t: DataFrame, p: MinHashParams) -> DataFrame:
    """(doc_id, n_shingles, set_digest, bands) of tidy documents; an empty set has no digest and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = circulant(p)
        for b in batches:
            n, digest, bands = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), p.k)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(c.bands(s) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(bands)], names=["doc_id", "n_shingles", "set_digest", "bands"])

    return t.mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, bands array<long>")


def full_sets(t: DataFrame, p: MinHashParams) -> DataFrame:
    """(doc, shingles, bits, wide) of tidy documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                sets = [shingles(t.as_py(), p.k) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets), _lists([bitmap(s) for s in sets]), pa.array([wide_bitmap(s) for s in sets], pa.binary())], names=["doc", "shingles", "bits", "wide"])

    return t.mapInArrow(run, "doc long, shingles array<long>, bits array<long>, wide binary")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(doc, comp) with comp the least doc reachable; nodes (doc), edges (a, b). Every round also jumps to labels' labels.

    So rounds grow with the logarithm of the longest chain of links; a chain that isn't settled after ``max_rounds`` (of over 2^50 links, about) is an error, never a result.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # as many map tasks as the rows are worth: few files for a small graph
    few = max(4, -(-both.count() // 100_000))
    both = both.coalesce(few)
    # documents without links keep their own label, and take no part
    linked = cut(both.select(F.col("a").alias("doc")).distinct().withColumn("comp", F.col("doc")).coalesce(few))
    labels = linked
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("doc", "b"), "b").coalesce(few).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "doc"), "doc", "left").select("doc", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = labels.select(F.col("doc").alias("comp"), F.col("comp").alias("root"))
        new = cut(step.coalesce(few).join(jump, "comp", "left").select("doc", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp")).coalesce(few))
        labels = new.select("doc", "comp")
        if new.where("comp <> old").isEmpty():
            return nodes.select("doc").distinct().join(labels, "doc", "left").select("doc", F.coalesce("comp", "doc").alias("comp"))
    raise RuntimeError("components did not settle")


def _may_link(ba, bb, na, nb, percent: int):
    """False only where parity bitmaps show that two sets are too different.

    J >= q/100  <=>  (100 + q) * |difference| <= (100 - q) * (na + nb)
    """
    apart = F.aggregate(F.zip_with(ba, bb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the verdict of their full sets; sizes and bitmaps are looked at before any set is moved."""
    small = sets.select("doc", F.size("shingles").alias("n"), "bits")
    left = small.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = small.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    p = pairs.join(left, "a").join(right, "b")
    possible = _may_link(F.col("ba"), F.col("bb"), F.col("na"), F.col("nb"), percent) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    p = p.select("a", "b", possible.alias("possible"))
    far = p.where(~F.col("possible")).select("a", "b", F.lit(False).alias("linked"))
    near = p.where("possible").select("a", "b")
    near = near.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * common >= percent * (F.size("sa") + F.size("sb") - common)
    return far.unionByName(near.select("a", "b", linked.alias("linked")))


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    t = tidy(docs, id_col, text_col)
    sk = cut(sketch(t, p))
    reps = sk.where("set_digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_digest").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
    reps = cut(reps.select("set_digest", F.col("r.doc_id").alias("doc"), F.col("r.bands").alias("bands")))
    banded = reps.select("doc", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = cut(banded.join(shared, "key"))
    weight = members.groupBy("doc").agg(F.sum("c").alias("weight"))
    nodes = cut(weight)
    labels = _link(t, members, nodes, p)
    rep_comp = reps.select("set_digest", "doc").join(labels, "doc", "left").select("set_digest", F.coalesce("comp", "doc").alias("comp"))
    out = sk.select("doc_id", "n_shingles", "set_digest").join(rep_comp, "set_digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _link(t: DataFrame, members: DataFrame, nodes: DataFrame, p: MinHashParams) -> DataFrame:
    """(doc, comp) of the documents that share a bucket: members (key, doc, c), nodes (doc, weight)."""
    wanted = nodes.select(F.col("doc").alias("doc_id"))
    # the ids are the small side: no sort of texts
    sets = cut(full_sets(t.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), p).dropDuplicates(["doc"]))
    heavy = members.join(nodes, "doc").groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc")).alias("low"))).alias("top"), F.min("doc").alias("least"))
    hubs = cut(members.select("key", "doc").join(heavy.select("key", (-F.col("top.low")).alias("pivot"), "least"), "key"))
    # each document first meets the pivot it shares most buckets with
    best = hubs.where("pivot <> doc").groupBy("doc", "pivot").agg(F.count("*").alias("n")).groupBy("doc").agg(F.max(F.struct("n", (-F.col("pivot")).alias("low"))).alias("m"))
    best = best.select("doc", (-F.col("m.low")).alias("hub"))
    seen = cut(_confirm(_pairs(best, "doc", "hub"), sets, p.percent))
    # then the pivots and least members of its other buckets, unless both are linked with one pivot
    linked = best.withColumns({"a": F.least("doc", "hub"), "b": F.greatest("doc", "hub")}).join(seen.where("linked").select("a", "b"), ["a", "b"]).select("doc", F.col("hub").alias("star"))
    stars = cut(nodes.select("doc").join(linked, "doc", "left").select("doc", F.coalesce("star", "doc").alias("star")))
    other = hubs.select("doc", F.explode(F.array("pivot", "least")).alias("hub")).where("doc <> hub").distinct()
    other = other.join(stars, "doc").join(stars.select(F.col("doc").alias("hub"), F.col("star").alias("hub_star")), "hub").where("star <> hub_star")
    more = cut(_confirm(_pairs(other, "doc", "hub").join(seen.select("a", "b"), ["a", "b"], "left_anti"), sets, p.percent))
    tried = seen.unionByName(more)
    edges = tried.where("linked").select("a", "b")
    labels = components(nodes, edges)
    # members of different components in one bucket may be linked by members that no pivot met
    placed = members.select("key", "doc").join(labels, "doc")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = cut(placed.join(mixed, "key"))
    if rest.isEmpty():
        return labels
    found = cut(_left_links(rest, sets, p.percent))
    return labels if found.isEmpty() else components(nodes, edges.unionByName(found))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def _in_blocks(rest: DataFrame, size: str, limit: int) -> DataFrame:
    """Rows (key, doc, comp, …) dealt to (key, kind, i, j) so that members of different components of a key meet in one of its groups.

    ``size`` is a row's own, and no group is much over twice ``limit`` of it. The most common component of a key is its main one, whose members needn't
    meet; with one block of each side, as almost always, every row is sent once.
    """
    per = rest.groupBy("key", "comp").agg(F.sum(size).alias("size"))
    per = per.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("m"), F.sum("size").alias("all"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / limit)).cast("int")
    per = per.select("key", F.col("m.comp").alias("main"), blocks(F.col("m.size")).alias("n_main"), blocks(F.col("all") - F.col("m.size")).alias("n_other"))
    r = rest.join(per, "key").withColumn("h", F.xxhash64("doc"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    own, other = F.pmod("h", "n_main"), F.pmod("h", "n_other")
    with_main = F.when(F.col("comp") == F.col("main"), F.transform(upto("n_other"), lambda j: at(0, own, j))).otherwise(F.transform(upto("n_main"), lambda i: at(0, i, other)))
    among = F.transform(F.filter(upto("n_other"), lambda j: j != other), lambda j: at(1, F.least(other, j), F.greatest(other, j)))
    groups = F.when((F.col("comp") == F.col("main")) | (F.col("n_other") == 1), with_main).otherwise(F.concat(with_main, among))
    return r.withColumn("g", F.explode(groups)).select(*rest.columns, "g.kind", "g.i", "g.j")


def _runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of equal rows."""
    if not len(keys[0]):
        return
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    at = np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys[0])]])
    yield from zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


class Parities:
    """Parity bitmaps of sets in order of size, and which of them may be linked with one."""

    def __init__(self, n: np.ndarray, wide: list[bytes], percent: int):
        self.n, self.percent, self.cls = n, percent, np.array([len(w) for w in wide])
        self.own: dict[int, tuple[int, np.ndarray]] = {}
        # bitmaps grow with the set, so a class is a range
        for c in np.unique(self.cls).tolist():
            lo, hi = np.searchsorted(self.cls, [c, c + 1])
            self.own[c] = int(lo), np.frombuffer(b"".join(wide[lo:hi]), np.uint64).reshape(hi - lo, c // 8)
        self.half = {c: m[:, : c // 16] ^ m[:, c // 16 :] for c, (_, m) in self.own.items() if c > 8 and c // 2 in self.own}

    def near(self, i: int) -> np.ndarray:
        """Places that sizes and bitmaps don't rule out as linked with i, itself included."""
        q, ni, c = self.percent, int(self.n[i]), int(self.cls[i])
        lo, hi = int(np.searchsorted(self.n, -(-q * ni // 100))), int(np.searchsorted(self.n, 100 * ni // q, "right"))
        base, own = self.own[c]
        mine, found = own[i - base], []
        for d in (c // 2, c, 2 * c):
            if d not in self.own:
                continue
            first, m = self.own[d]
            if d == 2 * c:
                m = self.half[d]
            a, z = max(lo, first), min(hi, first + len(m))
            if a >= z:
                continue
            x = mine if d >= c else mine[: c // 16] ^ mine[c // 16 :]
            apart = np.bitwise_count(m[a - first : z - first] ^ x).sum(1, dtype=np.int64)
            found.append(a + np.flatnonzero((100 + q) * apart <= (100 - q) * (self.n[a:z] + ni)))
        return np.concatenate(found) if found else np.empty(0, np.int64)


def _others(comp: np.ndarray) -> np.ndarray:
    """Places of those not in the most common component: each pair of different components has one."""
    value, inverse, count = np.unique(comp, return_inverse=True, return_counts=True)
    return np.flatnonzero(inverse != count.argmax()) if len(value) > 1 else np.empty(0, np.int64)


GROUP = ["key", "kind", "i", "j"]


def _suspects(percent: int):
    """applyInPandas: (key, doc, comp) of members that sizes and bitmaps leave a partner in another component."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([*GROUP, "n", "doc"], kind="stable")
        comp, n, wide = g["comp"].to_numpy(np.int64), g["n"].to_numpy(np.int64), g["wide"].tolist()
        flag = np.zeros(len(g), bool)
        for s, e in _runs([g[c].to_numpy() for c in GROUP]):
            others = _others(comp[s:e])
            if not len(others):
                continue
            par = Parities(n[s:e], wide[s:e], percent)
            for i in others.tolist():
                near = par.near(i)
                near = near[comp[s + near] != comp[s + i]]
                if len(near):
                    flag[s + near] = flag[s + i] = True
        return g.loc[flag, ["key", "doc", "comp"]]

    return run


def _exact_links(percent: int):
    """applyInPandas: (a, b) of linked members of different components, one for each union that they make."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([*GROUP, "n", "doc"], kind="stable")
        doc, comp, n, wide, sets = g["doc"].to_numpy(np.int64), g["comp"].to_numpy(np.int64), g["n"].to_numpy(np.int64), g["wide"].tolist(), g["shingles"].tolist()
        out = []
        for s, e in _runs([g[c].to_numpy() for c in GROUP]):
            others = _others(comp[s:e])
            if not len(others):
                continue
            par, root = Parities(n[s:e], wide[s:e], percent), {c: c for c in comp[s:e].tolist()}

            def top(c: int, root: dict[int, int] = root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for i in others.tolist():
                for j in par.near(i).tolist():
                    x, y = top(int(comp[s + i])), top(int(comp[s + j]))
                    if x == y:
                        continue
                    common = len(np.intersect1d(sets[s + i], sets[s + j], assume_unique=True))
                    if 100 * common >= percent * (int(n[s + i]) + int(n[s + j]) - common):
                        root[max(x, y)] = min(x, y)
                        out.append((doc[s + i], doc[s + j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _left_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components of (key, doc, comp), rows of buckets with several.

    All members of different components that share a bucket are compared, in blocks and without a row a pair: first by sizes and bitmaps, which
    leave the suspects; their full sets then meet in their buckets, where a link is wanted only between components that aren't joined yet.
    """
    small = cut(sets.select("doc", F.size("shingles").cast("long").alias("n"), "wide").join(rest.select("doc").distinct().hint("shuffle_hash"), "doc", "left_semi"))
    r = _in_blocks(rest.withColumn("one", F.lit(1)), "one", BLOCK_ROWS).drop("one").join(small, "doc")
    suspects = _grouped(r, F.octet_length("wide") + 64).applyInPandas(_suspects(percent), "key long, doc long, comp long").distinct()
    suspects = cut(suspects.join(small.select("doc", "n"), "doc"))
    full = sets.select("doc", "wide", "shingles").join(suspects.select("doc").distinct().hint("shuffle_hash"), "doc", "left_semi")
    r = _in_blocks(suspects, "n", BLOCK_SHINGLES).join(full, "doc")
    return _grouped(r, 9 * F.col("n") + 64).applyInPandas(_exact_links(percent), "a long, b long").distinct()


def _grouped(r: DataFrame, size):
    """Groups of whole (key, kind, i, j), of about GROUP_BYTES each."""
    r = cut(r)
    total = r.agg(F.sum(size)).first()[0] or 0
    return r.withColumn("grp", F.pmod(F.xxhash64(*GROUP), F.lit(max(1, -(-int(total) // GROUP_BYTES))))).groupBy("grp")
