"""Queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import bases, cigar, scores
from ..operators import candidates, index, mapping, pairs, rank, seeds
from ..sources import fastx, lines, sam

K, S = 13, 13


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def refs(spark, d):
    """The documents as sequences, made once: offsets then read lengths alone."""
    return storage.stored(index.refs_from_documents(t(spark, d, "documents")))


def plain_refs(spark, d):
    return index.refs_from_documents(t(spark, d, "documents"))


def lengths(spark, d):
    """The documents' lengths as sequences, made once; no bases are kept."""
    return storage.cut(plain_refs(spark, d).select("seq_idx", "length"))


def kindex(spark, d, r=None):
    return index.kmers(index.with_offsets(refs(spark, d) if r is None else r), K, S)


def reads(spark, d):
    """The benchmark's items, all their bases."""
    b = t(spark, d, "benchmark").select(F.col("item_id").alias("read_id"), F.lit(1).alias("mate"), F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("qname"), bases.dna(F.col("text")).alias("seq"))
    return b.withColumn("qual", made_quality())


def made_quality():
    at = F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.length("seq") - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(at, lambda i: F.char(33 + F.pmod(i * 31 + F.col("read_id") * 17, F.lit(41)))), "")


def words(spark, d, q=0):
    return seeds.query_words(reads(spark, d), K, q)


def counted(spark, d, r=None):
    """Words of reads with their number of places, and the part of the index that holds these words."""
    return seeds.looked_up(words(spark, d), kindex(spark, d, r))


def hits(spark, d, r=None):
    w, ix = counted(spark, d, r)
    return seeds.hits(w.where("nhits <= 10000"), ix, K)


def turned(spark, d):
    w, ix = counted(spark, d)
    return candidates.turned_hits(w.where("nhits <= 10000"), ix, K)


def aligned(spark, d):
    """Placements drawn from lineitem: fixed values, so that ranking and pairing have an exact answer."""
    li = t(spark, d, "lineitem")
    q = F.col("l_quantity").cast("long")
    return li.select(
        F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % 2 + 1).cast("int").alias("mate"), F.when(F.col("l_linenumber") % 2 == 1, "+").otherwise("-").alias("strand"), (F.col("l_suppkey") % 5).alias("seq_idx"),
        (F.col("l_partkey") % 300 + 1).alias("r_start"), (F.col("l_partkey") % 300 + 20 + q).alias("r_end"), F.col("l_linenumber").cast("long").alias("q_start"), (F.col("l_linenumber") + 19 + q).cast("long").alias("q_end"),
        F.expr("20 + cast(l_quantity AS bigint) div 5").alias("sw_score"), (q + 5).alias("n_match"),
    )


ALIGNED = """a AS (SELECT l_orderkey AS read_id, CAST(l_partkey % 2 + 1 AS INTEGER) AS mate, CASE WHEN l_linenumber % 2 = 1 THEN '+' ELSE '-' END AS strand,
    l_suppkey % 5 AS seq_idx, l_partkey % 300 + 1 AS r_start, l_partkey % 300 + 20 + CAST(floor(l_quantity) AS BIGINT) AS r_end, CAST(l_linenumber AS BIGINT) AS q_start,
    CAST(l_linenumber + 19 + floor(l_quantity) AS BIGINT) AS q_end, 20 + CAST(floor(l_quantity) AS BIGINT) // 5 AS sw_score, CAST(floor(l_quantity) AS BIGINT) + 5 AS n_match FROM lineitem)"""
REFS = """refs AS (SELECT doc_id AS seq_idx, 'doc' || doc_id AS name, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS bases FROM documents),
    offs AS (SELECT seq_idx, name, length(bases) AS length, bases, CAST(coalesce(sum(length(bases)) OVER (ORDER BY seq_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM refs)"""
INDEX = REFS + """, ix AS (SELECT substr(bases, CAST(pos + 1 AS INTEGER), 13) AS word, seq_idx, pos, "offset" + pos AS tpos FROM
    (SELECT seq_idx, "offset", bases, unnest(range((13 - "offset" % 13) % 13, length - 12, 13)) AS pos FROM offs)), cnt AS (SELECT word, count(*) AS nhits FROM ix GROUP BY word)"""
READS = """reads AS (SELECT item_id AS read_id, 'r' || item_id AS qname, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark),
    qw AS (SELECT read_id, qoffs, substr(seq, CAST(qoffs + 1 AS INTEGER), 13) AS fw FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 12)) AS qoffs FROM reads)),
    words AS (SELECT read_id, '+' AS strand, qoffs, fw AS word FROM qw UNION ALL SELECT read_id, '-', qoffs, translate(reverse(fw), 'ACGT', 'TGCA') FROM qw)"""
HITS = INDEX + ", " + READS + """, hits AS (SELECT w.read_id, w.strand, i.seq_idx, CASE WHEN w.strand = '+' THEN i.pos - w.qoffs ELSE i.pos + w.qoffs END AS shift, w.qoffs, i.pos FROM words w JOIN cnt USING (word) JOIN ix i USING (word) WHERE cnt.nhits <= 10000)"""
SEEDS = HITS + """, fl AS (SELECT *, CASE WHEN (qoffs - lag(qoffs) OVER w <= 13) AND ((qoffs - lag(qoffs) OVER w) % 13 = 0) THEN 0 ELSE 1 END AS nw FROM hits WINDOW w AS (PARTITION BY read_id, strand, seq_idx, shift ORDER BY qoffs)),
    sd AS (SELECT *, sum(nw) OVER (PARTITION BY read_id, strand, seq_idx, shift ORDER BY qoffs ROWS UNBOUNDED PRECEDING) AS seed FROM fl),
    seeds AS (SELECT read_id, strand, seq_idx, shift, seed, min(qoffs) AS q_start, max(qoffs) - min(qoffs) + 13 AS q_len, count(*) AS n_hits FROM sd GROUP BY ALL)"""

TURNED = """turned AS (SELECT h.read_id, h.strand, h.seq_idx, length(r.seq) AS n, h.pos, CASE WHEN h.strand = '+' THEN h.qoffs ELSE length(r.seq) - 13 - h.qoffs END AS q, h.pos - CASE WHEN h.strand = '+' THEN h.qoffs ELSE length(r.seq) - 13 - h.qoffs END AS diag FROM hits h JOIN reads r USING (read_id))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- sequences and indexes -------------------------------------------------------------------------------


@query(f"WITH {REFS} SELECT seq_idx, name, CAST(length(bases) AS BIGINT) AS length, sha256(bases) AS digest FROM refs")
def seq_encode(spark, d):
    return plain_refs(spark, d).select("seq_idx", "name", "length", F.sha2("bases", 256).alias("digest"))


@query(f"WITH {READS} SELECT read_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM reads")
def revcomp(spark, d):
    return reads(spark, d).select("read_id", bases.reverse_complement(F.col("seq")).alias("rc"))


@query(f"WITH {REFS} SELECT seq_idx, CAST(length AS BIGINT) AS length, \"offset\" FROM offs")
def ref_offsets(spark, d):
    return index.with_offsets(refs(spark, d)).select("seq_idx", "length", "offset")


@query(f"WITH {INDEX} SELECT word, seq_idx, CAST(pos AS BIGINT) AS pos, CAST(tpos AS BIGINT) AS tpos FROM ix")
def kmer_index(spark, d):
    return kindex(spark, d)


@query(f"WITH {INDEX} SELECT word, nhits FROM cnt")
def kmer_counts(spark, d):
    return index.word_counts(kindex(spark, d))


@query(f"WITH {INDEX} SELECT nhits, count(*) AS n_words FROM cnt GROUP BY nhits")
def kmer_freq_hist(spark, d):
    return index.frequency_histogram(index.word_counts(kindex(spark, d)))


@query(f"""WITH {INDEX}, kept AS (SELECT word, seq_idx, pos, CASE WHEN seq_idx % 50 = 7 THEN tpos + 1 ELSE tpos END AS tpos FROM ix WHERE (tpos // 13) % 97 <> 5),
    d AS ((SELECT 'index' AS side, * FROM (FROM kept EXCEPT ALL FROM ix)) UNION ALL (SELECT 'refs' AS side, * FROM (FROM (SELECT word, seq_idx, pos, tpos FROM ix) EXCEPT ALL FROM kept)))
    SELECT side, count(*) AS n_wrong, CAST(sum(pos) AS BIGINT) AS sum_pos FROM (SELECT side, pos FROM d) GROUP BY side""".replace("FROM kept EXCEPT ALL FROM ix", "FROM kept EXCEPT ALL FROM (SELECT word, seq_idx, pos, tpos FROM ix)"))
def index_self_check(spark, d):
    """A stored index with faults of known places, read again and held against the sequences."""
    r = index.with_offsets(refs(spark, d))
    bad = index.kmers(r, K, S).where(F.expr("(tpos div 13) % 97 <> 5")).withColumn("tpos", F.when(F.col("seq_idx") % 50 == 7, F.col("tpos") + 1).otherwise(F.col("tpos")))
    at = f"{storage.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    bad.write.parquet(at)
    out = storage.cut(index.missing_words(spark.read.parquet(at), r, K, S).groupBy("side").agg(F.count("*").alias("n_wrong"), F.sum("pos").alias("sum_pos")))
    storage.remove(spark, at)
    return out


@query(f"WITH {REFS} SELECT o.tpos, r.seq_idx, o.tpos - r.\"offset\" AS pos FROM (SELECT DISTINCT l_orderkey * 37 AS tpos FROM lineitem) o JOIN offs r ON o.tpos >= r.\"offset\" AND o.tpos < r.\"offset\" + r.length")
def offset_lookup(spark, d):
    o = t(spark, d, "lineitem").select((F.col("l_orderkey") * 37).alias("tpos")).distinct()
    return index.locate(o, index.with_offsets(refs(spark, d)))


@query(f"WITH {INDEX} SELECT seq_idx, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM ix GROUP BY seq_idx")
def words_per_sequence(spark, d):
    return index.distinct_words(index.with_offsets(refs(spark, d)), K, S)


@query(f"WITH {READS} SELECT read_id, c.base, CASE WHEN c.base IN ('A', 'G') THEN 'purine' ELSE 'pyrimidine' END AS base_class, count(*) AS n FROM (SELECT read_id, unnest(string_split(seq, '')) AS base FROM reads) c GROUP BY ALL")
def base_classes(spark, d):
    b = reads(spark, d).select("read_id", F.explode(F.split("seq", "")).alias("base")).where("base <> ''")
    return b.withColumn("base_class", bases.base_class(F.col("base"))).groupBy("read_id", "base", "base_class").agg(F.count("*").alias("n"))


# --- words and hits of reads -----------------------------------------------------------------------------


@query(f"WITH {READS} SELECT read_id, strand, CAST(qoffs AS BIGINT) AS qoffs, word FROM words")
def query_kmers(spark, d):
    return words(spark, d).select("read_id", "strand", F.col("qoffs").cast("long").alias("qoffs"), "word")


@query(f"""WITH {READS}, b AS (SELECT *, unnest(range(qoffs, qoffs + 13)) AS p FROM words),
    g AS (SELECT read_id, strand, qoffs, word, min((p * 31 + read_id * 17) % 41) AS worst FROM b GROUP BY ALL) SELECT read_id, strand, CAST(qoffs AS BIGINT) AS qoffs, word FROM g WHERE worst >= 2""")
def quality_filter(spark, d):
    return words(spark, d, 2).select("read_id", "strand", F.col("qoffs").cast("long").alias("qoffs"), "word")


@query(f"""WITH {READS}, l AS (SELECT *, lag(word, 1) OVER w AS a, lag(word, 2) OVER w AS b, lag(word, 3) OVER w AS c, lag(word, 4) OVER w AS e FROM words WINDOW w AS (PARTITION BY read_id, strand ORDER BY qoffs))
    SELECT read_id, strand, CAST(qoffs AS BIGINT) AS qoffs, word FROM l WHERE NOT coalesce(word = a, false) AND NOT coalesce(word = b, false) AND NOT coalesce(word = c, false) AND NOT coalesce(word = e, false)""")
def repeat_filter(spark, d):
    return seeds.drop_repeats(words(spark, d)).select("read_id", "strand", F.col("qoffs").cast("long").alias("qoffs"), "word")


@query(f"WITH {HITS} SELECT read_id, strand, CAST(seq_idx AS BIGINT) AS seq_idx, CAST(shift AS BIGINT) AS shift, CAST(qoffs AS BIGINT) AS qoffs FROM hits")
def seed_hits(spark, d):
    return hits(spark, d).select("read_id", "strand", "seq_idx", "shift", "qoffs")


@query(f"WITH {HITS} SELECT read_id, CAST(sum(nhits) AS BIGINT) AS total_hits, count(*) AS n_words FROM words JOIN cnt USING (word) WHERE nhits <= 10000 GROUP BY read_id")
def hits_per_read(spark, d):
    c = counted(spark, d)[0].where("nhits <= 10000")
    return c.groupBy("read_id").agg(F.sum("nhits").alias("total_hits"), F.count("*").alias("n_words"))


@query(f"""WITH {HITS}, r AS (SELECT read_id, strand, qoffs, nhits, row_number() OVER w AS seed_rank, sum(nhits) OVER (PARTITION BY read_id, strand ORDER BY nhits, qoffs ROWS UNBOUNDED PRECEDING) AS running
    FROM words JOIN cnt USING (word) WINDOW w AS (PARTITION BY read_id, strand ORDER BY nhits, qoffs)) SELECT read_id, strand, CAST(qoffs AS BIGINT) AS qoffs, nhits, seed_rank FROM r WHERE running <= 16384 OR seed_rank <= 3""")
def seed_rank(spark, d):
    return seeds.choose_seeds(counted(spark, d)[0], 16_384).select("read_id", "strand", F.col("qoffs").cast("long").alias("qoffs"), "nhits", F.col("seed_rank").cast("long").alias("seed_rank"))


@query(f"""WITH {READS}, f AS (SELECT read_id, strand, qoffs % 13 AS frame, unnest(range(qoffs, qoffs + 13)) AS q FROM words), c AS (SELECT read_id, strand, frame, count(DISTINCT q) AS n FROM f GROUP BY ALL)
    SELECT read_id, strand, max(n) - min(n) + 1 AS deficit FROM c GROUP BY ALL""")
def cover_deficit(spark, d):
    return seeds.cover_deficit(words(spark, d), K, S).select("read_id", "strand", "deficit")


@query(f"""WITH {HITS}, {TURNED}, n AS (SELECT *, CASE WHEN diag - lag(diag) OVER w >= least(3, (n - 13) // 13 + 1) * 13 THEN 1 WHEN lag(diag) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM turned WINDOW w AS (PARTITION BY read_id, strand, seq_idx ORDER BY diag, q)),
    r AS (SELECT *, sum(nw) OVER (PARTITION BY read_id, strand, seq_idx ORDER BY diag, q ROWS UNBOUNDED PRECEDING) AS region FROM n)
    SELECT read_id, strand, seq_idx, CAST(region AS BIGINT) AS region, count(*) AS n_hits, CAST(min(diag) AS BIGINT) AS lo, CAST(max(diag) AS BIGINT) AS hi FROM r GROUP BY ALL""")
def hit_regions(spark, d):
    r = candidates.hit_regions(turned(spark, d), K, S)
    return r.groupBy("read_id", "strand", "seq_idx", F.col("region").cast("long").alias("region")).agg(F.count("*").alias("n_hits"), F.min("diag").alias("lo"), F.max("diag").alias("hi"))


@query(f"WITH {SEEDS} SELECT read_id, strand, seq_idx, CAST(shift AS BIGINT) AS shift, CAST(q_start AS BIGINT) AS q_start, CAST(q_len AS BIGINT) AS q_len, n_hits FROM seeds")
def exact_seeds(spark, d):
    return seeds.exact_seeds(hits(spark, d), K, S).select("read_id", "strand", "seq_idx", "shift", "q_start", "q_len", "n_hits")


@query(f"WITH {SEEDS} SELECT read_id, strand, seq_idx, CAST(shift AS BIGINT) AS shift, CAST(q_start % 13 AS BIGINT) AS frame, CAST(sum(q_len) AS BIGINT) AS cover, count(*) AS n_seed FROM seeds GROUP BY ALL")
def const_shift_segments(spark, d):
    s = seeds.segments(seeds.exact_seeds(hits(spark, d), K, S), S)
    return s.select("read_id", "strand", "seq_idx", "shift", F.col("frame").cast("long").alias("frame"), "cover", "n_seed")


UNGAPPED = SEEDS + """, dg AS (SELECT DISTINCT s.read_id, s.strand, s.seq_idx, CASE WHEN s.strand = '-' THEN s.shift - (length(r.seq) - 13) ELSE s.shift END AS shift, CASE WHEN s.strand = '+' THEN r.seq ELSE translate(reverse(r.seq), 'ACGT', 'TGCA') END AS q FROM seeds s JOIN reads r USING (read_id)),
    cells AS (SELECT d.read_id, d.strand, d.seq_idx, d.shift, x.i, CASE WHEN substr(d.q, CAST(x.i + 1 AS INTEGER), 1) = substr(o.bases, CAST(x.i + d.shift + 1 AS INTEGER), 1) THEN 1 ELSE -2 END AS v
      FROM dg d JOIN offs o USING (seq_idx) JOIN (SELECT unnest(range(0, (SELECT max(length(seq)) FROM reads))) AS i) x ON x.i < length(d.q) AND x.i + d.shift >= 0 AND x.i + d.shift < o.length),
    cum AS (SELECT *, sum(v) OVER (PARTITION BY read_id, strand, seq_idx, shift ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM cells),
    low AS (SELECT *, c - least(0, coalesce(min(c) OVER (PARTITION BY read_id, strand, seq_idx, shift ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run FROM cum),
    sc AS (SELECT read_id, strand, seq_idx, shift, greatest(0, max(run)) AS score FROM low GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, strand, seq_idx, shift) AS rn, max(score) OVER (PARTITION BY read_id) AS mx FROM sc),
    n AS (SELECT read_id, count(*) AS n_best FROM rk WHERE score = mx GROUP BY read_id)"""


@query(f"WITH {UNGAPPED} SELECT read_id, strand, seq_idx, CAST(shift AS BIGINT) AS shift, CAST(score AS BIGINT) AS score, n_best FROM rk JOIN n USING (read_id) WHERE rn = 1")
def ungapped_best_hit(spark, d):
    r, to = reads(spark, d), refs(spark, d)
    s = seeds.segments(seeds.exact_seeds(hits(spark, d, to), K, S), S)
    b = seeds.best_hits(seeds.ungapped(r, s, to, K, r.agg(F.max(F.length("seq"))).first()[0] or 1))
    return b.select("read_id", "strand", "seq_idx", "shift", F.col("score").cast("long").alias("score"), F.col("n_best").cast("long").alias("n_best"))


@query()
def map_reads(spark, d):
    """Best gapped placement of each read."""
    r = refs(spark, d)
    a = mapping.map_reads(reads(spark, d), r, kindex(spark, d, r), K, S)
    return a.select("read_id", "strand", "seq_idx", "pos", "sw_score", "cigar")


# --- alignments ------------------------------------------------------------------------------------------

CIG = "cg AS (SELECT l_orderkey AS read_id, l_linenumber AS ln, concat(l_linenumber + 3, 'M', l_linenumber, 'X', 5, 'M', l_partkey % 4 + 1, 'I', CAST(floor(l_quantity) AS BIGINT), 'M', l_suppkey % 3 + 1, 'D', 7, 'M') AS cigar, CAST(l_linenumber AS BIGINT) AS x, l_partkey % 4 + 1 AS i, l_suppkey % 3 + 1 AS dl, CAST(floor(l_quantity) AS BIGINT) AS m FROM lineitem)"


def cigars(spark, d):
    li = t(spark, d, "lineitem")
    c = lambda e: F.expr(e).cast("string")
    return li.select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("ln"), F.concat(c("l_linenumber + 3"), F.lit("M"), c("l_linenumber"), F.lit("X5M"), c("l_partkey % 4 + 1"), F.lit("I"), c("cast(l_quantity AS bigint)"), F.lit("M"), c("l_suppkey % 3 + 1"), F.lit("D7M")).alias("cigar")).withColumn("ops", cigar.parse(F.col("cigar")))


@query(f"WITH {CIG} SELECT read_id, ln, cigar, (2 * x + 8) || 'M' || i || 'I' || m || 'M' || dl || 'D7M' AS merged FROM cg")
def cigar_text(spark, d):
    return cigars(spark, d).select("read_id", "ln", cigar.text(F.col("ops")).alias("cigar"), cigar.text(cigar.merged(F.col("ops"))).alias("merged"))


@query(f"""WITH {CIG} SELECT read_id, ln, 2 * x + 15 + i + m AS query_span, 2 * x + 15 + m + dl AS ref_span, x + i + dl AS edit_distance, 2 * x + 15 + i + m + dl AS ali_len,
    x + 15 + m - 2 * x - 4 - 3 * (i - 1) - 4 - 3 * (dl - 1) AS score FROM cg""")
def cigar_spans(spark, d):
    o = F.col("ops")
    return cigars(spark, d).select("read_id", "ln", *[f(o).cast("long").alias(n) for n, f in (("query_span", cigar.query_span), ("ref_span", cigar.ref_span), ("edit_distance", cigar.edit_distance), ("ali_len", cigar.aligned_length), ("score", cigar.score))])


@query(f"WITH {CIG} SELECT read_id, ln, '0:0:' || (2 * x + 8) || ',' || (2 * x + 8 + i) || ':' || (2 * x + 8) || ':' || m || ',' || (2 * x + 8 + i + m) || ':' || (2 * x + 8 + m + dl) || ':7' AS blocks FROM cg")
def gff_blocks(spark, d):
    b = F.transform(cigar.blocks(F.col("ops")), lambda x: F.concat_ws(":", x["q"].cast("string"), x["r"].cast("string"), x["len"].cast("string")))
    return cigars(spark, d).select("read_id", "ln", F.array_join(b, ",").alias("blocks"))


RANKED = f"WITH {ALIGNED}, u AS (SELECT DISTINCT read_id, mate, strand, seq_idx, r_start, r_end, q_start, q_end, sw_score FROM a), k AS (SELECT *, dense_rank() OVER (PARTITION BY read_id, mate ORDER BY sw_score DESC) - 1 AS sw_rank FROM u)"
BEST = RANKED + ", b AS (SELECT read_id, mate, max(sw_score) AS best, coalesce(max(sw_score) FILTER (WHERE sw_rank = 1), 0) AS second, count(*) FILTER (WHERE sw_rank = 0) AS n_best, count(*) FILTER (WHERE sw_rank = 1) AS n_second FROM k GROUP BY read_id, mate)"


def ranked(spark, d):
    return rank.dense_ranks(rank.distinct_results(aligned(spark, d)))


@query(RANKED + " SELECT read_id, mate, strand, seq_idx, r_start, q_start, sw_score, CAST(sw_rank AS BIGINT) AS sw_rank FROM k")
def sw_dense_rank(spark, d):
    return ranked(spark, d).select("read_id", "mate", "strand", "seq_idx", "r_start", "q_start", "sw_score", F.col("sw_rank").cast("long").alias("sw_rank"))


@query(BEST + " SELECT read_id, mate, best, second, n_best, n_second FROM b")
def best_second(spark, d):
    return rank.best_and_second(ranked(spark, d))


@query(BEST + """, q AS (SELECT *, floor(60 * (1 - exp(10 * (second - best) / 100.0)) - CASE WHEN n_second > 0 THEN floor(10 * log10(greatest(n_second, 1))) ELSE 0 END) AS v FROM b)
    SELECT read_id, mate, CAST(CASE WHEN n_best = 1 THEN greatest(0, least(60, CASE WHEN v >= 0 THEN v + 4 ELSE v END)) ELSE 0 END AS INTEGER) AS mapq FROM q""")
def mapq(spark, d):
    return rank.with_quality(rank.distinct_results(aligned(spark, d)), 100).select("read_id", "mate", "mapq")


@query(f"WITH {ALIGNED} SELECT read_id, mate, sw_score, n_match, sw_score < 22 OR n_match < 12 AS below_abs, sw_score < max(sw_score) OVER (PARTITION BY read_id, mate) - 3 AS below_rel FROM a")
def result_filter(spark, d):
    return rank.filter_results(aligned(spark, d), 22, 3, 12).select("read_id", "mate", "sw_score", "n_match", "below_abs", "below_rel")


@query(f"""WITH {ALIGNED}, w AS (SELECT *, max(r_end) OVER z AS me, max(sw_score) OVER z AS ms FROM a WINDOW z AS (PARTITION BY read_id, mate, seq_idx, strand ORDER BY r_start, r_end DESC, sw_score DESC, q_start, q_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT read_id, mate, strand, seq_idx, r_start, r_end, sw_score FROM w WHERE NOT coalesce(me >= r_end AND ms >= sw_score, false)""")
def prune_contained(spark, d):
    return rank.prune_contained(aligned(spark, d)).select("read_id", "mate", "strand", "seq_idx", "r_start", "r_end", "sw_score")


@query(f"""WITH {ALIGNED}, o AS (SELECT seq_idx, read_id, r_start AS lo, r_end AS hi, max(r_end) OVER (PARTITION BY seq_idx, read_id ORDER BY r_start, r_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR lo > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_idx, read_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT seq_idx, read_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY seq_idx, read_id, g""")
def interval_union(spark, d):
    return rank.interval_union(aligned(spark, d).select("seq_idx", "read_id", F.col("r_start").alias("lo"), F.col("r_end").alias("hi")), ["seq_idx", "read_id"])


# --- mates and inserts -----------------------------------------------------------------------------------

PAIRED = RANKED + """, p AS (SELECT x.read_id, x.strand AS sa, y.strand AS sb, x.seq_idx = y.seq_idx AS same_ref, x.r_start AS a1, y.r_start AS b1,
      CASE WHEN y.r_start < x.r_start THEN -1 ELSE 1 END * (greatest(x.r_end, y.r_end) - least(x.r_start, y.r_start) + 1) AS isize FROM k x JOIN k y ON x.read_id = y.read_id AND x.mate = 1 AND y.mate = 2 AND x.sw_rank = 0 AND y.sw_rank = 0),
    pr AS (SELECT *, same_ref AND (CASE WHEN isize >= 0 THEN sa = '+' AND sb = '-' ELSE sa = '-' AND sb = '+' END) AS proper, same_ref AND abs(isize) BETWEEN 0 AND 150 AS within FROM p)"""


def paired(spark, d):
    return pairs.mate_join(ranked(spark, d).withColumns({"mapq": F.lit(30), "prob": F.lit(0.5)}), hi=150)


@query(PAIRED + " SELECT read_id, sa AS a_strand, sb AS b_strand, a1 AS a_r_start, b1 AS b_r_start, isize, proper, within, CASE WHEN NOT same_ref THEN 'D' WHEN NOT proper THEN 'C' WHEN within THEN 'A' ELSE 'B' END AS label FROM pr")
def mate_join(spark, d):
    return paired(spark, d).select("read_id", "a_strand", "b_strand", "a_r_start", "b_r_start", "isize", "proper", "within", "label")


@query(PAIRED + ", w AS (SELECT read_id, isize, 0.25 * CASE WHEN proper AND within THEN 0.9999 * 0.997 WHEN proper THEN 0.9999 * 0.003 ELSE 0.0001 END AS w FROM pr) SELECT read_id, isize, CAST(round(w / sum(w) OVER (PARTITION BY read_id) * 1000) AS BIGINT) AS share FROM w")
def pair_weight(spark, d):
    return pairs.weighted(paired(spark, d)).select("read_id", "isize", F.round(F.col("share") * 1000).cast("long").alias("share"))


@query(f"WITH {ALIGNED}, w AS (SELECT read_id, seq_idx, greatest(1, CASE WHEN strand = '+' THEN r_start + 10 ELSE r_end - 90 END) AS lo, CASE WHEN strand = '+' THEN r_start + 90 ELSE r_end - 10 END AS hi FROM a WHERE mate = 1) SELECT DISTINCT a.read_id, a.seq_idx, a.r_start AS pos FROM a JOIN w ON a.read_id = w.read_id AND a.seq_idx = w.seq_idx AND a.mate = 2 AND a.r_start BETWEEN w.lo AND w.hi AND w.hi >= w.lo")
def rescue_hits(spark, d):
    a = aligned(spark, d)
    return pairs.in_windows(a.where("mate = 2").select("read_id", "seq_idx", F.col("r_start").alias("pos")), pairs.mate_windows(a.where("mate = 1"), 10, 90), 64)


SIZES = "sz AS (SELECT CAST(floor(o_totalprice) AS BIGINT) % 997 + o_custkey % 50 AS isize FROM orders)"


def sizes(spark, d):
    return t(spark, d, "orders").select((F.floor("o_totalprice").cast("long") % 997 + F.col("o_custkey") % 50).alias("isize"))


@query(f"WITH {SIZES}, r AS (SELECT isize, row_number() OVER (ORDER BY isize) - 1 AS i, count(*) OVER () AS n FROM sz) SELECT any_value(n) AS n, max(isize) FILTER (WHERE i = n // 4) AS q1, max(isize) FILTER (WHERE i = n * 2 // 4) AS q2, max(isize) FILTER (WHERE i = n * 3 // 4) AS q3 FROM r")
def insert_quartiles(spark, d):
    return pairs.quartiles(sizes(spark, d))


HIST = f"""WITH {SIZES}, r AS (SELECT isize, row_number() OVER (ORDER BY isize) - 1 AS i, count(*) OVER () AS n FROM sz),
    q AS (SELECT any_value(n) AS n, max(isize) FILTER (WHERE i = n // 4) AS q1, max(isize) FILTER (WHERE i = n * 2 // 4) AS q2, max(isize) FILTER (WHERE i = n * 3 // 4) AS q3 FROM r),
    k AS (SELECT q2, 6 * (q3 - q1) AS span, least(1028, greatest(16, CAST(floor(3 * sqrt(n)) AS BIGINT))) AS k FROM q),
    p AS (SELECT q2, greatest(1, span // k) AS width, greatest(1, CASE WHEN span // k < 1 THEN span ELSE k END) AS bins FROM k),
    b AS (SELECT isize - (q2 - width * bins // 2) AS off, width, bins, q2 - width * bins // 2 AS first FROM sz, p),
    h AS (SELECT CAST(off // width AS INTEGER) AS bin, first + (off // width) * width AS lo, width, count(*) AS n FROM b WHERE off >= 0 AND off < width * bins GROUP BY ALL)"""


@query(HIST + " SELECT bin, lo, width, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS upto, (SELECT count(*) FROM b WHERE off < 0) AS n_below, (SELECT count(*) FROM b WHERE off >= width * bins) AS n_above FROM h")
def insert_hist(spark, d):
    return pairs.cumulative(pairs.derived_histogram(sizes(spark, d)))


BANDWIDTH = ", bw AS (SELECT greatest(3.0::DOUBLE, 0.9 * pow(n, -0.2) * ((q3 - q1) / greatest(1, 6 * (q3 - q1) // least(1028, greatest(16, CAST(floor(3 * sqrt(n)) AS BIGINT))))) / 1.34) AS bw FROM q)"


@query(HIST + BANDWIDTH + """, s AS (SELECT a.bin, any_value(a.n) AS n, CAST(floor(round(sum(b.n * exp(-pow((b.bin - a.bin) / bw, 2) / 2)), 6) / any_value(bw)) AS BIGINT) AS n_smooth FROM h a JOIN h b ON true JOIN bw ON abs(a.bin - b.bin) <= floor(3 * bw) GROUP BY a.bin) SELECT * FROM s""")
def insert_hist_smooth(spark, d):
    z = sizes(spark, d)
    return pairs.smooth(pairs.derived_histogram(z), pairs.bandwidth(z))


@query("SELECT o_orderkey AS read_id FROM orders WHERE o_orderkey % 7 = 0")
def sample_every_nth(spark, d):
    return pairs.every_nth(t(spark, d, "orders").select(F.col("o_orderkey").alias("read_id")), 7)


# --- records and tools -----------------------------------------------------------------------------------


@query(f"WITH {ALIGNED} SELECT read_id, mate, 1 + CASE WHEN sw_score % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN strand = '-' THEN 16 ELSE 32 END + CASE WHEN mate = 1 THEN 64 ELSE 128 END + CASE WHEN sw_score % 3 = 0 THEN 256 ELSE 0 END AS flag FROM a")
def sam_flags(spark, d):
    f = F.lit(False)
    rev = F.col("strand") == "-"
    return aligned(spark, d).select("read_id", "mate", scores.sam_flag(F.lit(True), F.col("sw_score") % 2 == 0, f, f, rev, ~rev, F.col("mate"), F.col("sw_score") % 3 == 0).alias("flag"))


@query(f"WITH {ALIGNED} SELECT read_id, concat_ws(chr(9), 'r' || read_id, 0, 's' || seq_idx, r_start, 30, (q_end - q_start + 1) || 'M', '*', 0, 0, 'ACGT', '*', 'NM:i:0', 'AS:i:' || sw_score) AS line FROM a")
def sam_lines(spark, d):
    a = aligned(spark, d)
    c = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    s = lambda n: F.col(n).cast("string")
    r = a.select("read_id", c("r", s("read_id")).alias("qname"), F.lit(0).alias("flag"), c("s", s("seq_idx")).alias("rname"), F.col("r_start").alias("pos"), F.lit(30).alias("mapq"), c((F.col("q_end") - F.col("q_start") + 1).cast("string"), "M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.lit("ACGT").alias("seq"), F.lit("*").alias("qual"), F.lit(0).alias("nm"), F.col("sw_score").alias("as_score"))
    return sam.sam_lines(r)


@query(f"WITH {ALIGNED} SELECT read_id, concat_ws(' ', 'cigar:A:' || lpad(CAST(sw_score % 60 AS VARCHAR), 2, '0'), 'r' || read_id, CASE WHEN strand = '+' THEN q_start ELSE q_end END, CASE WHEN strand = '+' THEN q_end ELSE q_start END, strand, 's' || seq_idx, r_start, r_end, '+', sw_score, 'M ' || (q_end - q_start + 1)) AS line FROM a")
def cigar_lines(spark, d):
    a = aligned(spark, d).withColumns({"label": F.lit("A"), "mapq": (F.col("sw_score") % 60).cast("int"), "qname": F.concat(F.lit("r"), F.col("read_id").cast("string")), "rname": F.concat(F.lit("s"), F.col("seq_idx").cast("string")), "ops": F.concat(F.lit("M "), (F.col("q_end") - F.col("q_start") + 1).cast("string"))})
    return sam.cigar_lines(a)


@query(f"WITH {READS}, q AS (SELECT read_id, unnest(range(0, length(seq))) AS pos FROM reads), v AS (SELECT read_id, pos, (pos * 31 + read_id * 17) % 41 AS cur FROM q), l AS (SELECT *, lag(cur) OVER (PARTITION BY read_id ORDER BY pos) AS prev FROM v) SELECT CAST(pos AS BIGINT) AS pos, CAST(prev AS BIGINT) AS prev, CAST(cur AS BIGINT) AS cur, count(*) AS n FROM l GROUP BY ALL")
def basq_transitions(spark, d):
    q = reads(spark, d).select("read_id", F.posexplode(F.split("qual", "")).alias("pos", "c")).where("c <> ''").withColumn("cur", bases.phred(F.col("c")).cast("long"))
    q = q.withColumn("prev", F.lag("cur").over(seeds.Window.partitionBy("read_id").orderBy("pos")))
    return q.groupBy(F.col("pos").cast("long").alias("pos"), "prev", "cur").agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) AS n_reads, CAST(max(length(text)) AS BIGINT) AS max_length, CAST(max(length('d' || doc_id)) AS BIGINT) AS max_name, bool_and(regexp_full_match(text, '[A-Za-z]*')) AS all_letters
    FROM (SELECT lang, doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[^A-Za-z]', '', 'g') ELSE regexp_replace(text, '[^A-Za-z]', CASE WHEN lang = 'en' THEN '' ELSE '-' END, 'g') END AS text FROM documents WHERE text IS NOT NULL) GROUP BY lang""")
def read_stats(spark, d):
    """Records by language; of one language all are letters, the others have failing ones."""
    x = t(spark, d, "documents").where("text IS NOT NULL")
    seq = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[^A-Za-z]", "")).when(F.col("lang") == "en", F.regexp_replace("text", "[^A-Za-z]", "")).otherwise(F.regexp_replace("text", "[^A-Za-z]", "-"))
    return fastx.check(x.select("lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("qname"), seq.alias("seq")), ["lang"])


@query(f"WITH {READS} SELECT read_id, substr(seq, 1, 30) AS seq, read_id // 10 AS slice FROM reads")
def truncate_reads(spark, d):
    return reads(spark, d).select("read_id", F.substring("seq", 1, 30).alias("seq"), F.expr("read_id div 10").alias("slice"))


@query(f"WITH {READS} SELECT read_id, '>' || qname || chr(10) || seq AS value FROM reads")
def fasta_lines(spark, d):
    return fastx.fastx_lines(reads(spark, d).withColumn("qual", F.lit(None).cast("string")))


@query("SELECT c_custkey AS id, (c_custkey % 3 > 0) AS names_match FROM customer")
def pair_name_check(spark, d):
    n = F.col("c_custkey").cast("string")
    b = F.when(F.col("c_custkey") % 3 == 0, F.concat(n, F.lit("x/2"))).otherwise(F.concat(n, F.lit("/2")))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), bases.names_match(F.concat(n, F.lit("/1")), b).alias("names_match"))


@query(f"WITH {ALIGNED} SELECT seq_idx, count(*) AS n, count(*) FILTER (WHERE sw_score >= 24) AS n_good, count(*) FILTER (WHERE strand = '-') AS n_minus FROM a GROUP BY seq_idx")
def sam_summary(spark, d):
    return aligned(spark, d).groupBy("seq_idx").agg(F.count("*").alias("n"), F.count(F.when(F.col("sw_score") >= 24, 1)).alias("n_good"), F.count(F.when(F.col("strand") == "-", 1)).alias("n_minus"))


@query("SELECT CAST(n AS INTEGER) AS n, CASE WHEN n < 1 OR n > 9 THEN 0 WHEN n = 1 THEN 4 ELSE CAST(least(3, greatest(0, round(-10 * log10((n - 1) / CAST(n AS DOUBLE))))) AS INTEGER) END AS q FROM (SELECT unnest(range(0, 12)) AS n)")
def random_draw_quality(spark, d):
    r = spark.range(0, 12).select(F.col("id").cast("int").alias("n"))
    return r.select("n", scores.random_draw_quality(F.col("n")).cast("int").alias("q"))


# --- other lines and the order of records ----------------------------------------------------------------

PLACED = CIG + """, pl AS (SELECT *, 2 * x + 15 + i + m AS qe, 2 * x + 15 + m + dl AS re, CASE WHEN ln % 2 = 1 THEN '+' ELSE '-' END AS strand, x + 15 + m AS n_match, 2 * x + 15 + i + m + dl AS ali FROM cg)"""


def placed(spark, d):
    o, s = F.col("ops"), lambda n: F.col(n).cast("string")
    return cigars(spark, d).withColumns({
        "label": F.lit("A"), "mapq": F.col("ln") * 20, "sw_score": cigar.total(o, "M").cast("long"), "qname": F.concat(F.lit("r"), s("read_id")), "rname": F.concat(F.lit("s"), s("ln")), "q_start": F.lit(1).cast("long"), "q_end": cigar.query_span(o).cast("long"),
        "r_start": F.lit(1).cast("long"), "r_end": cigar.ref_span(o).cast("long"), "strand": F.when(F.col("ln") % 2 == 1, "+").otherwise("-"), "q_length": F.lit(200).cast("long"), "r_length": F.lit(900).cast("long"),
    })


@query(f"""WITH {PLACED} SELECT read_id, ln, printf('alignment:A:%02d %-5d r%d s%d %8d %8d %9d %9d   %s %7d %5.2f 200 900', CAST(least(99, ln * 20) AS BIGINT), n_match, read_id, CAST(ln AS BIGINT), CASE WHEN strand = '+' THEN 1 ELSE qe END, CASE WHEN strand = '+' THEN qe ELSE 1 END,
    1::BIGINT, re, CASE WHEN strand = '+' THEN 'F' ELSE 'C' END, n_match, ((20000 * n_match + ali) // (2 * ali)) / 100.0::DOUBLE) AS line FROM pl""")
def ssaha_lines(spark, d):
    return lines.ssaha_lines(placed(spark, d), ["read_id", "ln"])


@query(f"""WITH {PLACED} SELECT read_id, ln, concat('gff: r', read_id, chr(9), 'helixframe', chr(9), 'similarity', chr(9), CASE WHEN strand = '+' THEN 1 ELSE qe END, chr(9), CASE WHEN strand = '+' THEN qe ELSE 1 END, chr(9), n_match, chr(9), strand, chr(9), '.', chr(9), 'Subject "s', ln, '" 1 ', re, ';', chr(9),
    ' Align ', CASE WHEN strand = '+' THEN 1 ELSE qe END, ' 1 ', 2 * x + 8, '; Align ', CASE WHEN strand = '+' THEN 2 * x + 9 + i ELSE qe - (2 * x + 8 + i) END, ' ', 2 * x + 9, ' ', m, '; Align ', CASE WHEN strand = '+' THEN 2 * x + 9 + i + m ELSE qe - (2 * x + 8 + i + m) END, ' ', 2 * x + 9 + m + dl, ' 7;') AS line FROM pl""")
def gff2_lines(spark, d):
    return lines.gff2_lines(placed(spark, d), ["read_id", "ln"])


@query(HIST + " SELECT lo, lpad(CAST(lo AS VARCHAR), 8, ' ') || ' ' || lpad(CAST(n AS VARCHAR), 8, ' ') || ' ' || repeat('*', n * 60 // (SELECT max(n) FROM h)) AS line FROM h")
def insert_hist_bars(spark, d):
    return lines.histogram_bars(pairs.derived_histogram(sizes(spark, d)).select("lo", "n"))


@query(f"WITH {ALIGNED} SELECT read_id, mate, r_start, q_start, sw_score, sw_score % 2 = 0 AND count(*) FILTER (WHERE sw_score % 2 = 0) OVER (PARTITION BY read_id, mate) = 1 AS is_primary FROM a")
def demote_primaries(spark, d):
    a = aligned(spark, d).select("read_id", "mate", "r_start", "q_start", "sw_score", (F.col("sw_score") % 2 == 0).alias("is_primary"))
    return lines.demote_primaries(a)


@query(f"""WITH {ALIGNED}, r AS (SELECT DISTINCT read_id, mate, sw_score, r_start, r_end, CASE WHEN sw_score % 3 = 0 THEN seq_idx END AS pair_no FROM a), g AS (SELECT *, CASE WHEN pair_no IS NULL THEN mate ELSE 0 END AS out_group FROM r)
    SELECT *, CAST(row_number() OVER (PARTITION BY read_id ORDER BY out_group, pair_no NULLS FIRST, mate, sw_score DESC, r_start, r_end) AS INTEGER) AS ord FROM g""")
def report_order(spark, d):
    a = aligned(spark, d).select("read_id", "mate", "sw_score", "r_start", "r_end", F.when(F.col("sw_score") % 3 == 0, F.col("seq_idx")).alias("pair_no"))
    return lines.report_order(a)
