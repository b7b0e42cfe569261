"""More queries over the driver's tables, and their DuckDB SQL: what scans, sinks, tools and the mapper's rules give."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import bases, cigar, scores
from ..operators import candidates, index, pairs, rank, results, seeds, strategy, tools
from ..params import MapParams
from ..sources import bam, fastx, lines, sam
from .queries import ALIGNED, BANDWIDTH, CIG, HIST, INDEX, K, ORACLE, QUERIES, READS, REFS, S, SIZES, TURNED, HITS, aligned, cigars, counted, kindex, query, lengths, plain_refs, ranked, reads, refs, sizes, t, words  # noqa: F401

def s(name):
    return F.col(name).cast("string")


# --- reads of known places -------------------------------------------------------------------------------------

#: Windows of documents: from each long enough two places, the second turned.
KNOWN = REFS + """, kn AS (SELECT seq_idx * 2 + i AS read_id, seq_idx, i, (seq_idx * 7919 + i * 104729) % (length(bases) - 250) AS a0 FROM refs, (SELECT unnest([0, 1]) AS i) WHERE length(bases) >= 600),
    known AS (SELECT read_id, seq_idx, a0, i, CASE WHEN i = 0 THEN substr(bases, CAST(a0 + 1 AS INTEGER), 100) ELSE translate(reverse(substr(bases, CAST(a0 + 1 AS INTEGER), 100)), 'ACGT', 'TGCA') END AS seq FROM kn JOIN refs USING (seq_idx))"""


def known_reads(r, pair=False):
    """(read_id, mate, qname, seq, qual) of reads without errors: windows at fixed places; the mate of a pair is the one that ends 250 bases on."""
    w = r.where("length >= 600").select("seq_idx", "bases", "length", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    w = w.withColumn("at", F.expr("(seq_idx * 7919 + i * 104729) % (length - 250)"))
    w = w.select((F.col("seq_idx") * 2 + F.col("i")).alias("read_id"), "i", F.substring("bases", F.col("at").cast("int") + 1, F.lit(250)).alias("b"))
    first, last = F.substring("b", 1, 100), bases.reverse_complement(F.substring("b", 151, 100))
    one = F.when(F.col("i") == 0, first).otherwise(last if pair else bases.reverse_complement(first))
    two = F.when(F.col("i") == 0, last).otherwise(first)
    sides = [F.struct(F.lit(1).alias("mate"), one.alias("seq"))] + ([F.struct(F.lit(2).alias("mate"), two.alias("seq"))] if pair else [])
    w = w.select("read_id", F.explode(F.array(*sides)).alias("m"))
    return w.select("read_id", "m.mate", F.concat(F.lit("k"), s("read_id")).alias("qname"), "m.seq", F.lit(None).cast("string").alias("qual"))


@query(f"WITH {KNOWN} SELECT read_id, length(seq) AS best, sha256(seq) AS digest FROM known")
def map_known_reads(spark, d):
    """Reads without errors have a perfect placement, and what stands at the place that is reported first, turned if need be, is the read."""
    r = index.with_offsets(refs(spark, d))
    a = strategy.map_single(known_reads(r), r, index.kmers(r, K, S), MapParams(k=K, stride=S)).where("ord = 0")
    a = a.withColumns({"left": F.col("r_start").cast("long") - 1, "size": (F.col("r_end") - F.col("r_start") + 1).cast("long")})
    w = index.fetch(a, r, 200)
    text = F.when(F.col("strand") == "-", bases.reverse_complement(F.col("window"))).otherwise(F.col("window"))
    return w.select("read_id", F.col("sw_score").cast("long").alias("best"), F.sha2(text, 256).alias("digest"))


@query()
def map_known_pairs(spark, d):
    """SAM records of pairs without errors, 250 bases apart, by the whole strategy."""
    r = index.with_offsets(refs(spark, d))
    q = known_reads(r, True)
    p = MapParams(k=K, stride=S)
    a, restricted = strategy.map_pairs(q, r, index.kmers(r, K, S), p)
    return sam.records(strategy.report_pairs(a, q, restricted, p), q, r)


# --- sequences -----------------------------------------------------------------------------------------------------

TEXT = "coalesce(lower(c_mktsegment) || c_name || 'gattaca', '')"


def customers(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(F.concat(F.lower("c_mktsegment"), "c_name", F.lit("gattaca")), F.lit("")).alias("text"))


@query(f"SELECT c_custkey AS id, regexp_replace(upper({TEXT}), '[^ABCDEFG]', '-', 'g') AS coded FROM customer")
def alphabet_encode(spark, d):
    return customers(spark, d).select("id", bases.encode_alphabet(F.col("text"), "abcdefg", "-").alias("coded"))


STD = f"regexp_replace(replace(upper({TEXT}), 'U', 'T'), '[^ACGT]', 'N', 'g')"


@query(f"SELECT c_custkey AS id, {STD} AS coded, length(regexp_replace({STD}, '[^N]', '', 'g')) AS n_unknown FROM customer")
def encode_text(spark, d):
    """Texts with letters that are no bases, U and lower case among them."""
    c = customers(spark, d).withColumn("coded", bases.encode(F.col("text")))
    return c.select("id", "coded", F.length(F.regexp_replace("coded", "[^N]", "")).cast("long").alias("n_unknown"))


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN seg ELSE translate(reverse(seg), 'ACGT', 'TGCA') END AS seg, substr(text, 3, CAST(greatest(0, id % 7 - 2) AS INTEGER)) AS cropped, text || substr(coded, CAST(id % 5 + 1 AS INTEGER), 8) AS appended FROM (SELECT c_custkey AS id, {TEXT} AS text, {STD} AS coded, substr({STD}, CAST(c_custkey % 9 + 1 AS INTEGER), 12) AS seg FROM customer)")
def segments_of_text(spark, d):
    c, i = customers(spark, d), F.col("id")
    return c.select("id", bases.segment(F.col("text"), i % 9, F.lit(12), i % 2 == 1).alias("seg"), bases.crop(F.col("text"), F.lit(2), i % 7).alias("cropped"), bases.append_segment(F.col("text"), F.col("text"), i % 5, F.lit(8)).alias("appended"))


@query(f"WITH w AS (SELECT c_custkey AS id, unnest(range(0, greatest(0, length({STD}) - 4))) AS p, {STD} AS coded FROM customer) SELECT id, p, word FROM (SELECT id, p, substr(coded, CAST(p + 1 AS INTEGER), 5) AS word FROM w) WHERE word NOT LIKE '%N%'")
def words_with_unknown_bases(spark, d):
    """Words of sequences that hold other letters: those that touch one are left out, places count on."""
    r = customers(spark, d).select(F.col("id").alias("seq_idx"), F.length("text").cast("long").alias("length"), F.col("text").alias("bases"), F.lit(0).cast("long").alias("offset"))
    return index.kmers(r, 5, 1).select(F.col("seq_idx").alias("id"), F.col("pos").alias("p"), "word")


@query(f"""WITH w AS (SELECT c_custkey AS id, substr({STD}, CAST(p + 1 AS INTEGER), 3) AS word, p, {STD} AS coded FROM (SELECT *, unnest(range(0, greatest(0, length({TEXT}) - 2))) AS p FROM customer)),
    g AS (SELECT *, least((p * 7 + id) % 9, ((p + 1) * 7 + id) % 9, ((p + 2) * 7 + id) % 9) AS worst FROM w)
    SELECT id, strand, qoffs, word FROM (SELECT id, '+' AS strand, p AS qoffs, word FROM g WHERE worst >= 1 AND word NOT LIKE '%N%' UNION ALL SELECT id, '-', p, translate(reverse(word), 'ACGT', 'TGCA') FROM g WHERE worst >= 1 AND word NOT LIKE '%N%')""")
def words_of_bad_reads(spark, d):
    """Words of reads with unknown letters and qualities from 0 on."""
    c = customers(spark, d)
    at = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1)).otherwise(F.array().cast("array<int>"))
    qual = F.array_join(F.transform(at, lambda i: F.char(33 + (i * 7 + F.col("id")) % 9)), "")
    r = c.select(F.col("id").alias("read_id"), F.lit(1).alias("mate"), bases.encode(F.col("text")).alias("seq"), qual.alias("qual"))
    return seeds.query_words(r, 3, 1).select(F.col("read_id").alias("id"), "strand", F.col("qoffs").cast("long").alias("qoffs"), "word")


NAMES = "CASE WHEN c_custkey % 3 = 0 THEN c_name || ' more' WHEN c_custkey % 3 = 1 THEN c_name || '/1' ELSE c_name || '/2 x' END"


@query(f"SELECT c_custkey AS id, regexp_replace(split_part({NAMES}, ' ', 1), '/[12]$', '') AS short FROM customer")
def name_parts(spark, d):
    k = F.col("c_custkey") % 3
    n = F.when(k == 0, F.concat("c_name", F.lit(" more"))).when(k == 1, F.concat("c_name", F.lit("/1"))).otherwise(F.concat("c_name", F.lit("/2 x")))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), bases.short_name(n).alias("short"))


@query(f"WITH {REFS} SELECT l_orderkey, seq_idx, l_partkey % 500 AS \"left\", substr(bases, CAST(l_partkey % 500 + 1 AS INTEGER), CAST(l_suppkey + 20 AS INTEGER)) AS \"window\" FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) JOIN refs ON seq_idx = l_partkey WHERE l_partkey % 500 < length(bases)")
def fetch_windows(spark, d):
    li = t(spark, d, "lineitem")
    w = li.select("l_orderkey", F.col("l_partkey").alias("seq_idx"), (F.col("l_partkey") % 500).alias("left"), (F.col("l_suppkey") + 20).alias("size"))
    longest = (li.agg(F.max("l_suppkey")).first()[0] or 0) + 20
    return index.fetch_distinct(w, plain_refs(spark, d), longest).select("l_orderkey", "seq_idx", "left", "window")


@query(f"""WITH {REFS}, a AS (SELECT DISTINCT l_orderkey AS read_id, l_linenumber AS mate, l_partkey * 29 + 1 AS t_start, l_partkey * 29 + 40 + l_suppkey * 9 AS t_end FROM lineitem),
    j AS (SELECT read_id, mate, t_start, t_end, seq_idx, greatest(t_start - 1, "offset") - "offset" + 1 AS r_start, least(t_end, "offset" + length) - "offset" AS r_end FROM a JOIN offs ON t_start - 1 < "offset" + length AND t_end - 1 >= "offset" AND length > 0)
    SELECT read_id, mate, seq_idx, r_start, r_end, CAST(row_number() OVER (PARTITION BY read_id, mate, t_start, t_end ORDER BY seq_idx) AS INTEGER) AS part, count(*) OVER (PARTITION BY read_id, mate, t_start, t_end) AS n_parts FROM j""")
def split_spans(spark, d):
    a = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("mate"), (F.col("l_partkey") * 29 + 1).alias("t_start"), (F.col("l_partkey") * 29 + 40 + F.col("l_suppkey") * 9).alias("t_end")).distinct()
    return index.split_spans(a, index.with_offsets(lengths(spark, d))).select("read_id", "mate", "seq_idx", "r_start", "r_end", "part", "n_parts")


@query(f"""WITH {INDEX}, iv AS (SELECT s_suppkey AS seq_idx, s_suppkey * 3 AS lo, s_suppkey * 3 + 200 AS hi FROM supplier UNION ALL SELECT s_suppkey, s_suppkey * 3 + 150, s_suppkey * 3 + 400 FROM supplier)
    SELECT DISTINCT word, seq_idx, CAST(pos AS BIGINT) AS pos FROM ix JOIN iv USING (seq_idx) WHERE pos >= lo AND pos + 12 <= hi""")
def restricted_index(spark, d):
    sp = t(spark, d, "supplier")
    iv = lambda a, b: sp.select(F.col("s_suppkey").alias("seq_idx"), (F.col("s_suppkey") * 3 + a).alias("lo"), (F.col("s_suppkey") * 3 + b).alias("hi"))
    return index.restricted(index.with_offsets(refs(spark, d)), iv(0, 200).unionByName(iv(150, 400)), K, S).select("word", "seq_idx", "pos")


# --- hits ---------------------------------------------------------------------------------------------------------

COUNTED = INDEX + ", " + READS + ", c AS (SELECT w.read_id, w.strand, w.qoffs, w.word, length(r.seq) AS n, nhits FROM words w JOIN cnt USING (word) JOIN reads r USING (read_id))"


@query(f"WITH {COUNTED} SELECT read_id, CAST(sum(nhits) FILTER (WHERE nhits <= 20) AS BIGINT) AS hits_used, CAST(sum(nhits) AS BIGINT) AS hits_total FROM c GROUP BY read_id HAVING sum(nhits) FILTER (WHERE nhits <= 20) IS NOT NULL")
def work_ratio(spark, d):
    w, _ = counted(spark, d)
    return seeds.work(w, w.where("nhits <= 20")).where("hits_used > 0").select("read_id", "hits_used", "hits_total")


TRIES = ["10000", "5000", "2500", "1250", "625", "312", "156", "78", "39", "19"]


@query(f"""WITH {COUNTED}, x AS (SELECT *, greatest(8192.0::DOUBLE, 32 * n * ln(n)) AS cap, {', '.join(f'sum(CASE WHEN nhits <= {x} THEN nhits ELSE 0 END) OVER w AS s{x}' for x in TRIES)} FROM c WINDOW w AS (PARTITION BY read_id, strand)),
    y AS (SELECT *, CASE {' '.join(f'WHEN s{x} <= cap THEN {x}' for x in TRIES)} ELSE 19 END AS cutoff FROM x)
    SELECT read_id, strand, CAST(qoffs AS BIGINT) AS qoffs, nhits, CAST(cutoff AS INTEGER) AS cutoff FROM y WHERE nhits <= cutoff""")
def adaptive_cutoff(spark, d):
    return seeds.adaptive_cutoff(counted(spark, d)[0]).select("read_id", "strand", F.col("qoffs").cast("long").alias("qoffs"), "nhits", "cutoff")


@query(f"""WITH {HITS}, {TURNED}, rg AS (SELECT *, CASE WHEN diag - lag(diag) OVER w >= least(3, (n - 13) // 13 + 1) * 13 OR lag(diag) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM turned WINDOW w AS (PARTITION BY read_id, strand, seq_idx ORDER BY diag, q)),
    r AS (SELECT *, sum(nw) OVER (PARTITION BY read_id, strand, seq_idx ORDER BY diag, q ROWS UNBOUNDED PRECEDING) AS region FROM rg), k AS (SELECT read_id, strand, seq_idx, region FROM r GROUP BY ALL HAVING count(*) >= 2),
    b AS (SELECT DISTINCT read_id, strand, seq_idx, region, diag, unnest(range(q, q + 13)) AS a0 FROM r JOIN k USING (read_id, strand, seq_idx, region))
    SELECT read_id, strand, seq_idx, CAST(region AS BIGINT) AS region, CAST(diag AS BIGINT) AS diag, count(*) AS cover FROM b GROUP BY ALL""")
def segment_cover(spark, d):
    """Distinct bases that the hits of a diagonal cover, in regions of two hits at least."""
    w, ix = counted(spark, d)
    h = candidates.turned_hits(w.where("nhits <= 10000"), ix, K)
    return candidates.segments(candidates.hit_regions(h, K, S, 2), K, S).select("read_id", "strand", "seq_idx", "region", "diag", "cover")


# --- operations ----------------------------------------------------------------------------------------------------


@query(f"WITH {CIG} SELECT read_id, ln, x || 'S' || (x + 3) || 'M' || x || 'X5M' || i || 'I' || m || 'M' || dl || 'D7M' || i || 'H' AS clipped, x AS before, i AS after, 'M ' || (2 * x + 8) || ' I ' || i || ' M ' || m || ' D ' || dl || ' M 7' AS plain FROM cg")
def cigar_clips(spark, d):
    o = F.col("ops")
    c = cigars(spark, d).withColumn("i", F.expr("cast(regexp_extract(cigar, '(\\\\d+)I', 1) AS int)"))
    # a soft clip before, a hard one after
    both = F.concat(cigar.clipped(o, F.col("ln").cast("int"), F.lit(0)), F.slice(cigar.clipped(o, F.lit(0), F.col("i"), True), -1, 1))
    c = c.withColumn("both", both)
    x = cigar.clips(F.col("both"))
    return c.select("read_id", "ln", cigar.text(F.col("both")).alias("clipped"), x["before"].cast("long").alias("before"), x["after"].cast("long").alias("after"), cigar.plain(F.col("both")).alias("plain"))


@query(f"WITH {CIG} SELECT read_id, ln, (x + 3) || 'M' || x || 'X5M' || i || 'I' || m || 'M' || dl || 'D' || (7 + x + 3) || 'M' || x || 'X5M' || i || 'I' || m || 'M' || dl || 'D7M' AS doubled, '7M' || dl || 'D' || m || 'M' || i || 'I5M' || x || 'X' || (x + 3) || 'M' AS reversed FROM cg")
def cigar_append(spark, d):
    o = F.col("ops")
    return cigars(spark, d).select("read_id", "ln", cigar.text(cigar.append(o, o)).alias("doubled"), cigar.text(cigar.reverse(o)).alias("reversed"))


@query(f"WITH {CIG} SELECT read_id, ln, x + 15 + m AS n_match, x AS n_subst, i AS n_ins, dl AS n_del, x + 15 + m >= floor(0.7 * (2 * x + 15 + i + m)) AS share_reached, x + 15 + m >= 40 AS bases_reached FROM cg")
def operation_counts(spark, d):
    o = F.col("ops")
    k = cigar.counts(o)
    r = cigars(spark, d).select("read_id", "ln", *[k[a].cast("long").alias(b) for a, b in (("match", "n_match"), ("subst", "n_subst"), ("ins", "n_ins"), ("del", "n_del"))], cigar.query_span(o).alias("n"))
    return r.select("read_id", "ln", "n_match", "n_subst", "n_ins", "n_del", scores.identity_reached(F.col("n_match"), 0.7, F.col("n")).alias("share_reached"), scores.identity_reached(F.col("n_match"), 40, F.col("n")).alias("bases_reached"))


# over reference places 1 to x + 1 all is a match; from there on the tail of the deletion's block
@query(f"WITH {CIG} SELECT read_id, ln, (x + 1) || 'M' AS head, '5M' || i || 'I' || m || 'M' || dl || 'D7M' AS tail, 2 * x + 3 AS q_from, 2 * x + 3 AS r_from, 2 * x + 15 + i + m AS q_to, 2 * x + 15 + m + dl AS r_to FROM cg")
def cigar_crop(spark, d):
    """Parts over reference places: one within the first matches, and one that begins among mismatches and is trimmed to what follows."""
    o, ln = F.col("ops"), F.col("ln").cast("int")
    c = cigars(spark, d).withColumns({"a": cigar.crop(o, F.lit(1), ln + 1), "b": cigar.crop(o, ln + 3, F.lit(1 << 20))})
    return c.select("read_id", "ln", cigar.text(F.col("a.ops")).alias("head"), cigar.text(F.col("b.ops")).alias("tail"), *[F.col(f"b.{x}").cast("long").alias(x) for x in ("q_from", "r_from", "q_to", "r_to")])


@query("""SELECT l_orderkey AS read_id, l_linenumber AS ln, CASE WHEN a > 0 THEN a || 'M' ELSE '' END || '1X' || CASE WHEN b > a + 1 THEN (b - a - 1) || 'M1X' ELSE '' END || (60 - greatest(a, b) - 1) || 'M' AS made
    FROM (SELECT l_orderkey, l_linenumber, l_partkey % 20 AS a, l_partkey % 20 + 2 + l_suppkey % 5 AS b FROM lineitem)""")
def mismatches_to_operations(spark, d):
    a = (F.col("l_partkey") % 20).cast("int")
    b = (a + 2 + F.col("l_suppkey") % 5).cast("int")
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("ln"), cigar.text(cigar.from_mismatches(F.lit(60), F.array(b, a, F.lit(-3), F.lit(60)))).alias("made"))


@query(f"WITH {CIG} SELECT read_id, ln, CAST(list_sum(list_transform(range(x + 3, 2 * x + 3), lambda a: ((a + 2) * 31 + ln) % 41)) AS BIGINT) AS total FROM cg")
def mismatch_qualities(spark, d):
    """Sum of the qualities at mismatches of reads aligned from their third base on."""
    # place i has quality (31 i + ln) mod 41, which comes round every 41 places; 31 * 4 mod 41 = 1, so that of ln begins at place 4 ln
    round_ = "".join(chr(33 + i * 31 % 41) for i in range(41))
    c = cigars(spark, d).withColumns({"n": cigar.query_span(F.col("ops")) + 2, "from": F.pmod(F.col("ln").cast("int") * 4, F.lit(41))})
    qual = F.substring(F.repeat(F.lit(round_), F.expr("cast(2 + n div 41 AS int)")), F.col("from") + 1, F.col("n"))
    return c.withColumn("qual", qual).select("read_id", "ln", cigar.mismatch_quality(F.col("ops"), F.col("qual"), F.lit(3)).cast("long").alias("total"))


@query(f"WITH {CIG} SELECT read_id, ln, '0:0:' || (x + 3) || ',' || (2 * x + 3) || ':' || (2 * x + 3) || ':5,' || (2 * x + 8 + i) || ':' || (2 * x + 8) || ':' || m || ',' || (2 * x + 8 + i + m) || ':' || (2 * x + 8 + m + dl) || ':7' AS runs FROM cg")
def exact_runs(spark, d):
    b = F.transform(cigar.exact_runs(F.col("ops")), lambda x: F.concat_ws(":", x["q"].cast("string"), x["r"].cast("string"), x["len"].cast("string")))
    return cigars(spark, d).select("read_id", "ln", F.array_join(b, ",").alias("runs"))


# --- qualities, labels, pairs -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, CAST(least(60, greatest(0, floor(-10 * log10(greatest(1 - (o_custkey % 997 + 0.5) / 997.0::DOUBLE, 1e-7))))) AS INTEGER) AS q FROM orders")
def probability_to_quality(spark, d):
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scores.phred_of((F.col("o_custkey") % 997 + 0.5) / 997.0).alias("q"))


@query("""SELECT l_orderkey AS id, l_linenumber AS ln, CAST(CASE WHEN share > 1e-7 AND -10 * log10(share) < 60 THEN 60 - floor(-10 * log10(share)) ELSE 0 END AS INTEGER) AS cap
    FROM (SELECT l_orderkey, l_linenumber, least((l_partkey % 90) / (l_partkey % 90 + l_suppkey % 70 + 3)::DOUBLE, (l_linenumber % 5) / (l_linenumber % 5 + 3)::DOUBLE) AS share FROM lineitem)""")
def work_cap(spark, d):
    used, done = F.col("l_partkey") % 90, F.col("l_linenumber") % 5
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), scores.work_cap(used, used + F.col("l_suppkey") % 70, done, done).alias("cap"))


PROB = f"""WITH {ALIGNED}, u AS (SELECT DISTINCT read_id, mate, strand, seq_idx, r_start, r_end, q_start, q_end, sw_score FROM a), k AS (SELECT *, dense_rank() OVER (PARTITION BY read_id, mate ORDER BY sw_score DESC) - 1 AS sw_rank FROM u),
    n AS (SELECT *, count(*) FILTER (WHERE sw_rank = 0) OVER w AS n1, count(*) FILTER (WHERE sw_rank = 1) OVER w AS n2, row_number() OVER (PARTITION BY read_id, mate ORDER BY sw_score DESC, strand, seq_idx, r_start, r_end, q_start, q_end) - 1 AS ord FROM k WINDOW w AS (PARTITION BY read_id, mate)),
    p AS (SELECT *, CASE WHEN n1 > 1 THEN CASE WHEN sw_rank = 0 THEN 1.0::DOUBLE / n1 ELSE 0 END WHEN sw_rank = 0 THEN 1 - pow(10.0, -2.0) WHEN sw_rank = 1 THEN pow(10.0, -2.0) / greatest(n2, 1) ELSE 0 END AS prob, n1 = 1 AND n2 = 0 AS single FROM n)"""


def with_probabilities(spark, d):
    per = Window.partitionBy("read_id", "mate")
    r = ranked(spark, d)
    n = lambda k: F.sum((F.col("sw_rank") == k).cast("int")).over(per)
    r = r.withColumns({"n1": n(0), "n2": n(1), "ord": F.row_number().over(per.orderBy(F.col("sw_score").desc(), "strand", "seq_idx", "r_start", "r_end", "q_start", "q_end")) - 1})
    return r.withColumns({"mapq": F.lit(20), "prob": scores.placement_probability(F.lit(20), F.col("n1"), F.col("n2"), F.col("sw_rank")), "single": (F.col("n1") == 1) & (F.col("n2") == 0)})


@query(PROB + " SELECT read_id, mate, CAST(ord AS BIGINT) AS ord, CAST(round(prob * 1000000) AS BIGINT) AS ppm, single FROM p")
def placement_probabilities(spark, d):
    return with_probabilities(spark, d).select("read_id", "mate", F.col("ord").cast("long").alias("ord"), F.round(F.col("prob") * 1_000_000).cast("long").alias("ppm"), "single")


PAIRS = PROB + """, e AS (SELECT * FROM p WHERE sw_rank = 0 OR (sw_rank = 1 AND n1 = 1)),
    j AS (SELECT x.read_id, x.ord AS a_ord, y.ord AS b_ord, x.prob AS pa, y.prob AS pb, x.single AS sa, y.single AS sb, x.seq_idx = y.seq_idx AS same_ref, x.strand AS ta, y.strand AS tb, x.sw_score + y.sw_score AS total, x.sw_rank AS ra, y.sw_rank AS rb,
      CASE WHEN y.r_start < x.r_start THEN -1 ELSE 1 END * (greatest(x.r_end, y.r_end) - least(x.r_start, y.r_start) + 1) AS isize FROM e x JOIN e y ON x.read_id = y.read_id AND x.mate = 1 AND y.mate = 2),
    f AS (SELECT *, same_ref AND (CASE WHEN isize >= 0 THEN ta = '+' AND tb = '-' ELSE ta = '-' AND tb = '+' END) AS proper, same_ref AND abs(isize) BETWEEN 0 AND 150 AS within FROM j),
    w AS (SELECT *, pa * pb * CASE WHEN proper AND within THEN 0.9999::DOUBLE * 0.997 WHEN proper THEN 0.9999::DOUBLE * 0.003 ELSE 0.0001 END AS weight, CASE WHEN sa THEN (1 - pa) * (0.0001 + 0.9999::DOUBLE * 0.003) * pb ELSE 0 END AS b_else, CASE WHEN sb THEN pa * (0.0001 + 0.9999::DOUBLE * 0.003) * (1 - pb) ELSE 0 END AS a_else FROM f)"""


def found_pairs(spark, d):
    return pairs.find_pairs(strategy.pair_depth(with_probabilities(spark, d)), hi=150)


@query(PAIRS + """, m AS (SELECT *, greatest(1e-7, sum(weight + a_else + b_else) OVER r + 1e-7) AS tot, sum(weight) OVER (PARTITION BY read_id, a_ord) + sum(a_else) OVER r AS am, sum(weight) OVER (PARTITION BY read_id, b_ord) + sum(b_else) OVER r AS bm FROM w WINDOW r AS (PARTITION BY read_id))
    SELECT read_id, CAST(a_ord AS BIGINT) AS a_ord, CAST(b_ord AS BIGINT) AS b_ord, isize, CAST(round(weight / tot * 10000) AS BIGINT) AS share, CAST(round(am / tot * 10000) AS BIGINT) AS a_mass, CAST(round(bm / tot * 10000) AS BIGINT) AS b_mass FROM m""")
def pair_marginals(spark, d):
    w = pairs.weights(found_pairs(spark, d).withColumn("restricted", F.lit(0)))
    per = Window.partitionBy("read_id")
    m = pairs.marginals(w).withColumn("tot", F.col("weight") / F.col("share"))
    mass = lambda o, e: F.round((F.sum("weight").over(Window.partitionBy("read_id", o)) + F.sum(e).over(per)) / F.max("tot").over(per) * 10_000).cast("long")
    return m.where("weight > 0 OR weight = 0").select("read_id", F.col("a_ord").cast("long").alias("a_ord"), F.col("b_ord").cast("long").alias("b_ord"), "isize", F.round(F.col("share") * 10_000).cast("long").alias("share"), mass("a_ord", "a_else").alias("a_mass"), mass("b_ord", "b_else").alias("b_mass"))


@query(PAIRS + " SELECT read_id, CAST(a_ord AS BIGINT) AS a_ord, CAST(b_ord AS BIGINT) AS b_ord, CAST(row_number() OVER (PARTITION BY read_id ORDER BY total DESC, a_ord, b_ord) AS INTEGER) AS pair_rank FROM f WHERE proper AND within AND ra = 0 AND rb = 0")
def proper_pairs(spark, d):
    p = pairs.proper_pairs(with_probabilities(spark, d), hi=150)
    return p.select("read_id", F.col("a_ord").cast("long").alias("a_ord"), F.col("b_ord").cast("long").alias("b_ord"), "pair_rank")


@query(PROB + ", j AS (SELECT x.read_id, x.seq_idx = y.seq_idx AS same_ref, CASE WHEN y.r_start < x.r_start THEN -1 ELSE 1 END * (greatest(x.r_end, y.r_end) - least(x.r_start, y.r_start) + 1) AS isize FROM p x JOIN p y ON x.read_id = y.read_id AND x.mate = 1 AND y.mate = 2 AND x.ord = 0 AND y.ord = 0) SELECT read_id, isize FROM j WHERE same_ref")
def inferred_inserts(spark, d):
    return pairs.inferred_inserts(with_probabilities(spark, d))


ORIENT = """SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey % 2 = 0 AS f1, l_suppkey % 2 = 0 AS f2, l_linenumber % 2 = 0 AS lf, l_partkey % 5 AS k FROM lineitem"""


@query(f"""SELECT id, ln, CASE WHEN lf THEN f1 AND NOT f2 ELSE NOT f1 AND f2 END AS pe, CASE WHEN lf THEN NOT f1 AND f2 ELSE f1 AND NOT f2 END AS mp, CASE WHEN lf THEN f1 AND f2 ELSE NOT f1 AND NOT f2 END AS pp, true AS either,
    CASE WHEN k = 0 AND f1 THEN 'R' WHEN k = 0 THEN 'N' WHEN k = 1 THEN 'P' WHEN k = 2 THEN 'S' WHEN f1 THEN 'D' WHEN f2 THEN 'C' WHEN lf THEN 'A' ELSE 'B' END AS label FROM ({ORIENT})""")
def orientations(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), (F.col("l_partkey") % 2 == 0).alias("f1"), (F.col("l_suppkey") % 2 == 0).alias("f2"), (F.col("l_linenumber") % 2 == 0).alias("lf"), (F.col("l_partkey") % 5).alias("k"))
    strand, size = lambda c: F.when(F.col(c), "+").otherwise("-"), F.when(F.col("lf"), 100).otherwise(-100)
    proper = [scores.is_proper(lib, strand("f1"), strand("f2"), size).alias(n) for lib, n in (("pe", "pe"), ("mp", "mp"), ("pp", "pp"), ("any", "either"))]
    label = scores.label(F.col("k") > 2, ~F.col("f1"), ~F.col("f2"), F.col("lf"), F.col("k") != 0, F.col("k") == 1, F.col("f1"))
    return x.select("id", "ln", *proper, label.alias("label"))


@query(f"WITH {ALIGNED} SELECT read_id, mate, CASE WHEN strand = '-' THEN 120 - q_end ELSE q_start - 1 END AS before, CASE WHEN strand = '-' THEN q_start - 1 ELSE 120 - q_end END AS after, 's' || seq_idx AS rnext, r_start AS pnext, CASE WHEN sw_score % 2 = 0 THEN CASE WHEN mate = 1 THEN 55 ELSE -55 END ELSE 0 END AS tlen FROM a")
def clips_and_mate_fields(spark, d):
    a = aligned(spark, d)
    c = scores.clip_lengths(F.col("strand"), F.col("q_start"), F.col("q_end"), F.lit(120))
    m = scores.mate_fields(F.concat(F.lit("s"), s("seq_idx")), F.col("r_start"), F.col("sw_score") % 2 == 0, F.lit(55), F.col("mate"))
    return a.select("read_id", "mate", c["before"].alias("before"), c["after"].alias("after"), m["rnext"].alias("rnext"), m["pnext"].alias("pnext"), m["tlen"].alias("tlen"))


REPORTED = PROB + ", r AS (SELECT *, CASE WHEN n1 > 1 THEN 0 ELSE 20 END AS mapq, r_start % 7 > 0 AS fit FROM p)"


def reportable(spark, d):
    """Placements as the mapper gives them: those with some starts are below the limits."""
    r = with_probabilities(spark, d).withColumn("mapq", F.when(F.col("n1") > 1, 0).otherwise(20))
    return r.withColumns({"qseg": F.lit(0), "below_abs": F.col("r_start") % 7 == 0, "below_rel": F.lit(False), "cigar": F.lit("1M"), "edit_dist": F.lit(0)})


@query(REPORTED + """, o AS (SELECT *, count(*) FILTER (WHERE sw_rank = 0) OVER (PARTITION BY read_id, mate) AS top, max(CASE WHEN ord = 0 THEN mapq END) OVER (PARTITION BY read_id, mate) AS q0, row_number() OVER (PARTITION BY read_id, mate ORDER BY ord) AS nth FROM r WHERE fit),
    m AS (SELECT *, top > 1 AND coalesce(q0, 0) = 0 AS multi FROM o), e AS (SELECT DISTINCT read_id, mate FROM a), x AS (SELECT * FROM m WHERE nth = 1 AND NOT multi)
    SELECT e.read_id, e.mate, CAST(x.ord AS BIGINT) AS ord, CASE WHEN x.ord IS NOT NULL THEN 'S' WHEN EXISTS (SELECT 1 FROM m WHERE m.read_id = e.read_id AND m.mate = e.mate) THEN 'R' ELSE 'N' END AS label FROM e LEFT JOIN x USING (read_id, mate)""")
def report_unplaced_ties(spark, d):
    """What is reported of each mate when ties are left unplaced."""
    a = storage.cut(reportable(spark, d))
    out = strategy.report_single(a, aligned(spark, d).select("read_id", "mate").distinct(), MapParams(ties="unmapped"))
    return out.select("read_id", "mate", F.col("ord").cast("long").alias("ord"), "label")


@query(REPORTED + " SELECT read_id, mate, CAST(ord AS BIGINT) AS ord FROM (SELECT *, min(ord) FILTER (WHERE fit) OVER (PARTITION BY read_id, mate) AS first FROM r) WHERE fit AND ord <> first AND sw_rank > 0")
def report_leftovers(spark, d):
    """Placements fit for output that a report of all the best leaves out: none but the first of each mate, and its ties."""
    a = storage.cut(reportable(spark, d))
    shown = strategy.report_single(a, aligned(spark, d).select("read_id", "mate").distinct(), MapParams(ties="all"))
    return strategy.leftovers(a, shown).select("read_id", "mate", F.col("ord").cast("long").alias("ord"))


@query(PROB + " SELECT read_id, mate, CAST(ord AS BIGINT) AS ord, CAST(row_number() OVER (ORDER BY read_id, mate, ord) - 1 AS BIGINT) AS place FROM p")
def input_order(spark, d):
    """Records numbered in the order of the input, without one task that sorts them all."""
    r = with_probabilities(spark, d).select("read_id", "mate", F.col("ord").cast("long").alias("ord"))
    return tools.numbered(r, ["read_id", "mate", "ord"], "place")


# --- inserts ----------------------------------------------------------------------------------------------------------

SMOOTH = HIST + BANDWIDTH + """, s AS (SELECT a.bin, any_value(a.lo) AS lo, any_value(a.width) AS width, CAST(floor(round(sum(b.n * exp(-pow((b.bin - a.bin) / bw, 2) / 2)), 6) / any_value(bw)) AS BIGINT) AS n_smooth FROM h a JOIN h b ON true JOIN bw ON abs(a.bin - b.bin) <= floor(3 * bw) GROUP BY a.bin),
    c AS (SELECT lo, lo + width AS hi, CAST(sum(n_smooth) OVER (ORDER BY lo) AS BIGINT) AS upto, sum(n_smooth) OVER () AS total FROM s)"""


def smooth_histogram(spark, d):
    z = sizes(spark, d)
    h = storage.cut(pairs.derived_histogram(z))
    return pairs.smooth(h, pairs.bandwidth(z)).join(h.select("bin", "lo", "width"), "bin")


@query(SMOOTH + " SELECT lo, hi, upto, CAST(round(upto / total::DOUBLE * 1000000) AS BIGINT) AS ppm FROM c")
def insert_cdf(spark, d):
    return pairs.share_up_to(smooth_histogram(spark, d)).select("lo", "hi", "upto", F.round(F.col("share") * 1_000_000).cast("long").alias("ppm"))


@query(HIST + """, e AS (SELECT unnest(range(min(lo), max(lo) + 1, any_value(width))) AS lo FROM h), x AS (SELECT e.lo, coalesce(h.n, 0) AS n FROM e LEFT JOIN h USING (lo)), z AS (SELECT count(*) AS k, min(x.lo) AS lo, max(x.lo) AS hi, sum(x.n) AS total, (SELECT any_value(width) FROM h) AS w FROM x)
    SELECT CAST(lo AS BIGINT) AS ord, lo || ' ' || n AS line FROM x UNION ALL SELECT -1099511627775, concat_ws(' ', k, w, lo, hi + w - 1, total, q1, q2, q3) FROM z, q UNION ALL SELECT -1099511627776, '#insert histogram' UNION ALL SELECT 1099511627776, '#end of histogram'""")
def histogram_file(spark, d):
    z = sizes(spark, d)
    return lines.histogram_text(storage.cut(pairs.derived_histogram(z).select("lo", "width", "n")), z)


@query("SELECT o_orderkey AS read_id FROM orders WHERE o_orderkey % (SELECT greatest(1, count(*) // 4098) FROM orders) = 0")
def sampled_pairs(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"))
    return pairs.every_nth(o, pairs.sampling_interval(o.count()))


# --- files that are written and read again --------------------------------------------------------------------------------

RECORDS = """rec AS (SELECT o_orderkey * 10 + m AS id, 'q' || o_orderkey AS qname, 1 + CASE WHEN m = 1 THEN 64 ELSE 128 END + CASE WHEN o_custkey % 3 = 0 THEN 16 ELSE 0 END AS flag, 's' || (o_custkey + m) % 10 AS rname, o_custkey + 1 AS pos, o_custkey % 60 AS mapq, '20M' AS cigar,
    repeat(CASE WHEN m = 1 THEN 'ACGTT' ELSE 'GGCAT' END, 4) AS seq, repeat('I5', 10) AS qual, m AS nm, o_custkey % 100 AS as_score FROM orders, (SELECT unnest([1, 2]) AS m) WHERE m = 2 OR o_orderkey % 5 > 0)"""


def made_records(spark, d):
    """Records of pairs, and of mates 2 alone."""
    o = t(spark, d, "orders").withColumn("m", F.explode(F.array(F.lit(1), F.lit(2)))).where("m = 2 OR o_orderkey % 5 > 0")
    first = F.col("m") == 1
    flag = F.lit(1) + F.when(first, 64).otherwise(128) + F.when(F.col("o_custkey") % 3 == 0, 16).otherwise(0)
    return o.select(
        (F.col("o_orderkey") * 10 + F.col("m")).alias("read_id"), F.concat(F.lit("q"), s("o_orderkey")).alias("qname"), flag.alias("flag"), F.concat(F.lit("s"), ((F.col("o_custkey") + F.col("m")) % 10).cast("string")).alias("rname"), (F.col("o_custkey") + 1).cast("int").alias("pos"),
        (F.col("o_custkey") % 60).cast("int").alias("mapq"), F.lit("20M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.when(first, "ACGTT" * 4).otherwise("GGCAT" * 4).alias("seq"), F.lit("I5" * 10).alias("qual"),
        F.col("m").alias("nm"), (F.col("o_custkey") % 100).cast("int").alias("as_score"),
    )


def written(spark, name, write):
    """A path in the shared folder that ``write`` has filled; it lasts as long as the application."""
    at = f"{storage.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(at)
    storage.forget_at_exit(spark, at)
    return at


COLLATED = RECORDS + """, x AS (SELECT id, qname, CASE WHEN flag & 64 > 0 THEN 1 ELSE 2 END AS mate, CASE WHEN flag & 16 > 0 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END AS seq, CASE WHEN flag & 16 > 0 THEN reverse(qual) ELSE qual END AS qual FROM rec), n AS (SELECT qname, count(*) AS c FROM x GROUP BY qname)
    SELECT qname, CASE WHEN c = 2 THEN mate ELSE 0 END AS mate, seq, qual FROM x JOIN n USING (qname)"""


@query(f"WITH {COLLATED}")
def sam_scan(spark, d):
    """Records as SAM text, read again, mates brought together."""
    at = written(spark, "sam", lambda p: sam.sam_lines(made_records(spark, d)).select("line").write.text(p))
    return sam.collated(sam.read_sam(spark, at)).select("qname", "mate", "seq", "qual")


@query(f"WITH {RECORDS} SELECT qname, CAST(flag AS INTEGER) AS flag, rname, CAST(pos AS INTEGER) AS pos, CAST(mapq AS INTEGER) AS mapq, cigar, seq, qual, CAST(nm AS INTEGER) AS nm, CAST(as_score AS INTEGER) AS as_score FROM rec")
def bam_scan(spark, d):
    """Records as BAM files, read again."""
    sup = spark.range(10).select(F.col("id").alias("seq_idx"), F.concat(F.lit("s"), s("id")).alias("name"), F.lit(1 << 28).alias("length"))
    at = written(spark, "bam", lambda p: bam.write_bam(made_records(spark, d), sup, p))
    return bam.read_bam(spark, at).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", "nm", "as_score")


@query(f"WITH {RECORDS} SELECT qname, length(seq) AS length, seq, qual FROM rec WHERE flag & 64 > 0")
def fastq_scan(spark, d):
    """Records as FASTQ with lines of seven letters, gzipped, read again."""
    r = made_records(spark, d).where(F.col("flag").bitwiseAND(F.lit(64)) > 0)
    at = written(spark, "fastq", lambda p: fastx.fastx_lines(r, 7).select("value").write.option("compression", "gzip").text(p))
    return fastx.read_fastx(spark, at).select("qname", F.length("seq").cast("long").alias("length"), "seq", "qual")


@query(f"WITH {RECORDS}, o AS (SELECT qname, seq, row_number() OVER (ORDER BY id) - 1 AS i FROM rec WHERE flag & 64 > 0) SELECT i AS read_id, unnest([1, 2]) AS mate, qname, seq FROM o")
def fastq_pairs(spark, d):
    """Two folders of FASTQ files in one order, sorted by ranges, read by lines and put together."""
    r = made_records(spark, d).where(F.col("flag").bitwiseAND(F.lit(64)) > 0).orderBy("read_id")
    at = [written(spark, "mates", lambda p: fastx.fastx_lines(r).select("value").write.text(p)) for _ in range(2)]
    return fastx.pair_up(*(fastx.read_fastq_lines(spark, p) for p in at)).select("read_id", "mate", "qname", "seq")


@query(f"""WITH {READS}, c AS (SELECT read_id, qname, CASE WHEN length(seq) = 0 THEN [''] ELSE list_transform(range(0, (length(seq) + 59) // 60), lambda i: substr(seq, CAST(i * 60 + 1 AS INTEGER), 60)) END AS parts FROM reads)
    SELECT read_id, '>' || qname || chr(10) || array_to_string(parts, chr(10)) AS value FROM c""")
def fasta_wrapped(spark, d):
    return fastx.fastx_lines(reads(spark, d).withColumn("qual", F.lit(None).cast("string")), 60)


@query(f"WITH {REFS} SELECT -1 AS ord, '@HD' || chr(9) || 'VN:1.3' || chr(9) || 'SO:unknown' AS line UNION ALL SELECT seq_idx, '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || length(bases) FROM refs UNION ALL SELECT 4611686018427387904, '@PG' || chr(9) || 'ID:helixframe' || chr(9) || 'PN:helixframe' || chr(9) || 'VN:1' || chr(9) || 'CL:map'")
def sam_header_lines(spark, d):
    return sam.sam_header(refs(spark, d), "map")


@query(f"WITH {REFS} SELECT seq_idx, name, length(bases) AS length, sha256(bases) AS digest FROM refs")
def stored_refs(spark, d):
    """A reference set through FASTA, and through its stored form."""
    r = refs(spark, d).withColumns({"read_id": F.col("seq_idx"), "qname": F.concat("name", F.lit(" of a table")), "seq": F.lower("bases")})
    at = written(spark, "refs", lambda p: index.save_refs(index.refs_from_fastx(r), p))
    return index.load_refs(spark, at).select("seq_idx", "name", "length", F.sha2("bases", 256).alias("digest"))


# --- tools ---------------------------------------------------------------------------------------------------------------


@query("SELECT 'r' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '/1' WHEN o_orderkey % 3 = 1 THEN '/2' ELSE '' END AS qname, CASE WHEN o_orderkey % 3 = 0 THEN 'first' WHEN o_orderkey % 3 = 1 THEN 'second' ELSE 'none' END AS side, o_orderkey // 100 AS slice FROM orders")
def split_files(spark, d):
    k = F.col("o_orderkey") % 3
    r = t(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("r"), s("o_orderkey"), F.when(k == 0, "/1").when(k == 1, "/2").otherwise("")).alias("qname"))
    a, b, c = tools.split_by_mate(tools.slices(r, 100))
    return a.withColumn("side", F.lit("first")).unionByName(b.withColumn("side", F.lit("second"))).unionByName(c.withColumn("side", F.lit("none"))).select("qname", "side", "slice")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), b AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), k AS (SELECT greatest(1, (SELECT count(*) FROM a) // (SELECT count(*) FROM b)) AS step),
    x AS (SELECT 'a' AS source, i, i AS a0, 0 AS second FROM a UNION ALL SELECT 'b', i, i * step, 1 FROM b, k) SELECT source, i AS ordinal, row_number() OVER (ORDER BY a0, second) - 1 AS place FROM x""")
def interleaved_files(spark, d):
    n = lambda table, key: tools.numbered(t(spark, d, table).select(key), [key]).select("ordinal")
    a, b = n("orders", "o_orderkey"), n("customer", "c_custkey")
    x = tools.interleaved(a, b, t(spark, d, "orders").count(), t(spark, d, "customer").count())
    return tools.numbered(x.select("source", "ordinal", F.col("place.at").alias("at"), F.col("place.second").alias("second")), ["at", "second"], "place").select("source", "ordinal", "place")


@query(f"WITH {REFS} SELECT seq_idx, name, 11 AS start, CAST(10 + length(f) AS INTEGER) AS \"end\", f AS forward, translate(reverse(f), 'ACGT', 'TGCA') AS \"reverse\" FROM (SELECT seq_idx, name, substr(bases, 11, 70) AS f FROM refs WHERE name = 'doc12')")
def fetch_region(spark, d):
    return tools.region(refs(spark, d), "doc12 and more", 11, 70)


@query("SELECT c_name AS qname, length(c_mktsegment) AS length FROM customer WHERE c_name = 'Customer#000000007'")
def find_record(spark, d):
    c = t(spark, d, "customer").select(F.col("c_name").alias("qname"), F.col("c_mktsegment").alias("seq"))
    return tools.read_lengths(tools.find_record(c, "Customer#000000007"))


@query(f"WITH {READS}, q AS (SELECT read_id, length(seq) AS n, unnest(range(0, length(seq))) AS pos FROM reads), v AS (SELECT n, (pos * 31 + read_id * 17) % 41 AS q FROM q) SELECT (SELECT count(*) FROM reads) AS n_reads, (SELECT min(length(seq)) FROM reads) AS min_length, (SELECT max(length(seq)) FROM reads) AS max_length, CAST(min(q) AS BIGINT) AS min_quality, CAST(max(q) AS BIGINT) AS max_quality FROM v")
def quality_extrema(spark, d):
    return tools.quality_extrema(reads(spark, d))


@query(f"""WITH {RECORDS}, m AS (SELECT *, CASE WHEN pos % 11 = 0 THEN flag + 4 ELSE flag END AS f FROM rec), b AS (SELECT qname, min(rname) AS lo, max(rname) AS hi FROM m WHERE f & 1 > 0 AND f & 4 = 0 GROUP BY qname)
    SELECT count(*) AS n_reads, round(100.0 * count(*) FILTER (WHERE f & 4 = 0) / count(*), 2)::DOUBLE AS pct_mapped, round(100.0 * count(*) FILTER (WHERE f & 4 = 0 AND mapq >= 4) / count(*), 2)::DOUBLE AS pct_placed, round(100.0 * count(*) FILTER (WHERE f & 4 = 0 AND mapq >= 10) / count(*), 2)::DOUBLE AS pct_confident, 0::BIGINT AS n_proper_pairs, (SELECT count(*) FROM b WHERE lo <> hi) AS n_pairs_apart FROM m""")
def sam_statistics(spark, d):
    r = made_records(spark, d)
    return tools.sam_summary(r.withColumn("flag", F.when(F.col("pos") % 11 == 0, F.col("flag") + 4).otherwise(F.col("flag"))))
