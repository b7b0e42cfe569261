"""Faults that only larger tables, or tables dealt otherwise, show."""

import gzip
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from helixframe.functions import scores
from helixframe.operators import index, pairs, seeds, tools
from helixframe.sources import bam, fastx


@contextmanager
def conf(spark, **values):
    old = {k: spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k.replace("__", ".")) if v is None else spark.conf.set(k.replace("__", "."), v)


def test_numbers_hold_where_ranges_are_dealt_twice(spark):
    """Sizes of ranges are counted over fewer columns than are numbered; partitions merged by size would differ."""
    d = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    with conf(spark, spark__sql__shuffle__partitions="40", spark__sql__adaptive__advisoryPartitionSizeInBytes="300k", spark__sql__adaptive__coalescePartitions__minPartitionSize="50k", spark__sql__adaptive__coalescePartitions__parallelismFirst="false"):
        assert tools.numbered(d, ["k"]).where("ordinal = k AND length(text) = 128").count() == 60_000


def test_masses_of_pairs_are_those_of_the_written_priors(spark):
    """Three equal places, one of them proper and too far: each other one has 1 / 32 of the mass, which the SQL rounds up at four digits."""
    third = scores.placement_probability(F.lit(20), F.lit(3), F.lit(0), F.lit(0))
    sure = scores.placement_probability(F.lit(20), F.lit(1), F.lit(1), F.lit(0))
    row = spark.range(1).select(third.alias("third"), sure.alias("sure"), (1 - sure).alias("rest")).first()
    assert (row.third, row.sure) == (1 / 3, 1 - 0.01)
    assert (pairs.OUTSIDE, pairs.IMPROPER) == (0.003, 0.0001)


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [500_000, 10])
def test_spans_are_split_without_moving_their_parts(spark, monkeypatch, rows):
    monkeypatch.setattr(index, "BROADCAST_ROWS", rows)
    sizes = [(i * 37) % 11 * (i % 5 > 0) for i in range(700)]
    ahead = [sum(sizes[:i]) for i in range(700)]
    refs = spark.createDataFrame([(i * 3, n) for i, n in enumerate(sizes)], "seq_idx long, length long")
    refs = refs.join(index.offsets(refs), "seq_idx")
    spans = [(i, 1, i * 29 % 2900 - 2, i * 29 % 2900 + i * 7 % 2400) for i in range(200)] + [(999, 2, 10**6, 10**6 + 5)]
    got = index.split_spans(spark.createDataFrame(spans, "read_id long, mate int, t_start long, t_end long"), refs)
    want = []
    for r, m, a, z in spans:
        own = [(i * 3, max(a - 1, o) - o + 1, min(z, o + n) - o) for i, (n, o) in enumerate(zip(sizes, ahead, strict=True)) if n and a - 1 < o + n and z - 1 >= o]
        want += [(r, m, a, z, *x, k + 1, len(own)) for k, x in enumerate(own)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Window" not in plan(got)


def test_distinct_windows_are_dealt_once(spark):
    refs = spark.createDataFrame([(1, 9000, "ACGTT" * 1800), (2, 3, "GGG"), (3, 0, "")], "seq_idx long, length long, bases string")
    w = spark.createDataFrame([(1, 4090, 20), (1, 4090, 20), (1, 8990, 20), (1, 9000, 5), (2, 1, 9), (2, 3, 1), (3, 0, 1), (7, 0, 1)], "seq_idx long, left long, size long")
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        got = index.fetch_distinct(w, refs, 20)
        assert sorted(map(tuple, got.collect())) == [(1, 4090, 20, "ACGTT" * 4), (1, 8990, 20, "ACGTT" * 2), (2, 1, 9, "GG")]
        assert plan(got).split("Initial Plan")[0].count("ShuffleQueryStage") == 2 or plan(got).count("Exchange hashpartitioning") == 2


def test_an_index_is_held_against_its_sequences_in_one_exchange(spark):
    refs = spark.createDataFrame([(1, 0, 40, "ACGTTGCAAC" * 4), (2, 40, 9, "GGGGGGGGG")], "seq_idx long, offset long, length long, bases string")
    ix = index.kmers(refs, 5, 5)
    bad = ix.where("tpos <> 10").unionByName(ix.where("tpos = 20")).unionByName(ix.where("tpos = 20")).unionByName(ix.where("tpos = 40").withColumn("pos", F.col("pos") + 1))
    got = index.missing_words(bad, refs, 5, 5)
    assert sorted((r["side"], r["seq_idx"], r["pos"]) for r in got.collect()) == [("index", 1, 20), ("index", 1, 20), ("index", 2, 1), ("refs", 1, 10)]
    assert plan(got).split("Initial Plan")[-1].count("Exchange") == 1


def test_words_of_a_sequence_are_counted_where_it_lies(spark):
    rows = [(1, 0, "ACGTTGCAAC" * 400), (2, 4000, "ACGNACGTACGT"), (3, 4012, "ACG"), (4, 4015, "")]
    refs = spark.createDataFrame([(i, o, len(b), b) for i, o, b in rows], "seq_idx long, offset long, length long, bases string")
    got = index.distinct_words(refs, 5, 3)
    want = index.kmers(refs, 5, 3).groupBy("seq_idx").agg(F.count("*"), F.countDistinct("word"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in plan(got) and "Aggregate" not in plan(got)


def test_bam_files_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    r = spark.range(0, 20_000, 1, 3).select(F.concat(F.lit("q"), "id").alias("qname"), F.lit(0).alias("flag"), F.lit("s").alias("rname"), (F.col("id").cast("int") + 1).alias("pos"), F.lit(9).alias("mapq"), F.lit("8M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.lit("ACGTTGCA").alias("seq"), F.lit("IIIIIIII").alias("qual"), F.lit(1).alias("nm"), F.lit(None).cast("int").alias("as_score"))
    refs = spark.createDataFrame([(0, "s", 1 << 20)], "seq_idx long, name string, length long")
    was = type(r).toLocalIterator

    def few(self, *a, **k):
        assert self.columns == ["name", "length"] or self.columns == ["name", "length", "seq_idx"]
        return was(self, *a, **k)

    monkeypatch.setattr(type(r), "toLocalIterator", few)
    to = tmp_path / "out"
    assert bam.write_bam(r, refs, f"file://{to}") == 3 and sorted(p.name for p in to.glob("*.bam")) == [f"part-0000{i}.bam" for i in range(3)]
    assert all(p.read_bytes().endswith(bam.END) for p in to.glob("*.bam"))
    back = bam.read_bam(spark, f"file://{to}").drop("ordinal")
    assert back.count() == 20_000 and back.exceptAll(r.select(back.columns)).count() == 0


def test_fastq_files_follow_each_other_by_name(spark, tmp_path):
    """A scan takes the largest file first."""
    k = 0
    for f, n in enumerate((2, 300, 40)):
        (tmp_path / f"part-{f}.txt").write_text("".join(f"@q{k + i}\nACGT\n+\nIIII\n" for i in range(n)))
        k += n
    with conf(spark, spark__sql__files__maxPartitionBytes="4k", spark__sql__files__openCostInBytes="1"):
        got = fastx.read_fastq_lines(spark, f"file://{tmp_path}").collect()
    assert sorted((r["read_id"], r["qname"]) for r in got) == [(i, f"q{i}") for i in range(k)]


def test_fastx_is_read_in_parts(spark, tmp_path):
    (tmp_path / "r.fq.gz").write_bytes(gzip.compress("".join(f"@q{i} x\r\nAC\r\nGT\r\n+\r\nIIII\r\n" for i in range(25_001)).encode()))
    got = fastx.read_fastx(spark, f"file://{tmp_path}/r.fq.gz").collect()
    assert [(r["read_id"], r["qname"], r["seq"], r["qual"]) for r in got] == [(i, f"q{i} x", "ACGT", "IIII") for i in range(25_001)]
    assert fastx.AT_ONCE < 25_001


def test_few_words_are_sent_to_the_index(spark, monkeypatch):
    made = []
    monkeypatch.setattr(seeds, "cut", lambda d: made.append(d) or d)
    words = spark.createDataFrame([(1, 1, "+", "ACG"), (1, 1, "-", "CCC")], "read_id long, mate int, strand string, word string")
    ix = spark.createDataFrame([("ACG", 1, 5, 5), ("ACG", 2, 0, 9), ("TTT", 1, 0, 0)], "word string, seq_idx long, pos long, tpos long")
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        counted, used = seeds.looked_up(words, ix)
        assert used.count() == 2 and counted.first()["nhits"] == 2 and "BroadcastHashJoin" in plan(made[-1])
