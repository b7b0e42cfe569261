from collections import Counter

import pytest

import corpus_pipeline
from helixframe.llm import mixing, packing, quality_rules


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    raw = docs.toPandas()
    kept = []
    for stage, (_, f) in enumerate(corpus_pipeline.STAGES):
        # the mix goes to several files
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", stage != 3)
        f(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{stage}")
        docs = spark.read.parquet(f"{tmp_path}/{stage}")
        kept.append(docs.toPandas())
        if stage < 4:
            assert list(kept[-1].columns) == list(raw.columns)
    want = {d: x[3] for d, t in zip(raw.doc_id, raw.text, strict=True) if (x := quality_rules.judge(t, quality_rules.LineRules()))[2]}
    assert dict(zip(kept[0].doc_id, kept[0].text, strict=True)) == want
    groups = {}
    for d, t in want.items():
        groups.setdefault("".join(t.split()), []).append((-len(t), d))
    assert sorted(kept[1].doc_id) == sorted(min(g)[1] for g in groups.values())
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in zip(kept[1].doc_id, kept[1].text, strict=True) if (w := t.lower().split())}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(kept[2].doc_id) == sorted(d for d in sets if find(d) == d)
    copies = Counter(kept[3].doc_id)
    assert max(copies.values()) <= 3 and set(copies) <= set(kept[2].doc_id)
    words = sum(len(t.split()) for t in kept[2].text)
    assert sum(len(t.split()) for t in kept[3].text) == pytest.approx(words, rel=0.05)
    assert Counter(kept[4][kept[4].start == 0].doc_id) == copies
    # documents were written in the order of their positions, and sequences are made of such runs, in that order
    near = spark.read.parquet(f"{tmp_path}/2")
    written = [r.doc_id for r in packing.as_written(spark.read.parquet(f"{tmp_path}/3")).orderBy("place").collect()]
    assert written == [r.doc_id for r in mixing.mix(near).orderBy("mix_position", "doc_id").collect()]
    at = 0
    for _, block in kept[4].sort_values("place").groupby("place"):
        own = Counter(block[block.start == 0].doc_id)
        n = sum(own.values())
        assert own == Counter(written[at : at + n])
        at += n
    assert at == len(written) and kept[4].place.nunique() > 1


def test_one_row_of_a_group_stays_whatever_its_id(spark):
    rows = [(1, "alpha beta"), (None, "alpha beta"), (2, "gamma delta"), (2, "gamma delta"), (3, "alpha beta"), (3, "clean text"), (None, "lone text"), (None, "twice so"), (None, "twice so")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, "alpha beta"), (2, "gamma delta"), (3, "clean text"), (None, "lone text"), (None, "twice so")]
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert Counter(map(tuple, out.collect())) == Counter(want)
