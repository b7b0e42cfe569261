import random

import numpy as np

from helixframe.llm import minhash, toxicity
from helixframe.llm.minhash import MinHashParams, shingles

P = MinHashParams(k=4)


def brute(texts, k=4, percent=80):
    sets = {d: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := t.encode().translate(minhash.LOWER_AZ).split()) else set() for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    texts, n = {}, 0
    for family in range(12):
        base = [word() for _ in range(r.choice([3, 5, 9, 40, 150]))]
        for _ in range(r.choice([1, 3, 12])):
            own = list(base)
            for _ in range(r.randrange(0, max(1, len(own) // 18) + 1)):
                own[r.randrange(len(own))] = word()
            texts[n] = " ".join(own) if r.random() < 0.7 else " \n".join(own).upper()
            n += 1
    # a chain: each end is far from the other
    chain = [word() for _ in range(100)]
    for i in range(12):
        texts[n] = " ".join(chain[i * 4 : i * 4 + 60])
        n += 1
    texts |= {n: "", n + 1: " \t", n + 2: "one", n + 3: "ONE", n + 4: "É é", n + 5: "é é"}
    return texts


def test_components_against_brute_force(spark):
    texts = corpus()
    rows = [(d, t, "x", 1) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, comp string, kept int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, P).collect()}
    assert got == brute(texts)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "A B c d e")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, P).collect()), key=repr)
    assert got == sorted([(1, 0, 1, True), (None, 2, None, True), (None, 2, None, True), (7, 2, 3, False), (7, 2, 3, False), (3, 2, 3, True)], key=repr)
    assert minhash.near_duplicates(docs.limit(0), P).count() == 0


def test_signatures_estimate_similarity():
    c = minhash.Circulant(P)
    s = shingles(" ".join(f"w{i}" for i in range(900)), 4)
    t = np.union1d(s[: 800], shingles(" ".join(f"v{i}" for i in range(200)), 4))
    true = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
    assert abs((c.signature(s) == c.signature(t)).mean() - true) < 0.12


def test_bitmap_bounds_the_difference():
    a, b = shingles(" ".join(f"w{i}" for i in range(300)), 4), shingles(" ".join(f"w{i}" for i in range(40, 330)), 4)
    differ = sum(int(x).bit_count() for x in (minhash.bitmap(a) ^ minhash.bitmap(b)).view(np.uint64))
    assert differ <= len(np.setxor1d(a, b))


def test_pivots_of_a_star_without_its_centre_first(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for d in range(40):
        own = list(base)
        for j in r.sample(range(4, 116), 3):
            own[j] = f"e{d}_{j}"
        texts[d] = " ".join(own)
    texts[99] = " ".join(base)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, P).collect()}
    assert got == brute(texts)


def make(n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        s = [" ".join(r.choices([f"word{k}" for k in range(60)], k=8)) for _ in range(6)]
        if toxic:
            s[r.randrange(6)] += r.choice([" vile", " rotten"])
        docs.append((i, ". ".join(s)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_from_documents_and_finds_sentences(spark):
    docs, labels = make(400, 1)
    d = spark.createDataFrame([(*x, 0.5) for x in docs] + [(None, "vile", 0.5), (500, None, 0.5), (501, "", 0.5)], "doc_id long, text string, score double")
    y = spark.createDataFrame([*labels, (0, 0), (None, 1), (501, None)], "doc_id long, toxic int")
    model = toxicity.train(d, y)
    out = {r.doc_id: r for r in toxicity.score_documents(d, model).collect()}
    held = [i for i in range(400) if toxicity.held_out(i)]
    assert [out[i].held_out for i in held] == [True] * len(held)
    assert np.mean([out[i].predicted == labels[i][1] for i in held]) > 0.97
    assert out[500].score == 0.0 and out[501].predicted == 0
    for i in held:
        if labels[i][1] and out[i].predicted:
            text = dict(docs)[i].split(". ")
            assert {text[s.sentence].split()[-1] for s in out[i].offending} & {"vile", "rotten"}


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b. c")], "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(d, model).first().predicted == 0
    assert toxicity.score_documents(d.limit(0), model).count() == 0


def test_left_links_join_what_all_pairs_would(spark, monkeypatch):
    """Members of buckets in components of their own, in blocks far smaller than a bucket."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(minhash, "GROUP_BYTES", 20_000)
    r = random.Random(8)
    texts = {}
    base = [f"w{i}" for i in range(130)]
    for d in range(60):
        own = list(base[: r.choice([60, 90, 120, 130])])
        for _ in range(r.randrange(6)):
            own[r.randrange(len(own))] = f"x{r.randrange(9999)}"
        texts[d] = " ".join(own)
    texts[60], texts[61] = "a b c d", "a b c d e"
    want = {d: c for d, (_, c) in brute(texts).items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = minhash.full_sets(docs, P)
    for same in (False, True):
        # apart at first, or most of them in one component already
        comp = {d: min(want[d], d) if same and d % 3 else d for d in texts}
        rest = spark.createDataFrame([(k, d, comp[d]) for k in (1, 2) for d in texts if k == 1 or d % 5 == 0], "key long, doc long, comp long")
        edges = [(x.a, x.b) for x in minhash._left_links(rest, sets, 80).collect()] + [(d, comp[d]) for d in texts]
        root = {d: d for d in texts}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert {d: find(d) for d in texts} == want
        assert len(edges) < 6 * len(texts)


def test_parities_rule_out_no_linked_set():
    r = random.Random(4)
    sets = [shingles(" ".join(f"w{r.randrange(n + 40)}" for _ in range(n)), 4) for n in (3, 20, 33, 70, 140, 200, 300) for _ in range(4)]
    sets += [s[: max(1, int(len(s) * 0.82))] for s in sets]
    sets.sort(key=len)
    par = minhash.Parities(np.array([len(s) for s in sets]), [minhash.wide_bitmap(s) for s in sets], 80)
    for i, a in enumerate(sets):
        linked = {j for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        assert linked <= set(par.near(i).tolist())


def test_toxicity_query_on_held_out_documents(spark):
    from helixframe.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op9_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == toxicity.held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels if toxicity.held_out(r.doc_id)]
    assert sum(p == y for p, y in held) >= 0.95 * len(held) and sum(p and y for p, y in held) >= 0.8 * sum(y for _, y in held)


def test_very_long_and_odd_texts_are_scored(spark):
    docs, labels = make(200, 3)
    long = "word1 word2. " * 60_000 + "vile. " + "x" * 200_000
    d = spark.createDataFrame([*docs, (900, long), (901, "." * 100_000), (902, "\n \n"), (902, "\n \n")], "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = [r for r in toxicity.score_documents(d, model).collect() if r.doc_id >= 900]
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and {r.score for r in out if r.doc_id > 900} == {0.0}
