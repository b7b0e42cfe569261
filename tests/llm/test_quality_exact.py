import random
import re

from helixframe.llm import exact_dedup, quality_rules
from helixframe.llm.quality_rules import LineRules, counts


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


CASES = ["", " \n ", "a b c a b c a", "a a a a a", "x\nx\n\n y\nx", "#*$%&|<> é e b", "a b c d " * 30 + "\r\nq", "\x0b\x0cz\x1cz"]


def test_counts_against_brute_force():
    for t in CASES:
        assert counts(t) == brute(t), t


def test_measure_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate([*CASES, None])] + [(None, "z", 1), (0, "", 1)]
    out = quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert len(out) == len(rows) and all(r.base_failed and not r.kept for r in out if r.n_words < 50)
    assert quality_rules.measure(spark.createDataFrame([], "doc_id long, text string")).count() == 0


_RNG = random.Random(3)
GOOD = "\n".join(" ".join("".join(_RNG.choices("abcdefghij", k=6)) for _ in range(9)).capitalize() + "." for _ in range(12))


def test_clean_removes_lines_and_keeps_clean_documents(spark):
    nav = "Home | About | Contact | Login"
    rows = [(1, GOOD, "s", 0), (2, GOOD + "\n" + nav + "\nAll rights reserved.", "s", 0), (3, "\n".join([nav + f" {i}" for i in range(30)]), None, 0), (4, None, "s", 0)]
    out = {r.doc_id: r for r in quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars long")).collect()}
    assert set(out) == {1, 2} and out[1].text == GOOD == out[2].text and out[2].n_chars == len(GOOD)


def test_lost_share():
    _, _, kept, _, n = quality_rules.judge(GOOD, LineRules())
    assert kept and n == 0


def test_exact_dedup(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a  b"), (9, "a\tb "), (1, "x"), (2, None), (7, " "), (None, "q"), (8, "x "), (1, "x")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, digest string")
    out = sorted(exact_dedup.dedup(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in out}
    assert len(out) == len(rows)
    # longest: "a  b" and "a\tb " have 4 code points, so the smaller id of the two stays
    assert got[3] == got[5] == (4, 4, False)
    assert got[4] == (4, 4, True) and got[9] == (4, 4, False)
    assert got[2] == (7, 2, False) and got[7] == (7, 2, True)
    assert got[1] == (1, 2, True) and got[8] == (8, 1, True) and got[None] == (None, 1, True)
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_history_members_are_dropped(spark):
    old = spark.createDataFrame([(100, "a b"), (101, "c")], "doc_id long, text string")
    history = exact_dedup.groups(exact_dedup.digests(old))
    new = spark.createDataFrame([(1, "ab"), (2, "n"), (3, "n ")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(new, history).collect()}
    assert got == {1: (100, 2, False), 2: (3, 2, False), 3: (3, 2, True)}


def test_hash_is_minimal_and_perfect():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 100, 5000):
        h, b = rng.integers(0, 1 << 60, n), rng.integers(0, max(1, n // 4), n)
        seeds = exact_dedup.build_shard(h, b, max(1, n // 4))
        assert sorted(exact_dedup.slot_of(h, seeds[b], n)) == list(range(n))


def test_batches_give_what_one_table_gives(spark):
    r = random.Random(3)
    texts = ["a b", "ab", "a  b", "", None, " \n", "é", "x" * 300_000, "x" * 150_000 + " " + "x" * 150_000]
    rows = [(i, r.choice(texts), "clash") for i in range(60)] + [(100 + i, f"once {i}", "clash") for i in range(20)] + [(None, "a b", "clash"), (None, "only here", "clash"), (7, "ab", "clash"), (7, "ab", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = exact_dedup.dedup_in_batches(docs)
    want = exact_dedup.dedup(docs.drop("digest"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert exact_dedup.dedup_in_batches(docs.limit(0)).count() == 0
    # both kinds of lookup occur: of the later batch some are members of the earlier one
    keyed = exact_dedup.digests(docs)
    index = exact_dedup.build_index(exact_dedup.groups(keyed.where(exact_dedup.arrived_earlier())))
    late = exact_dedup.lookup(exact_dedup.groups(keyed.where(~exact_dedup.arrived_earlier())).select("digest"), index)
    assert {x.member for x in late.collect()} == {True, False}
