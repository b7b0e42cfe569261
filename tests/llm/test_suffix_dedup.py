import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from helixframe.llm import suffix_dedup as sd
from helixframe.llm.suffix_dedup import RepeatParams


def brute(rows, length, mode):
    texts = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    where = defaultdict(list)
    for i in order:
        for p in range(len(texts[i]) - length + 1):
            where[texts[i][p : p + length]].append((i, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, p in places if mode == "all" else places[1:]:
                gone[i][p : p + length] = True
    return sorted((repr(rows[i][0]), len(t), int(g.sum()), len(sd.runs(g)[0]), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()) for i, (t, g) in enumerate(zip(texts, gone, strict=True)))


def rows():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdeé", k=r.randrange(2, 8)))
    passage = [" ".join(word() for _ in range(n)) for n in (12, 20, 60)]
    out = []
    for d in range(60):
        parts = [word() for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(0, 3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passage))
        out.append((d, " ".join(parts)))
    out += [(100, out[3][1]), (101, out[3][1]), (102, "ab" * 300), (103, "x" * 150), (104, "x" * 49), (105, None), (106, ""), (None, out[5][1] + " tail"), (107, out[7][1][5:] + out[8][1]), (108, "long " + " ".join(word() for _ in range(9000)) + passage[2] * 2)]
    return out


@pytest.mark.parametrize("mode", ["all", "later"])
@pytest.mark.parametrize("hot", [1000, 2])
def test_against_brute_force(spark, monkeypatch, mode, hot):
    monkeypatch.setattr(sd, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(sd, "GROUP_BYTES", 3000)
    data = rows()
    docs = spark.createDataFrame([(*x, "key") for x in data], "doc_id long, text string, key string")
    out = sd.remove_repeats(docs, RepeatParams(50, 25, mode)).collect()
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out)
    assert got == brute(data, 50, mode)


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_previous_factors():
    r = np.random.default_rng(2)
    text = r.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(391)
    earlier, later = sd.repeated(text, starts, 10)
    raw = text.tobytes()
    for i in starts:
        assert earlier[i] == (raw.find(raw[i : i + 10]) < i)
        assert later[i] == (raw.find(raw[i : i + 10], i + 1) > 0)


def test_sliding_min():
    v = np.random.default_rng(1).integers(0, 50, 97).astype(np.uint64)
    assert sd.sliding_min(v, 7).tolist() == [v[i : i + 7].min() for i in range(91)]
