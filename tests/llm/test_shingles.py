from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import minhash

TEXT = st.text(st.sampled_from("aAbÀé  \t\n\x0b\x1c😀"), max_size=60)


def sequences(text: str, k: int) -> set[tuple[bytes, ...]]:
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, st.integers(1, 5))
def test_hashes_stand_for_sequences_of_words(x, y, k):
    a, b = minhash.shingles(x, k).tolist(), minhash.shingles(y, k).tolist()
    assert a == sorted(set(a)) and len(a) == len(sequences(x, k))
    assert len(set(a) & set(b)) == len(sequences(x, k) & sequences(y, k))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_blocks_do_not_matter(x):
    whole, before = minhash.shingles(x, 3).tolist(), minhash.BLOCK
    try:
        minhash.BLOCK = 3
        assert minhash.shingles(x, 3).tolist() == whole
    finally:
        minhash.BLOCK = before


def test_different_words_have_different_hashes():
    words = [f"{a}{b}" for a in range(300) for b in "xyz"] + ["q" * n for n in range(1, 300)]
    h = minhash.word_hashes(" ".join(words).encode()).tolist()
    assert len(h) == len(words) and max(Counter(h).values()) == max(Counter(words).values())
