"""Token ids of whole texts as the ``tokenizers`` library gives them, by cheaper routes where those are exact.

Both encoders are made once per Python worker and hold a bounded table; anything outside the characters for which the
short route is proven equal goes to the library itself.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np

#: Entries that a worker keeps of its word table.
TABLE_WORDS = 300_000

_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*\Z")
_PLAIN_CHUNK = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
_LOWER_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(4)
def version_digest(path: str) -> str:
    """Digest of a tokenizer file: what identifies its version in the cache of counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ByteCounter:
    """Number of tokens of a text for a byte-level BPE file."""

    def __init__(self, path: str):
        self.full = _library(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranks(spec)

    def _ranks(self, spec: dict):
        """A rank-based encoder of the same vocabulary, only if ids follow the order of merges and the split is the usual one."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        ok = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model["type"] == "BPE"
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab = model["vocab"]
        if not ok or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        back = {c: b for b, c in _byte_chars().items()}
        skip = set(self.special)
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in skip}
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        if self.fast is None or not _PLAIN.match(text) or any(s in text for s in self.special):
            return len(self.full.encode(text, add_special_tokens=False).ids)
        return len(self.fast.encode_ordinary(text))


class ChunkTable(dict):
    """Ids, as little-endian 32-bit numbers, of the text between two blanks, for a tokenizer that drops blanks.

    Blanks end a piece in such a tokenizer and its normaliser never acts across one, so the ids of a text are those of its
    chunks in a row. Cleared when it holds ``limit`` chunks.
    """

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        super().__init__()
        self.full, self.limit = _library(path), limit
        self.model = self.full.model
        self.chars = _byte_chars()
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN_CHUNK.match(chunk) and "<|" not in chunk:
            ids = b"".join([self.piece(p) for p in _LOWER_PIECE.findall(chunk.lower())])
        else:
            ids = np.asarray(self.full.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = ids
        return ids

    def piece(self, p: str) -> bytes:
        if (ids := self.pieces.get(p)) is None:
            mapped = p if p.isascii() else "".join([self.chars[b] for b in p.encode()])
            ids = np.asarray([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(self.pieces) >= self.limit // 2:
                self.pieces.clear()
            self.pieces[p] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(2)
def byte_counter(path: str) -> ByteCounter:
    return ByteCounter(path)


@functools.lru_cache(2)
def chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)
