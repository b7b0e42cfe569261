"""Personal data: detection, and replacement by keyed surrogates.

Found are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment card numbers, IBANs whose check digits are right, US social security
numbers, secrets assigned to a name (token = "…") or of a known prefix, and names after a title. A name's words are then replaced wherever they stand in that
document, titled or not. A surrogate is the image of the entity under a keyed permutation of the strings of its form: digits go to
digits, vowels to vowels and consonants to consonants of their case and script (however few), so that a name can be said and ends as it did; punctuation
and layout stay, top-level domains and prefixes of keys stay, a card keeps whether its check digit is right, an IBAN its country and right check digits, and a listed
given name is exchanged within its gender, whatever the title. Other words never go to a listed name, nor keys that aren't hexadecimal to ones that are:
maps that share a form are one permutation. So different entities don't collide and an entity has one surrogate in all documents (upper and lower
case, and other layouts of the same number, included); :func:`collisions` checks both on what was found. Row-wise: one scan, no exchange; only
the check of a whole table exchanges its distinct entities.

Defined results: null text counts as empty; null ids and repeated rows are passed through; of overlapping finds the first to start counts, then the kind named first; texts of any length are
read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

KINDS = ("email", "secret", "phone", "ip", "card", "iban", "ssn", "name")

# What each kind looks like. Searches begin with something rare and look around it, so that plain prose is passed over quickly.
_LOCAL = re.compile(r"[\w.%+-]")
_DOMAIN = re.compile(r"(?:[\w-]+\.)+[^\W\d_]{2,24}(?!\w)")
_ASSIGNED = re.compile(r"""[=:]\s{0,3}["']?([A-Za-z0-9_+/-]{16,}={0,2})""")
_KEYWORD = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}\Z", re.I)
_PREFIXED = re.compile(r"(?:sk|pk|rk)[-_](?:(?:live|test|proj)[-_])?([A-Za-z0-9]{16,})|AKIA([0-9A-Z]{16})(?![0-9A-Z])|gh[pousr]_([A-Za-z0-9]{20,})")
_PREFIXES = ("sk-", "sk_", "pk-", "pk_", "rk-", "rk_", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_NUMBERS = re.compile(r"[+(\d][\d ().+-]*")
_NUMBER = {
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?![\w])|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-])|(?<![\w+.-])[2-9]\d{2}[2-9]\d{6}(?![\w-]|\.\d)"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d|\w)"),
    "card": re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
}
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Titles that names follow.
_TITLES = ("Mrs.", "Mr.", "Ms.", "Dr.", "Prof.", "Miss", "Sir", "Lady", "Herr", "Frau", "Monsieur", "Madame", "Señora", "Señor", "Господин", "Госпожа")
_NAMED = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, _TITLES))})\s(?P<name>[^\W\d_a-z][^\W\d_]+(?:[ \u00a0][^\W\d_a-z][^\W\d_]+)?)")
_MALE = "Adam Albert Alan Boris Carl Daniel David Edward Emil Felix Frank George Hans Henry Hugo Jack James Jean John Karl Leo Louis Luis Marco Mark Martin Michael Miguel Oliver Oscar Otto Paul Pedro Peter Pierre Ralph Robert Simon Thomas Victor William".split()
_FEMALE = "Alice Amelia Anna Bella Carla Carmen Clara Diana Elena Emily Emma Eva Flora Grace Greta Hanna Helen Irene Ivy Jane Julia Karen Laura Lena Lucia Maria Marie Martha Mary Nina Nora Olga Paula Rosa Ruth Sara Sofia Sophie Susan Vera".split()
_GIVEN = {x.lower(): (names, i) for names in (_MALE, _FEMALE) for i, x in enumerate(names)}
#: Alphabets of digits and common letters; those of other letters go by script, see :func:`alphabet`.
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
_VOWELS = set("aeiouàáâãäåæèéêëìíîïòóôõöøùúûüаеиоуыэюяαεηιουω")
#: What a character is exchanged within: the vowels, or the rest, of its alphabet.
_OF = {c: "".join(x for x in a if (x in _VOWELS) == (c in _VOWELS)) for a in _ALPHABETS for c in a}


@cache
def _scripts() -> dict[str, str]:
    """Alphabet of every letter and digit that _ALPHABETS has not: the lower-case or caseless ones of its script, category and case.

    A script is the first word of a character's name. Letters alone of their kind go to one alphabet of their own, so that none stays as it is.
    """
    kinds: dict[tuple, list[str]] = {}
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c in _OF or not (c.isalpha() or c.isdecimal() or c.isnumeric()):
            continue
        if len(c.lower()) == 1 and c.lower() != c and c.lower().upper() == c:
            continue  # is written as its lower case
        cased = len(c.upper()) == 1 and c.upper().lower() == c and c.upper() != c
        kinds.setdefault((unicodedata.name(c, "x").split()[0].split("-")[0], unicodedata.category(c), cased), []).append(c)
    few = "".join(c for k in kinds.values() if len(k) == 1 for c in k)
    return {c: a for k in [*kinds.values(), list(few)] if len(k) > 1 for a in ["".join(k)] for c in a}


def alphabet(c: str) -> str | None:
    """The alphabet of a lower-case or caseless character; None if it is neither a letter nor a digit."""
    return _OF.get(c) or (None if c.isascii() else _scripts().get(c))


def lower(c: str) -> str:
    """Lower case where upper case brings the character back."""
    x = c.lower()
    return x if len(x) == 1 and x.upper() == c else c


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int
    value: str
    surrogate: str


def _round(key: bytes, tweak: bytes, i: int, x: int, size: int) -> int:
    d = hashlib.blake2b(i.to_bytes(1, "big") + x.to_bytes(-(-size // 8) or 1, "big") + tweak, key=key, digest_size=64).digest()
    out = int.from_bytes(d, "big")
    while out.bit_length() < size:
        d = hashlib.blake2b(d, key=key, digest_size=64).digest()
        out = out << 512 | int.from_bytes(d, "big")
    return out & ((1 << size) - 1)


def permute(n: int, modulus: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(modulus): a balanced Feistel network, walked until it is back in range."""
    half = max(1, -(-(modulus - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = n >> half, n & mask
        for i in range(8):
            left, right = right, left ^ _round(key, tweak, i, right, half)
        n = left << half | right
        if n < modulus:
            return n


def _exchange(text: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """Text over the given alphabets, one for each character, permuted among all such texts; where these are few enough to matter, none goes to itself."""
    n, m = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        n, m = n * len(a) + a.index(c), m * len(a)
    t = f"{tweak}|{'|'.join(a if len(a) < 64 else a[:8] + str(len(a)) for a in alphabets)}".encode()
    n = _moved(n, m, key, t) if m < 1 << 32 else permute(n, m, key, t)
    out = []
    for a in reversed(alphabets):
        n, k = divmod(n, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _moved(n: int, modulus: int, key: bytes, tweak: bytes) -> int:
    """A permutation without fixed points: a step of 1 to modulus - 1 round the ring, seen through a keyed permutation."""
    step = 1 + int.from_bytes(hashlib.blake2b(b"step" + tweak, key=key, digest_size=16).digest(), "big") % (modulus - 1)
    at = permute(n, modulus, key, tweak)
    return _back((at + step) % modulus, modulus, key, tweak)


def _back(n: int, modulus: int, key: bytes, tweak: bytes) -> int:
    """Inverse of :func:`permute`."""
    half = max(1, -(-(modulus - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = n >> half, n & mask
        for i in reversed(range(8)):
            left, right = right ^ _round(key, tweak, i, left, half), left
        n = left << half | right
        if n < modulus:
            return n


def form_preserving(value: str, key: bytes, tweak: str, digits_only: bool = False) -> str:
    """Letters and digits exchanged within their alphabets, case and all others as they were."""
    low = [lower(c) for c in value]
    of = [alphabet(c) for c in low]
    at = [i for i, a in enumerate(of) if a and (not digits_only or a == _ALPHABETS[0])]
    if not at:
        return value
    # what stays is part of the form, unless only digits count: then layouts of one number agree
    form = "" if digits_only else "".join("x" if a else c for a, c in zip(of, low, strict=True))
    new = _exchange("".join(low[i] for i in at), [of[i] for i in at], key, f"{tweak}|{form}")
    out = list(value)
    for i, c in zip(at, new, strict=True):
        out[i] = c.upper() if value[i] != low[i] else c
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit of these digits."""
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _relaid(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def name_word(word: str, key: bytes) -> str:
    """A word of a name: a listed given name within its gender; another one by a permutation of its form, walked past the listed names.

    A last letter that is a vowel stays, as it often tells the gender; single and double letters go whole.
    """
    low = word.lower()
    if low in _GIVEN:
        names, i = _GIVEN[low]
        new = names[_moved(i, len(names), key, f"given|{names[0]}".encode())]
        return new.upper() if word.isupper() and len(word) > 1 else new.lower() if word.islower() else new
    keep = len(word) if len(word) < 3 or low[-1] not in _VOWELS else len(word) - 1
    new = word
    while True:
        new = form_preserving(new[:keep], key, f"name|{low[keep:]}") + word[keep:]
        if new.lower() not in _GIVEN:
            return new


def _name(value: str, key: bytes) -> str:
    return "".join(name_word(x, key) if x.strip() else x for x in re.split(r"(\s)", value))


def _iban_check(country: str, rest: str) -> int:
    """The two check digits of an account's letters and digits."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def _compact(value: str) -> str:
    return "".join(c for c in value if c.isalnum()).upper()


def canonical(kind: str, v: str) -> str:
    """What an entity is, apart from case and layout."""
    if kind == "ip":
        return str(_address(v)) if ":" in v else ".".join(str(int(x)) for x in v.split("."))
    if kind == "iban":
        return _compact(v)
    return "".join(c for c in v if c.isdigit()) if kind in ("phone", "card", "ssn") else v.lower()


def _address(v: str) -> ipaddress.IPv6Address | None:
    try:
        return ipaddress.IPv6Address(v)
    except ValueError:
        return None


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def surrogate(kind: str, value: str, key: bytes, title: str = "") -> str:
    """The surrogate of an entity. That of a name is the same under any title, and without one."""
    if kind == "ip" and ":" in value:
        n = permute(int(_address(value)), 1 << 128, key, b"ipv6")
        return str(ipaddress.IPv6Address(n)) if "::" in value else ":".join(f"{n >> s & 0xFFFF:x}" for s in range(112, -1, -16))
    if kind == "ip":
        n = 0
        for x in value.split("."):
            n = n * 256 + int(x)
        n = permute(n, 1 << 32, key, b"ip")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        d = "".join(c for c in value if c.isdigit())
        off = (int(d[-1]) - luhn(d[:-1])) % 10
        new = _exchange(d[:-1], [_ALPHABETS[0]] * (len(d) - 1), key, f"card|{off}")
        return _relaid(value, new + str((luhn(new) + off) % 10))
    if kind == "iban":
        v = _compact(value)
        rest = v[4:].lower()
        new = _exchange(rest, [_ALPHABETS[0] if c.isdigit() else _ALPHABETS[1] for c in rest], key, f"iban|{v[:2]}").upper()
        it = iter(f"{v[:2]}{_iban_check(v[:2], new):02d}{new}")
        return "".join(next(it) if c.isalnum() else c for c in value)
    if kind == "secret":
        if _HEX.fullmatch(value):
            new = _exchange(value.lower(), ["0123456789abcdef"] * len(value), key, "hex")
            return new.upper() if re.search("[A-F]", value) else new
        new = value
        while True:
            new = form_preserving(new, key, kind)
            # what isn't hexadecimal never becomes so
            if not _HEX.fullmatch(new):
                return new
    if kind == "name":
        return _name(value, key)
    if kind == "email":
        head, top = value.rsplit(".", 1)
        return f"{form_preserving(head, key, f'email|{top.lower()}')}.{top}"
    return form_preserving(value, key, kind, digits_only=kind in ("phone", "ssn"))


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    at = text.find("@")
    while at >= 0:
        start = at
        while start and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
        at = text.find("@", at + 1)


def _secrets(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ASSIGNED.finditer(text):
        if _KEYWORD.search(text[max(0, m.start() - 24) : m.start()]):
            yield m.start(1), m.end(1), "secret"
    if any(p in text for p in _PREFIXES):
        for m in _PREFIXED.finditer(text):
            if not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
                yield m.start(m.lastindex), m.end(m.lastindex), "secret"


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for chunk in _NUMBERS.finditer(text):
        p, end = chunk.span()
        if end - p < 7:
            continue
        while p < end - 6:
            c = text[p]
            if (c.isdigit() and not (p and text[p - 1].isdigit())) or c in "+(":
                found = next(((m.end(), kind) for kind, pattern in _NUMBER.items() if (m := pattern.match(text, p))), None)
                if found:
                    yield p, found[0], found[1]
                    p = found[0]
                    continue
            p += 1
    if _COLONS.search(text):
        for m in _IPV6.finditer(text):
            groups = [x for x in m.group().split(":") if x]
            if len(groups) > 2 and any(c.isdigit() for c in m.group()) and _address(m.group()):
                yield m.start(), m.end(), "ip"


def _ibans(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _IBAN.finditer(text):
        v = _compact(m.group())
        if not (m.start() and text[m.start() - 1].isalnum()) and len(v) >= 15 and int(v[2:4]) == _iban_check(v[:2], v[4:]):
            yield m.start(), m.end(), "iban"


def _names(text: str) -> Iterator[tuple[int, int, str]]:
    if any(t in text for t in _TITLES):
        for m in _NAMED.finditer(text):
            yield m.start("name"), m.end("name"), "name"


def find(text: str, key: bytes) -> list[Found]:
    """Entities in order, with their surrogates; words of titled names also where they stand alone."""
    spans = sorted([*_emails(text), *_secrets(text), *_numbers(text), *_ibans(text), *_names(text)], key=lambda s: (s[0], KINDS.index(s[2]), -s[1]))
    kept: list[tuple[int, int, str]] = []
    for s in spans:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    words = {w for s, e, kind in kept if kind == "name" for w in text[s:e].split() if len(w) > 1}
    if words:
        own = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})(?!\w)")
        starts, ends = [s for s, _, _ in kept], [e for _, e, _ in kept]
        for m in own.finditer(text):
            i = bisect.bisect_right(starts, m.start())
            if not (i and ends[i - 1] > m.start()) and not (i < len(starts) and starts[i] < m.end()):
                kept.append((m.start(), m.end(), "name"))
        kept.sort()
    memo: dict[tuple[str, str], str] = {}
    out = []
    for s, e, kind in kept:
        v = text[s:e]
        if (kind, v) not in memo:
            memo[kind, v] = surrogate(kind, v, key)
        out.append(Found(kind, s, e, v, memo[kind, v]))
    return out


def replace(text: str, key: bytes) -> tuple[str, list[Found]]:
    found = find(text, key)
    if not found:
        return text, found
    parts, at = [], 0
    for f in found:
        parts += text[at : f.start], f.surrogate
        at = f.end
    return "".join(parts) + text[at:], found


def _digest(kind: str, v: str, key: bytes) -> bytes:
    return hashlib.blake2b(f"{kind}|{canonical(kind, v)}".encode("utf-8", "surrogatepass"), key=key, digest_size=16, person=b"same entity").digest()


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, entities): the text with surrogates, and (kind, start, end, surrogate, identity, image) of what was replaced, in the original's places.

    ``identity`` and ``image`` are keyed digests of the entity and of its surrogate, apart from case and layout: enough to check for collisions, and nothing else.
    """
    schema = "doc_id long, text string, entities array<struct<kind: string, start: long, end: long, surrogate: string, identity: binary, image: binary>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string()), ("identity", pa.binary()), ("image", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = [], []
            for t in b.column(1):
                new, f = replace(t.as_py(), key)
                texts.append(new)
                found.append([{"kind": x.kind, "start": x.start, "end": x.end, "surrogate": x.surrogate, "identity": _digest(x.kind, x.value, key), "image": _digest(x.kind, x.surrogate, key)} for x in f])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(found, kind)], names=["doc_id", "text", "entities"])

    return tidy(docs, id_col, text_col).mapInArrow(run, schema)


def found_in(out: DataFrame) -> DataFrame:
    """(kind, identity, surrogate_identity), as :func:`collisions` takes them, of what :func:`pseudonymise` returned."""
    return out.select(F.explode("entities").alias("e")).select("e.kind", F.col("e.identity").alias("identity"), F.col("e.image").alias("surrogate_identity"))


def entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, identity, surrogate_identity) of every entity found: what it is apart from case and layout. Sensitive: holds the originals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [x for t in b.column(1) for x in find(t.as_py(), key)]
            yield pa.RecordBatch.from_arrays([pa.array([x.kind for x in f], pa.string()), pa.array([canonical(x.kind, x.value) for x in f], pa.string()), pa.array([canonical(x.kind, x.surrogate) for x in f], pa.string())], names=["kind", "identity", "surrogate_identity"])

    return tidy(docs, id_col, text_col).mapInArrow(run, "kind string, identity string, surrogate_identity string")


def collisions(found: DataFrame) -> DataFrame:
    """(kind, problem, value): surrogates of two entities, and entities of two surrogates. Empty if all is well."""
    distinct = found.distinct()
    two = distinct.groupBy("kind", F.col("surrogate_identity").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select("kind", F.lit("shared").alias("problem"), "value")
    split = distinct.groupBy("kind", F.col("identity").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select("kind", F.lit("split").alias("problem"), "value")
    return two.unionByName(split)
