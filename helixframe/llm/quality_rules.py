"""Quality rules: line-first cleaning.

Each line is judged by itself (terminal punctuation, navigation, boilerplate, repeats); lines that fail
are removed, and a document is rejected when it then has lost too much of its text. Both decisions are
row-wise, so the plan is one scan with no exchange.

Defined results: a null text counts as empty; an empty text has zero counts, fails the base rule (fewer
than ``min_words`` words) and is not kept; a null doc_id is passed through; repeated rows are judged alike;
other columns are carried by :func:`clean` and ignored by :func:`measure`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BLANK_BYTES, tidy


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules. A document is rejected by lines only when the lines removed hold more than
    ``max_lost`` of its word characters."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    max_lost: float = 0.5
    max_symbol_share: float = 0.1
    max_junk_words: float = 0.5
    max_bullet_words: int = 4
    min_copies: int = 3


NAV = re.compile(r"^\s*(?:home|about(?: us)?|contact(?: us)?|sign (?:in|up)|log ?(?:in|out)|menu|search|next|previous|back to top|read more|share|subscribe|skip to content|privacy policy|terms of (?:use|service))\s*$", re.I)
NAV_SEP = re.compile(r"\s(?:\||»|›|>|·|•)\s")
BOILER = re.compile(r"all rights reserved|cookies? (?:policy|settings)|enable javascript|javascript is (?:disabled|required)|terms of (?:use|service)|privacy policy|lorem ipsum|click here|licen[sc]ed under|released under the", re.I)
TERMINAL = ".!?:;\"'”’)]…»"


def line_fails(line: str, copies: int, rules: LineRules) -> str | None:
    """The rule a non-blank line fails, or None. ``copies``: how often it stands in its document."""
    if copies > rules.min_copies:
        return "repeated"
    if BOILER.search(line):
        return "boilerplate"
    if NAV.match(line) or len(NAV_SEP.findall(line)) >= 3:
        return "navigation"
    body = line.strip()
    if "{" in body and body.endswith(("{", "}", ";")):
        return "code"
    words = body.split()
    sym = sum(body.count(c) for c in "#*$%&|<>")
    if sym > rules.max_symbol_share * len(body):
        return "symbols"
    if body[-1] not in TERMINAL and len(words) <= rules.max_bullet_words:
        return "punctuation"
    return None


def clean_text(text: str, rules: LineRules) -> tuple[str, dict[str, int], int, int]:
    """The text without failing lines, lines removed by rule, and word bytes before and after."""
    lines = text.split("\n")
    copies = Counter(lines) if len(lines) > 1 else {text: 1}
    kept, why, before, after = [], Counter(), 0, 0
    seen: set[str] = set()
    for line in lines:
        n = len(line.encode("utf-8", "surrogatepass").translate(None, BLANK_BYTES))
        before += n
        if not n:
            kept.append(line)
            continue
        # of a line repeated often the first one stays
        reason = line_fails(line, copies[line] if line in seen else 1, rules)
        seen.add(line)
        if reason:
            why[reason] += 1
        else:
            after += n
            kept.append(line)
    return "\n".join(kept), dict(why), before, after


def counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    w = raw.split()
    n = len(w)
    n_blank = len(raw) - len(raw.translate(None, BLANK_BYTES))
    symbols = sum(map(raw.count, b"#*$%&|<>"))
    dup = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x.strip(BLANK_BYTES)]
        dup = len(lines) - len(set(lines))
    rep = 0
    if n > 2:
        tri = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(tri)) < len(tri):
            c = Counter(tri)
            end = 0
            for i, t in enumerate(tri):
                if c[t] > 1:
                    rep += i + 3 - max(i, end)
                    end = i + 3
    return n, len(text) - n_blank, symbols, dup, rep


def judge(text: str, rules: LineRules) -> tuple[tuple[int, int, int, int, int], bool, bool, str, int]:
    """Counts, whether the base rule fails, whether the document is kept, its cleaned text, lines removed."""
    c = counts(text)
    base = c[0] < rules.min_words or c[4] > rules.max_repeat_share * c[0]
    if base:
        return c, True, False, text, 0
    cleaned, why, before, after = clean_text(text, rules)
    lost = before - after
    return c, False, lost <= rules.max_lost * before, cleaned, sum(why.values())


OUT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("n_lines_removed", T.LongType())]
)


def measure(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base rule, verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for t in b.column(1):
                c, base, kept, _, removed = judge(t.as_py(), rules)
                for k, v in enumerate((*c, base, kept, removed)):
                    cols[k].append(v)
            arrays = [b.column(0)] + [pa.array(x, pa.bool_() if k in (5, 6) else pa.int64()) for k, x in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=OUT.names)

    return tidy(docs, id_col, text_col).mapInArrow(run, OUT)


def clean(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The documents that are kept, all their columns, with the cleaned text (and its length, where there is such a column).

    Columns go by place once the text's is found; of several of that name the first is cleaned, the others are carried as they are.
    """
    schema = docs.schema
    at = schema.names.index(text_col)
    n_at = schema.names.index(n_chars_col) if n_chars_col in schema.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, texts = [], []
            for i, t in enumerate(b.column(at)):
                _, _, kept, cleaned, _ = judge(t.as_py() or "", rules)
                if kept:
                    keep.append(i)
                    texts.append(cleaned)
            arrays = [c.take(pa.array(keep, pa.int64())) for c in b.columns]
            arrays[at] = pa.array(texts, b.schema.field(at).type)
            if n_at is not None:
                arrays[n_at] = pa.array([len(t) for t in texts], b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return docs.mapInArrow(run, schema)
