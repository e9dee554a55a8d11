"""Highlights: the sentences or windows of a hit that hold the query's terms best.

Arrow functions, meant for the rows of an answer, after selection.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrank.errors import require

#: Snippets and characters by default, and their bounds.
SNIPPETS, MOST_SNIPPETS, CHARS, LEAST_CHARS, MOST_CHARS = 3, 64, 300, 16, 4096


def _found(text: str, terms: set[str]) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\S+", text) if m[0].lower() in terms]


def sentence_snippets(text: str, terms: set[str], snippets: int = SNIPPETS, chars: int = CHARS) -> list[str]:
    """The best lines - most distinct terms, then most terms, then first - cut to size, in the text's order."""
    ranked = []
    for i, m in enumerate(re.finditer(r"[^\r\n]+", text)):
        line = m[0].strip()
        found = _found(line, terms)
        if found:
            ranked.append((-len({t for *_, t in found}), -len(found), i, line))
    return [line[:chars] for *_, line in sorted(sorted(ranked)[:snippets], key=lambda r: r[2])]


def window_snippets(text: str, terms: set[str], snippets: int = SNIPPETS, chars: int = CHARS) -> list[str]:
    """Windows around clusters of terms, a third of the room before them, on word bounds; overlapping ones are merged."""
    clusters: list[list[tuple[int, int, str]]] = []
    for f in _found(text, terms):
        if clusters and f[1] - clusters[-1][0][0] <= chars:
            clusters[-1].append(f)
        else:
            clusters.append([f])
    best = sorted(sorted(clusters, key=lambda c: (-len({t for *_, t in c}), -len(c), c[0][0]))[:snippets], key=lambda c: c[0][0])
    spans: list[list[int]] = []
    for c in best:
        room = max(0, chars - (c[-1][1] - c[0][0]))
        start = max(0, c[0][0] - room // 3)
        end = min(len(text), start + max(chars, c[-1][1] - start))
        while 0 < start < c[0][0] and not text[start - 1].isspace():
            start += 1
        while c[-1][1] < end < len(text) and not text[end].isspace():
            end -= 1
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    return [text[a:b].strip() for a, b in spans]


def highlight(text: Column, terms: Iterable[str], mode: str = "sentence", snippets: int = SNIPPETS, chars: int = CHARS) -> Column:
    """array<string> of snippets."""
    require(mode in ("sentence", "window"), f"the mode {mode}")
    require(1 <= snippets <= MOST_SNIPPETS and LEAST_CHARS <= chars <= MOST_CHARS, f"{snippets} snippets of {chars} characters")
    wanted, cut = {t.lower() for t in terms}, sentence_snippets if mode == "sentence" else window_snippets

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or "", wanted, snippets, chars))

    return run(text)
