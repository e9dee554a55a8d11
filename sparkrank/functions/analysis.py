"""Text analysis: words, normalisers, stems, sentences.

The plain way - white space, lower case - is one SQL expression. Stems, full case folding and
Unicode word bounds run as Arrow functions, stems over distinct terms only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrank.errors import require

#: The characters of Unicode's White_Space, as a class of a Java regular expression.
WHITE_SPACE = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: A longer run is cut into words of so many UTF-16 units.
LONGEST_WORD = 255
#: Documents whose stems are counted at a time.
STEM_ROWS = 1024
_WORD = re.compile(r"[^\W_](?:[\w]|(?<=[^\W\d_])['\u2019.\u00B7:](?=[^\W\d_])|(?<=\d)[.,;'](?=\d))*|[\u2600-\u27BF\U0001F300-\U0001FAFF]")
_INVISIBLE = re.compile("[\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF]")


@dataclass(frozen=True)
class Analysis:
    """How a text becomes terms. Normalisers run in the order of the fields."""

    words: str = "whitespace"
    strip_invisible: bool = False
    fold_accents: bool = False
    fold_case: bool = True
    stem: bool = False


#: Presets by name.
INGEST, FOLDED, CASED, STEMMED = Analysis(), Analysis(fold_accents=True, strip_invisible=True), Analysis(fold_case=False), Analysis(stem=True)


def words(text: Column, analysis: Analysis = INGEST) -> Column:
    """The words of a text in order, before empties go: a word that normalisation empties keeps its position."""
    require(analysis.words in ("whitespace", "unicode"), f"words by {analysis.words}")
    if analysis.words == "unicode":
        return _unicode_words(text)
    return F.filter(F.split(text, WHITE_SPACE), lambda w: w != "")


def terms(text: Column, analysis: Analysis = INGEST) -> Column:
    """Normalised words in order, those that became empty still among them."""
    if analysis.strip_invisible or analysis.fold_accents:
        return _normalised(words(text, analysis), F.lit(analysis.strip_invisible), F.lit(analysis.fold_accents), F.lit(analysis.fold_case))
    if is_plain(analysis):
        return words(F.lower(text) if analysis.fold_case else text, analysis)
    return F.transform(words(text, analysis), lambda w: F.lower(w)) if analysis.fold_case else words(text, analysis)


def is_plain(analysis: Analysis) -> bool:
    """Whether terms are cut at white space alone, so that a text's case can be folded before."""
    return analysis.words == "whitespace" and not (analysis.strip_invisible or analysis.fold_accents)


def spaced(text: Column, analysis: Analysis = INGEST) -> Column:
    """A text as one string, a blank on both sides of each term: " a  b ". What is found in it by a string search is found as terms."""
    require(is_plain(analysis), "terms that white space alone does not cut")
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text) if analysis.fold_case else text, WHITE_SPACE, "  "), F.lit(" "))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unicode_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicode_words(t))


def unicode_words(text: str) -> list[str]:
    """Words by an approximation of Unicode's word boundaries: letters and digits, joined by the marks that stand inside words."""
    out = []
    for w in _WORD.findall(text):
        while len(w.encode("utf-16-le")) // 2 > LONGEST_WORD:
            head = w[:LONGEST_WORD]
            out.append(head)
            w = w[len(head) :]
        out.append(w)
    return out


def normalise(word: str, strip: bool, accents: bool, case: bool) -> str:
    if strip:
        word = _INVISIBLE.sub("", word)
    if accents:
        word = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)))
    return word.casefold() if case else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _normalised(lists: pd.Series, strip: pd.Series, accents: pd.Series, case: pd.Series) -> pd.Series:
    how = bool(strip.iloc[0]), bool(accents.iloc[0]), bool(case.iloc[0])
    return lists.map(lambda ws: None if ws is None else [normalise(w, *how) for w in ws])


_VOWELS = set("aeiou")


def _is_consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _is_consonant(w, i - 1)


def _measure(w: str) -> int:
    shape = "".join("c" if _is_consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(not _is_consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _is_consonant(w, len(w) - 3) and not _is_consonant(w, len(w) - 2) and _is_consonant(w, len(w) - 1) and w[-1] not in "wxy"


#: The endings of steps 2, 3 and 4 of Porter's algorithm of 1980.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(word: str) -> str:
    """The classic Porter stem of a lower-case word. Whatever is no vowel counts as a consonant, digits and other letters too."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        ending = next((e for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if ending:
            w = w[: -len(ending)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for listed in (STEP_2, STEP_3):
        found = max((x for x in listed if w.endswith(x[0])), key=lambda x: len(x[0]), default=None)
        if found and _measure(w[: -len(found[0])]) > 0:
            w = w[: -len(found[0])] + found[1]
    ending = max((e for e in STEP_4 if w.endswith(e)), key=len, default=None)
    if ending:
        stem = w[: -len(ending)]
        if _measure(stem) > 1 and (ending != "ion" or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else porter(t))


def stemmed(rows: DataFrame, term: str = "term") -> DataFrame:
    """Replace terms by their stems; each distinct term is stemmed once and joined back."""
    known = rows.select(term).distinct().withColumn("stem", stem(F.col(term)))
    return rows.join(known, term).drop(term).withColumnRenamed("stem", term)


@lru_cache(1 << 17)
def _known_stem(word: str) -> str:
    return porter(word)


def stem_documents(lists: DataFrame) -> DataFrame:
    """(term, df) of rows with one column, a document's distinct terms: stems and the documents that hold them, a row per stem and batch, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEM_ROWS):
                own = batch.column(0).slice(at, STEM_ROWS)
                coded = own.flatten().dictionary_encode()
                stems = pa.array([_known_stem(t) for t in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
                code = stems.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64)
                n, doc = len(stems.dictionary), np.repeat(np.arange(len(own)), pc.list_value_length(own).fill_null(0).to_numpy())
                # two terms of a document may have one stem
                df = np.bincount(np.unique(doc * n + code) % max(n, 1), minlength=n)
                yield pa.RecordBatch.from_arrays([stems.dictionary, pa.array(df, pa.int64())], names=["term", "df"])

    return lists.mapInArrow(run, "term string, df long")


def sentences(text: Column) -> Column:
    """One sentence per line that is not blank, trimmed."""
    lines = F.split(text, "\r\n|\r|\n")
    trimmed = F.transform(lines, lambda s: F.regexp_replace(s, f"^{WHITE_SPACE}|{WHITE_SPACE}$", ""))
    return F.filter(trimmed, lambda s: s != "")
