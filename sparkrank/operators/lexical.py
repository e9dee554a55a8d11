"""Lexical retrieval: postings, BM25 in its forms, phrases, expansion and suggestions.

Statistics cover the whole corpus that a reader can see; filters only remove hits. Scores are
summed as doubles, ranked by their 32-bit value and then by doc_id, so that the order of a
shuffle never shows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sparkrank.errors import Refused, require
from sparkrank.functions.analysis import INGEST, Analysis, is_plain, spaced, stem_documents, stemmed, terms
from sparkrank.staging import staged

#: BM25's parameters.
K1, B = 1.2, 0.75
#: Most terms that a prefix may expand to, by default and at all.
PREFIX_CAP, PREFIX_MOST = 128, 1024
#: Terms of texts whose postings are made at a time.
POSTED_TERMS = 1 << 20


def postings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", field: str = "body", analysis: Analysis = INGEST, only: Iterable[str] | None = None) -> DataFrame:
    """(field, term, doc_id, tf, positions, dl): one row per term and document, which is a row of docs.

    A word that normalisation empties keeps its place in the positions and counts for nothing
    else. With `only`, just these terms are exploded: the rest of a text never becomes rows.
    """
    all_terms = terms(F.col(f"`{text}`"), analysis)
    own = docs.select(F.lit(field).alias("field"), F.col(f"`{doc_id}`").alias("doc_id"), all_terms.alias("terms"))
    placed = F.filter(F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("position"))), lambda x: x["term"] != "")
    own = own.select("field", "doc_id", F.size(placed).cast("long").alias("dl"), placed.alias("placed"))
    if only is not None and not analysis.stem:
        own = own.withColumn("placed", F.filter("placed", lambda x: x["term"].isin(list(only))))
    if only is None and not analysis.stem:
        rows = _posted(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), all_terms.alias("terms")))
        return rows.select(F.lit(field).alias("field"), "term", "doc_id", "tf", "positions", "dl")
    if not analysis.stem:
        # a text is one row, so its postings are made in it: sorted by term and position, cut where the term changes
        own = own.withColumn("placed", F.sort_array("placed"))
        starts = F.filter(F.sequence(F.lit(1), F.size("placed")), lambda i: (i == 1) | (F.get("placed", i - 1)["term"] != F.get("placed", i - 2)["term"]))
        own = own.withColumn("starts", F.when(F.size("placed") > 0, starts))  # a filter would be pushed below and cut the text once more
        end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("placed") + 1)
        cut = F.transform("starts", lambda s, k: F.struct(F.get("placed", s - 1)["term"].alias("term"), F.slice("placed", s, end(k) - s)["position"].alias("positions")))
        # outer: Spark gives an inner one a filter on its array, which cuts and sorts the text once more
        rows = own.select("field", "doc_id", "dl", F.inline_outer(cut)).where("term is not null")
        return rows.select("field", "term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions", "dl")
    rows = stemmed(own.select("field", "doc_id", "dl", F.inline("placed")))
    if only is not None:
        rows = rows.where(F.col("term").isin(list(only)))
    # a document's postings stay in its own task until here: the shuffle carries one row per term
    out = rows.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"), F.first("dl").alias("dl"))
    return out.select("field", "term", "doc_id", "tf", "positions", "dl")


def _posted(own: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions, dl) of rows (doc_id, terms): each row's places sorted by term, some POSTED_TERMS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy())
            at = 0
            while at < batch.num_rows:
                past = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTED_TERMS, side="right"))
                part = batch.slice(at, max(past - at, 1))  # a longer document is a part by itself
                at += part.num_rows
                yield _posted_part(part.column(0), part.column(1))

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"term string, doc_id {kind}, tf long, positions array<int>, dl long")


def _posted_part(ids: pa.Array, lists: pa.Array) -> pa.RecordBatch:
    counts = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code, n = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = (np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    if empty.any():  # a word that normalisation empties
        some = ~empty[code]
        code, doc, place = code[some], doc[some], place[some]
    key = doc * n + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    bounds = np.append(starts, len(key))
    owner, dl = key[starts] // n, np.bincount(doc, minlength=len(counts))
    positions = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place[order]))
    columns = [coded.dictionary.take(pa.array(key[starts] % n)), ids.take(pa.array(owner)), pa.array(np.diff(bounds), pa.int64()), positions, pa.array(dl[owner], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "tf", "positions", "dl"])


def field_stats(docs: DataFrame, text: str = "text", analysis: Analysis = INGEST) -> DataFrame:
    """One row: n documents, their total length, avgdl (1 for an empty corpus)."""
    length = F.size(F.filter(terms(F.col(f"`{text}`"), analysis), lambda t: t != ""))
    out = docs.select(F.coalesce(length, F.lit(0)).cast("long").alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    return out.select("n", "total", F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(F.lit(1.0)).alias("avgdl"))


def counted_field_stats(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """As field_stats, from the corpus's term statistics: no text is read again."""
    out = docs.agg(F.count("*").alias("n")).join(stats.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("total")))
    return out.select("n", "total", F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(F.lit(1.0)).alias("avgdl"))


def corpus_terms(docs: DataFrame, text: str = "text", field: str = "body", analysis: Analysis = INGEST) -> DataFrame:
    """(field, term, df, cf) as term_stats, without postings: a task shuffles one row per term, not one per term and document."""
    sorted_terms = F.array_sort(F.filter(terms(F.col(f"`{text}`"), analysis), lambda t: t != ""))
    own = docs.select(sorted_terms.alias("terms"))
    first = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (~F.coalesce(F.get("terms", i - 1).eqNullSafe(t), F.lit(False))).alias("first")))
    rows = own.select(F.inline(first))
    if analysis.stem:
        raise Refused("stems without postings")
    return rows.groupBy("term").agg(F.count_if("first").alias("df"), F.count("*").alias("cf")).select(F.lit(field).alias("field"), "term", "df", "cf")


def matching(docs: DataFrame, query: Iterable[str], text: str = "text", analysis: Analysis = INGEST) -> DataFrame:
    """The rows that hold a term of the query, whole and unscored."""
    wanted = list(dict.fromkeys(query))
    require(len(wanted) > 0, "a query without terms")
    body = F.col(f"`{text}`")
    if is_plain(analysis):
        return docs.where(reduce(lambda a, c: a | c, [F.contains(spaced(body, analysis), F.lit(f" {t} ")) for t in wanted]))
    return docs.where(F.arrays_overlap(terms(body, analysis), F.lit(wanted)))


def term_stats(posted: DataFrame) -> DataFrame:
    """(field, term, df, cf)."""
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _occurrences(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == term)).cast("long")


def bm25(docs: DataFrame, query: Iterable[str] | Mapping[str, float], text: str = "text", analysis: Analysis = INGEST, k1: float = K1, b: float = B, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of the documents that hold a query term. query: terms, or terms with weights.

    Without an index the texts are read once, when this is called: term counts come from one
    expression over a text, the corpus's statistics are observed on the way, and the counts of
    the documents that hold a term are written down, from which the scores are computed.
    """
    weights = dict(query) if isinstance(query, Mapping) else {t: 1.0 for t in dict.fromkeys(query)}
    require(len(weights) > 0, "a query without terms")
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.filter(terms(F.col(f"`{text}`"), analysis), lambda t: t != "").alias("terms"))
    counts = [_occurrences("terms", t).alias(f"tf{i}") for i, t in enumerate(weights)]
    own = own.select("doc_id", F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("dl"), *counts)
    hits = [F.col(f"tf{i}") > 0 for i in range(len(weights))]
    seen = Observation()
    own = own.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), *[F.count_if(h).alias(f"df{i}") for i, h in enumerate(hits)])
    own = staged(own.where(reduce(lambda a, c: a | c, hits)), "bm25")
    stats = seen.get
    n, avgdl = stats["n"], (stats["total"] / stats["n"] if stats["total"] else 1.0)
    parts = [F.when(h, w * idf(F.lit(n), F.lit(stats[f"df{i}"])) * tf_norm(F.col(f"tf{i}"), F.col("dl"), F.lit(avgdl), k1, b)).otherwise(0.0) for i, (h, w) in enumerate(zip(hits, weights.values(), strict=True))]
    return own.select("doc_id", reduce(lambda a, c: a + c, parts).alias("score"))


def bm25_fused(docs: DataFrame, query: Iterable[str], fields: Mapping[str, tuple[float, float, float]], analysis: Analysis = INGEST, doc_id: str = "doc_id") -> DataFrame:
    """Sum over fields of weight x BM25; fields: name to (weight, k1, b), a weight of 0 standing for 1."""
    scored = [bm25(docs, query, name, analysis, k1, b, doc_id).select("doc_id", (F.col("score") * (weight or 1.0)).alias("score")) for name, (weight, k1, b) in fields.items()]
    return reduce(lambda a, c: a.unionByName(c), scored).groupBy("doc_id").agg(F.sum("score").alias("score"))


def bm25_indexed(posted: DataFrame, stats: DataFrame, query: Mapping[str, float] | Iterable[str], field: str = "body", k1: float = K1, b: float = B) -> DataFrame:
    """As bm25, from a postings table; stats is one row of field_stats. Only the query's terms are read."""
    weights = dict(query) if isinstance(query, Mapping) else {t: 1.0 for t in dict.fromkeys(query)}
    own = posted.where((F.col("field") == field) & F.col("term").isin(list(weights)))
    one = stats.first()
    known = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.count("*").alias("df")).collect()}  # one row per query term
    factor = F.lit(0.0)
    for t, df in known.items():
        factor = F.when(F.col("term") == t, weights[t] * idf(F.lit(one["n"]), F.lit(df))).otherwise(factor)
    return own.select("doc_id", (factor * tf_norm(F.col("tf"), F.col("dl"), F.lit(one["avgdl"]), k1, b)).alias("part")).groupBy("doc_id").agg(F.sum("part").alias("score"))


def ranking(score: str = "score", doc_id: str = "doc_id") -> list[Column]:
    """Score as 32 bits, high first, -0 as 0; then doc_id."""
    return [(F.col(score).cast("float") + F.lit(0.0).cast("float")).desc(), F.col(doc_id).asc()]


def top_k(scored: DataFrame, k: int, min_score: float = 0.0, score: str = "score", doc_id: str = "doc_id") -> DataFrame:
    """The first k by ranking(), with their rank; a floor keeps ties, and 0 is none."""
    require(1 <= k <= 10_000, f"k of {k}")
    if min_score:
        scored = scored.where(F.col(score) >= min_score)
    return numbered(scored.orderBy(*ranking(score, doc_id)).limit(k), *ranking(score, doc_id))


def numbered(pool: DataFrame, *order: Column) -> DataFrame:
    """A bounded pool with the column rank."""
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def rescore(docs: DataFrame, ids: DataFrame, query: Iterable[str], text: str = "text", analysis: Analysis = INGEST) -> DataFrame:
    """BM25 of given doc_ids only, by the whole corpus's statistics; 0 where no term occurs."""
    return ids.select("doc_id").distinct().join(bm25(docs, query, text, analysis), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


# phrases


def phrase_starts(text: Column, phrase: list[str], slop: int = 0, analysis: Analysis = INGEST) -> Column:
    """Positions where the phrase's terms begin to occur in order within len + slop words, each taken as early as it can."""
    require(len(phrase) > 1, "a phrase of fewer than two words")
    placed = F.filter(F.transform(terms(text, analysis), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(phrase))

    def found(placed: Column) -> Column:
        starts = F.transform(F.filter(placed, lambda x: x["t"] == phrase[0]), lambda x: x["i"])

        def reaches(start: Column) -> Column:
            near = F.filter(placed, lambda x: (x["i"] > start) & (x["i"] < start + len(phrase) + slop))

            def after(term: str, at: Column) -> Column:
                return F.array_min(F.transform(F.filter(near, lambda x: (x["t"] == term) & (x["i"] > at)), lambda x: x["i"]))

            at = start
            for term in phrase[1:]:
                at = after(term, at)
            return F.coalesce(at - start + 1 <= len(phrase) + slop, F.lit(False))

        return F.filter(starts, reaches)

    # bound to a lambda's variable, the phrase's terms are found once in a text
    return F.get(F.transform(F.array(placed), found), F.lit(0))


def phrase_count(text: Column, phrase: list[str], analysis: Analysis = INGEST) -> Column:
    """At how many places the phrase's terms stand side by side: a search in the text as one string, overlaps included."""
    require(len(phrase) > 1, "a phrase of fewer than two words")
    quoted = "".join(" \\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E " for t in phrase)
    return F.regexp_count(spaced(text, analysis), F.lit(f"(?={quoted})"))


def phrase_matches(docs: DataFrame, phrase: list[str], slop: int = 0, text: str = "text", analysis: Analysis = INGEST, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n): documents that hold the phrase, and at how many places it starts."""
    body = F.col(f"`{text}`")
    n = phrase_count(body, phrase, analysis) if slop == 0 and is_plain(analysis) else F.size(phrase_starts(body, phrase, slop, analysis))
    if is_plain(analysis):  # a plain string search for the terms passes over texts that lack one
        held = F.lower(body) if analysis.fold_case else body
        docs = docs.where(reduce(lambda a, c: a & c, [F.contains(held, F.lit(t)) for t in dict.fromkeys(phrase)]))
    listed = F.array(F.struct(F.col(f"`{doc_id}`").alias("doc_id"), n.cast("long").alias("n")))
    # a filter on n would be computed beside n; in an array it is the same value
    return docs.select(F.inline(F.filter(listed, lambda x: x["n"] > 0)))


def phrase_route(n_terms: int, slop: int, has_bigrams: bool, has_positions: bool) -> str:
    """Which table answers a phrase: bigrams for two terms side by side, positions else; refused without either."""
    if n_terms == 2 and slop == 0 and has_bigrams:
        return "bigrams"
    if not has_positions:
        raise Refused("a phrase over a field without positions")
    return "positions"


def _pairs(docs: DataFrame, text: str, analysis: Analysis, *kept: Column) -> DataFrame:
    """The columns kept and `pairs`, a row's neighbouring terms as one string each, in order."""
    own = docs.select(*kept, terms(F.col(f"`{text}`"), analysis).alias("terms"))
    own = own.select(*kept, "terms", F.greatest(F.size("terms") - 1, F.lit(0)).alias("n"))
    pair = lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit(" "), b)) if not is_plain(analysis) else F.concat(a, F.lit(" "), b)
    own = own.select(*kept, F.zip_with(F.slice("terms", 1, F.col("n")), F.slice("terms", 2, F.col("n")), pair).alias("pairs"))
    return own if is_plain(analysis) else own.withColumn("pairs", F.filter("pairs", lambda p: p.isNotNull()))


def bigrams(docs: DataFrame, text: str = "text", analysis: Analysis = INGEST, doc_id: str = "doc_id") -> DataFrame:
    """(bigram, doc_id, tf): pairs of terms on neighbouring positions."""
    own = _pairs(docs.withColumnRenamed(doc_id, "doc_id"), text, analysis, F.col("doc_id")).select("doc_id", F.explode_outer("pairs").alias("bigram")).where("bigram is not null")
    return own.groupBy("bigram", "doc_id").agg(F.count("*").alias("tf"))


def bigram_stats(docs: DataFrame, text: str = "text", analysis: Analysis = INGEST, doc_id: str = "doc_id") -> DataFrame:
    """(bigram, docs, tf) as sums over bigrams(). A document of one row is counted in it, so a task shuffles one row per bigram."""
    once, again = by_id(docs, doc_id)
    own = _pairs(once, text, analysis).select(F.sort_array("pairs").alias("pairs"))
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), "pairs"), 1, F.size("pairs"))
    # outer: Spark gives an inner one a filter on its array, which cuts and sorts the text once more
    own = own.select(F.inline_outer(F.arrays_zip("pairs", before.alias("before")))).where("pairs is not null")
    rows = own.select(F.col("pairs").alias("bigram"), (~F.col("pairs").eqNullSafe(F.col("before"))).cast("long").alias("docs"), F.lit(1).cast("long").alias("tf"))
    if again is not None:
        rows = rows.union(bigrams(again, text, analysis, doc_id).select("bigram", F.lit(1).cast("long"), "tf"))
    return rows.groupBy("bigram").agg(F.sum("docs").alias("docs"), F.sum("tf").alias("tf"))


def by_id(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """The rows that are a document by themselves, and those whose doc_id is repeated or null, None if there are none."""
    key = F.col(f"`{doc_id}`")
    repeated = staged(docs.select(key.alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"), "repeated")
    if repeated.isEmpty():
        return docs, None
    same = key.eqNullSafe(F.col("id"))
    return docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")


def stem_stats(docs: DataFrame, text: str = "text", analysis: Analysis = INGEST, doc_id: str = "doc_id") -> DataFrame:
    """(term, df): Porter stems of the vocabulary and the doc_ids that hold them. A document of one row is stemmed in its task, so a task shuffles stems alone."""
    once, again = by_id(docs, doc_id)
    distinct = F.array_distinct(terms(F.col(f"`{text}`"), analysis))
    out = stem_documents(once.select(distinct.alias("terms"))).groupBy("term").agg(F.sum("df").alias("df"))
    if again is None:
        return out
    own = stemmed(again.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(distinct).alias("term")))
    return out.union(own.groupBy("term").agg(F.count_distinct("doc_id").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))


# expansion and suggestion


def vocabulary(docs: DataFrame, text: str = "text", analysis: Analysis = INGEST) -> DataFrame:
    """(term, df) over documents; a document's repeats go before the shuffle."""
    distinct = F.array_distinct(F.filter(terms(F.col(f"`{text}`"), analysis), lambda t: t != ""))
    return docs.select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def with_prefix(vocab: DataFrame, prefix: str) -> DataFrame:
    """The rows of a vocabulary whose term begins with a prefix, however many they are."""
    require(prefix != "", "an empty prefix")
    return vocab.where(F.col("term").startswith(prefix))


def expand_prefix(vocab: DataFrame, prefix: str, cap: int = PREFIX_CAP) -> list[str]:
    """The terms with a prefix, in byte order, as a list to put into a query; more than `cap` of them are refused, not cut."""
    require(cap <= PREFIX_MOST, f"a cap of {cap}")
    found = [r["term"] for r in with_prefix(vocab, prefix).select("term").orderBy("term").limit(cap + 1).collect()]
    require(len(found) <= cap, f"more than {cap} terms begin with {prefix}")
    return found


def suggest(vocab: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Completions: (term, df) by df, then bytes."""
    require(prefix != "" and 1 <= limit <= 100, "a prefix and a limit of 1 to 100")
    return vocab.where(F.col("term").startswith(prefix)).orderBy(F.col("df").desc(), "term").limit(limit)


def osa_distance(a: str, b: str, most: int) -> int:
    """Edits between two words - insert, delete, replace, swap neighbours - or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return min(rows[-1][-1], most + 1)


def did_you_mean(vocab: DataFrame, word: str, max_edits: int = 1, shared: int = 1, limit: int = 10) -> DataFrame:
    """(term, distance, df): terms near a word that share its first characters, by distance, df, bytes.

    Length and prefix filters run in the scan; the distance is an Arrow function over what is left.
    """
    require(max_edits in (1, 2), f"{max_edits} edits")

    @F.pandas_udf("int")
    def distance(found: pd.Series) -> pd.Series:
        return found.map(lambda t: osa_distance(word, t, max_edits))

    near = vocab.where(F.col("term").startswith(word[:shared]) & F.length("term").between(len(word) - max_edits, len(word) + max_edits) & (F.col("term") != word))
    near = near.withColumn("distance", distance("term")).where(F.col("distance") <= max_edits)
    return near.orderBy("distance", F.col("df").desc(), "term").limit(limit).select("term", "distance", "df")


def parse_synonyms(lines: Iterable[str]) -> dict[tuple[str, ...], list[tuple[str, ...]]]:
    """Rules: "a, b c, d" are synonyms of each other, "a, b => c" one way."""
    table: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for line in lines:
        line = line.split("#")[0].strip()
        if not line:
            continue
        left, arrow, right = line.partition("=>")
        sources = [tuple(x.lower().split()) for x in left.split(",") if x.strip()]
        targets = [tuple(x.lower().split()) for x in right.split(",") if x.strip()] if arrow else sources
        require(bool(sources) and bool(targets), f"the rule {line}")
        for s in sources:
            own = table.setdefault(s, [])
            own += [t for t in targets if t != s and t not in own]
    return table


def expand_synonyms(query: list[str], table: Mapping[tuple[str, ...], list[tuple[str, ...]]]) -> list[str]:
    """The query's terms and those of its synonyms; at each place the longest entry is matched."""
    out, i, longest = list(query), 0, max(map(len, table), default=0)
    while i < len(query):
        for n in range(min(longest, len(query) - i), 0, -1):
            if found := table.get(tuple(query[i : i + n])):
                out += [t for entry in found for t in entry]
                i += n
                break
        else:
            i += 1
    return list(dict.fromkeys(out))


def glossary_scores(docs: DataFrame, concepts: Mapping[str, str], weight: float = 1.0, most: float = 3.0, text: str = "text", analysis: Analysis = INGEST, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, concept_id, score): the strongest registered concept of each document, min(words x weight, most), ties by id.

    concepts: id to surface form. Few and fixed: each is one expression in the scan.
    """
    t = terms(F.col(f"`{text}`"), analysis)
    joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    found = F.array(*[F.when(F.contains(joined, F.lit(f" {' '.join(s.lower().split())} ")), F.struct(F.lit(-min(len(s.split()) * weight, most)).alias("negated"), F.lit(i).alias("id"))) for i, s in sorted(concepts.items())])
    best = F.array_min(F.filter(found, lambda x: x.isNotNull()))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), best.alias("best")).where("best is not null")
    return own.select("doc_id", F.col("best.id").alias("concept_id"), (-F.col("best.negated")).alias("score"))


def explain_bm25(docs: DataFrame, query: Iterable[str], ids: DataFrame, text: str = "text", analysis: Analysis = INGEST) -> DataFrame:
    """(doc_id, term, tf, df, dl, idf, contribution) of the given documents: the parts that bm25 sums."""
    posted = postings(docs, text, analysis=analysis, only=list(query)).select("term", "doc_id", "tf", "dl")
    stats = F.broadcast(field_stats(docs, text, analysis))  # one row
    known = posted.groupBy("term").agg(F.count("*").alias("df"))
    own = posted.join(ids.select("doc_id"), "doc_id", "left_semi").join(F.broadcast(known), "term").join(stats, F.lit(True))  # known: a row per query term
    out = own.withColumn("idf", idf(F.col("n"), F.col("df")))
    return out.select("doc_id", "term", "tf", "df", "dl", "idf", (F.col("idf") * tf_norm(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("contribution"))


# sparse vectors


def splade(impacts: DataFrame, query: Mapping[str, float], floor: float = 0.0, doc_id: str = "doc_id", vector: str = "impacts") -> DataFrame:
    """(doc_id, score): dot product of map<term, impact> with a query's weights, from a floor on."""
    parts = [F.coalesce(F.try_element_at(F.col(f"`{vector}`"), F.lit(t)), F.lit(0.0)) * w for t, w in query.items()]
    own = impacts.select(F.col(f"`{doc_id}`").alias("doc_id"), reduce(lambda a, c: a + c, parts).alias("score"))
    return own.where((F.col("score") > 0) & (F.col("score") >= floor))


def quantise_impacts(vector: Column, levels: int = 255) -> Column:
    """Impacts as whole levels of the document's largest: struct(scale, levels map)."""
    largest = F.array_max(F.map_values(vector))
    scale = largest / levels
    return F.struct(scale.alias("scale"), F.transform_values(vector, lambda k, v: F.round(v / scale).cast("int")).alias("levels"))
