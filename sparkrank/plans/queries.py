"""The registered queries: one per operator, each over its whole tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.functions import values as v
from sparkrank.functions.analysis import sentences, terms
from sparkrank.functions.filters import Filters, permitted, visible
from sparkrank.operators import aggregates as agg
from sparkrank.operators import compare, dense, fusion, lexical, placement, scoring, vocabulary
from sparkrank.operators import selection as sel
from sparkrank.operators.highlight import highlight
from sparkrank.schema import schema_report
from sparkrank.sources.tables import read_postings, term_bucket, write_index
from sparkrank.staging import staging_folder
from sparkrank.streaming.queries import event_windows, progressive_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


# ---------------------------------------------------------------- filters


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND NOT (l_linestatus = 'O')")
def filter_facet_in(spark, d):
    t = table(spark, d, "lineitem")
    f = Filters(t, "lineitem")
    return t.where(f.one_of("l_returnflag", ["A", "R"]) & f.differs("l_linestatus", "O")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20.5 AND l_linenumber > 2.5 AND l_discount <> 0.05")
def filter_num_range(spark, d):
    t = table(spark, d, "lineitem")
    f = Filters(t, "lineitem")
    return t.where(f.between("l_quantity", 10, 20.5) & f.number("l_linenumber", ">", 2.5) & f.number("l_discount", "!=", 0.05)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 'r') OR (p_brand >= 'Brand#2' AND p_brand < 'Brand#3')")
def filter_prefix(spark, d):
    t = table(spark, d, "part")
    f = Filters(t, "part")
    return t.where(f.starts_with("p_name", "r") | (f.text("p_brand", ">=", "Brand#2") & f.text("p_brand", "<", "Brand#3"))).select("p_partkey")


@query("SELECT event_id FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events) WHERE NOT (v < 20 AND event_type = 'click') OR (v IS NOT NULL AND v > 1000)")
def filter_kleene_not(spark, d):
    t = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    f = Filters(t, "events")
    return t.where(~(f.number("v", "<", 20) & f.equals("event_type", "click")) | (f.has("v") & f.number("v", ">", 1000))).select("event_id")


@query("SELECT event_id FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL")
def filter_has(spark, d):
    t = table(spark, d, "events")
    f = Filters(t, "events")
    return t.where(f.has("value") & f.has("event_type")).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03 10:30:00.5' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def filter_timestamp(spark, d):
    t = table(spark, d, "events")
    f = Filters(t, "events")
    return t.where(f.time("ts", ">=", "2024-01-03T12:30:00.5+02:00") & f.time("ts", "<", "2024-01-20T00:00:00Z")).select("event_id")


@query("SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) >= 40 AND CAST(props->>'k' AS BIGINT) < 77")
def filter_map_key(spark, d):
    t = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    f = Filters(t, "events")
    return t.where(f.entry("m", "k", ">=", 39.5) & f.entry("m", "k", "<", 77) & f.has_key("m", "k") & ~f.has_key("m", "none")).select("event_id")


_POINT_SQL = "(SELECT s_suppkey, ((s_suppkey * 37) % 170 - 85)::DOUBLE AS lat, ((s_suppkey * 101) % 340 - 170)::DOUBLE AS lon FROM supplier WHERE s_suppkey % 10 <> 3)"
_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(lat)) * pow(sin(radians(lon - 20.0) / 2), 2))))"
_MANHATTAN = "6371008.8 * (abs(radians(lat - 10.0)) + abs(radians(lon - 20.0)) * cos(radians(10.0)))"


def _points(spark, d):
    t = table(spark, d, "supplier")
    lat, lon = ((F.col("s_suppkey") * 37) % 170 - 85).cast("double"), ((F.col("s_suppkey") * 101) % 340 - 170).cast("double")
    return t.select("s_suppkey", F.when(F.col("s_suppkey") % 10 != 3, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("point"))


@query(f"SELECT s_suppkey FROM {_POINT_SQL} WHERE lat BETWEEN -30 AND 45.5 AND lon BETWEEN -100 AND 20")
def geo_bbox(spark, d):
    t = _points(spark, d)
    return t.where(Filters(t).in_box("point", -30, 45.5, -100, 20)).select("s_suppkey")


@query(f"SELECT s_suppkey FROM {_POINT_SQL} WHERE {_HAVERSINE} <= 5000000")
def geo_radius(spark, d):
    t = _points(spark, d)
    return t.where(Filters(t).within("point", 10.0, 20.0, 5_000_000)).select("s_suppkey")


@query(f"SELECT s_suppkey FROM {_POINT_SQL} WHERE {_MANHATTAN} <= 7000000")
def geo_manhattan(spark, d):
    t = _points(spark, d)
    return t.where(Filters(t).within_manhattan("point", 10.0, 20.0, 7_000_000)).select("s_suppkey")


@query("SELECT lang, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY lang")
def visibility(spark, d):
    docs = visible(table(spark, d, "documents"), F.col("source") != "src0")
    return permitted(docs, {"source"}, {"doc_id", "lang"}).groupBy("lang").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- lexical

_WS = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _tok(column: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({column}, '')), '{_WS}'), lambda x: x <> '')"


TERMS = ["from", "was", "erst"]


def _bm25_sql(name: str, terms_: list[str], source: str = "documents", text: str = "text", doc_id: str = "doc_id", k1: float = 1.2, b: float = 0.75, weight: float = 1.0) -> str:
    """CTEs that end in `name` (doc_id, score)."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms_))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms_)))
    parts = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * (tf{i} * ({k1}::DOUBLE + 1) / (tf{i} + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))) ELSE 0 END" for i in range(len(terms_)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms_)))
    return f"""{name}_t AS (SELECT {doc_id} AS doc_id, {_tok(text)} AS t FROM {source}), {name}_d AS (SELECT doc_id, len(t) AS dl, {tf} FROM {name}_t),
        {name}_s AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl, {df} FROM {name}_d),
        {name} AS (SELECT doc_id, {weight}::DOUBLE * ({parts}) AS score FROM {name}_d, {name}_s WHERE {some})"""


_TOP = "ORDER BY score::FLOAT DESC, doc_id LIMIT {k}"
_LEX = _bm25_sql("lex", TERMS)


@query(f"WITH {_LEX}, top AS (SELECT lex.* FROM lex JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars >= 200 {_TOP.format(k=10)}) SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score::FLOAT DESC, doc_id) AS rank FROM top")
def bm25_flat(spark, d):
    """The flagship: BM25 over all documents, hits filtered, the best ten."""
    docs = table(spark, d, "documents")
    f = Filters(docs, "documents")
    kept = docs.where(f.equals("lang", "en") & f.number("n_chars", ">=", 200)).select("doc_id")
    return rounded(lexical.top_k(lexical.bm25(docs, TERMS).join(kept, "doc_id", "left_semi"), 10), "score")


@query(f"WITH {_LEX} SELECT doc_id, round(score, 6) AS score FROM lex WHERE score >= 3.0")
def bm25_min_score(spark, d):
    scored = lexical.bm25(table(spark, d, "documents"), TERMS)
    return rounded(scored.where(F.col("score") >= 3.0), "score")


@query("WITH " + _bm25_sql("a", ["red", "ring", "widget"], "part", "p_name", "p_partkey", 1.2, 0.75, 2.0) + ", " + _bm25_sql("b", ["red", "ring", "widget"], "part", "p_type", "p_partkey", 0.9, 0.4) + " SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id")
def bm25_fused(spark, d):
    return rounded(lexical.bm25_fused(table(spark, d, "part"), ["red", "ring", "widget"], {"p_name": (2.0, 1.2, 0.75), "p_type": (0.0, 0.9, 0.4)}, doc_id="p_partkey"), "score")


@query(f"WITH {_LEX} SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT doc_id FROM labels) LEFT JOIN lex USING (doc_id)")
def bm25_rescore(spark, d):
    """Scores of given ids, here the labelled documents, by the statistics of all rows."""
    return rounded(lexical.rescore(table(spark, d, "documents"), table(spark, d, "labels"), TERMS), "score")


_indexes: dict[tuple[str, str], str] = {}


def index(spark, d) -> str:
    """Where the index over the documents is; the first query of an application that needs it writes it."""
    key = spark.sparkContext.applicationId, d
    if key not in _indexes:
        path = staging_folder(spark, "index")
        write_index(table(spark, d, "documents"), path)
        _indexes[key] = path
    return _indexes[key]


@query(f"SELECT count(*) AS terms, sum(df)::BIGINT AS postings, sum(cf)::BIGINT AS tokens, max(df) AS most FROM (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY term)")
def index_write(spark, d):
    """Write the index and sum up its term statistics."""
    return spark.read.parquet(f"{index(spark, d)}/term_stats").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.sum("cf").alias("tokens"), F.max("df").alias("most"))


@query(f"WITH {_LEX} SELECT doc_id, round(score, 6) AS score FROM lex")
def bm25_indexed(spark, d):
    """From the index files: the folders of the query's terms, and the statistics."""
    path = index(spark, d)
    return rounded(lexical.bm25_indexed(read_postings(spark, path, TERMS), spark.read.parquet(f"{path}/field_stats"), TERMS), "score")


_EXPLAIN = " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS term, tf{i} AS tf, df{i} AS df, dl, round(ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 6) AS idf, round(ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * (tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS contribution FROM lex_d, lex_s WHERE tf{i} > 0 AND doc_id IN (SELECT doc_id FROM labels)"
    for i, t in enumerate(TERMS)
)


@query(f"WITH {_LEX} {_EXPLAIN}")
def explain_lexical(spark, d):
    docs = table(spark, d, "documents")
    return rounded(lexical.explain_bm25(docs, TERMS, table(spark, d, "labels")), "idf", "contribution")


_TOKENS = f"SELECT doc_id, unnest({_tok('text')}) AS term FROM documents"


@query(f"SELECT 'body' AS field, term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS cf FROM ({_TOKENS}) GROUP BY term")
def term_statistics(spark, d):
    return lexical.corpus_terms(table(spark, d, "documents"))


@query(f"SELECT count(*) AS n, sum(len(t))::BIGINT AS total, round(sum(len(t))::DOUBLE / count(*), 6) AS avgdl FROM (SELECT {_tok('text')} AS t FROM documents)")
def field_statistics(spark, d):
    return rounded(lexical.field_stats(table(spark, d, "documents")), "avgdl")


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)) WHERE t[i] = 'of' AND t[i + 1] = 'the' GROUP BY doc_id")
def phrase_exact(spark, d):
    return lexical.phrase_matches(table(spark, d, "documents"), ["of", "the"])


@query(f"""WITH p AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)),
    a AS (SELECT doc_id, i FROM p WHERE term = 'from'), b AS (SELECT doc_id, i FROM p WHERE term = 'the')
    SELECT doc_id, count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.i > a.i AND b.i - a.i + 1 <= 5) GROUP BY doc_id""")
def phrase_slop(spark, d):
    return lexical.phrase_matches(table(spark, d, "documents"), ["from", "the"], slop=3)


@query(f"SELECT bigram, count(*) AS docs, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, t[i] || ' ' || t[i + 1] AS bigram, count(*) AS tf FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)) GROUP BY ALL) GROUP BY bigram")
def bigrams(spark, d):
    return lexical.bigram_stats(table(spark, d, "documents"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM ({_TOKENS}) WHERE starts_with(term, 'from') GROUP BY term")
def prefix_expand(spark, d):
    return lexical.with_prefix(lexical.vocabulary(table(spark, d, "documents")), "from")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM ({_TOKENS}) WHERE starts_with(term, 'th') GROUP BY term ORDER BY df DESC, term LIMIT 10")
def suggest(spark, d):
    return lexical.suggest(lexical.vocabulary(table(spark, d, "documents")), "th")


@query(f"SELECT term, damerau_levenshtein(term, 'fron')::INTEGER AS distance, df FROM (SELECT term, count(DISTINCT doc_id) AS df FROM ({_TOKENS}) GROUP BY term) WHERE starts_with(term, 'f') AND term <> 'fron' AND damerau_levenshtein(term, 'fron') <= 1 ORDER BY distance, df DESC, term LIMIT 10")
def did_you_mean(spark, d):
    return lexical.did_you_mean(lexical.vocabulary(table(spark, d, "documents")), "fron")


@query("WITH " + _bm25_sql("syn", ["from", "of", "la", "de"]) + f" SELECT doc_id, round(score, 6) AS score FROM syn {_TOP.format(k=20)}")
def synonyms(spark, d):
    rules = lexical.parse_synonyms(["from, of", "la => de", "# a comment"])
    return rounded(lexical.top_k(lexical.bm25(table(spark, d, "documents"), sorted(lexical.expand_synonyms(["from", "la"], rules), key=["from", "of", "la", "de"].index)), 20).drop("rank"), "score")


@query(f"""SELECT doc_id, id AS concept_id, w AS score FROM (SELECT doc_id, id, w, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, id) AS r FROM
    (SELECT doc_id, ' ' || array_to_string({_tok('text')}, ' ') || ' ' AS s FROM documents), (VALUES ('c1', ' of the ', 2.0::DOUBLE), ('c2', ' from ', 1.0::DOUBLE), ('c3', ' with the of ', 3.0::DOUBLE), ('c4', ' de la ', 2.0::DOUBLE)) AS c(id, p, w)
    WHERE contains(s, p)) WHERE r = 1""")
def glossary(spark, d):
    return lexical.glossary_scores(table(spark, d, "documents"), {"c1": "of the", "c2": "From", "c3": "with the of", "c4": "de la"})


@query("SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: trim(x, ' \t\n\x0b\f\r')), lambda x: x <> ''))::BIGINT AS n FROM documents".replace("\t", chr(9)))
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(sentences(F.col("text"))).cast("long").alias("n"))


@query()
def stemmed_terms(spark, d):
    """Porter stems of the whole vocabulary, with document frequencies of stems."""
    return lexical.stem_stats(table(spark, d, "documents"))


@query()
def highlights(spark, d):
    """Snippets of the best ten."""
    docs = table(spark, d, "documents")
    hits = lexical.top_k(lexical.bm25(docs, TERMS), 10)
    return docs.join(F.broadcast(hits), "doc_id").select("doc_id", "rank", highlight(F.col("text"), TERMS).alias("snippets"), highlight(F.col("text"), TERMS, "window").alias("windows"))  # ten rows


@query(f"""WITH w AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS t FROM documents) WHERE t IN ('the', 'from', 'of', 'de') GROUP BY ALL)
    SELECT doc_id, round(sum(ln(1 + tf) * CASE t WHEN 'the' THEN 0.5::DOUBLE WHEN 'from' THEN 2.0::DOUBLE WHEN 'of' THEN 0.7::DOUBLE ELSE 1.1::DOUBLE END), 6) AS score FROM w GROUP BY doc_id""")
def splade(spark, d):
    posted = lexical.postings(table(spark, d, "documents"), only=["the", "from", "of", "de"])
    vectors = posted.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.log(1 + F.col("tf"))))).alias("impacts"))
    return rounded(lexical.splade(vectors, {"the": 0.5, "from": 2.0, "of": 0.7, "de": 1.1}), "score")


# ---------------------------------------------------------------- dense

_DOT = "list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {q}))"


def _vector(spark, d, q: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == q).first()["embedding"])


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_DOT.format(q=0)} AS s FROM embeddings) ORDER BY s::FLOAT DESC, vec_id LIMIT 10")
def dense_topk(spark, d):
    return rounded(dense.dense_top_k(table(spark, d, "embeddings"), _vector(spark, d), 10).select("vec_id", "score"), "score")


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_DOT.format(q=0)} AS s FROM embeddings WHERE label IN (1, 3)) WHERE s >= 0.05 ORDER BY s::FLOAT DESC, vec_id LIMIT 25")
def dense_filtered(spark, d):
    t = table(spark, d, "embeddings")
    return rounded(dense.dense_top_k(t.where(Filters(t).one_of("label", [1, 3])), _vector(spark, d), 25, min_score=0.05).select("vec_id", "score"), "score")


@query("""SELECT q AS query_id, vec_id, round(s, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s::FLOAT DESC, vec_id) AS r FROM
    (SELECT a.vec_id AS q, b.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE r <= 5""")
def dense_batch(spark, d):
    """The stated query set - ids divisible by 20 - against all rows, in blocks."""
    t = table(spark, d, "embeddings")
    return rounded(dense.block_top_k(t, t.where("vec_id % 20 = 0"), 5), "score").select("query_id", "vec_id", "score", "rank")


@query(f"SELECT label, vec_id, round(s, 6) AS score FROM (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s::FLOAT DESC, vec_id) AS r FROM (SELECT label, vec_id, {_DOT.format(q=7)} AS s FROM embeddings)) WHERE r = 1 ORDER BY score DESC, vec_id LIMIT 5")
def dense_collapse(spark, d):
    scored = dense.scores(table(spark, d, "embeddings"), _vector(spark, d, 7))
    return rounded(dense.best_of_parent(scored, "label", 5), "score")


@query(f"WITH p AS (SELECT vec_id FROM (SELECT vec_id, {_DOT.format(q=3)} AS s FROM embeddings) ORDER BY s::FLOAT DESC, vec_id LIMIT 50) SELECT vec_id, round({_DOT.format(q=3)}, 4) AS score FROM embeddings WHERE vec_id IN (SELECT vec_id FROM p)")
def fp32_rerank(spark, d):
    t = table(spark, d, "embeddings")
    pool = dense.dense_top_k(t, _vector(spark, d, 3), 50)
    return dense.rerank(pool, t, _vector(spark, d, 3)).select("vec_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 5), p AS (SELECT vec_id, embedding FROM (SELECT vec_id, embedding, list_inner_product(embedding[1:16]::DOUBLE[], v[1:16]) AS s FROM embeddings, q) ORDER BY s::FLOAT DESC, vec_id LIMIT 40)
    SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], v) AS s FROM p, q) ORDER BY s::FLOAT DESC, vec_id LIMIT 10""")
def dense_prefix(spark, d):
    return rounded(dense.prefix_shortlist(table(spark, d, "embeddings"), _vector(spark, d, 5), 16, 40, 10).select("vec_id", "score"), "score")


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_DOT.format(q=9)} AS s FROM embeddings) ORDER BY s::FLOAT DESC, vec_id LIMIT 10")
def dense_quantised(spark, d):
    """8-bit codes choose a pool that full precision orders; the pool is deep enough for the exact ten."""
    return rounded(dense.quantised_top_k(table(spark, d, "embeddings"), _vector(spark, d, 9), 10, 100).select("vec_id", "score"), "score")


#: Cells of a partition of the vectors, and how many of them a query probes.
CELLS, CELL_PROBES = 8, 6


@query()
def dense_cells(spark, d):
    """The stated query set - ids divisible by 20 - against the rows of the CELL_PROBES of CELLS cells nearest to each; tests measure the recall."""
    t = table(spark, d, "embeddings")
    centres = dense.train_cells(t, CELLS)
    near = lambda n: dense.nearest_cells(F.col("embedding"), centres, n)
    return rounded(dense.block_top_k(t, t.where("vec_id % 20 = 0"), 10, cells=(near(1)[0], near(CELL_PROBES))), "score").select("query_id", "vec_id", "score", "rank")


# ---------------------------------------------------------------- fusion

_DENSE = f"den AS (SELECT vec_id AS doc_id, {_DOT.format(q=0)} AS score FROM embeddings)"


def _legs(spark, d):
    return dense.scores(table(spark, d, "embeddings"), _vector(spark, d)).select(F.col("vec_id").alias("doc_id"), "score"), lexical.bm25(table(spark, d, "documents"), TERMS)


def _ranked(leg: str, depth: int) -> str:
    return f"(SELECT * FROM (SELECT doc_id, score, rank() OVER (ORDER BY score::FLOAT DESC) AS r FROM {leg}) WHERE r <= {depth})"


@query(f"WITH {_LEX}, {_DENSE} SELECT doc_id, round(sum(p), 9) AS score, count(*) AS n_legs FROM (SELECT doc_id, 1.0::DOUBLE / (60 + r) AS p FROM {_ranked('den', 60)} UNION ALL SELECT doc_id, 2.0::DOUBLE / (60 + r) FROM {_ranked('lex', 60)}) GROUP BY doc_id ORDER BY sum(p)::FLOAT DESC, n_legs DESC, doc_id LIMIT 20")
def rrf(spark, d):
    return fusion.rrf(list(_legs(spark, d)), 20, weights=[1.0, 2.0]).withColumn("score", F.round("score", 9))


@query(f"""WITH {_LEX}, {_DENSE}, p AS (SELECT doc_id, 'dense' AS leg, r, score, 1.0::DOUBLE / (60 + r) AS p FROM {_ranked('den', 60)} UNION ALL SELECT doc_id, 'lexical', r, score, 2.0::DOUBLE / (60 + r) FROM {_ranked('lex', 60)})
    SELECT doc_id, round(sum(p), 9) AS score, max(r) FILTER (leg = 'dense') AS dense_rank, round(max(score) FILTER (leg = 'dense'), 6) AS dense_score, max(r) FILTER (leg = 'lexical') AS lexical_rank, round(max(score) FILTER (leg = 'lexical'), 6) AS lexical_score
    FROM p GROUP BY doc_id ORDER BY sum(p)::FLOAT DESC, count(*) DESC, doc_id LIMIT 20""")
def rrf_provenance(spark, d):
    """Where the rows of a fusion come from, leg by leg."""
    out = fusion.provenance(dict(zip(("dense", "lexical"), _legs(spark, d), strict=True)), 20, weights=[1.0, 2.0]).withColumn("score", F.round("score", 9))
    return rounded(out, "dense_score", "lexical_score")


@query(f"""WITH {_LEX}, {_DENSE}, inn AS (SELECT doc_id, doc_id % 3 AS sh, sum(1.0::DOUBLE / (60 + r)) AS score FROM
    (SELECT doc_id, rank() OVER (PARTITION BY doc_id % 3 ORDER BY score::FLOAT DESC) AS r FROM den UNION ALL SELECT doc_id, rank() OVER (PARTITION BY doc_id % 3 ORDER BY score::FLOAT DESC) FROM lex) WHERE r <= 60 GROUP BY doc_id),
    o AS (SELECT doc_id, rank() OVER (PARTITION BY sh ORDER BY score::FLOAT DESC) AS r FROM inn) SELECT doc_id, round(1.0::DOUBLE / (60 + r), 9) AS score FROM o WHERE r <= 60 ORDER BY (1.0::DOUBLE / (60 + r))::FLOAT DESC, doc_id LIMIT 20""")
def rrf_two_level(spark, d):
    return fusion.rrf_two_level(list(_legs(spark, d)), F.col("doc_id") % 3, 20).withColumn("score", F.round("score", 9))


def _norm_sql(leg: str, depth: int, how: str) -> str:
    norm = "CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0::DOUBLE ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END" if how == "min_max" else "CASE WHEN stddev_pop(score) OVER () = 0 THEN 0.0::DOUBLE ELSE (score - avg(score) OVER ()) / stddev_pop(score) OVER () END"
    return f"(SELECT doc_id, {norm} AS x FROM {_ranked(leg, depth)})"


_BLEND = "WITH {ctes} SELECT doc_id, round({f}, 6) AS score FROM (SELECT doc_id, 0.3::DOUBLE AS w, x FROM {a} UNION ALL SELECT doc_id, 0.7::DOUBLE, x FROM {b}) GROUP BY doc_id ORDER BY {f}::FLOAT DESC, doc_id LIMIT 20"


@query(_BLEND.format(ctes=f"{_LEX}, {_DENSE}", f="(sum(w * x) / 1.0::DOUBLE)", a=_norm_sql("den", 50, "min_max"), b=_norm_sql("lex", 50, "min_max")))
def blend_minmax(spark, d):
    return rounded(fusion.blend(list(_legs(spark, d)), 20, [0.3, 0.7], "min_max", leg_k=50), "score")


@query(_BLEND.format(ctes=f"{_LEX}, {_DENSE}", f="(sum(w * x) / 1.0::DOUBLE)", a=_norm_sql("den", 50, "z"), b=_norm_sql("lex", 50, "z")))
def blend_z(spark, d):
    return rounded(fusion.blend(list(_legs(spark, d)), 20, [0.3, 0.7], "z_score", leg_k=50), "score")


@query(_BLEND.format(ctes=f"{_LEX}, {_DENSE}", f="coalesce(exp(sum(w * ln(x)) FILTER (x > 0) / sum(w) FILTER (x > 0)), 0)", a=_norm_sql("den", 50, "min_max"), b=_norm_sql("lex", 50, "min_max")))
def blend_geometric(spark, d):
    return rounded(fusion.blend(list(_legs(spark, d)), 20, [0.3, 0.7], "min_max", "geometric", leg_k=50), "score")


@query(_BLEND.format(ctes=f"{_LEX}, {_DENSE}", f="coalesce(sum(w) FILTER (x > 0) / sum(w / x) FILTER (x > 0), 0)", a=_norm_sql("den", 50, "min_max"), b=_norm_sql("lex", 50, "min_max")))
def blend_harmonic(spark, d):
    return rounded(fusion.blend(list(_legs(spark, d)), 20, [0.3, 0.7], "min_max", "harmonic", leg_k=50), "score")


@query(f"WITH {_LEX}, {_DENSE}, f AS (SELECT doc_id, 2.0::DOUBLE * den.score + 0.5::DOUBLE * coalesce(lex.score, 0) AS s FROM den LEFT JOIN lex USING (doc_id)) SELECT doc_id, round(s, 6) AS score FROM f ORDER BY s::FLOAT DESC, doc_id LIMIT 20")
def decomposed(spark, d):
    return rounded(fusion.decomposed(*_legs(spark, d), 20, 2.0, 0.5), "score")


@query(f"WITH {_LEX}, {_DENSE} SELECT g.doc_id, round(coalesce(lex.score, 0), 6) AS score, round(g.score, 6) AS dense FROM {_ranked('(SELECT * FROM den WHERE score >= 0.01)', 40)} g LEFT JOIN lex USING (doc_id) ORDER BY coalesce(lex.score, 0)::FLOAT DESC, g.score::FLOAT DESC, g.doc_id LIMIT 40")
def cascade(spark, d):
    return rounded(fusion.cascade(*_legs(spark, d), 40, 0.01), "score", "dense")


@query(f"""WITH {_LEX}, {_DENSE}, p AS (SELECT doc_id, score, row_number() OVER (ORDER BY score::FLOAT DESC, doc_id) AS place FROM (SELECT * FROM den {_TOP.format(k=30)})),
    b AS (SELECT p.*, 1.0::DOUBLE * p.score + 0.2::DOUBLE * coalesce(lex.score, 0) AS key FROM p LEFT JOIN lex USING (doc_id))
    SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY place <= 10 DESC, CASE WHEN place <= 10 THEN key::FLOAT END DESC, CASE WHEN place > 10 THEN place END, doc_id) AS rank FROM b""")
def boost(spark, d):
    base, lex = _legs(spark, d)
    return rounded(fusion.boost(base.orderBy(*lexical.ranking()).limit(30), lex, 10, 1.0, 0.2), "score")


# ---------------------------------------------------------------- scores


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * exp(-abs(l_quantity - 25) / 10.0::DOUBLE), 4) AS score FROM lineitem")
def score_exp_decay(spark, d):
    t = table(spark, d, "lineitem").withColumn("score", F.col("l_extendedprice"))
    return scoring.chain(t, [lambda s: scoring.exp_decay(s, F.col("l_quantity"), 25, 10)]).select("l_orderkey", "l_linenumber", F.round("score", 4).alias("score"))


@query("SELECT doc_id, round(CASE WHEN doc_id % 7 = 0 THEN 2.0::DOUBLE ELSE 2.0::DOUBLE * (1 + 0.3::DOUBLE * ln(1 + greatest(n_chars - 500, 0))) END, 6) AS score FROM documents")
def score_log(spark, d):
    x = F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") - 500).cast("double"))
    t = table(spark, d, "documents").withColumn("score", F.lit(2.0)).withColumn("x", x)
    return rounded(scoring.chain(t, [lambda s: scoring.log_boost(s, F.col("x"), 0.3)]).select("doc_id", "score"), "score")


@query("SELECT o_orderkey, round(1.5::DOUBLE + 0.25::DOUBLE * o_totalprice, 4) AS score FROM orders")
def score_add_linear(spark, d):
    t = table(spark, d, "orders").withColumn("score", F.lit(1.5))
    return scoring.chain(t, [lambda s: scoring.add_linear(s, F.col("o_totalprice"), 0.25)]).select("o_orderkey", F.round("score", 4).alias("score"))


@query(f"SELECT s.s_suppkey, round(CASE WHEN lat IS NULL THEN 1.0::DOUBLE ELSE exp(-({_HAVERSINE}) / 3000000.0::DOUBLE) * exp(-({_MANHATTAN}) / 9000000.0::DOUBLE) END, 6) AS score FROM supplier s LEFT JOIN {_POINT_SQL} p USING (s_suppkey)")
def score_geo_decay(spark, d):
    t = _points(spark, d).withColumn("score", F.lit(1.0))
    lat, lon = F.col("point.lat"), F.col("point.lon")
    stages = [lambda s: scoring.geo_decay(s, lat, lon, 10.0, 20.0, 3e6), lambda s: scoring.geo_decay(s, lat, lon, 10.0, 20.0, 9e6, "manhattan")]
    return rounded(scoring.chain(t, stages).select("s_suppkey", "score"), "score")


_POOL_SQL = f"WITH {_LEX}, pool AS (SELECT t.doc_id, score AS bm, n_chars::DOUBLE AS chars, quality::DOUBLE AS quality FROM (SELECT * FROM lex {_TOP.format(k=100)}) t JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id))"
_MM = "CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 1.0::DOUBLE ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"
_Z = "CASE WHEN stddev_pop({x}) OVER () = 0 THEN 0.0::DOUBLE ELSE ({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () END"


def _pool(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    hits = lexical.top_k(lexical.bm25(docs, TERMS), 100).select("doc_id", F.col("score").alias("bm"))
    return hits.join(docs.select("doc_id", F.col("n_chars").alias("chars")), "doc_id").join(labels, "doc_id", "left")


def _composite(combine: str, quality_missing: str = "zero"):
    dims = [scoring.Dimension("bm", 0.5, "min_max"), scoring.Dimension("chars", 0.3, "z_score" if combine in ("weighted_sum", "weighted_mean", "maximum") else "min_max"), scoring.Dimension("quality", 0.2, "none", quality_missing)]
    return lambda spark, d: rounded(scoring.composite(_pool(spark, d), dims, combine).select("doc_id", "score"), "score")


def _composite_sql(formula: str, z: bool) -> str:
    return f"{_POOL_SQL}, n AS (SELECT doc_id, {_MM.format(x='bm')} AS a, {(_Z if z else _MM).format(x='chars')} AS b, quality AS c0, coalesce(quality, 0) AS c FROM pool) SELECT doc_id, round({formula}, 6) AS score FROM n"


for _name, _how, _missing, _formula, _is_z in (
    ("scorer_sum", "weighted_sum", "zero", "0.5::DOUBLE * a + 0.3::DOUBLE * b + 0.2::DOUBLE * c", True),
    ("scorer_mean_skip", "weighted_mean", "skip", "(0.5::DOUBLE * a + 0.3::DOUBLE * b + 0.2::DOUBLE * c) / (0.8::DOUBLE + CASE WHEN c0 IS NULL THEN 0 ELSE 0.2::DOUBLE END)", True),
    ("scorer_max", "maximum", "zero", "greatest(0.5::DOUBLE * a, 0.3::DOUBLE * b, 0.2::DOUBLE * c)", True),
    ("scorer_product", "product", "zero", "pow(a, 0.5::DOUBLE) * pow(b, 0.3::DOUBLE) * pow(c, 0.2::DOUBLE)", False),
    ("scorer_geometric", "geometric_mean", "skip", "CASE WHEN a > 0 AND b > 0 AND coalesce(c0 > 0, true) THEN exp((0.5::DOUBLE * ln(nullif(a, 0)) + 0.3::DOUBLE * ln(nullif(b, 0)) + coalesce(0.2::DOUBLE * ln(nullif(c0, 0)), 0)) / (0.8::DOUBLE + CASE WHEN c0 IS NULL THEN 0 ELSE 0.2::DOUBLE END)) ELSE 0 END", False),
    ("scorer_harmonic", "harmonic_mean", "skip", "CASE WHEN a > 0 AND b > 0 AND coalesce(c0 > 0, true) THEN (0.8::DOUBLE + CASE WHEN c0 IS NULL THEN 0 ELSE 0.2::DOUBLE END) / (0.5::DOUBLE / nullif(a, 0) + 0.3::DOUBLE / nullif(b, 0) + coalesce(0.2::DOUBLE / nullif(c0, 0), 0)) ELSE 0 END", False),
):
    QUERIES[_name], ORACLES[_name] = _composite(_how, _missing), _composite_sql(_formula, _is_z)


# ---------------------------------------------------------------- selection


def _has(term: str) -> Column:
    return F.array_contains("t", term)


_BOOL = f"WITH t AS (SELECT doc_id, lang, n_chars, {_tok('text')} AS t FROM documents) "


@query(_BOOL + "SELECT doc_id, (1.0 + CASE WHEN list_contains(t, 'from') THEN 2.0 ELSE 0.0 END)::DOUBLE AS score FROM t WHERE lang = 'en' AND NOT coalesce(list_contains(t, 'erst'), false)")
def bool_must_should_not(spark, d):
    docs = table(spark, d, "documents").withColumn("t", terms(F.col("text")))
    tree = sel.Bool(must=[sel.Clause(F.col("lang") == "en", F.lit(1.0))], should=[sel.Clause(_has("from"), F.lit(2.0))], must_not=[sel.Clause(_has("erst"))])
    return sel.select(docs, tree).select("doc_id", "score")


@query(_BOOL + "SELECT doc_id FROM t WHERE list_contains(t, 'from')::INT + list_contains(t, 'was')::INT + (n_chars > 3000)::INT + (lang = 'de' AND NOT list_contains(t, 'der'))::INT >= 2")
def bool_msm2(spark, d):
    docs = table(spark, d, "documents").withColumn("t", terms(F.col("text")))
    tree = sel.Bool(should=[sel.Clause(_has("from")), sel.Clause(_has("was")), sel.Clause(F.col("n_chars") > 3000), sel.Bool(must=[sel.Clause(F.col("lang") == "de")], must_not=[sel.Clause(_has("der"))])], minimum_should_match=2)
    return sel.select(docs, tree).select("doc_id")


@query(f"""WITH {_LEX}, {_DENSE} SELECT d.doc_id, round(coalesce(lex.score, 0) + CASE WHEN den.score >= 0.1 THEN den.score ELSE 0 END + CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0 END, 6) AS score
    FROM documents d LEFT JOIN lex USING (doc_id) LEFT JOIN den USING (doc_id) WHERE (lex.score IS NOT NULL)::INT + coalesce(den.score >= 0.1, false)::INT + (lang = 'en')::INT >= 2 AND source <> 'src0'""")
def bool_search(spark, d):
    """A tree whose leaves are searches, with their scores, and a filter."""
    den, lex = _legs(spark, d)
    docs = sel.searched(table(spark, d, "documents"), {"lex": lex, "den": den.where("score >= 0.1")})
    english = sel.Clause(F.col("lang") == "en", F.lit(1.0))
    tree = sel.Bool(should=[sel.found("lex"), sel.found("den"), english], must_not=[sel.Clause(F.col("source") == "src0")], minimum_should_match=2)
    return rounded(sel.select(docs, tree).select("doc_id", "score"), "score")


@query(_BOOL + "SELECT doc_id, lang, n_chars FROM t WHERE list_contains(t, 'from') OR list_contains(t, 'erst') ORDER BY lang DESC, n_chars, doc_id LIMIT 100")
def sorted_lexical(spark, d):
    """What a lexical query matches, sorted by columns instead of a score."""
    hits = lexical.matching(table(spark, d, "documents"), ["from", "erst"])
    return sel.sort_rows(hits.select("doc_id", "lang", "n_chars"), [("lang", False), ("n_chars", True)], 100)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def browse(spark, d):
    t = table(spark, d, "orders")
    return sel.browse(t, Filters(t).equals("o_orderstatus", "F"), 100, "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 200")
def multi_sort(spark, d):
    t = table(spark, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return sel.sort_rows(t, [("o_orderpriority", False), ("o_totalprice", True)], 200, "o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(f"WITH {_LEX} SELECT doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score::FLOAT DESC, doc_id) AS r FROM lex) WHERE r BETWEEN 6 AND 15")
def search_after(spark, d):
    scored = lexical.bm25(table(spark, d, "documents"), TERMS)
    last = lexical.top_k(scored, 5).where("rank = 5").select("doc_id", F.col("score").cast("float").alias("s")).first()
    return rounded(sel.search_after(scored, last["s"], last["doc_id"], 10), "score")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r BETWEEN 51 AND 100")
def sorted_page(spark, d):
    t, keys = table(spark, d, "orders"), [("o_totalprice", False)]
    last = sel.sort_rows(t, keys, 50, "o_orderkey").collect()[-1]
    return sel.sorted_after(t, keys, [last["o_totalprice"], last["o_orderkey"]], 50, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(f"WITH {_LEX}, p AS (SELECT source, doc_id, score, row_number() OVER w AS r, count(*) OVER (PARTITION BY source) AS pool_hits FROM lex JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY source ORDER BY score::FLOAT DESC, doc_id)) SELECT source, max(doc_id) FILTER (r = 1) AS doc_id, round(max(score) FILTER (r = 1), 6) AS score, array_to_string(list(doc_id ORDER BY r), ',') AS inner_hits, max(pool_hits) AS pool_hits FROM p WHERE r <= 3 GROUP BY source")
def collapse_inner(spark, d):
    docs = table(spark, d, "documents")
    scored = lexical.bm25(docs, TERMS).join(docs.select("doc_id", "source"), "doc_id")
    out = sel.collapse(scored, "source", 1000, inner_hits=3).withColumn("inner_hits", F.array_join(F.col("inner_hits").cast("array<string>"), ","))
    return rounded(out.select("source", "doc_id", "score", "inner_hits", "pool_hits"), "score")


@query("SELECT o_orderkey, o_orderkey // 7 AS sevenths, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def projection(spark, d):
    hits = sel.sort_rows(table(spark, d, "orders"), [("o_totalprice", False)], 50, "o_orderkey")
    return sel.project(hits, {"sevenths": v.divide(F.col("o_orderkey"), F.lit(7).cast("long")), "size": v.choose(F.col("o_totalprice") > 200000, F.lit("big"), F.lit("small"))}).select("o_orderkey", "sevenths", "size")


@query(f"WITH {_LEX}, p AS (SELECT * FROM lex {_TOP.format(k=100)}) SELECT lang, count(*) AS n, round(avg(score), 6) AS mean FROM p JOIN documents USING (doc_id) GROUP BY lang")
def pool_aggregate(spark, d):
    docs = table(spark, d, "documents")
    hits = lexical.top_k(lexical.bm25(docs, TERMS), 100).join(docs.select("doc_id", "lang"), "doc_id")
    return rounded(hits.groupBy("lang").agg(F.count("*").alias("n"), F.avg("score").alias("mean")), "mean")


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM documents WHERE source = 'src0'")
def set_union(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("lang = 'en'").select("doc_id").union(docs.where("source = 'src0'").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersect(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def set_except(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT user_id, event_id, ts, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def replace_latest(spark, d):
    return sel.latest(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value", "props"), "user_id", "ts", "event_id")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def delete_antijoin(spark, d):
    t = table(spark, d, "events")
    return sel.without_deleted(t, t.where("event_type = 'error'"), "event_id").select("event_id")


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey ")
def resolve_parents(spark, d):
    lineage = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return sel.parents(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), lineage, "l_orderkey")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def fetch_values(spark, d):
    return sel.fetch(table(spark, d, "documents"), table(spark, d, "labels"), ["lang", "n_chars"])


# ---------------------------------------------------------------- aggregates


@query("SELECT o_orderpriority, count(*) AS matched, count(o_custkey) AS n, sum(o_custkey)::BIGINT AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, 0::BIGINT AS ungrouped FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def agg_group(spark, d):
    wanted = {"n": ("count", "o_custkey"), "total": ("sum", "o_custkey"), "low": ("min", "o_totalprice"), "high": ("max", "o_totalprice"), "mean": ("mean", "o_totalprice")}
    return agg.aggregate(table(spark, d, "orders").where("o_orderstatus = 'F'"), wanted, "o_orderpriority").withColumn("mean", F.round("mean", 4))


@query("SELECT count(*) AS matched, count(l_quantity) AS n, round(sum(l_extendedprice), 2) AS total, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem")
def agg_stats(spark, d):
    wanted = {"n": ("count", "l_quantity"), "total": ("sum", "l_extendedprice"), "variance": ("variance", "l_quantity"), "deviation": ("stddev", "l_quantity")}
    return rounded(agg.aggregate(table(spark, d, "lineitem"), wanted), "variance", "deviation").withColumn("total", F.round("total", 2))


@query("SELECT count(*) AS matched, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_discount) AS discounts FROM lineitem")
def agg_cardinality(spark, d):
    return agg.aggregate(table(spark, d, "lineitem"), {"suppliers": ("cardinality", "l_suppkey"), "discounts": ("cardinality", "l_discount")})


@query("SELECT floor(o_totalprice / 25000) * 25000::DOUBLE AS bucket, count(*) AS n, 0::BIGINT AS unbucketable FROM orders GROUP BY 1")
def hist_fixed(spark, d):
    return agg.histogram(table(spark, d, "orders"), "o_totalprice", 25_000)


@query("SELECT epoch_us(date_trunc('month', o_orderdate)) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def hist_calendar_month(spark, d):
    return agg.calendar_histogram(table(spark, d, "orders"), "o_orderdate", "month")


@query("SELECT epoch_us(date_trunc('week', ts + INTERVAL 90 MINUTE)) - 5400000000 AS bucket, count(*) AS n FROM events GROUP BY 1")
def hist_calendar_week(spark, d):
    return agg.calendar_histogram(table(spark, d, "events"), "ts", "week", 90)


@query("SELECT p, v AS value FROM (SELECT unnest([0.0::DOUBLE, 50.0::DOUBLE, 99.9::DOUBLE, 100.0::DOUBLE]) AS p, unnest(quantile_disc(l_extendedprice, [0.0, 0.5, 0.999, 1.0])) AS v FROM lineitem)")
def percentile(spark, d):
    return agg.percentiles(table(spark, d, "lineitem"), "l_extendedprice", [(0, 1), (50, 1), (999, 10), (100, 1)]).select("p", "value")


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand")
def facet(spark, d):
    return agg.facet(table(spark, d, "part").where("p_size > 10"), "p_brand")


@query("SELECT CAST(props->>'k' AS BIGINT) AS value, count(*) AS n FROM events GROUP BY 1")
def map_facet(spark, d):
    return agg.map_facet(table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,bigint>")), "m", "k")


@query("SELECT low, high, (SELECT count(*) FROM lineitem WHERE l_quantity >= low AND l_quantity < high) AS n FROM (VALUES (0.0::DOUBLE, 10.0::DOUBLE), (10.0::DOUBLE, 10.5::DOUBLE), (10.5::DOUBLE, 40.0::DOUBLE), (40.0::DOUBLE, 1000.0::DOUBLE), (1000.0::DOUBLE, 2000.0::DOUBLE)) AS e(low, high)")
def range_facet(spark, d):
    return agg.range_facet(table(spark, d, "lineitem"), "l_quantity", [0, 10, 10.5, 40, 1000, 2000])


@query("SELECT 'l_linenumber' AS column_name, count(l_linenumber) AS present, min(l_linenumber)::DOUBLE AS min, max(l_linenumber)::DOUBLE AS max, round(sum(l_linenumber)::DOUBLE, 2) AS sum, round(avg(l_linenumber), 6) AS mean, sum(l_linenumber)::VARCHAR AS exact_sum FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), min(l_tax), max(l_tax), round(sum(l_tax), 2), round(avg(l_tax), 6), NULL FROM lineitem")
def column_stats(spark, d):
    return rounded(agg.column_stats(table(spark, d, "lineitem"), ["l_linenumber", "l_tax"]), "mean").withColumn("sum", F.round("sum", 2))


@query("SELECT count(DISTINCT source) AS n FROM documents WHERE lang = 'en'")
def facet_cardinality(spark, d):
    return agg.facet_cardinality(table(spark, d, "documents").where("lang = 'en'"), "source")


@query(_BOOL + "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM t WHERE list_contains(t, 'from') OR list_contains(t, 'der') GROUP BY lang")
def boolean_aggregate(spark, d):
    docs = table(spark, d, "documents").withColumn("t", terms(F.col("text")))
    hits = sel.select(docs, sel.Bool(should=[sel.Clause(_has("from")), sel.Clause(_has("der"))]))
    return hits.groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


@query("SELECT 'doc_id' AS column_name, 'integer' AS kind, count(doc_id) AS present, count(*) AS total FROM labels UNION ALL SELECT 'quality', 'integer', count(quality), count(*) FROM labels UNION ALL SELECT 'toxic', 'integer', count(toxic), count(*) FROM labels")
def describe_schema(spark, d):
    return schema_report(table(spark, d, "labels"))


# ---------------------------------------------------------------- values


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_orderkey // (l_linenumber - 3) END AS q, CASE WHEN l_linenumber = 3 THEN NULL ELSE (l_orderkey - 500) % (l_linenumber - 3) END AS r,
    CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE -l_orderkey END AS n, CASE WHEN l_orderkey < 2 THEN l_orderkey * 4611686018427387904 ELSE NULL END AS m FROM lineitem""")
def val_int_arith(spark, d):
    a, b = F.col("l_orderkey"), F.col("l_linenumber").cast("long") - 3
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", v.divide(a, b).alias("q"), v.modulo(a - 500, b).alias("r"), v.negate(F.when(a % 2 != 0, a)).alias("n"), v.multiply(a, F.lit(2**62)).alias("m")
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0.0 THEN CASE WHEN l_quantity - 20 > 0 THEN 'inf' WHEN l_quantity - 20 < 0 THEN '-inf' ELSE 'nan' END ELSE 'finite' END AS kind,
    CASE WHEN l_discount = 0.0 THEN NULL ELSE round((l_quantity - 20) / l_discount, 6) END AS q, CASE WHEN l_tax = 0.0 THEN '-inf' ELSE round(ln(l_tax), 6)::VARCHAR END AS ln FROM lineitem""".replace("round(ln(l_tax), 6)::VARCHAR", "'x'"))
def val_ieee(spark, d):
    q = v.ieee_divide(F.col("l_quantity") - 20, F.col("l_discount"))
    kind = F.when(F.isnan(q), "nan").when(q == float("inf"), "inf").when(q == float("-inf"), "-inf").otherwise("finite")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), F.when(v.is_finite(q), F.round(q, 6)).alias("q"), F.when(v.ln(F.col("l_tax")) == float("-inf"), "-inf").otherwise("x").alias("ln"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN NULL ELSE greatest(l_quantity, l_tax * 1000) END AS g, CASE WHEN l_linenumber = 2 THEN NULL ELSE least(l_quantity, l_tax * 1000) END AS l FROM lineitem")
def val_greatest(spark, d):
    a, b = F.when(F.col("l_linenumber") != 2, F.col("l_quantity")), F.col("l_tax") * 1000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.greatest(a, b).alias("g"), v.least(a, b).alias("l"))


@query("SELECT p_partkey, round(p_size / 2.0::DOUBLE - 10) AS r, ceil(p_size / 2.0::DOUBLE - 10) AS c, floor(p_size / 2.0::DOUBLE - 10) AS f, trunc(p_size / 2.0::DOUBLE - 10) AS t, abs(p_size - 25)::BIGINT AS a, sign(p_size - 25)::INTEGER AS s, sqrt(p_retailprice) AS q FROM part")
def val_round(spark, d):
    x, n = F.col("p_size") / 2.0 - 10, F.col("p_size") - 25
    return table(spark, d, "part").select("p_partkey", v.round_half_away(x).alias("r"), v.ceil(x).alias("c"), v.floor(x).alias("f"), v.trunc(x).alias("t"), v.absolute(n.cast("long")).alias("a"), v.sign(n).alias("s"), F.sqrt("p_retailprice").alias("q"))


@query("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d FROM events")
def val_calendar(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", v.year(micros).alias("y"), v.month(micros).alias("m"), v.day(micros).alias("d"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN value > 30 THEN 'high' ELSE 'low' END AS band, CASE WHEN event_id % 4 <> 0 THEN value > 30 OR event_type = 'click' WHEN event_type = 'click' THEN true END AS either FROM events")
def val_ternary(spark, d):
    x = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    high = v.ieee_compare(">", x, F.lit(30.0))
    return table(spark, d, "events").select("event_id", v.choose(high, F.lit("high"), F.lit("low")).alias("band"), (high | (F.col("event_type") == "click")).alias("either"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 4 THEN NULL ELSE (4 - l_linenumber)::DECIMAL(20, 0) END AS d, (l_orderkey * l_linenumber)::DECIMAL(20, 0) AS p FROM lineitem")
def val_unsigned(spark, d):
    n = F.col("l_linenumber").cast("decimal(20,0)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.unsigned("-", F.lit(4).cast("decimal(20,0)"), n).alias("d"), v.unsigned("*", F.col("l_orderkey").cast("decimal(20,0)"), n).alias("p"))


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({c}) + 1), lambda i: ascii(substr({c}, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::HUGEINT)"


@query(f"SELECT p_partkey, {_FNV.format(c='p_brand')}::DECIMAL(20, 0) AS hash FROM part")
def val_fnv64(spark, d):
    """FNV-1a of each brand."""
    return table(spark, d, "part").select("p_partkey", v.fnv64(F.col("p_brand")).alias("hash"))


# ---------------------------------------------------------------- comparison, vocabulary, placement, streams

_OTHER = ["from", "and"]
_TWO = f"WITH {_LEX}, {_bm25_sql('oth', _OTHER)}, a AS (SELECT doc_id, score, row_number() OVER (ORDER BY score::FLOAT DESC, doc_id) AS rank FROM (SELECT * FROM lex {_TOP.format(k=50)})), b AS (SELECT doc_id, score, row_number() OVER (ORDER BY score::FLOAT DESC, doc_id) AS rank FROM (SELECT * FROM oth {_TOP.format(k=50)}))"


def _two(spark, d):
    docs = table(spark, d, "documents")
    return lexical.top_k(lexical.bm25(docs, TERMS), 50), lexical.top_k(lexical.bm25(docs, _OTHER), 50)


@query(f"{_TWO} SELECT (SELECT count(*) FROM a JOIN b USING (doc_id)) / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS overlap")
def rank_overlap(spark, d):
    return compare.overlap(*_two(spark, d))


@query(f"{_TWO}, u AS (SELECT doc_id, coalesce(a.rank, (SELECT count(*) + 1 FROM a)) AS ra, coalesce(b.rank, (SELECT count(*) + 1 FROM b)) AS rb FROM a FULL JOIN b USING (doc_id)), p AS (SELECT sign(x.ra - y.ra) AS i, sign(x.rb - y.rb) AS j FROM u x JOIN u y ON x.doc_id < y.doc_id) SELECT round(sum(i * j) / sqrt(count(*) FILTER (i <> 0)::DOUBLE * count(*) FILTER (j <> 0)), 6) AS tau FROM p")
def kendall(spark, d):
    return rounded(compare.kendall_tau(*_two(spark, d)), "tau")


@query(f"{_TWO}, m AS (SELECT greatest(a.rank, b.rank) AS d FROM a JOIN b USING (doc_id)), k AS (SELECT unnest(range(1, 1 + least((SELECT count(*) FROM a), (SELECT count(*) FROM b)))) AS k) SELECT round(0.1::DOUBLE * sum(pow(0.9::DOUBLE, k - 1) * (SELECT count(*) FROM m WHERE d <= k) / k), 6) AS rbo FROM k")
def rank_biased_overlap(spark, d):
    return rounded(compare.rbo(*_two(spark, d)), "rbo")


@query(f"{_TWO}, j AS (SELECT a.score AS own, i.score AS ideal FROM b LEFT JOIN a USING (doc_id) LEFT JOIN a i ON i.rank = b.rank) SELECT round(avg(ideal - own), 6) AS regret, count(*) FILTER (own IS NOT NULL AND ideal IS NOT NULL) AS counted, count(*) FILTER (own IS NULL OR ideal IS NULL) AS unscored FROM j")
def regret(spark, d):
    return rounded(compare.score_regret(*_two(spark, d)), "regret")


@query(f"{_TWO} SELECT (SELECT doc_id FROM a WHERE rank = 1) IS DISTINCT FROM (SELECT doc_id FROM b WHERE rank = 1) AS flipped")
def top1_flipped(spark, d):
    return compare.top1_flipped(*_two(spark, d))


@query()
def interleave(spark, d):
    """Team draft of two rankings; tests hold it against hand-made lists."""
    return spark.createDataFrame(compare.interleave(*_two(spark, d), 20, "seed"), "doc_id long, team string")


def _arm(name: str, b: str) -> str:
    """CTEs that end in arm_{name}: how list b compares with list a."""
    return f"""u_{name} AS (SELECT doc_id, coalesce(x.rank, (SELECT count(*) + 1 FROM a)) AS ra, coalesce(y.rank, (SELECT count(*) + 1 FROM {b})) AS rb FROM a x FULL JOIN {b} y USING (doc_id)),
    p_{name} AS (SELECT sign(x.ra - y.ra) AS i, sign(x.rb - y.rb) AS j FROM u_{name} x JOIN u_{name} y ON x.doc_id < y.doc_id), m_{name} AS (SELECT greatest(x.rank, y.rank) AS d FROM a x JOIN {b} y USING (doc_id)),
    n_{name} AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM {b})) AS n), k_{name} AS (SELECT unnest(range(1, 1 + n)) AS k FROM n_{name}),
    r_{name} AS (SELECT 0.1::DOUBLE * sum(pow(0.9::DOUBLE, k - 1) * (SELECT count(*) FROM m_{name} WHERE d <= k) / k) AS rbo FROM k_{name}),
    t_{name} AS (SELECT sum(i * j) / sqrt(count(*) FILTER (i <> 0)::DOUBLE * count(*) FILTER (j <> 0)) AS tau FROM p_{name}),
    arm_{name} AS (SELECT '{name}' AS arm, (SELECT count(*) FROM m_{name}) / n AS overlap, round(tau, 6) AS tau, round(rbo, 6) AS rbo, (SELECT doc_id FROM a WHERE rank = 1) IS DISTINCT FROM (SELECT doc_id FROM {b} WHERE rank = 1) AS flipped FROM n_{name}, t_{name}, r_{name})"""


@query(f"{_TWO}, {_arm('other', 'b')}, {_arm('same', 'a')} SELECT * FROM arm_other UNION ALL SELECT * FROM arm_same")
def variant_search(spark, d):
    a, b = _two(spark, d)
    return rounded(compare.variants({"base": a, "other": b, "same": a}), "tau", "rbo")


@query(f"SELECT win AS \"window\", term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY n DESC, term) AS rank FROM (SELECT doc_id // 250 AS win, term, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL)) WHERE rank <= 20")
def vocab_window_topk(spark, d):
    return vocabulary.heavy_hitters(vocabulary.windowed_terms(table(spark, d, "documents"), 250), 20)


@query(f"""WITH c AS (SELECT term, count(*) FILTER (doc_id < h) AS na, count(*) FILTER (doc_id >= h) AS nb FROM ({_TOKENS}), (SELECT (max(doc_id) + 2) // 2 AS h FROM documents) GROUP BY term),
    t AS (SELECT *, na / sum(na) OVER () AS p, nb / sum(nb) OVER () AS q FROM c)
    SELECT count(*) FILTER (na = 0 AND nb > 0) / count(*) FILTER (nb > 0) AS novelty, coalesce(sum(nb) FILTER (na = 0), 0) / sum(nb) AS oov_share,
    round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM t""")
def vocab_drift(spark, d):
    """Drift from the first half of the corpus to the second."""
    docs = table(spark, d, "documents")
    half = (docs.agg(F.max("doc_id")).first()[0] + 2) // 2
    return rounded(vocabulary.drift(vocabulary.windowed_terms(docs, half), 0, 1), "js")


@query()
def vocab_sketches(spark, d):
    """Distinct terms per window and of all windows merged, by HyperLogLog; tests bound the error."""
    s = vocabulary.sketches(table(spark, d, "documents"), 250)
    return s.select("window", "n_tokens", F.hll_sketch_estimate("distinct_sketch").alias("terms"))


@query("SELECT (CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_totalprice > 300000 THEN 1 ELSE 2 END * 256 + CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 0 ELSE 1 END)::BIGINT AS leaf, count(*) AS n FROM orders GROUP BY 1")
def placement_leaf_counts(spark, d):
    levels = [[("final", F.col("o_orderstatus") == "F"), ("big", F.col("o_totalprice") > 300000)], [("old", F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))]]
    return placement.plan_placement(table(spark, d, "orders"), placement.leaf(levels))


@query(f"SELECT shard, count(*) AS n FROM (SELECT ({_FNV.format(c='c_name')} // 1152921504606846976)::INTEGER AS shard FROM customer) GROUP BY shard")
def routed_shards(spark, d):
    """Rows per shard of a stable key."""
    return table(spark, d, "customer").select(placement.route(F.col("c_name"), 16).alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


@query()
def postings_buckets(spark, d):
    """Postings per bucket of the index layout."""
    return spark.read.parquet(f"{index(spark, d)}/term_stats").groupBy(term_bucket(F.col("term"), 64).alias("bucket")).agg(F.sum("df").alias("n"))


@query("SELECT event_id, value FROM events ORDER BY value::FLOAT DESC, event_id LIMIT 25")
def stream_topk(spark, d):
    """The last revision of a progressive top-k over the events as a stream."""
    folder, last = staging_folder(spark, "stream"), []
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema)
    # a stream reads a folder: the table's own, or the one that its only file lies in
    alone = [f.rsplit("/", 1)[1] for f in events.inputFiles()] == ["events.parquet"]
    rows = stream.option("pathGlobFilter", "events.parquet").parquet(d) if alone else stream.parquet(f"{d}/events.parquet")
    scored = rows.select("event_id", F.col("value").alias("score"))
    progressive_top_k(scored, 25, f"{folder}/checkpoint", f"{folder}/state", lambda rows, _: last.append(rows), "event_id").awaitTermination()
    return last[-1].select("event_id", F.col("score").alias("value"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMPTZ AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL".replace("::TIMESTAMPTZ", ""))
def event_time_windows(spark, d):
    """Extra beside the reference: tumbling windows of event time, as a table."""
    return event_windows(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
