"""The registered query of each operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.llm.chat_format import format_chat, masked_text, read_chat
from sparkrank.llm.decontaminate import find_contamination
from sparkrank.llm.exact_dedup import dedup_exact
from sparkrank.llm.mixing import mix_sources
from sparkrank.llm.near_dedup import near_classes
from sparkrank.llm.substring_dedup import remove_repeated_windows
from sparkrank.llm.suffix_dedup import remove_repeated_bytes
from sparkrank.llm.toxicity import fit, in_training_fold, score_documents
from sparkrank.llm.url_filter import filter_urls
from sparkrank.llm.warc import read_warc, write_warc

#: The rules of op9: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The text of the two turns of conversation -7, which looks like the template.
LOOKALIKE = "\\### Assistant: </turn> ok"


#: The mixture of op6 and of the pipeline: weights of the tree's nodes, "*" for any name; nodes not listed weigh 1.
MIX_WEIGHTS = {
    ("crawl",): 2, ("web",): 3, ("curated",): 5,
    ("*", "en"): 6, ("*", "de"): 2, ("*", "fr"): 2, ("curated", "es"): 3,
    ("*", "*", "src7"): 4, ("*", "en", "src12"): 3, ("*", "*", "src19"): 0,
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.75, 2, 20


def domain_of() -> Column:
    """The domain of a document by its source: src0 is a crawl, sources of one digit are web, the others curated."""
    return F.when(F.col("source") == "src0", "crawl").when(F.length("source") == 4, "web").otherwise("curated")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages"))).drop("payload")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), with_text=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~in_training_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), with_text=False)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), domain_of(), MIX_WEIGHTS, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents")).drop("n_chunks")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(LOOKALIKE))
    chats = format_chat(turns.union(extra))
    chats = chats.select("conv_id", "formatted", read_chat(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_warc": op2_warc,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_chat_formatting": op10_chat_formatting,
}

_MIX_SQL = r"""
    WITH d AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN length(source) = 4 THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, '') AS lang,
                      coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
    -- a leaf of weight 0 holds nothing that may be drawn
    leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 2 AS cap FROM d WHERE source <> 'src19' GROUP BY ALL),
    -- a child whose share of the budget exceeds what it holds is full; the others share the rest
    n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'crawl' THEN 2 WHEN 'web' THEN 3 ELSE 5 END AS w,
                  least((SELECT (sum(n_tokens) * 0.75::DOUBLE)::DOUBLE FROM d), (SELECT sum(cap) FROM leaf))::DOUBLE AS b0 FROM leaf GROUP BY domain),
    f1 AS (SELECT *, floor(b0)::BIGINT AS budget, cap * sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                  <= (floor(b0)::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM n1),
    g1 AS (SELECT domain, CASE WHEN is_full THEN cap ELSE ((budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) * w) // sum(w) FILTER (NOT is_full) OVER () END AS budget FROM f1),
    n2 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, CASE WHEN domain = 'curated' AND lang = 'es' THEN 3 WHEN lang = 'en' THEN 6 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END AS w FROM leaf GROUP BY ALL),
    f2 AS (SELECT n2.*, budget, cap * sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                  <= (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM n2 JOIN g1 USING (domain)),
    g2 AS (SELECT domain, lang, CASE WHEN is_full THEN cap ELSE ((budget - coalesce(sum(cap) FILTER (is_full) OVER p, 0)) * w) // sum(w) FILTER (NOT is_full) OVER p END AS budget FROM f2 WINDOW p AS (PARTITION BY domain)),
    n3 AS (SELECT leaf.*, CASE WHEN source = 'src19' THEN 0 WHEN source = 'src7' AND NOT (lang = 'en' AND source = 'src12') THEN 4 WHEN lang = 'en' AND source = 'src12' THEN 3 ELSE 1 END AS w FROM leaf),
    f3 AS (SELECT n3.*, budget, cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                  <= (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM n3 JOIN g2 USING (domain, lang) WHERE w > 0),
    g3 AS (SELECT domain, lang, source, tokens, CASE WHEN is_full THEN cap ELSE ((budget - coalesce(sum(cap) FILTER (is_full) OVER p, 0)) * w) // sum(w) FILTER (NOT is_full) OVER p END AS given
           FROM f3 WINDOW p AS (PARTITION BY domain, lang)),
    plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 1 END AS epochs, given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS rest FROM g3),
    own AS (SELECT d.*, epochs::BIGINT AS epochs, rest, sha256('20:' || epochs::BIGINT || ':' || doc_id) AS place FROM d JOIN plan USING (domain, lang, source)),
    part AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM own)
    SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, epochs)) AS epoch FROM own
    UNION ALL SELECT doc_id, domain, lang, source, n_tokens, epochs FROM part WHERE rest > 0 AND upto <= rest"""

ORACLES = {
    "op1_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM benchmark),
        s AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
        n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
        ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
        c AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN s USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, c AS n_common, n AS n_shingles, c / n AS containment FROM c JOIN n USING (item_id) WHERE c >= 0.8 * n - 1e-9""",
    "op2_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM m""",
    "op6_mixing": _MIX_SQL,
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
        first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM win JOIN first USING (s) WHERE doc_id > m), range(13) AS r(k)),
        words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL), '') AS t
                 FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id),
        spans AS (SELECT doc_id, count(*) AS n_spans FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.p = g.p - 1) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
    "op9_url_filters": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        j AS (SELECT page_id, host, path, CASE
                WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
                WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
                WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
                WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
                WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op10_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        n AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS prev, FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        -- escaped characters count twice; a marker opens each block, another stands between the turns of one
        e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<#:]', '', 'g')) AS len,
                     CASE WHEN prev = role THEN 6 ELSE 4 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + 2 + 8 END AS marks FROM n)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(len + marks)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
}
