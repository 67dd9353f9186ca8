"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewaylens.llm import (
    decontaminate, language_id, lexical_search, line_dedup, lm_scoring, pii, prefix_trie, sentencepiece_suffix, simhash_dedup, topk,
    toxicity, url_filter, warc,
)
from gatewaylens.llm.common import read_table, remainder
from gatewaylens.session import written

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    """doc_id, ids, n_tokens, decoded, round_trip (whether the decoded text is the text; null texts have nulls)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.md5("text").alias("digest"))
    encoded = sentencepiece_suffix.encode(docs, model, keep=["doc_id", "digest"])
    decoded = sentencepiece_suffix.decode(encoded, model)
    return decoded.select(
        "doc_id", "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_tokens"), "decoded",
        (F.md5("decoded") == F.col("digest")).alias("round_trip"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(language_id.training_rows(docs))
    held_out = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return language_id.identify(held_out, model, keep=["doc_id", "held_out"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(warc.planned(read_table(spark, sf_dir, "pages")))
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "word", "distance", F.round("similarity", 6).alias("similarity"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), n_removed="n_removed")
    return kept.select("doc_id", "n_removed", "text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs)).withColumn("known", F.filter("spans", lambda s: s["base"]))
    def count(kind: str) -> Column:
        return F.size(F.filter("known", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), *map(count, pii.KINDS), F.sha2(_spelled("known"), 256).alias("base_sha256"), _spelled("spans").alias("spans"))


def _spelled(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


RULES = [  # fixed values
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.build(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = lm_scoring.score_documents(docs, remainder(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op12_toxicity(spark: SparkSession, sf_dir: str, least: float = 0.7) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    marked = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = toxicity.score(marked, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = written(prefix_trie.coded_turns(read_table(spark, sf_dir, "conversations")), "coded")
    conv = F.col("conv")
    turns, lengths = prefix_trie.rebuilt(coded, shared=F.crc32(conv.cast("string").cast("binary")) % 4, base=conv - conv % 20)
    return prefix_trie.prefix_trie(turns, lengths)


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_sentencepiece, op2_language_id, op3_warc, op4_topk, op5_decontaminate, op6_line_dedup, op7_simhash, op8_pii,
    op9_url_filter, op10_lm_scoring, op11_lexical_search, op12_toxicity, op13_prefix_trie)}

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(text, {_CAPITALS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
# CRC-32 of a number's decimal digits, bit by bit (polynomial 0xEDB88320).
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                          lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)))"""

SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000
                             THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS newest FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN newest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN newest <> page_id THEN newest END AS refers_to
        FROM m""",
    "op4_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_url_filter": """
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        rules(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                                          ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        best AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict
                 FROM h JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
        SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM h LEFT JOIN best ON h.page_id = best.page_id""",
    "op11_lexical_search": f"""
        WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
        c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0),
        tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
        df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, c),
        q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
              FROM q JOIN tf USING (t) JOIN w USING (t), c GROUP BY item_id, doc_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_prefix_trie": f"""
        WITH t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n
                   FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list(said ORDER BY n) AS said, {_CRC32} % 4 AS h FROM t GROUP BY conv_id),
        full_ AS (SELECT o.conv_id, list_concat(coalesce(b.said[1:o.h], []), o.said[o.h + 1:]) AS said
                  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
        m AS (SELECT conv_id, len(said) AS len, depth, said[1:depth] AS said FROM (SELECT *, unnest(range(len(said) + 1)) AS depth FROM full_)),
        n AS (SELECT said, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
              FROM m GROUP BY said, depth),
        k AS (SELECT said[1:depth - 1] AS said, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
        v AS (SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE
                (n_convs - 1) * len(regexp_extract_all(n.said[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saved
              FROM n LEFT JOIN k ON k.depth = n.depth AND k.said = n.said),
        a AS (SELECT said[1:up] AS said, up AS depth, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
              FROM (SELECT *, unnest(range(depth + 1)) AS up FROM v) GROUP BY ALL)
        SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, a.leaves AS n_leaves,
               CAST(a.saved AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM v JOIN a ON a.depth = v.depth AND a.said = v.said
        LEFT JOIN n p ON p.depth = v.depth - 1 AND p.said = v.said[1:v.depth - 1]""",
}
