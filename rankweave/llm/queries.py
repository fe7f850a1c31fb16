"""The queries of this subpackage, one an operator, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, importance, langid, line_dedup, multi_index, ngram_join, packing, pii, sharding, topk, toxicity, url_filter, word_runs

#: Host and path rules of the URL query.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links at cosine 0.9, its component, and whether it is kept."""
    return multi_index.similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of distinct 5-word shingles and the least id of its near-duplicates."""
    found = ngram_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), words=5, percent=75)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page's url."""
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 4096 tokens and its place there."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(documents, public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the documents that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    out = bpe.decode(coded.select("doc_id", "ids"), path, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity, grade and verdict of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.grade(documents, model).select("doc_id", "severity", "grade", "toxic")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every query (vec_id divisible by 50) with all other vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5, scale=256)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans of every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.kind.isin(*pii.BASE))
    counts = [pii.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined_spans(base), 256).alias("base_sha256"), pii.joined_spans(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s.score)).alias("top_score"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, text digest, shard and place in it; the law is near-equal bytes."""
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those it loses to documents with the same ones, and a digest of the rest."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), documents=5, least=40)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def looped_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of a document, the tail of every tenth by the id's crc32 replaced by repetitions of its beginning."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, its longest one, and digests of all runs and of the words without repetitions."""
    found = word_runs.word_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), least=12, rewrite=looped_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    found = found.withColumn("best", best).withColumn("listed", F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    exponent = F.expr("(1000 * best.length) div (-best.period)")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight and score towards the benchmark's texts, and the rank of those drawn."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = importance.resample(documents, table(spark, sf_dir, "benchmark").select("text"), percent=10, min_words=20, longest=1, buckets=10000, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_URL_SQL = """
WITH rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rn FROM rest),
hits AS (SELECT p.rn, arg_max(struct_pack(rule := rh || rp, verdict := rv), length(rh || rp)) AS b FROM parts p JOIN rules
  ON (p.host = rh OR suffix(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY p.rn)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (rn)
"""


def queries() -> dict:
    return {"op1_multi_index": op1_multi_index, "op2_ngram_join": op2_ngram_join, "op3_url_filter": op3_url_filter, "op4_packing": op4_packing, "op5_langid": op5_langid, "op6_byte_bpe": op6_byte_bpe, "op7_toxicity": op7_toxicity, "op8_top_k": op8_top_k, "op9_pii": op9_pii, "op10_sharding": op10_sharding, "op11_line_dedup": op11_line_dedup, "op12_word_runs": op12_word_runs, "op13_importance": op13_importance}


_REACH_SQL = """
reach(a, b) AS (SELECT DISTINCT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

_VECTOR_SQL = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
good AS (SELECT id, v FROM nodes WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),{_REACH_SQL}
SELECT n.id AS vec_id, coalesce(l.n, 0) AS n_links, r.component_id, n.id = r.component_id AS kept FROM nodes n JOIN roots r ON n.id = r.id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = n.id
"""

_JACCARD_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
nodes AS (SELECT id, len(s) AS n FROM sets), flat AS (SELECT id, unnest(s) AS g FROM sets),
links AS (SELECT x.id AS a, y.id AS b FROM flat x JOIN flat y ON x.g = y.g AND x.id <> y.id JOIN nodes p ON p.id = x.id JOIN nodes q ON q.id = y.id
  GROUP BY x.id, y.id HAVING 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))),{_REACH_SQL}
SELECT n.id AS doc_id, n.n AS n_shingles, r.component_id FROM nodes n JOIN roots r ON n.id = r.id
"""

_TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scores WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_LINES_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rn, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT rn) >= 5),
judged AS (SELECT rn, line, i, c.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM c.keeper AS gone FROM keyed LEFT JOIN common c ON keyed.k = c.k)
SELECT any_value(d.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged JOIN docs d USING (rn) GROUP BY rn
"""

_IMPORTANCE_SQL = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY n) AS t FROM range(256) r(n)),
docs AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
marks AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
raw AS (SELECT rn, w, count(*) AS n FROM (SELECT rn, unnest(w) AS w FROM docs) GROUP BY rn, w),
goal AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM marks) GROUP BY w),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM raw UNION SELECT w FROM goal)),
bucketed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(x, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, i + 1, 1)) - 1 AS BIGINT))), lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS BIGINT) + 1])), 4294967295) % 10000 AS b FROM vocabulary, crc),
s AS (SELECT b, sum(n) AS n FROM raw JOIN bucketed USING (w) GROUP BY b), t AS (SELECT b, sum(n) AS n FROM goal JOIN bucketed USING (w) GROUP BY b),
gain AS (SELECT r.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS g FROM range(10000) r(b) LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b),
weights AS (SELECT rn, CAST(sum(n * g) AS BIGINT) AS weight FROM raw JOIN bucketed USING (w) JOIN gain USING (b) GROUP BY rn),
scored AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM docs LEFT JOIN weights USING (rn)),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r, count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * able // 100 THEN r END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": _LINES_SQL, "op13_importance": _IMPORTANCE_SQL, "op1_multi_index": _VECTOR_SQL, "op2_ngram_join": _JACCARD_SQL, "op3_url_filter": _URL_SQL, "op8_top_k": _TOP_K_SQL}
