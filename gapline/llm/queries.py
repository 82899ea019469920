"""The opN queries: each applies its operator to the whole of its table, and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import chat, embedding_dedup, langid, minhash, mixing, packing, quality, topk, url_filter, warc
from gapline.llm.common import cut

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
CHAT_SCHEMAS = {
    "reply": {"required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 5}}, "additionalProperties": False},
    "search": {"required": ["limit", "query"], "properties": {"limit": {"type": "integer", "minimum": 1, "maximum": 30}, "query": {"type": "string", "minLength": 1, "maxLength": 160}}, "additionalProperties": False},
}



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op2_warc_index_merge(spark, sf_dir):
    found = warc.captures(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def url_labels(spark, sf_dir) -> DataFrame:
    """``url`` and ``bad`` of pages whose document is labelled: a page's document is the number in its path."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint)")
    return table(spark, sf_dir, "pages").select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", "bad")


def op4_url_filter(spark, sf_dir):
    mined = url_filter.mine(url_labels(spark, sf_dir))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, mined).select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs.where(~out), table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model, 0.3).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = cut(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), F.md5("text").alias("digest")))
    return mixing.mix(sizes, size=F.col("size"), digest=F.col("digest")).select("doc_id", "size", "source_size", "target", "taken")


def op7_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op8_tool_call_linking(spark, sf_dir):
    """User turns are calls, of ``search`` if the text has a comma, else of ``reply``; assistant turns are results of the turn before them.

    Ids are those of turns, so they repeat in each conversation; a turn with a null conversation or number has a null id. Of two
    calls in a row (two turns apart) the later one waits for the result of the earlier, but a search waits for the call after it
    if that has the shorter text. Turns of other roles (system, null) are neither calls nor results.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ident = lambda turn: F.when(F.col("conv_id").isNotNull(), F.concat(F.lit("call_"), turn.cast("string")))
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    search = F.coalesce(F.contains("text", F.lit(",")), F.lit(False))
    name = F.when(search, "search").otherwise("reply")
    arguments = F.when(search, F.to_json(F.struct(words.alias("limit"), F.col("text").alias("query")))).otherwise(F.to_json(F.struct("turn", "text")))
    calls = turns.where("role = 'user'").select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.length("text").alias("size"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    # of a turn given more than once the first by name and size counts
    each = calls.where("call_id is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("name", F.coalesce("size", F.lit(0)).alias("size"))).alias("x")).select("conv_id", "turn", "x.*")
    pairs = chat.hash_join(each, each.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("size").alias("next_size")), ["conv_id", "turn"])
    this, after = (F.concat(F.lit("call_"), (F.col("turn") + k).cast("string")) for k in (0, 2))
    back = (F.col("name") == "search") & (F.col("next_size") < F.col("size"))
    depends = pairs.select("conv_id", F.when(back, after).otherwise(this).alias("before"), F.when(back, this).otherwise(after).alias("after"))
    return chat.link(calls, results, CHAT_SCHEMAS, depends)


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embedding_near_dedup, op2_warc_index_merge, op3_language_id, op4_url_filter, op5_quality, op6_mixing, op7_minhash_near_dedup, op8_tool_call_linking, op9_packing, op10_top_k, pipeline)
}

ORACLE_SQL = {
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v
  WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN d ON v.vec_id = d.a
""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5(text) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS stop FROM s),
p AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER b, 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY stop::DOUBLE / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(level) AS level FROM p WHERE stop >= level * weight),
t AS (SELECT w.source, w.source_size, least(w.stop::DOUBLE, l.level * w.weight) AS target FROM w, l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|' || coalesce(d.digest, '') || '|6'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
    "op2_warc_index_merge": r"""
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
q AS (
  SELECT page_id, url, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest AS g, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest),
k AS (
  SELECT q.*, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to,
    regexp_replace(split_part(regexp_replace(coalesce(url, ''), '^.*?://', ''), '#', 1), '^([^/?]*).*$', '\1') AS h0,
    split_part(regexp_replace(coalesce(url, ''), '^.*?://', ''), '#', 1) AS rest
  FROM q LEFT JOIN f ON payload_digest = g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(lower(h0), '^www[0-9]*\.', ''), '.')), ',') || ')' ||
    CASE WHEN substr(rest, len(h0) + 1) = '' THEN '/' ELSE lower(substr(rest, len(h0) + 1)) END AS url_key,
  strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 315360000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM k
""",
    "op8_tool_call_linking": """
WITH RECURSIVE c0 AS (
  SELECT conv_id, turn, CASE WHEN conv_id IS NOT NULL THEN 'call_' || turn END AS call_id, text, coalesce(contains(text, ','), false) AS search,
    len(text) - len(replace(text, ' ', '')) + 1 AS words FROM conversations WHERE role = 'user'),
c AS (
  SELECT *, CASE WHEN search THEN 'search' ELSE 'reply' END AS name,
    CASE WHEN search THEN '{"limit":' || words || ',"query":' || to_json(text)::VARCHAR || '}' WHEN text IS NULL THEN '{"turn":' || turn || '}'
      ELSE '{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}' END AS arguments,
    CASE WHEN search THEN words <= 30 AND len(text) <= 160 ELSE coalesce(len(text) >= 1 AND turn BETWEEN 0 AND 5, false) END AS valid,
    CASE WHEN call_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, CASE WHEN search THEN 'search' ELSE 'reply' END, text) END AS nth FROM c0),
r0 AS (SELECT conv_id, turn, CASE WHEN conv_id IS NOT NULL THEN 'call_' || (turn - 1) END AS call_id, text FROM conversations WHERE role = 'assistant'),
r AS (SELECT *, CASE WHEN call_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text) END AS nth FROM r0),
x AS (
  SELECT coalesce(c1.conv_id, r1.conv_id) AS conv_id, coalesce(c1.call_id, r1.call_id) AS call_id, c1.turn AS call_turn, r1.turn AS result_turn, c1.name, c1.arguments, r1.text AS content,
    coalesce(c1.valid, false) AS valid, CASE WHEN c1.name IS NULL THEN 'orphan' WHEN r1.nth IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM (SELECT * FROM c WHERE nth = 1) c1 FULL JOIN (SELECT * FROM r WHERE nth = 1) r1 ON c1.conv_id = r1.conv_id AND c1.call_id = r1.call_id),
e0 AS (SELECT conv_id, turn, min((CASE WHEN search THEN 1 ELSE 0 END) * 1000000000 + coalesce(len(text), 0)) AS k FROM c0 WHERE call_id IS NOT NULL GROUP BY ALL),
dep AS (
  SELECT a.conv_id, a.turn, a.k >= 1000000000 AND b.k % 1000000000 < a.k % 1000000000 AS back FROM e0 a JOIN e0 b ON a.conv_id = b.conv_id AND a.turn + 2 = b.turn),
node AS (
  SELECT conv_id || '|c' || call_id AS id, call_turn AS turn FROM x WHERE conv_id IS NOT NULL AND call_id IS NOT NULL AND call_turn IS NOT NULL
  UNION ALL SELECT conv_id || '|r' || call_id, result_turn FROM x WHERE conv_id IS NOT NULL AND call_id IS NOT NULL AND result_turn IS NOT NULL),
edge AS (
  SELECT conv_id || '|c' || call_id AS a, conv_id || '|r' || call_id AS b FROM x WHERE status = 'linked'
  UNION ALL SELECT conv_id || '|rcall_' || (turn + CASE WHEN back THEN 2 ELSE 0 END), conv_id || '|ccall_' || (turn + CASE WHEN back THEN 0 ELSE 2 END) FROM dep),
walk AS (
  SELECT id, turn AS top, 0::BIGINT AS far FROM node
  UNION SELECT n.id, w.top, w.far + 1 FROM walk w JOIN edge e ON w.id = e.a JOIN node n ON n.id = e.b),
place AS (SELECT id, max(top) AS turn, arg_max(far, (top, far)) AS level FROM walk GROUP BY id),
every AS (
  SELECT x.*, p.turn AS call_place, p.level AS call_level, q.turn AS result_place, q.level AS result_level FROM x
  LEFT JOIN place p ON p.id = conv_id || '|c' || call_id LEFT JOIN place q ON q.id = conv_id || '|r' || call_id
  UNION ALL BY NAME SELECT conv_id, call_id, turn AS call_turn, name, arguments, valid, 'repeated_call' AS status FROM c WHERE nth > 1
  UNION ALL BY NAME SELECT conv_id, call_id, turn AS result_turn, text AS content, false AS valid, 'repeated_result' AS status FROM r WHERE nth > 1)
SELECT conv_id, call_id, call_turn, result_turn, call_place, call_level, result_place, result_level, status, valid,
  '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || coalesce(to_json(call_id)::VARCHAR, 'null') || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null')
    || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS record
FROM every
""",
}
