"""Every query of the library with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Options
from ..functions import scalars as S
from ..operators import chunkers as C
from ..operators import numbering, routing, stats, tables, vector_index, vectors
from ..sources.files import table
from ..sources.streams import shared_folder
from ..streaming import microbatch
from . import pipelines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def logs(spark: SparkSession, d: str) -> DataFrame:
    return stats.event_logs(table(spark, d, "events"))


LOGS = """WITH logs AS (SELECT event_id, event_type AS topic, user_id % 4 AS group_id, user_id, ts AS started_at,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'completed' END AS status,
 CASE WHEN event_type NOT IN ('error', 'view') THEN ts + to_microseconds(cast(round(value * 1000000) AS bigint)) END AS completed_at FROM events) """
CHARACTER = r"""WITH RECURSIVE w AS (
 SELECT doc_id, text, length(text) AS n, 0 AS s, cast(NULL AS integer) AS e, 0 AS step FROM documents
 UNION ALL
 SELECT doc_id, text, n, CASE WHEN e IS NULL THEN 0 WHEN e - 300 > s THEN e - 300 ELSE e END, x, step + 1 FROM (
  SELECT doc_id, text, n, s, e, step, p, CASE WHEN e0 < n AND k > 0 THEN p + k ELSE e0 END AS x FROM (
   SELECT *, CASE WHEN e0 < n THEN length(regexp_extract(substring(text, p + 2, e0 - p), '^(?s:.*)[ \n\t.,!?;:]')) ELSE 0 END AS k FROM (
    SELECT *, least(p + 1200, n) AS e0 FROM (SELECT *, CASE WHEN e IS NULL THEN 0 WHEN e - 300 > s THEN e - 300 ELSE e END AS p FROM w) WHERE p < n)))),
pieces AS (SELECT doc_id, s, e, regexp_replace(substring(text, s + 1, e - s), '^\s+|\s+$', '', 'g') AS t FROM w WHERE e IS NOT NULL),
chunks AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1 AS bigint) AS chunk_index, t AS text_content, cast(s AS bigint) AS char_start, cast(e AS bigint) AS char_end FROM pieces WHERE t <> '') """


@query(CHARACTER + "SELECT doc_id, chunk_index, text_content, char_start, char_end FROM chunks")
def chunk_character(spark, d):
    return C.chunk(docs(spark, d)).drop("chunk_id")


@query(CHARACTER + "SELECT doc_id, count(*) AS n_chunks, cast(sum(length(text_content)) AS bigint) AS sum_chars, cast(min(length(text_content)) AS bigint) AS min_chars, cast(max(length(text_content)) AS bigint) AS max_chars, round(avg(length(text_content)), 6) AS avg_chars FROM chunks GROUP BY doc_id")
def chunk_character_stats(spark, d):
    a = C.chunk_arrays(docs(spark, d)).select("doc_id", F.transform("chunks", lambda c: F.length(c["text_content"]).cast("long")).alias("n")).where(F.size("n") > 0)
    total = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)
    return a.select("doc_id", F.size("n").cast("long").alias("n_chunks"), total.alias("sum_chars"), F.array_min("n").alias("min_chars"), F.array_max("n").alias("max_chars"), F.round(total / F.size("n"), 6).alias("avg_chars"))


def _coverage_sql(ctes: str, spans: str) -> str:
    """Coverage of the spans (doc_id, char_start, char_end), with the lost ranges as text."""
    return ctes + f""", spans AS ({spans}), m AS (SELECT *, coalesce(max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM spans),
 ends AS (SELECT doc_id, cast(length(text) AS bigint) AS n, coalesce((SELECT max(char_end) FROM spans s WHERE s.doc_id = d.doc_id), 0) AS e FROM documents d),
 gaps AS (SELECT doc_id, b AS x, char_start AS y FROM m WHERE char_start > b UNION ALL SELECT doc_id, e, n FROM ends WHERE n > e),
 lost AS (SELECT doc_id, string_agg(x || '-' || y, ',' ORDER BY x) AS t FROM gaps GROUP BY doc_id),
 sums AS (SELECT doc_id, cast(sum(char_end - char_start) AS bigint) AS c, cast(sum(greatest(char_end - greatest(char_start, b), 0)) AS bigint) AS s FROM m GROUP BY doc_id)
 SELECT doc_id, n AS n_chars, coalesce(c, 0) AS covered, coalesce(s, 0) AS spanned, e AS last_end, coalesce(s, 0) < 0.95 * n AS lossy, coalesce(t, '') AS lost FROM ends LEFT JOIN sums USING (doc_id) LEFT JOIN lost USING (doc_id)"""


def _as_text(covered: DataFrame) -> DataFrame:
    return covered.withColumn("lost", F.array_join(F.transform("lost", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ","))


@query(_coverage_sql(CHARACTER, "SELECT doc_id, char_start, char_end FROM chunks"))
def chunk_coverage(spark, d):
    return _as_text(C.coverage_of(C.chunk_arrays(docs(spark, d), contents=False)))


@query(_coverage_sql(CHARACTER, "SELECT doc_id, char_start, char_end FROM chunks WHERE chunk_index % 3 <> 1"))
def chunk_coverage_lost(spark, d):
    """What is lost where every third chunk is."""
    return _as_text(C.coverage_of(C.chunk_arrays(docs(spark, d), contents=False), keep=lambda c: c["chunk_index"] % 3 != 1))


@query(CHARACTER + "SELECT doc_id, chunk_index, 'character' AS strategy, length(text_content)::varchar AS chunk_size, '1200' AS size_config, '300' AS overlap_config, source FROM chunks JOIN documents USING (doc_id)")
def chunk_metadata(spark, d):
    """The metadata of character chunks, with what the document brings."""
    t = docs(spark, d)
    m = C.with_metadata(C.chunk(t.select(F.struct("doc_id", "source").alias("k"), "text"), key="k").select("k.*", "chunk_index", "text_content"), "character", Options(), source=F.col("source"))
    return m.select("doc_id", "chunk_index", *[F.col("chunk_metadata")[k].alias(n) for k, n in (("chunking_strategy", "strategy"), ("chunk_size", "chunk_size"), ("size_config", "size_config"), ("overlap_config", "overlap_config"), ("source", "source"))])


@query("""SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE n // 900 + 1 END AS e_character, CASE WHEN n // 4 = 0 THEN 0 ELSE (n // 4) // 450 + 1 END AS e_token,
 cast(floor(n / (1500 * 0.7::double)) AS bigint) + 1 AS e_semantic, CASE WHEN n = 0 THEN 0 ELSE n // 1200 + 1 END AS e_recursive, cast(floor(n / (1500 * 0.6::double)) AS bigint) + 1 AS e_embedding, n // 1250 + 1 AS e_linguistic
 FROM (SELECT doc_id, length(text) AS n FROM documents)""")
def estimate_chunks_all(spark, d):
    return docs(spark, d).select("doc_id", *[e.cast("long").alias(f"e_{k}") for k, e in S.estimates(F.length("text")).items()])


_TOKENS = r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\s+') AS k FROM documents),
 w AS (SELECT doc_id, k, unnest(range(0, greatest(len(k) - 50, 1), 450)) AS a FROM t WHERE len(k) > 0),
 chunks AS (SELECT doc_id, cast(a // 450 AS bigint) AS chunk_index, cast(least(500, len(k) - a) AS bigint) AS token_count, array_to_string(list_slice(k, a + 1, a + 500), '') AS text_content,
  cast(length(array_to_string(list_slice(k, 1, a), '')) AS bigint) AS char_start, cast(length(array_to_string(list_slice(k, 1, a + 500), '')) AS bigint) AS char_end FROM w) """


@query(_TOKENS + "SELECT doc_id, chunk_index, token_count, text_content, char_start, char_end FROM chunks")
def chunk_token(spark, d):
    return C.chunk(docs(spark, d), "token").select("doc_id", "chunk_index", "token_count", "text_content", "char_start", "char_end")


@query(_coverage_sql(_TOKENS, "SELECT doc_id, char_start, char_end FROM chunks WHERE chunk_index % 3 <> 1"))
def chunk_token_coverage_lost(spark, d):
    return _as_text(C.coverage_of(C.chunk_arrays(docs(spark, d), "token", contents=False), keep=lambda c: c["chunk_index"] % 3 != 1))


def vocabulary(spark) -> C.Vocabulary:
    """Of spark.corvella.token_vocabulary, or the public one that is installed."""
    path = Options.of(spark).token_vocabulary
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return C.Vocabulary(path)


@query()
def chunk_token_bpe(spark, d):
    return C.chunk(docs(spark, d), "token", vocabulary=vocabulary(spark))


def _chunks(name):
    def run(spark, d):
        return C.chunk(docs(spark, d), name)

    run.__name__ = f"chunk_{name}"
    return run


_BOUNDARY_SQL = r"regexp_matches(x, '^(#{1,6}\s|[0-9]+\.\s|[A-Z][A-Z\s][A-Z\s]+$|\[Page [0-9]+\]|(Chapter|Section) [0-9])')"
# Sections of lines; long ones packed sentence by sentence, with the tail of the piece before.
_SEMANTIC = r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\s*\n+', chr(10) || chr(10), 'g'), chr(10)) AS s FROM documents)),
 f AS (SELECT doc_id, i, x, sum(CASE WHEN i > 0 AND {BOUNDARY} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
 sections AS (SELECT doc_id, k, string_agg(x, chr(10) ORDER BY i) AS t FROM f GROUP BY doc_id, k),
 placed AS (SELECT doc_id, k, t, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sections),
 long AS (SELECT doc_id, k, off, string_split(regexp_replace(t, '([.!?])\s', '\1' || chr(1), 'g'), chr(1)) AS s FROM placed WHERE length(t) > 1500),
 r AS (SELECT doc_id, k, off, s, 0 AS i, '' AS held, cast(NULL AS varchar) AS done FROM long UNION ALL
  SELECT doc_id, k, off, s, i + 1, CASE WHEN i = len(s) THEN '' WHEN held = '' THEN s[i + 1] WHEN length(held) + length(s[i + 1]) + 1 > 1500 THEN regexp_replace(CASE WHEN length(held) > 300 AND instr(right(held, 300), ' ') > 0 THEN substring(right(held, 300), instr(right(held, 300), ' ') + 1) ELSE right(held, 300) END || ' ' || s[i + 1], '^\s+|\s+$', '', 'g') ELSE held || ' ' || s[i + 1] END,
   CASE WHEN i = len(s) OR (held <> '' AND length(held) + length(s[i + 1]) + 1 > 1500) THEN held END FROM r WHERE i <= len(s)),
 pieces AS (SELECT doc_id, k, 0 AS i, off, t AS done FROM placed WHERE length(t) <= 1500 UNION ALL SELECT doc_id, k, i, off, done FROM r WHERE done IS NOT NULL),
 chunks AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS bigint) AS chunk_index, regexp_replace(done, '^\s+|\s+$', '', 'g') AS text_content, cast(off AS bigint) AS char_start, cast(off + length(done) AS bigint) AS char_end FROM pieces WHERE length(regexp_replace(done, '^\s+|\s+$', '', 'g')) >= 400) """.replace("{BOUNDARY}", _BOUNDARY_SQL)

query(_SEMANTIC + "SELECT *, substring(sha256(doc_id || '|semantic|' || chunk_index), 1, 24) AS chunk_id FROM chunks")(_chunks("semantic"))
for _name in ("recursive_semantic", "embedding_semantic", "linguistic"):
    query()(_chunks(_name))


@query(_coverage_sql(_SEMANTIC, "SELECT doc_id, char_start, char_end FROM chunks"))
def chunk_semantic_coverage(spark, d):
    return _as_text(C.coverage_of(C.chunk_arrays(docs(spark, d), "semantic", contents=False)))


@query(r"""SELECT doc_id, cast(unnest(range(len(s))) AS bigint) AS n, unnest(s) AS paragraph FROM (SELECT doc_id, list_filter(list_transform(
 string_split(regexp_replace(replace(text, chr(10), chr(10) || ' ' || chr(10) || chr(10)), '\n\s*\n+', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)""")
def split_paragraphs(spark, d):
    spaced = F.replace("text", F.lit("\n"), F.lit("\n \n\n"))
    return docs(spark, d).select("doc_id", F.posexplode(S.paragraphs(spaced)).alias("n", "paragraph")).withColumn("n", F.col("n").cast("long"))


@query(r"""SELECT doc_id, s AS sentence, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\s', '\1' || chr(1), 'g'), chr(1)))) AS s FROM documents) WHERE s <> '' GROUP BY ALL""")
def split_sentences_naive(spark, d):
    return docs(spark, d).select("doc_id", F.explode(S.sentences(F.col("text"))).alias("sentence")).groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\b(Mr|Mrs|Dr|Ms|Prof|Sr|Jr|Inc|Ltd|Corp|Co|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.', '\1' || chr(2), 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
 lambda s: regexp_replace(replace(s, chr(2), '.'), '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM documents) SELECT doc_id, cast(unnest(range(len(s))) AS bigint) AS n, unnest(s) AS sentence FROM p""")
def split_sentences_abbrev(spark, d):
    s = docs(spark, d).select("doc_id", F.posexplode(S.careful_sentences(F.col("text"))).alias("n", "sentence"))
    return s.withColumn("n", F.col("n").cast("long"))


_PREFIXED = "CASE i % 5 WHEN 0 THEN '## ' || l WHEN 1 THEN '3. ' || l WHEN 2 THEN 'Section 2 ' || l WHEN 3 THEN '[Page 4]' ELSE l END"


@query(f"""WITH l AS (SELECT doc_id, i, {_PREFIXED} AS x FROM (SELECT doc_id, unnest(s) AS l, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))
 SELECT doc_id, cast(i AS bigint) AS line_no, ({_BOUNDARY_SQL}) AS boundary, coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i), '') = '' AS after_blank FROM l""")
def section_boundaries(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    x = lines.withColumn("x", F.expr(_PREFIXED))
    w = Window.partitionBy("doc_id").orderBy("i")
    return x.select("doc_id", F.col("i").cast("long").alias("line_no"), S.is_boundary(F.col("x")).alias("boundary"), (F.coalesce(F.lag("x").over(w), F.lit("")) == "").alias("after_blank"))


@query("""WITH l AS (SELECT doc_id, unnest(s) AS l, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), p AS (SELECT *, coalesce(right(lag(l) OVER (PARTITION BY doc_id ORDER BY i), 40), '') AS t FROM l)
 SELECT doc_id, cast(i AS bigint) AS line_no, CASE WHEN instr(t, ' ') > 0 THEN substring(t, instr(t, ' ') + 1) ELSE t END || l AS with_overlap FROM p""")
def overlap_prev_chunk(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    t = F.coalesce(F.lag("l").over(Window.partitionBy("doc_id").orderBy("i")), F.lit(""))
    p = lines.withColumn("t", F.when(F.length(t) > 40, F.substring(t, -40, 40)).otherwise(t))
    cut = F.when(F.instr("t", " ") > 0, F.expr("substring(t, instr(t, ' ') + 1)")).otherwise(F.col("t"))
    return p.select("doc_id", F.col("i").cast("long").alias("line_no"), F.concat(cut, "l").alias("with_overlap"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), h AS (SELECT doc_id, ('0x' || substring(md5(w), 1, 4))::int AS h FROM t), b AS (SELECT doc_id, h % 64 AS dim, cast(sum(CASE WHEN h >= 32768 THEN 1 ELSE -1 END) AS double) AS x FROM h GROUP BY ALL)
 SELECT doc_id, cast(dim AS bigint) AS dim, round(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 0), 6) AS x FROM b""")
def embed_hashed(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    codes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int"))
    return docs(spark, d).select("doc_id", F.inline(vectors.hashed(codes))).withColumn("x", F.round("x", 6))


_Q = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


def _first(spark, d):
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).select("embedding")


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 6) AS score FROM embeddings, {_Q} ORDER BY round(list_cosine_similarity(embedding::double[], q::double[]), 9) DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), _first(spark, d)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 6) AS score FROM embeddings, {_Q} WHERE label = 3 ORDER BY round(list_cosine_similarity(embedding::double[], q::double[]), 9) DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    return vectors.top_k(table(spark, d, "embeddings").where("label = 3"), _first(spark, d)).select("vec_id", F.round("score", 6).alias("score"))


_EACH = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
 SELECT query_id, vec_id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS bigint) AS rank FROM s QUALIFY rank <= 10"""


def _asked(spark, d) -> DataFrame:
    """The stated queries: every hundredth id."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(_EACH)
def vector_topk_batch(spark, d):
    return vectors.top_k_each(table(spark, d, "embeddings"), _asked(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def _index(spark, d) -> tuple[DataFrame, vector_index.Index]:
    e = table(spark, d, "embeddings")
    index = vector_index.train(e)
    return vector_index.build(e, index, shared_folder(spark)), index


@query()
def vector_index_search(spark, d):
    """The nearest rows by the index; vector_index_recall measures what it misses."""
    return vector_index.search(*_index(spark, d), _asked(spark, d))


@query("SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, d):
    found = vector_index.search(*_index(spark, d), _asked(spark, d))
    r = vector_index.recall(found, vectors.top_k_each(table(spark, d, "embeddings"), _asked(spark, d)))
    return r.select("queries", (F.col("recall") >= 0.9).alias("recall_reached"))


@query(_EACH)
def vector_index_exact(spark, d):
    return vector_index.search(*_index(spark, d), _asked(spark, d), exact=True).withColumn("rank", F.col("rank").cast("long"))


@query(f"""SELECT vec_id, CASE WHEN list_sum(list_transform(embedding::double[], lambda x: x * x)) = 0 THEN 0.0::double ELSE round(list_cosine_similarity(embedding::double[], q::double[]), 6) END AS score
 FROM (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT -1, list_transform(embedding, lambda x: 0::float) FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)), {_Q}""")
def vector_zero_norm(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    zero = e.orderBy("vec_id").limit(1).select(F.lit(-1).cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.lit(0).cast("float")).alias("embedding"))
    return vectors.scored(e.union(zero), _first(spark, d)).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT label, cast(dim AS bigint) AS dim, round(avg(x::double), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY ALL")
def vector_centroid(spark, d):
    return vectors.centroids(table(spark, d, "embeddings"), "label").select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, round(embedding[1]::double, 6) AS x0 FROM embeddings")
def vector_upsert(spark, d):
    e = table(spark, d, "embeddings")
    return tables.upsert(e, e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100), "vec_id").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("x0"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_delete(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return tables.delete(table(spark, d, "embeddings"), gone, "vec_id").select("vec_id", "label")


_SETS = r"""WITH s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a FROM documents), p AS (SELECT l.doc_id, l.a, r.a AS b FROM s l JOIN s r ON r.doc_id = l.doc_id + 1),
 j AS (SELECT doc_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) END AS j FROM p) """


def _neighbours(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    s = docs(spark, d).select("doc_id", F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))).alias("a"))  # hashes, as sets are shuffled
    return s.join(s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id").select("doc_id", S.jaccard(F.col("a"), F.col("b")).alias("j"))


@query(_SETS + "SELECT doc_id, round(j, 6) AS jaccard FROM j")
def jaccard_pairs(spark, d):
    return _neighbours(spark, d).select("doc_id", F.round("j", 6).alias("jaccard"))


@query(_SETS + """, c AS (SELECT l.vec_id AS doc_id, list_cosine_similarity(l.embedding::double[], r.embedding::double[]) AS c FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1)
 SELECT doc_id, round(CASE WHEN c > 0 THEN 0.5 * c + 0.25 * j + 0.25 * j ELSE 0.5 * j + 0.5 * j END, 6) AS score FROM c JOIN j USING (doc_id)""")
def blended_similarity(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    c = e.join(e.select((F.col("doc_id") - 1).alias("doc_id"), F.col("embedding").alias("next")), "doc_id").select("doc_id", S.cosine(F.col("embedding"), F.col("next")).alias("c"))
    return c.join(_neighbours(spark, d), "doc_id").select("doc_id", F.round(S.blended(F.col("c"), F.col("j"), F.col("j")), 6).alias("score"))


@query(LOGS + "SELECT coalesce(status, '*') AS status, coalesce(topic, '*') AS topic, count(*) AS n FROM logs GROUP BY GROUPING SETS ((status), (topic), ())")
def event_stats(spark, d):
    return stats.totals(logs(spark, d))


@query(LOGS + "SELECT topic, status, count(*) AS n, round(coalesce(avg(epoch_us(completed_at) - epoch_us(started_at)), 0) / 1000, 3) AS avg_ms FROM logs GROUP BY topic, status")
def event_stats_duration(spark, d):
    return stats.durations(logs(spark, d))


@query(LOGS + """SELECT *, CASE WHEN completed > 0 THEN 'healthy' ELSE 'degraded' END AS health FROM (SELECT group_id, max(event_id) AS last_event, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed
 FROM logs WHERE started_at >= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events) GROUP BY group_id)""")
def consumer_health(spark, d):
    return stats.health(logs(spark, d), logs(spark, d).agg(F.max("started_at") - F.expr("INTERVAL 5 MINUTES")).scalar())


@query(LOGS + "SELECT coalesce(status, '*') AS status, count(*) AS n, cast(sum(user_id % 7) AS bigint) AS emails FROM logs GROUP BY ROLLUP (status)")
def email_stats(spark, d):
    return stats.mail_totals(logs(spark, d), F.col("user_id") % 7)


@query(LOGS + ", b AS (SELECT group_id, status, event_id // 20 AS batch_id, count(*) AS processed FROM logs GROUP BY ALL) SELECT status, count(*) AS n, cast(sum(processed) AS bigint) AS processed, round(avg(processed), 6) AS avg_processed FROM b GROUP BY status")
def batch_stats(spark, d):
    b = logs(spark, d).groupBy("group_id", "status", F.expr("event_id div 20").alias("batch_id")).agg(F.count("*").alias("processed"))
    return stats.batch_totals(b)


@query(CHARACTER + """SELECT doc_id, count(*) AS total, count(*) FILTER (st = 'completed') AS completed, count(*) FILTER (st = 'failed') AS failed, count(*) FILTER (st = 'pending') AS pending FROM (
 SELECT doc_id, CASE WHEN quality IS NULL THEN 'pending' WHEN (chunk_index + quality) % 7 = 0 THEN 'failed' ELSE 'completed' END AS st FROM chunks LEFT JOIN labels USING (doc_id)) GROUP BY doc_id""")
def chunk_status_pivot(spark, d):
    c = C.chunk_arrays(docs(spark, d), contents=False).select("doc_id", F.size("chunks").alias("n")).where("n > 0").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    bad = F.size(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i + F.col("quality")) % 7 == 0))
    by = c.select("doc_id", F.col("n").cast("long").alias("total"), F.when(F.col("quality").isNull(), 0).otherwise(bad).cast("long").alias("failed"), F.when(F.col("quality").isNull(), F.col("n")).otherwise(0).cast("long").alias("pending"))
    g = by.groupBy("doc_id").agg(*[F.sum(x).alias(x) for x in ("total", "failed", "pending")])
    return g.select("doc_id", "total", (F.col("total") - F.col("failed") - F.col("pending")).alias("completed"), "failed", "pending")


@query(LOGS + "SELECT event_id, topic, status FROM logs WHERE started_at >= (SELECT max(ts) - INTERVAL 24 HOUR FROM events) ORDER BY started_at DESC, event_id LIMIT 100")
def recent_logs(spark, d):
    since = logs(spark, d).agg(F.max("started_at") - F.expr("INTERVAL 24 HOURS")).scalar()
    return stats.newest(logs(spark, d).where(F.col("started_at") >= since)).select("event_id", "topic", "status")


@query(LOGS + "SELECT event_id, topic FROM logs WHERE status = 'failed' ORDER BY started_at DESC, event_id LIMIT 50")
def failed_events(spark, d):
    return stats.newest(logs(spark, d).where("status = 'failed'"), 50).select("event_id", "topic")


@query("SELECT event_id AS \"offset\", cast(user_id AS varchar) AS key, props AS value FROM events ORDER BY event_id LIMIT 50")
def dead_letter_browse(spark, d):
    letters = table(spark, d, "events").select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("ts").alias("timestamp"))
    return routing.browse(letters).select("offset", "key", "value")


_HASH = """WITH f AS (SELECT doc_id, encode(text) AS b FROM documents), h AS (SELECT doc_id, octet_length(b) AS n, sha256(encode('doc.md') || encode(cast(octet_length(b) AS varchar)) ||
 CASE WHEN octet_length(b) <= 20480 THEN b ELSE b[1:10240] || b[octet_length(b) - 10239 : octet_length(b)] END) AS quick_hash FROM f) """


def _hashed(spark, d):
    return docs(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("n"), S.quick_hash(F.lit("doc.md"), F.col("text").cast("binary")).alias("quick_hash"))


@query(_HASH + "SELECT doc_id, quick_hash, CASE WHEN first <> doc_id THEN first END AS existing_id, CASE WHEN first <> doc_id THEN 'duplicate' ELSE 'uploaded' END AS status FROM (SELECT *, min(doc_id) OVER (PARTITION BY quick_hash) AS first FROM h)")
def dedup_quick_hash(spark, d):
    return tables.mark_duplicates(_hashed(spark, d)).select("doc_id", "quick_hash", "existing_id", "status")


@query(_HASH + "SELECT count(*) AS total, count(*) FILTER (rn = 1 AND n <= 20000) AS success, count(*) FILTER (n > 20000) AS failed, count(*) FILTER (rn > 1 AND n <= 20000) AS duplicates FROM (SELECT *, row_number() OVER (PARTITION BY quick_hash ORDER BY doc_id) AS rn FROM h)")
def upload_summary(spark, d):
    m = tables.mark_duplicates(_hashed(spark, d))
    ok, dup = F.col("n") <= 20000, F.col("status") == "duplicate"
    return m.agg(F.count("*").alias("total"), F.count_if(ok & ~dup).alias("success"), F.count_if(~ok).alias("failed"), F.count_if(ok & dup).alias("duplicates"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dedup_processed(spark, d):
    return docs(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT email_id, turn, role FROM (SELECT cast(conv_id AS varchar) || ':' || cast(turn % 3 AS varchar) AS email_id, turn, role, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def first_wins_email(spark, d):
    e = table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") % 3).cast("string")).alias("email_id"), "turn", "role")
    return tables.first_wins(e, "email_id", "turn")


@query(LOGS + "SELECT user_id, arg_max(status, started_at) AS status, epoch_us(max(started_at)) AS at_us FROM logs GROUP BY user_id")
def latest_status(spark, d):
    return tables.latest(logs(spark, d), "user_id", "status", "started_at", "event_id").select("user_id", "status", F.unix_micros("started_at").alias("at_us"))


@query("SELECT user_id, batch_no, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS batch_no FROM events) GROUP BY ALL")
def microbatch_fixed(spark, d):
    return numbering.batched(table(spark, d, "events").select("user_id", "event_id", "ts"), 20, "user_id", "ts", "event_id").groupBy("user_id", "batch_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_BATCHES = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (
 SELECT user_id, event_id, rn, 0::bigint AS b, 1 AS c, t AS f FROM o WHERE rn = 1 UNION ALL
 SELECT o.user_id, o.event_id, o.rn, CASE WHEN c >= 5 OR t - f >= 172800000000 THEN b + 1 ELSE b END, CASE WHEN c >= 5 OR t - f >= 172800000000 THEN 1 ELSE c + 1 END, CASE WHEN c >= 5 OR t - f >= 172800000000 THEN t ELSE f END FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1) """


@query(_BATCHES + "SELECT user_id, b AS batch_no, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY ALL")
def microbatch_count_or_timeout(spark, d):
    return microbatch.batches(table(spark, d, "events"), 5, 48 * 3600).groupBy("user_id", "batch_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(ORACLE_SQL["microbatch_count_or_timeout"])
def stream_microbatch(spark, d):
    from ..sources.streams import events_once

    return events_once(spark, d, lambda s: microbatch.stream_batches(s, 5, 48 * 3600), microbatch.OUT).groupBy("user_id", "batch_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'dead_letter' END AS handler, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def stream_routing(spark, d):
    from ..sources.streams import events_once

    routed = lambda s: routing.route(s.withColumn("topic", F.col("event_type")), {t: t for t in ("click", "view", "purchase")}).select("handler", "event_id")
    return events_once(spark, d, routed, "handler string, event_id long").groupBy("handler").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT doc_id, substring(sha256('email:' || doc_id), 1, 24) AS email_doc_id, substring(sha256('emb:' || doc_id), 1, 16) AS emb_id, substring(sha256('attach:' || doc_id || ':' || source), 1, 16) AS attach_id FROM documents""")
def ids_sha(spark, d):
    i = F.col("doc_id").cast("string")
    return docs(spark, d).select("doc_id", S.email_document_id(i).alias("email_doc_id"), S.embedding_id(i).alias("emb_id"), S.attachment_id(i, F.col("source")).alias("attach_id"))


_NAME = "string_split(url, '/')[-1] || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.exe' WHEN 2 THEN '.md' ELSE '' END"


def _files(spark, d):
    name = F.concat(F.element_at(F.split("url", "/"), -1), F.expr("CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.exe' WHEN 2 THEN '.md' ELSE '' END"))
    return table(spark, d, "pages").select("page_id", "url", name.alias("name"), F.length("html").cast("long").alias("size"))


@query(f"SELECT page_id, CASE WHEN s = '' THEN 'attachment' ELSE s END AS safe FROM (SELECT page_id, regexp_replace({_NAME}, '[^A-Za-z0-9.\\-_]', '_', 'g') AS s FROM pages)")
def sanitize_filename(spark, d):
    return _files(spark, d).select("page_id", S.safe_name(F.col("name")).alias("safe"))


@query(f"SELECT page_id, e AS ext, CASE e WHEN '.pdf' THEN 'application/pdf' WHEN '.md' THEN 'text/markdown' WHEN '.markdown' THEN 'text/markdown' WHEN '.json' THEN 'application/json' END AS content_type, CASE e WHEN '.pdf' THEN 'pdf' WHEN '.md' THEN 'md' WHEN '.markdown' THEN 'markdown' WHEN '.json' THEN 'json' ELSE 'dead_letter' END AS handler FROM (SELECT page_id, lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)) AS e FROM pages)")
def file_type_route(spark, d):
    f = tables.routed(_files(spark, d).withColumnRenamed("name", "filename"))
    return f.select("page_id", S.extension(F.col("filename")).alias("ext"), S.by_extension(F.col("filename"), S.CONTENT_TYPES).alias("content_type"), "handler")


@query(f"SELECT page_id, CASE WHEN length(html) > 4000 THEN 'file too large' WHEN e NOT IN ('pdf', 'md', 'txt') THEN 'file type not allowed' WHEN page_id % 5 = 0 THEN 'no download url' END AS error FROM (SELECT page_id, html, lower(regexp_extract({_NAME}, '^.+\\.([^.]+)$', 1)) AS e FROM pages)")
def attachment_validation(spark, d):
    url = F.when(F.col("page_id") % 5 != 0, F.col("url"))
    return _files(spark, d).select("page_id", tables.attachment_error(F.col("name"), F.col("size"), url, "pdf, md, txt", 4000).alias("error"))


@query("""WITH a AS (SELECT conv_id, turn, 'file ' || role || '.txt' AS name FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, name ORDER BY turn) - 1 AS k FROM a)
 SELECT conv_id, turn, 'base/acc_' || conv_id % 5 || '/' || conv_id || '/' || CASE WHEN k = 0 THEN replace(name, ' ', '_') ELSE replace(replace(name, ' ', '_'), '.txt', '') || '_' || k || '.txt' END AS file_path FROM n""")
def attachment_paths(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("acc "), (F.col("conv_id") % 5).cast("string")).alias("account_id"), F.col("conv_id").cast("string").alias("email_id"), F.concat(F.lit("file "), "role", F.lit(".txt")).alias("name"), F.col("turn").alias("pos"))
    return tables.attachment_paths(c, "base").select("conv_id", "turn", "file_path")


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview, substring(text, 1, 50) AS subject, length(coalesce(text, '')) > 0 AS embeds FROM conversations")
def email_preview(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.preview(F.col("text")).alias("preview"), F.substring("text", 1, 50).alias("subject"), (F.length(F.coalesce("text", F.lit(""))) > 0).alias("embeds"))


@query("SELECT conv_id, count(*) AS n, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS thread FROM conversations GROUP BY conv_id")
def email_thread_hydrate(spark, d):
    t = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("x")).alias("m"))
    return t.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["x"]), "|").alias("thread"))


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k, '{\"event_id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS encoded FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct("event_id", F.col("event_type").alias("type"))).alias("encoded"))


@query("SELECT doc_id, source AS content_type, substring(text, 1, 200) AS text_preview, lang, 'documents' AS mongo_collection FROM documents")
def payload_merge(spark, d):
    """Fixed keys give way to those of the chunk's metadata."""
    fixed = F.create_map(F.lit("content_type"), F.lit("pdf"), F.lit("text_preview"), F.substring("text", 1, 200), F.lit("mongo_collection"), F.lit("documents"))
    meta = F.create_map(F.lit("content_type"), F.col("source"), F.lit("lang"), F.col("lang"))
    return docs(spark, d).select("doc_id", tables.merge_payload(fixed, meta).alias("p")).select("doc_id", *[F.col("p")[k].alias(k) for k in ("content_type", "text_preview", "lang", "mongo_collection")])


@query(LOGS + "SELECT group_id, count(*) FILTER (status = 'failed') AS storage_errors, cast(ceil(count(*) / 300.0) AS bigint) AS batches, count(*) FILTER (status = 'failed') > 0 AS has_partial_failure, CASE WHEN count(*) FILTER (status = 'completed') = 0 THEN 'failed' ELSE 'completed' END AS status FROM logs GROUP BY group_id")
def partial_failure(spark, d):
    return stats.saved(logs(spark, d), "group_id")


@query("SELECT event_id, event_id % 5 + 1 AS retry_count FROM events WHERE event_type = 'error' AND event_id % 5 < 3")
def retry_replay(spark, d):
    f = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.lit("pending_retry").alias("status"), (F.col("event_id") % 5).alias("retry_count"))
    return tables.replay(tables.retry_candidates(f).withColumn("status", F.lit("failed"))).select("event_id", "retry_count")


@query("SELECT event_id, cast(round(value) AS bigint) * CASE event_id % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 ELSE 1 END AS bytes FROM events")
def parse_size(spark, d):
    text = F.concat(F.round("value").cast("long").cast("string"), F.element_at(F.array(F.lit("KB"), F.lit("MB"), F.lit("GB"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, d, "events").select("event_id", S.size_bytes(text).alias("bytes"))


@query(CHARACTER + """, h AS (SELECT doc_id, text, octet_length(encode(text)) AS b, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents),
 u AS (SELECT h.doc_id, CASE WHEN b > 20000 THEN 'failed' WHEN f <> h.doc_id THEN 'duplicate' WHEN l.doc_id IS NOT NULL THEN 'skipped' ELSE 'completed' END AS status FROM h LEFT JOIN labels l USING (doc_id))
 SELECT status, count(*) AS n_docs, cast(coalesce(sum(c), 0) AS bigint) AS n_chunks FROM u LEFT JOIN (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id) k ON k.doc_id = u.doc_id AND u.status = 'completed' GROUP BY status""")
def document_pipeline(spark, d):
    u, c = pipelines.ingest(docs(spark, d), table(spark, d, "labels"), 20000)
    n = c.groupBy("doc_id").agg(F.count("*").alias("c"))
    return u.select("doc_id", "status").join(n, "doc_id", "left").groupBy("status").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_chunks"))


@query(CHARACTER + "SELECT doc_id, chunk_index, substring(text_content, 1, 200) AS text_preview, 'completed' AS embedding_status FROM chunks JOIN embeddings ON vec_id = doc_id AND chunk_index = vec_id % 3")
def chunk_vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3).alias("chunk_index"), "embedding")
    return pipelines.index(C.chunk(docs(spark, d)), e).select("doc_id", "chunk_index", "text_preview", "embedding_status")


@query(CHARACTER + "SELECT doc_id, substring(sha256(doc_id || '|character|' || chunk_index), 1, 24) AS chunk_id, cast(len(embedding) AS bigint) AS vector_size, 0::bigint AS retry_count, 'pending_retry' AS status FROM chunks JOIN embeddings ON vec_id = doc_id AND chunk_index = 0 WHERE label = 0")
def embedding_failures(spark, d):
    e = table(spark, d, "embeddings").where("label = 0").select(F.col("vec_id").alias("doc_id"), F.lit(0).cast("long").alias("chunk_index"), "embedding")
    return pipelines.quarantine(e, C.chunk(docs(spark, d)))


def _mail_events(spark, d):
    m = F.struct(
        F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") % 3).cast("string")).alias("id"), F.substring("text", 1, 50).alias("subject"), F.struct(F.struct(F.col("role").alias("address")).alias("emailAddress")).alias("from_address"),
        F.struct(F.col("text").alias("content")).alias("body"), (F.col("turn") == 0).alias("is_read"),
        F.when(F.col("turn") % 4 == 0, "high").alias("importance"), F.when(F.col("turn") % 2 == 0, F.array("role", F.lit("k"))).alias("keywords"),
        F.when(F.col("turn") % 3 == 0, F.array(F.struct(F.lit("a").alias("id"), F.concat("role", F.lit(".pdf")).alias("name"), F.length("text").cast("long").alias("size"), F.lit("u").alias("contentLocation")))).alias("attachments"),
    )
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]).alias("value"))
    return t.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("event_id"), (F.col("conv_id") % 5).cast("string").alias("account_id"), F.struct("value").alias("response_data"))).alias("value"))


@query("""SELECT substring(sha256('email:' || conv_id || ':' || turn % 3), 1, 24) AS document_id, conv_id || ':' || turn % 3 AS email_id, cast(conv_id % 5 AS varchar) AS account_id, cast(conv_id AS varchar) AS event_id, substring(text, 1, 50) AS subject, role AS sender, cast(length(text) AS bigint) AS n_chars, turn = 0 AS is_read, false AS has_attachments FROM conversations""")
def email_flatten(spark, d):
    e = pipelines.emails(_mail_events(spark, d))
    return e.select("document_id", "email_id", "account_id", "event_id", "subject", "sender", F.length("content").cast("long").alias("n_chars"), "is_read", "has_attachments")


@query("""WITH e AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)),
 b AS (SELECT conv_id % 5 AS a, text, (row_number() OVER (PARTITION BY conv_id % 5 ORDER BY cast(conv_id AS varchar), turn) - 1) // 20 AS batch_no FROM e WHERE n = 1)
 SELECT cast(a AS varchar) AS account_id, batch_no, count(*) AS processed, count(*) FILTER (length(text) > 0) AS embedded, cast(sum(length(text)) AS bigint) AS n_chars FROM b GROUP BY ALL""")
def email_pipeline(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("event_id"))
    e = pipelines.process_emails(_mail_events(spark, d), done)
    return e.groupBy("account_id", "batch_no").agg(F.count("*").alias("processed"), F.count_if("embeds").alias("embedded"), F.sum(F.length("content")).alias("n_chars"))


@query(f"SELECT h.vec_id, h.score, lang, source FROM (SELECT vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 6) AS score FROM embeddings, {_Q} ORDER BY round(list_cosine_similarity(embedding::double[], q::double[]), 9) DESC, vec_id LIMIT 10) h JOIN documents ON doc_id = vec_id")
def vector_hydrate(spark, d):
    hits = vectors.top_k(table(spark, d, "embeddings"), _first(spark, d)).select("vec_id", F.round("score", 6).alias("score"))
    return F.broadcast(hits).join(docs(spark, d), F.col("doc_id") == F.col("vec_id")).select("vec_id", "score", "lang", "source")


from . import flows  # noqa: E402, F401  adds its queries and those of records and state
