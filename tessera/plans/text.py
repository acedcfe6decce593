"""Queries over logs, posts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import text as tx
from tessera.operators import text
from tessera.sources.tables import table

from .inputs import rounded

_LOGS = """logs AS (SELECT event_id AS line_no, 'user ' || user_id || ' ' || event_type || ' from 10.0.' || (user_id % 256) || '.1:8080 value ' || value || '  at 0x' || to_hex(event_id) || ' blk_-' || (event_id % 7) AS line,
  'blk_-' || (event_id // 20) AS session FROM events)"""
_MASK = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, 'blk_-?\d+', '<*>', 'g'), '\b0x[0-9a-fA-F]+\b', '<*>', 'g'), '\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b', '<*>', 'g'), '-?\b\d+(?:\.\d+)?\b', '<*>', 'g'), '\s+', ' ', 'g'))"
_COUNTS = f"{_LOGS}, counts AS (SELECT session, {_MASK} AS template, count(*) AS n FROM logs GROUP BY 1, 2)"


def _logs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    number = F.col("value").cast("string")
    line = F.concat(F.lit("user "), F.col("user_id"), F.lit(" "), F.col("event_type"), F.lit(" from 10.0."), F.col("user_id") % 256, F.lit(".1:8080 value "), number, F.lit("  at 0x"), F.hex("event_id"), F.lit(" blk_-"), F.col("event_id") % 7)
    return e.select(F.col("event_id").alias("line_no"), line.alias("line"), F.concat(F.lit("blk_-"), F.expr("event_id div 20")).alias("session"))


def _counts(spark, sf_dir):
    return text.session_templates(_logs(spark, sf_dir), F.col("session"))


@query(f"WITH {_LOGS} SELECT {_MASK} AS template, row_number() OVER (ORDER BY min(line_no)) - 1 AS template_id, count(*) AS n FROM logs GROUP BY 1")
def mask_templates(spark, sf_dir):
    return text.mask_templates(_logs(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT session, template, n FROM counts")
def template_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


_TEMPLATES = ["click", "error", "purchase", "signup", "view"]
_NAMES = [f"user <*> {t} from <*> value <*> at <*> <*>" for t in _TEMPLATES]


@query(f"WITH {_COUNTS} SELECT session, " + ", ".join(f"coalesce(sum(n) FILTER (template = '{n}'), 0)::BIGINT AS \"{n}\"" for n in _NAMES) + " FROM counts GROUP BY 1")
def event_count_matrix(spark, sf_dir):
    return text.event_count_matrix(_counts(spark, sf_dir), _NAMES)


_IDF = f"{_COUNTS}, idf AS (SELECT template, count(DISTINCT session) AS df, ln((1 + (SELECT count(DISTINCT session) FROM counts)) / (1 + count(DISTINCT session))) + 1 AS idf FROM counts GROUP BY 1)"


@query(f"WITH {_IDF} SELECT template, df, round(idf, 6) AS idf FROM idf")
def template_idf(spark, sf_dir):
    return rounded(text.template_idf(_counts(spark, sf_dir)), "idf")


_RARITY = f"{_IDF}, rarity AS (SELECT session, sum(n * idf) AS rarity FROM counts JOIN idf USING (template) GROUP BY 1)"


@query(f"WITH {_RARITY} SELECT session, round(rarity, 6) AS rarity FROM rarity")
def session_rarity(spark, sf_dir):
    return rounded(text.session_rarity(_counts(spark, sf_dir)), "rarity")


@query(f"""WITH {_COUNTS}, full_ AS (SELECT s.session, t.template, coalesce(n, 0) AS n FROM (SELECT DISTINCT session FROM counts) s CROSS JOIN (SELECT DISTINCT template FROM counts) t LEFT JOIN counts USING (session, template)),
b AS (SELECT template, quantile_cont(n, 0.05) AS lo, quantile_cont(n, 0.95) AS hi FROM full_ GROUP BY 1) SELECT session, bool_or(n < lo OR n > hi) AS violated FROM full_ JOIN b USING (template) GROUP BY 1""")
def count_invariants(spark, sf_dir):
    return text.count_invariants(_counts(spark, sf_dir))


@query(f"WITH {_RARITY} SELECT session, coalesce((rarity - avg(rarity) OVER ()) / nullif(stddev_pop(rarity) OVER (), 0) > 0.5, false) AS flag FROM rarity")
def zscore_flags(spark, sf_dir):
    return text.zscore_flags(text.session_rarity(_counts(spark, sf_dir)), "rarity", 0.5).select("session", "flag")


@query(f"WITH {_COUNTS}, t AS (SELECT session, sum(n * n)::DOUBLE AS v FROM counts GROUP BY 1) SELECT session, v > (SELECT quantile_cont(v, 0.85) FROM t) AS flag FROM t")
def quantile_flags(spark, sf_dir):
    sums = _counts(spark, sf_dir).groupBy("session").agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("v"))
    return text.quantile_flags(sums, "v", 0.85).select("session", "flag")


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM}) AS norm_md5 FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("norm_md5"))


_TOKENS = "tokens AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2)"
_WEIGHTS = f"{_TOKENS}, df AS (SELECT term, count(*) AS df FROM tokens GROUP BY 1), weights AS (SELECT doc_id, term, tf, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS weight FROM tokens JOIN df USING (term))"


@query(f"WITH {_TOKENS} SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens FROM tokens GROUP BY 1")
def token_counts(spark, sf_dir):
    return text.token_table(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"))


@query(f"WITH {_TOKENS} SELECT doc_id, term, tf FROM tokens WHERE term IN ('the', 'and', 'of', 'der', 'la', 'que')")
def bag_of_words(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("the", "and", "of", "der", "la", "que")], "term string")
    return text.bag_of_words(table(spark, sf_dir, "documents"), "doc_id", "text", words)


@query(f"WITH {_WEIGHTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM weights) SELECT doc_id, term, tf, round(weight, 6) AS weight, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def tfidf_top_terms(spark, sf_dir):
    return rounded(text.top_terms(text.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", 3), "weight")


LEXICON = {"the": 0.5, "and": 1.0, "idiot": -3.0, "der": 0.7, "la": 0.3, "of": -0.4}


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    changed = F.regexp_replace("text", r"\bis\b", "not")  # so that negations occur
    return text.sentiment(d.select("doc_id", changed.alias("text"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(doc_id % 60 as int))").alias("at")), "text", LEXICON).select("doc_id", "at", "score")


_SCORED = f"""src AS (SELECT doc_id, regexp_replace(text, '\\bis\\b', 'not', 'g') AS text, TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) AS posted FROM documents),
words AS (SELECT doc_id, posted, list_filter(string_split({_NORM}, ' '), lambda w: w <> '') AS w FROM src),
pos AS (SELECT doc_id, posted, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
val AS (SELECT doc_id, i, CASE word {' '.join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in LEXICON.items())} ELSE 0 END AS v, word IN ('not', 'no', 'never') AS neg, max(CASE WHEN word IN ('not', 'no', 'never') THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM pos),
scored AS (SELECT doc_id, posted, coalesce(t / sqrt(t * t + 15), 0) AS score FROM words LEFT JOIN (SELECT doc_id, sum(CASE WHEN neg THEN 0 WHEN i - last <= 3 THEN -v ELSE v END) AS t FROM val GROUP BY 1) USING (doc_id))"""


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored")
def lexicon_score(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("doc_id", "score"), "score")


@query(f"WITH {_SCORED} SELECT CAST(CAST(posted AS DATE) AS VARCHAR) AS day, round(avg(score), 6) AS mean_score, count(*) AS n FROM scored GROUP BY 1")
def sentiment_daily(spark, sf_dir):
    return rounded(text.sentiment_series(_scored(spark, sf_dir), "at"), "mean_score").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_SCORED} SELECT CAST(CAST(date_trunc('week', posted) AS DATE) + 6 AS VARCHAR) AS day, round(avg(score), 6) AS mean_score, count(*) AS n FROM scored GROUP BY 1")
def sentiment_weekly(spark, sf_dir):
    return rounded(text.sentiment_series(_scored(spark, sf_dir), "at", weekly=True), "mean_score").withColumn("day", F.col("day").cast("string"))


_CHUNKS = r"""ws AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
st AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 200) / 160.0)::BIGINT))) AS c FROM ws WHERE len(w) > 0),
chunks AS (SELECT doc_id, c::INTEGER AS chunk_id, array_to_string(w[c * 160 + 1 : c * 160 + 200], ' ') AS chunk FROM st)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_id, md5(chunk) AS chunk_md5 FROM chunks")
def chunk_documents(spark, sf_dir):
    return text.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk_id", F.md5("chunk").alias("chunk_md5"))


def _vectors(spark, sf_dir):
    """Every twentieth vector as a query, and all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding"), e.select("vec_id", "embedding")


@query("""WITH s AS (SELECT a.vec_id AS q, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT q, vec_id, round(score, 5) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    queries, vectors = _vectors(spark, sf_dir)
    return rounded(text.cosine_topk(queries, vectors, 5, "q", "vec_id"), "score", digits=5)


def _retrieval(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index = text.tfidf(docs, "doc_id", "text", normalise=True)
    queries = table(spark, sf_dir, "benchmark")
    plain = text.token_table(docs, "doc_id", "text")
    weights = text.query_weights(queries, "item_id", "text", plain, docs.agg(F.count(F.lit(1)).alias("docs")))
    return text.retrieve(index, weights, 5, "doc_id", "item_id"), queries


_RETRIEVE = f"""{_WEIGHTS}, norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY 1),
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
qw AS (SELECT item_id, term, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS weight FROM qt JOIN df USING (term)), qn AS (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM qw GROUP BY 1),
sc AS (SELECT item_id, w.doc_id, sum(q.weight * w.weight / qn.norm / n.norm) AS score FROM qw q JOIN weights w USING (term) JOIN qn USING (item_id) JOIN norms n ON n.doc_id = w.doc_id GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM sc), ranked AS (SELECT * FROM rk WHERE rank <= 5)"""


@query(f"WITH {_RETRIEVE} SELECT item_id, doc_id, round(score, 5) AS score, rank FROM ranked")
def tfidf_retrieval(spark, sf_dir):
    return rounded(_retrieval(spark, sf_dir)[0], "score", digits=5)


@query(f"WITH {_RETRIEVE}, truth AS (SELECT item_id, item_id * 3 AS relevant FROM benchmark), f AS (SELECT item_id, min(rank) AS r FROM ranked JOIN truth USING (item_id) WHERE doc_id % 10 = relevant % 10 GROUP BY 1) SELECT round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall, round(avg(coalesce(1 / r, 0)), 6) AS mrr, count(*) AS n FROM truth LEFT JOIN f USING (item_id)")
def retrieval_recall_mrr(spark, sf_dir):
    ranked, queries = _retrieval(spark, sf_dir)
    truth = queries.select("item_id", (F.col("item_id") * 3 % 10).alias("relevant"))
    return rounded(text.retrieval_quality(ranked.withColumn("decade", F.col("doc_id") % 10), truth, "item_id", "decade", 3), "recall", "mrr")


@query(f"WITH {_RETRIEVE} SELECT item_id, md5(arg_min(text, rank)) AS answer, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS sources FROM ranked JOIN documents USING (doc_id) GROUP BY 1")
def extractive_answer(spark, sf_dir):
    ranked, _ = _retrieval(spark, sf_dir)
    withtext = ranked.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return text.extractive_answer(withtext, "item_id", "doc_id", "text").withColumn("answer", F.md5("answer"))


@query()
def mmr_select(spark, sf_dir):
    queries, vectors = _vectors(spark, sf_dir)
    pool = text.cosine_topk(queries, vectors, 20, "q", "vec_id").join(vectors, "vec_id")
    return text.mmr(pool, 5, "q", "vec_id", "embedding", "score")


@query("SELECT doc_id, CASE WHEN f < 0.7 THEN 'train' WHEN f < 0.85 THEN 'val' ELSE 'test' END AS part FROM (SELECT doc_id, ('0x' || substring(sha256('42:' || doc_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS f FROM documents)")
def hash_split(spark, sf_dir):
    f = tx.hash_fraction(F.col("doc_id"), 42)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(f < 0.7, "train").when(f < 0.85, "val").otherwise("test").alias("part"))


@query("SELECT n_nationkey, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM nation")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.slug(F.col("n_name")).alias("slug"))


@query("SELECT label AS y, count(*) AS n, round(max(list_cosine_similarity(embedding::DOUBLE[], embedding[33:64]::DOUBLE[] || embedding[1:32]::DOUBLE[])), 5) AS top FROM embeddings GROUP BY 1")
def cosine_rows(spark, sf_dir):
    turned = F.concat(F.slice("embedding", 33, 32), F.slice("embedding", 1, 32))
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(tx.cosine(F.col("embedding"), turned)), 5).alias("top"))
