"""Queries for classifier, regression and ranking metrics, drift and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import metrics
from tessera.sources.tables import table

from .inputs import SCORES, rounded, scores

_CONF = "c AS (SELECT count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y <> 1 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred <> 1) AS fn, count(*) FILTER (y <> 1 AND pred <> 1) AS tn FROM scores)"


@query(f"WITH {SCORES}, {_CONF} SELECT tp, fp, fn, tn FROM c")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_counts(scores(spark, sf_dir))


@query(f"WITH {SCORES}, {_CONF} SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou FROM c")
def precision_recall_f1(spark, sf_dir):
    return rounded(metrics.precision_recall_f1(scores(spark, sf_dir)), "accuracy", "precision", "recall", "f1", "iou")


_CUM = "g AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS q FROM scores GROUP BY 1), cum AS (SELECT score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {SCORES}, {_CUM} SELECT score, round(fp / nq, 6) AS fpr, round(tp / np, 6) AS tpr FROM cum UNION ALL SELECT NULL, 0, 0")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(scores(spark, sf_dir)), "fpr", "tpr")


@query(f"WITH {SCORES}, {_CUM} SELECT score, round(tp / np, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM cum")
def pr_curve(spark, sf_dir):
    return rounded(metrics.pr_curve(scores(spark, sf_dir)), "recall", "precision")


@query(f"WITH {SCORES}, {_CUM} SELECT round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS auc FROM cum")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scores(spark, sf_dir)), "auc")


_MULTI = """m AS (SELECT l_linenumber AS y, CAST((l_linenumber + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) % 8 AS INTEGER) AS pred FROM lineitem),
k AS (SELECT y AS class, 1 AS a, 0 AS s, CASE WHEN y = pred THEN 1 ELSE 0 END AS h FROM m UNION ALL SELECT pred, 0, 1, 0 FROM m),
per AS (SELECT class, sum(a)::BIGINT AS support, sum(s) AS said, sum(h) AS hit FROM k GROUP BY 1),
f AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / nullif(said + support, 0), 0) AS f1, coalesce(hit / nullif(said + support - hit, 0), 0) AS iou FROM per)"""


def _multi(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as y", "cast((l_linenumber + case when l_partkey % 3 = 0 then 1 else 0 end) % 8 as int) as pred")


@query(f"WITH {_MULTI} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(iou, 6) AS iou FROM f")
def per_class_scores(spark, sf_dir):
    return rounded(metrics.per_class(_multi(spark, sf_dir), "y", "pred"), "precision", "recall", "f1", "iou")


@query(f"WITH {_MULTI} SELECT y, pred, count(*) AS n FROM m GROUP BY 1, 2")
def multiclass_confusion(spark, sf_dir):
    return metrics.confusion_matrix(_multi(spark, sf_dir), "y", "pred")


_SUMMARY = {
    "macro_f1": "avg(f1)",
    "micro_f1": "sum(hit) / sum(support)",
    "cohen_kappa": "(sum(hit) / sum(support) - sum(support * said) / (sum(support) * sum(support))) / (1 - sum(support * said) / (sum(support) * sum(support)))",
    "mean_iou": "avg(iou)",
    "fw_iou": "sum(support * iou) / sum(support)",
}
for _name, _sql in _SUMMARY.items():
    _column = {"cohen_kappa": "kappa"}.get(_name, _name)
    query(f"WITH {_MULTI} SELECT round({_sql}, 6) AS {_column} FROM f", _name)(lambda spark, sf_dir, c=_column: rounded(metrics.multiclass_summary(_multi(spark, sf_dir), "y", "pred").select(c), c))


@query(f"WITH {SCORES}, {_CONF} SELECT round(tp / nullif(tp + fp + fn, 0), 6) AS iou FROM c")
def iou(spark, sf_dir):
    return rounded(metrics.precision_recall_f1(scores(spark, sf_dir), empty=1.0).select("iou"), "iou")


@query("""WITH e AS (SELECT vec_id, label % 8 AS y, embedding[1:8] AS s FROM embeddings), o AS (SELECT y, s, s[y + 1] AS own FROM e)
SELECT round(avg((len(list_filter(range(8), lambda i: s[i + 1] > own OR (s[i + 1] = own AND i < y))) < 3)::INT), 6) AS topk_accuracy FROM o""")
def topk_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").selectExpr("label % 8 as y", "slice(embedding, 1, 8) as s")
    return rounded(metrics.topk_accuracy(e, "y", "s", 3), "topk_accuracy")


@query("SELECT round(sqrt(avg(pow(l_quantity - l_tax * 500, 2))), 5) AS rmse, round(avg(abs(l_quantity - l_tax * 500)), 5) AS mae, round(1 - avg(pow(l_quantity - l_tax * 500, 2)) / var_pop(l_quantity), 5) AS r2 FROM lineitem")
def mae_r2(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_quantity as y", "l_tax * 500 as pred")
    return rounded(metrics.regression(df, "y", "pred"), "rmse", "mae", "r2", digits=5)


@query("SELECT round(sqrt(avg(pow(l_quantity - l_tax * 500, 2))), 5) AS rmse FROM lineitem")
def rmse(spark, sf_dir):
    return rounded(metrics.regression(table(spark, sf_dir, "lineitem").selectExpr("l_quantity as y", "l_tax * 500 as pred"), "y", "pred").select("rmse"), "rmse", digits=5)


_BUYS = "buys AS (SELECT DISTINCT o_custkey AS u, p_size AS item, l_linenumber AS grade FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), g AS (SELECT u AS \"user\", item, max(grade) AS grade FROM buys GROUP BY 1, 2)"


def _buys(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = line.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("user"), F.col("p_size").alias("item")).agg(F.max("l_linenumber").alias("grade"))


@query(f"WITH {_BUYS} SELECT item, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, item LIMIT 10")
def popularity_topk(spark, sf_dir):
    return metrics.popularity(_buys(spark, sf_dir), "item", 10)


@query(f"WITH {_BUYS} SELECT item, count(*) AS n FROM g WHERE item NOT IN (SELECT item FROM g WHERE \"user\" = 7) GROUP BY 1 ORDER BY n DESC, item LIMIT 10")
def popularity_excluding_seen(spark, sf_dir):
    buys = _buys(spark, sf_dir)
    return metrics.popularity(buys, "item", 10, exclude=buys.where("user = 7"))


_RANKED = f"""{_BUYS}, recs AS (SELECT u AS "user", (u * 7 + r * 11) % 50 + 1 AS item, r AS rank FROM (SELECT DISTINCT "user" AS u FROM g), range(1, 11) t(r)),
hits AS (SELECT "user", rank, grade, row_number() OVER (PARTITION BY "user" ORDER BY rank) AS h FROM recs JOIN g USING ("user", item)),
ideal AS (SELECT "user", count(*) AS rel, sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY grade DESC) AS r FROM g) GROUP BY 1),
per AS (SELECT "user", coalesce(any_value(n) / 10, 0) AS precision, coalesce(any_value(n) / any_value(rel), 0) AS recall, coalesce(any_value(ap) / least(any_value(rel), 10), 0) AS ap, coalesce(any_value(dcg) / any_value(idcg), 0) AS ndcg, coalesce(1 / any_value(first), 0) AS rr
  FROM ideal LEFT JOIN (SELECT "user", count(*) AS n, sum(h / rank) AS ap, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg, min(rank) AS first FROM hits GROUP BY 1) USING ("user") GROUP BY 1)"""


def _recs(spark, sf_dir):
    buys = _buys(spark, sf_dir)
    recs = buys.select("user").distinct().select("user", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank"))
    return recs.select("user", F.expr("cast((user * 7 + rank * 11) % 50 + 1 as int)").alias("item"), "rank"), buys


for _name, _column in {"precision_at_k": "precision", "recall_at_k": "recall", "ndcg_at_k": "ndcg", "map_at_k": "ap", "mrr": "rr"}.items():
    query(f"WITH {_RANKED} SELECT round(avg({_column}), 6) AS {_name} FROM per", _name)(lambda spark, sf_dir, c=_column, n=_name: metrics.ranking(*_recs(spark, sf_dir), 10).agg(F.round(F.avg(c), 6).alias(n)))


@query(f"WITH {_RANKED} SELECT round((SELECT count(DISTINCT item) FROM recs WHERE item IN (SELECT p_size FROM part)) / (SELECT count(DISTINCT p_size) FROM part), 6) AS coverage")
def catalog_coverage(spark, sf_dir):
    recs, _ = _recs(spark, sf_dir)
    return rounded(metrics.catalog_coverage(recs, table(spark, sf_dir, "part").select(F.col("p_size").alias("item"))), "coverage")


_HALVES = "r AS (SELECT o_totalprice AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01'), c AS (SELECT o_totalprice * 1.1 + 500 AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')"


def _halves(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.expr("timestamp_ntz '1998-06-01'")
    return o.where(early).select(F.col("o_totalprice").alias("v")), o.where(~early).select((F.col("o_totalprice") * 1.1 + 500).alias("v"))


_PSI = f"""{_HALVES}, e AS (SELECT list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM r),
b AS (SELECT len(list_filter(cuts, lambda x: x <= v)) AS bin, a, bb FROM (SELECT v, 1 AS a, 0 AS bb FROM r UNION ALL SELECT v, 0, 1 FROM c), e),
n AS (SELECT bin, greatest(sum(a) / sum(sum(a)) OVER (), 1e-6) AS p, greatest(sum(bb) / sum(sum(bb)) OVER (), 1e-6) AS q FROM b GROUP BY 1), psi AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM n),
g AS (SELECT v, sum(a) AS a, sum(bb) AS bb FROM (SELECT v, 1 AS a, 0 AS bb FROM r UNION ALL SELECT v, 0, 1 FROM c) GROUP BY 1),
ks AS (SELECT max(d) AS ks FROM (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(bb) OVER w / sum(bb) OVER ()) AS d FROM g WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)))"""


@query(f"WITH {_PSI} SELECT round(psi, 6) AS psi FROM psi")
def psi(spark, sf_dir):
    return rounded(metrics.psi(*_halves(spark, sf_dir), "v"), "psi")


@query(f"WITH {_PSI} SELECT round(ks, 6) AS ks FROM ks")
def ks(spark, sf_dir):
    return rounded(metrics.ks(*_halves(spark, sf_dir), "v"), "ks")


@query(f"WITH {_PSI} SELECT 'v' AS feature, round(psi, 6) AS psi, round(ks, 6) AS ks, psi > 0.01 AS drifted FROM psi, ks")
def feature_drift_report(spark, sf_dir):
    return rounded(metrics.feature_drift_report(*_halves(spark, sf_dir), ["v"], threshold=0.01), "psi", "ks")


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def standardize(spark, sf_dir):
    return rounded(metrics.standardize(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), "c_acctbal")


@query("WITH c AS (SELECT s_acctbal + 1000 AS x, (s_suppkey % 5 + 1)::DOUBLE AS w FROM supplier), o AS (SELECT x, sum(w) AS w FROM c GROUP BY 1), cum AS (SELECT *, sum(w) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS cw FROM o) SELECT round(sum(w * x * (2 * cw - w)) / (sum(w) * sum(w * x)) - 1, 6) AS gini FROM cum")
def gini(spark, sf_dir):
    return rounded(metrics.gini(table(spark, sf_dir, "supplier").selectExpr("s_acctbal + 1000 as x", "cast(s_suppkey % 5 + 1 as double) as w"), "x", "w"), "gini")


@query("WITH p AS (SELECT event_id, pow((event_id * 37 % 1009 + 1) / 1010.0::DOUBLE, 4) AS p FROM events), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM p), c AS (SELECT max(p) AS cut FROM r WHERE p <= k / m * 0.05) SELECT event_id, coalesce(p <= cut, false) AS rejected FROM p, c")
def bh_fdr(spark, sf_dir):
    p = table(spark, sf_dir, "events").selectExpr("event_id", "pow((event_id * 37 % 1009 + 1) / 1010D, 4) as p")
    return metrics.benjamini_hochberg(p, "p").select("event_id", "rejected")


@query()
def holdout_split(spark, sf_dir):
    return metrics.holdout_split(_buys(spark, sf_dir), "user", "item", 0.1, 0.2).groupBy("user").pivot("part", ["train", "val", "test"]).count().na.fill(0)


@query()
def stratified_split(spark, sf_dir):
    return metrics.stratified_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id").groupBy("label").pivot("part", ["train", "val", "test"]).count().na.fill(0)


@query("""WITH p AS (SELECT l_linenumber AS image, l_returnflag = 'R' AS y, l_discount * 10 >= 0.5 AS s FROM lineitem WHERE l_tax > 0.01), c AS (SELECT image, count(*) FILTER (y AND s) AS tp, count(*) FILTER (NOT y AND s) AS fp, count(*) FILTER (y AND NOT s) AS fn FROM p GROUP BY 1)
SELECT round(avg(coalesce(tp / nullif(tp + fp + fn, 0), 1)), 6) AS iou, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 1)), 6) AS f1, round(avg(coalesce(tp / nullif(tp + fp, 0), 1)), 6) AS precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 1)), 6) AS recall FROM c""")
def batch_metrics(spark, sf_dir):
    px = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as image", "int(l_returnflag = 'R') as y", "l_discount * 10 as s", "l_tax")
    return rounded(metrics.batch_metrics(px, "image", "y", "s", ignore=F.col("l_tax") <= 0.01), "iou", "f1", "precision", "recall")


@query("SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS label_index FROM customer")
def encode_labels(spark, sf_dir):
    return metrics.encode_labels(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("WITH m AS (SELECT event_type AS engine, median(value) AS seconds FROM events GROUP BY 1) SELECT engine, round(seconds, 6) AS seconds, dense_rank() OVER (ORDER BY seconds)::INTEGER AS rank, round(seconds / min(seconds) OVER (), 6) AS times_fastest FROM m")
def rank_engines(spark, sf_dir):
    return rounded(metrics.rank_engines(table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("value").alias("seconds"))), "seconds", "times_fastest")
