"""Metrics of classifiers, regressions and rankings, by aggregation alone.

Global orders (ROC, rank AUC) are taken over score groups: rows are first counted by score, then cumulated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered, running


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    yes, said = F.col(y) == 1, F.col(pred) == 1
    return df.agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ~said).alias("tn"))


def precision_recall_f1(df: DataFrame, y: str = "y", pred: str = "pred", empty: float = 0.0) -> DataFrame:
    """accuracy, precision, recall, f1, iou of the positive class; ``empty`` where a denominator is 0."""
    c = confusion_counts(df, y, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(_ratio(tp + tn, tp + fp + fn + tn, empty).alias("accuracy"), _ratio(tp, tp + fp, empty).alias("precision"), _ratio(tp, tp + fn, empty).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn, empty).alias("f1"), _ratio(tp, tp + fp + fn, empty).alias("iou"))


def thresholded(df: DataFrame, score: str, threshold: float = 0.5, ignore: Column | None = None) -> DataFrame:
    return (df if ignore is None else df.where(~ignore)).withColumn("pred", (F.col(score) >= threshold).cast("int"))


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, y: str, pred: str, empty: float | None = 0.0) -> DataFrame:
    """(class, support, precision, recall, f1, iou) of every class that occurs in either column; null for undefined if ``empty`` is None."""
    none = F.lit(0).cast("long")
    side = lambda c, actual, said, hit: F.struct(c.alias("class"), actual.alias("actual"), said.alias("said"), hit.alias("hit"))
    n, same = F.col("n"), F.col("y") == F.col("pred")
    cells = confusion_matrix(df, y, pred).select(F.inline(F.array(side(F.col("y"), n, none, F.when(same, n).otherwise(none)), side(F.col("pred"), none, n, none))))
    c = cells.groupBy("class").agg(*[F.sum(x).alias(x) for x in ("actual", "said", "hit")])
    hit, said, actual = (F.col(x) for x in ("hit", "said", "actual"))
    return c.select("class", actual.alias("support"), _ratio(hit, said, empty).alias("precision"), _ratio(hit, actual, empty).alias("recall"), _ratio(2 * hit, said + actual, empty).alias("f1"), _ratio(hit, said + actual - hit, empty).alias("iou"))


def multiclass_summary(df: DataFrame, y: str, pred: str) -> DataFrame:
    """accuracy, macro_f1, micro_f1, kappa, mean_iou, fw_iou; one row."""
    classes = per_class(df, y, pred).join(df.groupBy(F.col(pred).alias("class")).agg(F.count(F.lit(1)).alias("said")), "class", "left").fillna(0, ["said"])
    a = classes.agg(
        F.sum("support").cast("double").alias("n"), F.sum(F.col("recall") * F.col("support")).alias("hit"), F.avg("f1").alias("macro_f1"), F.avg("iou").alias("mean_iou"),
        F.sum(F.col("support").cast("double") * F.col("said")).alias("chance"), F.sum(F.col("support") * F.col("iou")).alias("weighted"),
    )
    n, hit = F.col("n"), F.col("hit")
    expected = F.try_divide(F.col("chance"), n * n)
    return a.select(_ratio(hit, n).alias("accuracy"), "macro_f1", _ratio(hit, n).alias("micro_f1"), _ratio(hit / n - expected, 1 - expected).alias("kappa"), "mean_iou", _ratio(F.col("weighted"), n).alias("fw_iou"))


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """Positives and negatives at each score and above it."""
    groups = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("q"))
    return running(groups, [F.desc("score")], {"tp": "p", "fp": "q"})


def _totals(df: DataFrame, y: str) -> DataFrame:
    return F.broadcast(df.agg(F.count_if(F.col(y) == 1).alias("np"), F.count_if(F.col(y) != 1).alias("nq")))  # one row


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(score, fpr, tpr), one point a score; the point (0, 0) has a null score."""
    points = _by_score(df, y, score).crossJoin(_totals(df, y)).select("score", _ratio(F.col("fp"), F.col("nq")).alias("fpr"), _ratio(F.col("tp"), F.col("np")).alias("tpr"))
    return points.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def pr_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    return _by_score(df, y, score).crossJoin(_totals(df, y)).select("score", _ratio(F.col("tp"), F.col("np")).alias("recall"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; 0.5 with a single class."""
    area = _by_score(df, y, score).agg(F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("a"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return area.select(_ratio(F.col("a"), F.col("np").cast("double") * F.col("nq"), 0.5).alias("auc"))


def regression(df: DataFrame, y: str, pred: str) -> DataFrame:
    """rmse, mae, r2 (0 for a constant truth)."""
    error = F.col(y) - F.col(pred)
    a = df.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("var"))
    return a.select(F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).otherwise(0.0).alias("r2"))


def topk_accuracy(df: DataFrame, y: str, scores: str, k: int) -> DataFrame:
    """Share of rows whose class index is among the k largest of the scores array (earlier index first on ties)."""
    own = F.element_at(scores, F.col(y) + 1)
    better = F.size(F.filter(F.transform(scores, lambda s, i: (s > own) | ((s == own) & (i < F.col(y)))), lambda b: b))
    return df.agg(F.coalesce(F.avg((better < k).cast("double")), F.lit(0.0)).alias("topk_accuracy"))


def ranking(recs: DataFrame, truth: DataFrame, k: int, user: str = "user", item: str = "item", rank: str = "rank", grade: str = "grade") -> DataFrame:
    """Per user with relevant items: precision, recall, ap, ndcg at k and rr. ``recs`` has ranks from 1; ``truth`` has grades over 0."""
    top = recs.where(F.col(rank) <= k).join(truth, [user, item])
    w = Window.partitionBy(user).orderBy(rank)
    hits = top.withColumn("_hit", F.row_number().over(w)).groupBy(user).agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.col("_hit") / F.col(rank)).alias("ap"), F.sum((F.pow(F.lit(2.0), grade) - 1) / F.log2(F.col(rank) + 1)).alias("dcg"),
    )
    ideal = truth.withColumn("_r", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(grade))))
    need = ideal.groupBy(user).agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("_r") <= k, (F.pow(F.lit(2.0), grade) - 1) / F.log2(F.col("_r") + 1))).alias("idcg"))
    first = recs.join(truth, [user, item], "left_semi").groupBy(user).agg(F.min(rank).alias("first"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return need.join(hits, user, "left").join(first, user, "left").select(
        user, zero(F.col("hits") / k).alias("precision"), zero(F.col("hits") / F.col("relevant")).alias("recall"), zero(F.col("ap") / F.least("relevant", F.lit(k))).alias("ap"), zero(F.try_divide("dcg", "idcg")).alias("ndcg"), zero(1 / F.col("first")).alias("rr"),
    )


def catalog_coverage(recs: DataFrame, catalog: DataFrame, item: str = "item") -> DataFrame:
    seen = catalog.select(item).distinct().join(recs.select(item, F.lit(1).alias("_s")).distinct(), item, "left")
    return seen.agg(_ratio(F.count("_s"), F.count(F.lit(1))).alias("coverage"))


def popularity(df: DataFrame, item: str, k: int, exclude: DataFrame | None = None) -> DataFrame:
    """The k most frequent items (ties by item), without those of ``exclude``."""
    rows = df if exclude is None else df.join(exclude.select(item).distinct(), item, "left_anti")
    return rows.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), item).limit(k)


def holdout_split(df: DataFrame, user: str, item: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """Rows with ``part``: per user floor(n * test) and floor(n * val) rows by a hash of seed and item, the rest for training."""
    n = F.count(F.lit(1)).over(Window.partitionBy(user))
    r = F.row_number().over(Window.partitionBy(user).orderBy(F.xxhash64(F.lit(seed), item), item))
    return df.withColumns({"_n": n, "_r": r}).withColumn("part", F.when(F.col("_r") <= F.floor(F.col("_n") * test), "test").when(F.col("_r") <= F.floor(F.col("_n") * test) + F.floor(F.col("_n") * val), "val").otherwise("train")).drop("_n", "_r")


def stratified_split(df: DataFrame, label: str, row_id: str, fractions: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 0) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(label))
    r = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), row_id), row_id))
    a, b = F.round(n * fractions[0]), F.round(n * (fractions[0] + fractions[1]))
    return df.withColumns({"_a": a, "_b": b, "_r": r}).withColumn("part", F.when(F.col("_r") <= F.col("_a"), "train").when(F.col("_r") <= F.col("_b"), "val").otherwise("test")).drop("_a", "_b", "_r")


def psi(reference: DataFrame, current: DataFrame, value: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index over the reference's quantile bins with open ends."""
    cuts = F.array_distinct(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).alias("cuts")
    edges = F.broadcast(reference.agg(cuts))  # one row
    rows = reference.select(value, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(current.select(value, F.lit(0).alias("a"), F.lit(1).alias("b"))).where(F.col(value).isNotNull()).crossJoin(edges)
    place = F.size(F.filter("cuts", lambda c: c <= F.col(value)))
    counted = rows.groupBy(place.alias("bin"), "cuts").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    spine = edges.select(F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("bin"))
    full = spine.join(counted.drop("cuts"), "bin", "left").fillna(0)
    total = Window.partitionBy()
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(total), F.lit(eps))
    return full.select(share("a").alias("p"), share("b").alias("q")).agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Largest gap between the two empirical distribution functions."""
    both = reference.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(current.select(F.col(value).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("v is not null")
    groups = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = running(groups, ["v"], {"upto_a": "a", "upto_b": "b"})
    total = F.broadcast(upto.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b")))  # one row
    gap = F.abs(F.col("upto_a") / F.col("all_a") - F.col("upto_b") / F.col("all_b"))
    return upto.crossJoin(total).select(gap.alias("g")).agg(F.coalesce(F.max("g"), F.lit(0.0)).alias("ks"))


def feature_drift_report(reference: DataFrame, current: DataFrame, features: list[str], threshold: float = 0.25) -> DataFrame:
    """(feature, psi, ks, drifted), each feature a plan of its own."""
    parts = [psi(reference, current, f).crossJoin(F.broadcast(ks(reference, current, f))).select(F.lit(f).alias("feature"), "psi", "ks", (F.col("psi") > threshold).alias("drifted")) for f in features]
    return reduce(DataFrame.unionByName, parts)


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by population deviation; a deviation of 0 counts as 1."""
    stats = F.broadcast(df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]))  # one row
    out = df.crossJoin(stats)
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0))
    return out.select(*df.columns)


def gini(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Weighted Gini coefficient by prefix sums over value groups; 0 for an empty or zero-mean input, an error for a negative value."""
    w = F.col(weight) if weight else F.lit(1.0)
    x = F.when(F.col(value) < 0, F.raise_error(F.lit("negative value"))).otherwise(F.col(value))
    groups = df.where(F.col(value).isNotNull()).groupBy(x.alias("x")).agg(F.sum(w).alias("w"))
    cum = running(groups, ["x"], {"cw": "w"})
    a = cum.agg(F.sum(F.col("w") * F.col("x") * (2 * F.col("cw") - F.col("w"))).alias("s"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("t"))
    return a.select(F.coalesce(F.try_divide(F.col("s"), F.col("n") * F.col("t")) - 1, F.lit(0.0)).alias("gini"))


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Rows with ``rejected``: p at most the largest p of rank k with p <= k / m * alpha. Ranks are counted over groups of equal p."""
    groups = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(groups, ["v"], {"rank": "n"})
    m = F.broadcast(ranked.agg(F.sum("n").alias("m")))  # one row
    cut = ranked.crossJoin(m).select("v", (F.col("v") <= F.col("rank") / F.col("m") * alpha).alias("ok")).agg(F.max(F.when(F.col("ok"), F.col("v"))).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("rejected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def batch_metrics(df: DataFrame, image: str, y: str, score: str, threshold: float = 0.5, ignore: Column | None = None) -> DataFrame:
    """Means over images of iou, f1, precision and recall of thresholded scores; an empty denominator counts as 1."""
    rows = thresholded(df, score, threshold, ignore)
    yes, said = F.col(y) == 1, F.col("pred") == 1
    c = rows.groupBy(image).agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.agg(F.avg(_ratio(tp, tp + fp + fn, 1.0)).alias("iou"), F.avg(_ratio(2 * tp, 2 * tp + fp + fn, 1.0)).alias("f1"), F.avg(_ratio(tp, tp + fp, 1.0)).alias("precision"), F.avg(_ratio(tp, tp + fn, 1.0)).alias("recall"))


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows with ``label_index``: the label's place among the sorted different labels."""
    index = numbered(df.select(label).where(F.col(label).isNotNull()).distinct(), [label], "label_index").withColumn("label_index", F.col("label_index").cast("int"))
    return df.join(index, label, "left")


def rank_engines(runs: DataFrame, engine: str = "engine", seconds: str = "seconds") -> DataFrame:
    """Median seconds of each engine with its dense rank and how many times the fastest it takes."""
    m = runs.groupBy(engine).agg(F.median(seconds).alias("seconds"))
    return m.select(engine, "seconds", F.dense_rank().over(Window.orderBy("seconds")).alias("rank"), (F.col("seconds") / F.min("seconds").over(Window.partitionBy())).alias("times_fastest"))
