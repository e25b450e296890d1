"""Evaluation metrics and significance tests.

Counts are conditional aggregates (one pass, partial aggregation).  Ranking
metrics (ROC-AUC, average precision, curves) first collapse rows to one row
per distinct score, then take distributed running sums
(``txnguard.plans.scale.global_cumsum``) -- never a global sort in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnguard.operators.aggregates import prf_cols, r6
from txnguard.plans.scale import exact_quantiles, global_cumsum


def confusion(df: DataFrame, label: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    aggs = [F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
            F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def prf(counts: DataFrame) -> DataFrame:
    return counts.select("*", *prf_cols())


def fpr_fnr(counts: DataFrame) -> DataFrame:
    fp, tn, fn, tp = (F.col(c) for c in ("fp", "tn", "fn", "tp"))
    return counts.select("*", r6(F.when(fp + tn > 0, fp / (fp + tn)).otherwise(0.0)).alias("fpr"),
                         r6(F.when(fn + tp > 0, fn / (fn + tp)).otherwise(0.0)).alias("fnr"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted avg."""
    c = confusion(df, label, pred)
    # class 1 is the positive class; class 0 swaps the roles.
    one = c.select(F.lit("1").alias("class"), F.col("tp"), F.col("fp"), F.col("fn"),
                   (F.col("tp") + F.col("fn")).alias("support"))
    zero = c.select(F.lit("0").alias("class"), F.col("tn").alias("tp"), F.col("fn").alias("fp"),
                    F.col("fp").alias("fn"), (F.col("tn") + F.col("fp")).alias("support"))
    per = one.unionByName(zero).select("class", "support", *prf_cols())
    tot = per.agg(F.sum("support").alias("n"))
    acc = c.select(F.lit("accuracy").alias("class"), (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
                   .alias("support"),
                   r6((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
                   .alias("precision")).select("class", "support", "precision",
                                               F.col("precision").alias("recall"), F.col("precision").alias("f1"))
    macro = per.agg(F.lit("macro avg").alias("class"), F.sum("support").alias("support"),
                    r6(F.avg("precision")).alias("precision"), r6(F.avg("recall")).alias("recall"),
                    r6(F.avg("f1")).alias("f1"))
    weighted = per.crossJoin(tot).agg(
        F.lit("weighted avg").alias("class"), F.sum("support").alias("support"),
        *[r6(F.sum(F.col(m) * F.col("support")) / F.first("n")).alias(m) for m in ("precision", "recall", "f1")])
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


def two_views(df: DataFrame, label: str, decision: str = "decision") -> DataFrame:
    """Flagged (REVIEW or BLOCK) and block-only binary views, with P/R/F1."""
    d = F.col(decision)
    v = df.select(label, d.isin("REVIEW", "BLOCK").cast("int").alias("flagged"),
                  (d == "BLOCK").cast("int").alias("block_only"))
    a = confusion(v, label, "flagged").withColumn("view", F.lit("flagged"))
    b = confusion(v, label, "block_only").withColumn("view", F.lit("block_only"))
    return prf(a.unionByName(b))


def _score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    return (df.where(F.col(score).isNotNull())
            .groupBy(F.col(score).alias("s"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def _desc_cum(df: DataFrame, score: str, label: str) -> DataFrame:
    t = _score_counts(df, score, label).withColumn("neg_s", -F.col("s"))
    return global_cumsum(t, ["neg_s"], ["pos", "neg"]).drop("neg_s")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with ties counted 1/2; null with a single class."""
    t = _score_counts(df, score, label)
    cum = global_cumsum(t, ["s"], ["neg"])   # ascending: negatives at or below s
    tot = t.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    part = cum.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * 0.5)).alias("__u"))
    return part.crossJoin(tot).select(
        r6(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("__u") / (F.col("P") * F.col("N"))))
        .alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Step-wise AP: sum over distinct thresholds of (R_n - R_{n-1}) * P_n."""
    cum = _desc_cum(df, score, label)
    tot = cum.agg(F.sum("pos").alias("P"))
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    ap = cum.agg(F.sum(F.col("pos") * prec).alias("__s"))
    return ap.crossJoin(tot).select(r6(F.when(F.col("P") > 0, F.col("__s") / F.col("P"))).alias("average_precision"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    cum = _desc_cum(df, score, label)
    tot = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.crossJoin(tot).select(F.col("s").alias("threshold"),
                                     r6(F.col("cum_neg") / F.col("N")).alias("fpr"),
                                     r6(F.col("cum_pos") / F.col("P")).alias("tpr"))


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    cum = _desc_cum(df, score, label)
    tot = cum.agg(F.sum("pos").alias("P"))
    return cum.crossJoin(tot).select(
        F.col("s").alias("threshold"), r6(F.col("cum_pos") / F.col("P")).alias("recall"),
        r6(F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"))


def single_class_guard(df: DataFrame, label: str, metrics: DataFrame) -> DataFrame:
    """Null every metric column when only one class is present."""
    n = df.agg(F.count_distinct(label).alias("__k"))
    cols = metrics.columns
    return metrics.crossJoin(n).select(*[F.when(F.col("__k") > 1, F.col(c)).alias(c) for c in cols])


def model_comparison(df: DataFrame, label: str, models: dict[str, tuple[str, str]],
                     split: str | None = None) -> DataFrame:
    """Rows (model, split, metric, value) for each model ``name -> (score, pred)``."""
    parts = []
    for name, (score, pred) in models.items():
        c = prf(confusion(df, label, pred))
        auc = roc_auc(df, score, label)
        ap = average_precision(df, score, label)
        m = c.crossJoin(auc).crossJoin(ap)
        long = m.selectExpr(
            f"'{name}' AS model",
            "stack(5, 'precision', precision, 'recall', recall, 'f1', f1, 'roc_auc', roc_auc, "
            "'average_precision', average_precision) AS (metric, value)")
        parts.append(long)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mcnemar_counts(df: DataFrame, label: str, pred_a: str, pred_b: str) -> DataFrame:
    ca = F.col(pred_a) == F.col(label)
    cb = F.col(pred_b) == F.col(label)
    return df.agg(F.count_if(ca & cb).alias("n11"), F.count_if(~ca & ~cb).alias("n00"),
                  F.count_if(ca & ~cb).alias("n01"), F.count_if(~ca & cb).alias("n10"))


def binom_cdf_half(k: int, n: int) -> float:
    """P(X <= k) for X ~ Binomial(n, 1/2).

    All chances are taken relative to the middle one: going outward, that of
    i - 1 is i / (n - i + 1) of that of i, so their logarithms are running sums
    and the share of the tail in the whole needs no factorial.  The whole is
    summed as far out as it can matter (some ten standard deviations)."""
    if n <= 0 or k >= n:
        return 1.0
    if k < 0:
        return 0.0
    if 2 * k >= n:
        return 1.0 - binom_cdf_half(n - k - 1, n)
    mid = n // 2
    reach = min(mid, int(10 * math.sqrt(n)) + 50)

    def below(top: int, terms: int) -> np.ndarray:
        """log of the chances of top - 1, top - 2, ... relative to that of top."""
        i = np.arange(top, top - terms, -1, dtype=np.float64)
        return np.cumsum(np.log(i) - np.log(n - i + 1))
    half = np.exp(below(mid, reach)).sum()  # below the middle; as much lies above it
    whole = 1.0 + 2.0 * half if n % 2 == 0 else 2.0 * (1.0 + half)
    if mid - k <= 50_000_000:
        at_k = float(below(mid, mid - k)[-1]) if k < mid else 0.0
    else:  # beyond any chance that a double holds for such n
        return 0.0
    tail = 1.0 + np.exp(below(k, min(k, reach))).sum() if k else 1.0
    return min(1.0, float(math.exp(at_k) * tail / whole))


def _mcnemar_p(n01: pd.Series, n10: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(n01.astype("int64"), n10.astype("int64")):
        n = int(a + b)
        out.append(1.0 if n == 0 else min(1.0, 2.0 * binom_cdf_half(int(min(a, b)), n)))
    return pd.Series(out, dtype="float64")


def mcnemar(df: DataFrame, label: str, pred_a: str, pred_b: str, alpha: float = 0.05) -> DataFrame:
    """Exact McNemar test on the discordant pairs (one-row result)."""
    c = mcnemar_counts(df, label, pred_a, pred_b)
    p = F.pandas_udf(_mcnemar_p, "double")(F.col("n01"), F.col("n10"))
    return c.withColumn("p_value", r6(p)).withColumn(
        "verdict", F.when(F.col("p_value") < alpha, "significant").otherwise("not significant"))


def mcnemar_direction(df: DataFrame, label: str, pred_a: str, pred_b: str, alpha: float = 0.05, small: int = 25) -> DataFrame:
    """The test that fits the number of discordant pairs, one row: up to
    ``small`` the exact one (statistic: the smaller count), beyond it chi-squared
    with continuity correction (1 degree of freedom); and which model is better,
    ``a``, ``b``, ``neither`` (equal counts) or ``none`` (not significant)."""
    c = mcnemar_counts(df, label, pred_a, pred_b)
    a, b = F.col("n01"), F.col("n10")
    n = a + b
    gap = F.abs(a - b) - 1
    statistic = F.when(n <= small, F.least(a, b).cast("double")).otherwise(gap * gap / n)
    tail = F.pandas_udf(lambda s: s.map(lambda v: math.erfc(math.sqrt(v / 2))), "double")
    exact = F.pandas_udf(_mcnemar_p, "double")
    p = F.when(n <= small, exact(a, b)).otherwise(tail(F.coalesce(statistic, F.lit(0.0))))
    c = c.select("n01", "n10", F.when(n <= small, "exact").otherwise("chi2").alias("test"), r6(statistic).alias("statistic"), p.alias("p"))
    better = F.when(a > b, "a").when(b > a, "b").otherwise("neither")
    return c.withColumn("direction", F.when(F.col("p") < alpha, better).otherwise("none")).withColumn("p_value", r6(F.col("p"))).drop("p")


def bootstrap_ci(df: DataFrame, label: str, pred_a: str, pred_b: str, n_boot: int = 5000,
                 seed: int = 42, n_tasks: int | None = None) -> DataFrame:
    """Bootstrap of delta precision / recall / F1 (b - a).

    A row resample only changes how often each of the 8 (y, a, b) cells is
    drawn, so each resample is one multinomial draw over the cell counts:
    the same distribution as resampling rows, without an n x B blow-up.
    Resamples are spread over ``spark.range`` partitions; every draw is
    seeded by (seed, resample id), so results ignore the partitioning.
    """
    spark = df.sparkSession
    cells = df.groupBy(F.col(label).cast("int").alias("y"), F.col(pred_a).cast("int").alias("a"),
                       F.col(pred_b).cast("int").alias("b")).count()
    counts = {(r["y"], r["a"], r["b"]): r["count"] for r in cells.collect()}  # at most 8 rows
    keys = [(y, a, b) for y in (0, 1) for a in (0, 1) for b in (0, 1)]
    vec = np.array([counts.get(k, 0) for k in keys], dtype=np.int64)
    n = int(vec.sum())
    probs = vec / n if n else np.full(8, 1 / 8)
    ys, as_, bs = (np.array([k[i] for k in keys]) for i in range(3))

    def metrics(c, pred):
        tp = c[:, (ys == 1) & (pred == 1)].sum(1)
        fp = c[:, (ys == 0) & (pred == 1)].sum(1)
        fn = c[:, (ys == 1) & (pred == 0)].sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(tp + fp > 0, tp / np.maximum(tp + fp, 1), 0.0)
            r = np.where(tp + fn > 0, tp / np.maximum(tp + fn, 1), 0.0)
            f = np.where(p + r > 0, 2 * p * r / np.where(p + r > 0, p + r, 1), 0.0)
        return p, r, f

    def draw(it):
        for pdf in it:
            ids = pdf["id"].to_numpy()
            c = np.stack([np.random.default_rng([seed, int(i)]).multinomial(n, probs) for i in ids]) \
                if len(ids) else np.zeros((0, 8), dtype=np.int64)
            pa, ra, fa = metrics(c, as_)
            pb, rb, fb = metrics(c, bs)
            yield pd.DataFrame({"id": ids, "d_precision": pb - pa, "d_recall": rb - ra, "d_f1": fb - fa})

    parts = n_tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    boots = spark.range(0, n_boot, numPartitions=parts).mapInPandas(
        draw, "id long, d_precision double, d_recall double, d_f1 double")
    long = boots.selectExpr("stack(3, 'precision', d_precision, 'recall', d_recall, 'f1', d_f1) AS (metric, delta)")
    q = exact_quantiles(long, "delta", [0.025, 0.975], ["metric"]).groupBy("metric").agg(
        F.max(F.when(F.col("p") == 0.025, F.col("q"))).alias("ci_low"),
        F.max(F.when(F.col("p") == 0.975, F.col("q"))).alias("ci_high"))
    m = long.groupBy("metric").agg(F.avg("delta").alias("mean_delta"))
    return m.join(q, "metric").select(
        "metric", r6(F.col("mean_delta")).alias("mean_delta"), r6(F.col("ci_low")).alias("ci_low"),
        r6(F.col("ci_high")).alias("ci_high"),
        ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)).alias("crosses_zero"))


def flag_reconstruct(df: DataFrame, prob_cols: Sequence[str] = (), decision_cols: Sequence[str] = (),
                     threshold: float = 0.5, out: str = "flag") -> DataFrame:
    """Binary flag from the first present probability (>= threshold), else
    from the first present decision (REVIEW/BLOCK)."""
    cands: list[Column] = [(F.col(c) >= threshold).cast("int") for c in prob_cols if c in df.columns]
    cands += [F.when(F.col(c).isNotNull(), F.upper(F.col(c)).isin("BLOCK", "REVIEW").cast("int"))
              for c in decision_cols if c in df.columns]
    return df.withColumn(out, F.coalesce(*cands) if cands else F.lit(None).cast("int"))


def error_over_time(df: DataFrame, ts: str, err: str, label: str, bucket_hours: int = 1) -> DataFrame:
    tsc = F.col(ts).cast("timestamp")
    t0 = df.agg(F.min(tsc).alias("__t0"))
    hours = F.floor((F.unix_seconds(tsc) - F.unix_seconds(F.col("__t0"))) / (3600 * bucket_hours))
    return (df.crossJoin(F.broadcast(t0)).groupBy(hours.cast("long").alias("hours_since_start"), label)
            .agg(F.count(F.lit(1)).alias("n"), r6(F.avg(err)).alias("mean_err"), r6(F.max(err)).alias("max_err")))


def decision_totals_by_label(df: DataFrame, decision: str, label: str) -> DataFrame:
    return df.groupBy(decision).agg(F.count_if(F.col(label) == 0).alias("legit"),
                                    F.count_if(F.col(label) == 1).alias("fraud"))


def ablation(df: DataFrame, label: str, configs: dict[str, str]) -> DataFrame:
    """Confusion + P/R/F1 for several binary prediction columns side by side."""
    parts = [prf(confusion(df, label, col)).withColumn("config", F.lit(name)) for name, col in configs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked_examples(df: DataFrame, label: str, pred: str, order: Sequence[str], k: int = 5) -> DataFrame:
    """First k TP / FN / FP rows by ``order`` (column names, the first a row
    key; k is the feature: a report)."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    outcome = F.when(y & p, "TP").when(y & ~p, "FN").when(~y & p, "FP")
    from txnguard.plans.scale import top_k_per_group
    d = df.withColumn("outcome", outcome).where(F.col("outcome").isNotNull())
    return top_k_per_group(d, ["outcome"], list(order), k, tie_col=order[0])
