"""Queries for the feature pipeline and model operators.

Model operators have no SQL twin (rows-only in the driver; invariants are
tested in pytest).  ``ml_gbt_train`` trains the operator's defaults, the
reference's 300 rounds of depth 6; the queries that score, explain or retrain
a model use 30 rounds of depth 4.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txnguard.catalog import query, scored_txn
from txnguard.operators import aggregates as A
from txnguard.operators import metrics, ml, policy, shapley, windows
from txnguard.oracles import SCORED, THR, TXN, with_
from txnguard.plans.bindings import CHECKOUT_SQL, FEAT_SQL, checkout, features_txn
from txnguard.sources.tables import XGB_T_HIGH, XGB_T_LOW, read_table, txn

NUMERIC = ["amount", "geo_distance_km", "txn_count_5m", "txn_count_60m", "amount_zscore", "avg_amount_50"]
FLAGS = ["is_new_device", "is_proxy_vpn", "country_mismatch", "night_txn", "weekend_txn"]
GBT_ITER, GBT_DEPTH = 30, 4

SPLIT_SQL = """sp AS (
  SELECT *, CASE WHEN rn - 1 < floor(n * 0.70) THEN 'train' WHEN rn - 1 < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY ts, txn_id) AS rn, count(*) OVER () AS n FROM feat))"""


def split_features(spark, sf_dir):
    f = features_txn(spark, sf_dir, [*NUMERIC, *FLAGS]).select("txn_id", "ts", "label", "p_xgb", "billing_country", *NUMERIC,
                                           *[F.col(c).cast("string").alias(c) for c in FLAGS])
    split = windows.time_split(txn(spark, sf_dir).select("txn_id", "ts"), ["ts", "txn_id"])  # from the keys alone
    return f.join(split.select("txn_id", "split"), "txn_id")


def model_table(spark, sf_dir):
    """Model input of all rows.  Features and vectors are each written once: statistics and
    categories read the former, every fit and scoring the latter."""
    s = split_features(spark, sf_dir).checkpoint()
    train = s.where(F.col("split") == "train")
    x, names = ml.column_transformer(train, s, NUMERIC, FLAGS + ["billing_country"])
    return x.select("txn_id", "split", "label", "p_xgb", "features").checkpoint(), names


@query("ml_standard_scale", with_(TXN, FEAT_SQL, SPLIT_SQL) + """
, st AS (SELECT avg(amount) AS m1, stddev_pop(amount) AS s1, avg(txn_count_60m) AS m2, stddev_pop(txn_count_60m) AS s2,
                avg(geo_distance_km) AS m3, stddev_pop(geo_distance_km) AS s3 FROM sp WHERE split = 'train')
SELECT txn_id, round((amount - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1.0 END, 6) AS num__amount,
       round((txn_count_60m - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1.0 END, 6) AS num__txn_count_60m,
       round((geo_distance_km - m3) / CASE WHEN s3 > 0 THEN s3 ELSE 1.0 END, 6) AS num__geo_distance_km FROM sp, st""")
def q_scale(spark, sf_dir):
    s = split_features(spark, sf_dir)
    cols = ["amount", "txn_count_60m", "geo_distance_km"]
    out = ml.standard_scale(s.select("txn_id", "split", *cols), ml.scale_stats(s.where(F.col("split") == "train"), cols), cols)
    return out.select("txn_id", *[A.r6(F.col(f"num__{c}")).alias(f"num__{c}") for c in cols])


@query("ml_onehot", with_(TXN, FEAT_SQL, SPLIT_SQL) + """
, tc AS (SELECT DISTINCT billing_country FROM sp WHERE split = 'train' AND k < 80)
SELECT txn_id, CASE WHEN billing_country IN (SELECT billing_country FROM tc) THEN 'cat__billing_country_' || billing_country
                    ELSE '' END AS active, CASE WHEN billing_country IN (SELECT billing_country FROM tc) THEN 1.0 ELSE 0.0 END
       AS n_active FROM sp""")
def q_onehot(spark, sf_dir):
    s = split_features(spark, sf_dir).join(features_txn(spark, sf_dir, []).select("txn_id", "k"), "txn_id")
    cats = ml.train_categories(s.where((F.col("split") == "train") & (F.col("k") < 80)), ["billing_country"])
    o = ml.onehot(s.select("txn_id", "billing_country"), cats)
    names = [c for c in o.columns if c.startswith("cat__")]
    active = F.array_compact(F.array(*[F.when(F.col(n) == 1.0, F.lit(n)) for n in names]))
    return o.select("txn_id", F.array_join(active, ",").alias("active"),
                    sum((F.col(n) for n in names), F.lit(0.0)).alias("n_active"))


@query("ml_column_transformer")
def q_column_transformer(spark, sf_dir):
    x, names = model_table(spark, sf_dir)
    width = x.select(F.size(vector_to_array("features")).alias("w")).agg(F.max("w")).first()[0]
    return spark.createDataFrame([(i, n, width) for i, n in enumerate(names)], "position int, feature string, width int")


ADAPTER_FEATURES = ["num__Amount", "num__V1", "num__txn_count_60m", "num__txn_count_30m", "num__txn_count_5m",
                    "num__ip_reputation", "cat__is_new_device_True", "cat__is_new_device_False",
                    "cat__is_proxy_vpn_True", "cat__ip_country_NATION_1", "cat__billing_country_NATION_2",
                    "cat__country_mismatch_True", "cat__night_txn_True", "cat__weekend_txn_True"]


@query("ml_checkout_adapter", with_(TXN, FEAT_SQL, CHECKOUT_SQL) + """
SELECT txn_id, coalesce(amount, 0.0) AS num__Amount, 0.0 AS num__V1, CAST(velocity_1h AS DOUBLE) AS num__txn_count_60m,
  CAST(velocity_1h AS DOUBLE) AS num__txn_count_30m, CAST(greatest(0, floor(velocity_1h / 3)) AS DOUBLE) AS num__txn_count_5m,
  0.0 AS num__ip_reputation, CASE WHEN is_new_device THEN 1.0 ELSE 0.0 END AS cat__is_new_device_True,
  CASE WHEN is_new_device THEN 0.0 ELSE 1.0 END AS cat__is_new_device_False,
  CASE WHEN is_proxy_vpn THEN 1.0 ELSE 0.0 END AS cat__is_proxy_vpn_True,
  CASE WHEN ip_country = 'NATION_1' THEN 1.0 ELSE 0.0 END AS cat__ip_country_NATION_1,
  CASE WHEN country = 'NATION_2' THEN 1.0 ELSE 0.0 END AS cat__billing_country_NATION_2,
  CASE WHEN ip_country <> country THEN 1.0 ELSE 0.0 END AS cat__country_mismatch_True,
  CASE WHEN hour IN (0, 1, 2, 3, 4, 5) THEN 1.0 ELSE 0.0 END AS cat__night_txn_True, 0.0 AS cat__weekend_txn_True
FROM chk""")
def q_adapter(spark, sf_dir):
    return ml.checkout_adapter(checkout(spark, sf_dir), ADAPTER_FEATURES)


@query("ml_class_weight", with_(TXN) + """
SELECT count(*) FILTER (WHERE label = 0) AS neg, count(*) FILTER (WHERE label = 1) AS pos,
       CASE WHEN count(*) FILTER (WHERE label = 1) > 0 THEN count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1) END
       AS scale_pos_weight FROM txn""")
def q_class_weight(spark, sf_dir):
    return ml.class_weight(txn(spark, sf_dir), "label")


def embedding_table(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("label") == 3).cast("int").alias("minority"),
                    array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))


@query("ml_smote", """
WITH n AS (SELECT CASE WHEN label = 3 THEN 1 ELSE 0 END AS minority, count(*) AS n FROM embeddings GROUP BY 1),
s AS (SELECT (SELECT n FROM n WHERE minority = 0) - (SELECT n FROM n WHERE minority = 1) AS need)
SELECT minority, false AS synthetic, n FROM n UNION ALL SELECT 1, true, need FROM s WHERE need > 0""")
def q_smote(spark, sf_dir):
    """Minority (embedding label 3) oversampled to 1:1 with k = 5 exact
    neighbours; counts per class and origin."""
    s = ml.smote(embedding_table(spark, sf_dir), "features", "minority", "vec_id", minority=1, k=5, seed=42)
    return s.groupBy("minority", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("ml_smote_neighbours", """
WITH m AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label = 3),
d AS (SELECT a.vec_id, b.vec_id AS neighbour,
        sqrt(list_sum([(a.x[i] - b.x[i]) * (a.x[i] - b.x[i]) FOR i IN range(1, len(a.x) + 1)])) AS d FROM m a JOIN m b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS INTEGER) AS rank FROM d)
SELECT vec_id, rank, neighbour, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def q_smote_neighbours(spark, sf_dir):
    """The 5 nearest minority rows of each minority row."""
    n = ml.minority_neighbours(embedding_table(spark, sf_dir), "features", "minority", "vec_id", minority=1, k=5)
    n = n.select(F.col("id").alias("vec_id"), F.posexplode("neighbours").alias("i", "n"))
    return n.select("vec_id", (F.col("i") + 1).alias("rank"), F.col("n.id").alias("neighbour"), F.round("n.d", 6).alias("distance"))


def _train_gbt(spark, sf_dir, extra_train=None, table=None):
    x, names = table or model_table(spark, sf_dir)
    train = x.where(F.col("split") == "train")
    if extra_train is not None:
        train = train.unionByName(extra_train).dropDuplicates(["txn_id"])
    model = ml.gbt_train(train, max_iter=GBT_ITER, max_depth=GBT_DEPTH, col_subsample="0.8")
    return model, x, names


@query("ml_gbt_train")
def q_gbt(spark, sf_dir):
    x, _ = model_table(spark, sf_dir)
    model = ml.gbt_train(x.where(F.col("split") == "train"))
    s = ml.score(model, x).select("split", "label", "p_model").checkpoint()  # scored once, read by six metrics
    out = None
    for split in ("train", "val", "test"):
        part = s.where(F.col("split") == split)
        m = metrics.roc_auc(part, "p_model", "label").crossJoin(metrics.average_precision(part, "p_model", "label"))
        m = m.withColumn("split", F.lit(split))
        out = m if out is None else out.unionByName(m)
    return out


@query("ml_score_table")
def q_score(spark, sf_dir):
    model, x, _ = _train_gbt(spark, sf_dir)
    return ml.score(model, x.where(F.col("split") == "test")).select("txn_id", "label", A.r6(F.col("p_model")).alias("p_model"))


@query("topk_feature_importance")
def q_importance(spark, sf_dir):
    model, _, names = _train_gbt(spark, sf_dir)
    imp = model.featureImportances.toArray()
    rows = sorted(((names[i], float(v)) for i, v in enumerate(imp)), key=lambda r: (-r[1], r[0]))[:20]
    return spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(rows)], "feature string, importance double, rank int")


@query("ml_random_search")
def q_random_search(spark, sf_dir):
    """3-fold CV over 30 seeded draws from the whole hyper-parameter grid, scored by
    exact average precision."""
    x, _ = model_table(spark, sf_dir)
    r = ml.random_search(x.where(F.col("split") == "train"), "txn_id")
    return r.select("draw", F.col("maxDepth").alias("max_depth"), F.col("stepSize").alias("step"), F.col("maxIter").alias("max_iter"),
                    F.col("subsamplingRate").alias("subsample"), F.col("featureSubsetStrategy").alias("col_subsample"), "cv_average_precision")


def _ae(spark, sf_dir, k=8):
    e = embedding_table(spark, sf_dir)
    ae = ml.anomaly_train(e.where(F.col("minority") == 0), k=k)
    return e, ae


@query("ml_anomaly_train")
def q_ae_train(spark, sf_dir):
    """PCA bottleneck fitted on legit embeddings; summary of the fit."""
    e, ae = _ae(spark, sf_dir)
    pc = ae["pc"]
    return spark.createDataFrame([(int(pc.shape[0]), int(pc.shape[1]), float(abs(pc.T @ pc - __import__("numpy").eye(pc.shape[1])).max()))],
                                 "input_dim int, bottleneck int, orthonormality_error double")


@query("ml_reconstruction_error")
def q_recon(spark, sf_dir):
    e, ae = _ae(spark, sf_dir)
    r = ml.reconstruction_error(e, ae)
    return r.groupBy("minority").agg(F.count(F.lit(1)).alias("n"), A.r6(F.avg("ae_err")).alias("mean_err"),
                                     A.r6(F.max("ae_err")).alias("max_err"))


@query("topk_recon_error_features")
def q_recon_features(spark, sf_dir):
    """For the minority row with the largest reconstruction error: features
    ranked by squared error, top 10."""
    import numpy as np
    e, ae = _ae(spark, sf_dir)
    r = ml.reconstruction_error(e.where(F.col("minority") == 1), ae).select("vec_id", "ae_err")
    worst = r.orderBy(F.col("ae_err").desc(), "vec_id").limit(1).join(e, "vec_id")
    x = np.asarray(worst.select(vector_to_array("features")).first()[0]) - ae["mean"]
    rec = (x @ ae["pc"]) @ ae["pc"].T
    sq = (x - rec) ** 2
    order = sorted(range(len(sq)), key=lambda i: (-sq[i], i))[:10]
    return spark.createDataFrame([(f"V{i + 1}", float(sq[i]), r + 1) for r, i in enumerate(order)],
                                 "feature string, sq_error double, rank int")


@query("ml_gated_second_model")
def q_gated(spark, sf_dir):
    """Anomaly scoring only inside the gray zone (filter -> score -> join back)."""
    e, ae = _ae(spark, sf_dir)
    # gray zone on a score derived from the first component (binding)
    e = e.withColumn("p_xgb", F.abs(vector_to_array("features")[0]) * 2)
    gate = policy.in_gray_zone("p_xgb", XGB_T_LOW, XGB_T_HIGH)
    g = ml.gated_second_model(e, gate, lambda d: ml.reconstruction_error(d, ae), "vec_id")
    return g.groupBy(gate.alias("in_gray_zone")).agg(F.count(F.lit(1)).alias("n"),
                                                      F.count("ae_err").alias("n_scored"))


@query("ml_pca_2d")
def q_pca2d(spark, sf_dir):
    e = embedding_table(spark, sf_dir)
    p = ml.pca_2d(e)
    return p.select("vec_id", A.r6(F.col("pc1")).alias("pc1"), A.r6(F.col("pc2")).alias("pc2"))


def _shap(spark, sf_dir, n_rows=2000, n_background=500):
    model, x, names = _train_gbt(spark, sf_dir)
    test = x.where(F.col("split") == "test")
    # hash-ordered exact sample of the rows to explain (the sample is the operator's feature)
    sample = test.orderBy(F.xxhash64("txn_id", F.lit(42)), "txn_id").limit(n_rows)
    bg = x.where(F.col("split") == "train")
    return shapley.tree_shap(model, sample, names, "txn_id", bg, n_background)


@query("ml_permutation_shap")
def q_shap(spark, sf_dir):
    c = _shap(spark, sf_dir)
    return c.select("txn_id", "feature", A.r6(F.col("contribution")).alias("contribution"))


@query("ml_global_importance")
def q_global_importance(spark, sf_dir):
    return ml.global_importance(_shap(spark, sf_dir), 15, required=["num__amount"]).select(
        "feature", A.r6(F.col("mean_abs")).alias("mean_abs"), "rank")


@query("ml_local_top_contributors", """
, c AS (SELECT vec_id, 'V' || CAST(i AS VARCHAR) AS feature, CAST(v AS DOUBLE) AS contribution FROM (
    SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
SELECT vec_id, feature, round(contribution, 6) AS contribution, rank, direction FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY contribution DESC, feature) AS rank, 'positive' AS direction
  FROM c WHERE contribution > 0) WHERE rank <= 5
UNION ALL
SELECT vec_id, feature, round(contribution, 6), rank, direction FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY contribution ASC, feature) AS rank, 'negative' AS direction
  FROM c WHERE contribution < 0) WHERE rank <= 5""".replace("\n, c AS", "WITH c AS", 1))
def q_local_top(spark, sf_dir):
    """Per-row contributions bound to the embedding components."""
    e = read_table(spark, sf_dir, "embeddings")
    c = e.select("vec_id", F.posexplode("embedding").alias("i", "v")).select(
        "vec_id", F.concat(F.lit("V"), (F.col("i") + 1).cast("string")).alias("feature"),
        F.col("v").cast("double").alias("contribution"))
    out = ml.local_top_contributors(c, "vec_id", 5)
    return out.select("vec_id", "feature", A.r6(F.col("contribution")).alias("contribution"), "rank", "direction")


@query("ml_pick_local_examples", with_(TXN, THR, SCORED) + """
SELECT txn_id, label, p_xgb FROM scored
ORDER BY label DESC, CASE WHEN label = 1 THEN txn_id END ASC NULLS LAST, p_xgb DESC, txn_id LIMIT 2""")
def q_pick(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    return ml.pick_local_examples(s, "label", "p_xgb", "txn_id", 2).select("txn_id", "label", "p_xgb")


@query("ml_retrain_with_feedback")
def q_retrain(spark, sf_dir):
    """Union the train split with labelled feedback rows (closed reviews of
    the validation period, analyst label), dedupe, refit, evaluate."""
    table = model_table(spark, sf_dir)
    x, _ = table
    fb = (x.where((F.col("split") == "val") & (F.pmod("txn_id", F.lit(3)) == 0))
          .select("txn_id", "split", "label", "p_xgb", "features"))
    base, _, _ = _train_gbt(spark, sf_dir, table=table)
    new, _, _ = _train_gbt(spark, sf_dir, extra_train=fb, table=table)
    test = x.where(F.col("split") == "test")
    rows = None
    for name, m in (("base", base), ("retrained", new)):
        s = ml.score(m, test).select("label", "p_model").checkpoint()  # scored once, read by both metrics
        r = metrics.roc_auc(s, "p_model", "label").crossJoin(metrics.average_precision(s, "p_model", "label")) \
            .withColumn("model", F.lit(name))
        rows = r if rows is None else rows.unionByName(r)
    return rows
