"""Feature pipeline and model operators on Spark ML.

The reference's single-machine models are re-aimed onto Spark ML:
boosted trees -> ``GBTClassifier``; the dense autoencoder -> ``PCA`` on
legit rows (a linear autoencoder with the same bottleneck idea).  Scaling
uses the population std (the MLlib scaler uses the sample std), one-hot
encoding keeps train categories only (unknown -> all zeros).  Python runs
only in Arrow-batched ``mapInPandas`` with small broadcast matrices
(reconstruction error) and in the blocks of the metric index behind SMOTE.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnguard.operators.neighbours import knn
from txnguard.plans.scale import global_row_number


# ---------------------------------------------------------------- scaling / encoding
def scale_stats(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row table of population mean / std per column (fit on train)."""
    return train.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))])


def standard_scale(df: DataFrame, stats: DataFrame, cols: Sequence[str], prefix: str = "num__") -> DataFrame:
    """(x - mean) / std with the train statistics; zero std divides by 1."""
    j = df.crossJoin(F.broadcast(stats))  # one row
    out = []
    for c in cols:
        sd = F.col(f"{c}__std")
        out.append(((F.col(c) - F.col(f"{c}__mean")) / F.when(sd > 0, sd).otherwise(F.lit(1.0))).alias(prefix + c))
    keep = [c for c in df.columns if c not in cols]
    return j.select(*keep, *out)


def train_categories(train: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct train categories per column (metadata: bounded by the
    columns' cardinality, like the label list of a StringIndexer), read in one pass."""
    out = {c: [] for c in cols}
    if out:
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in out])
        for c, v in train.select(F.inline(pairs)).where(F.col("v").isNotNull()).distinct().collect():
            out[c].append(v)
    return {c: sorted(vals) for c, vals in out.items()}


def onehot(df: DataFrame, categories: dict[str, list[str]], prefix: str = "cat__") -> DataFrame:
    """One 0/1 column per train category ``cat__<col>_<value>``; unknown
    values give all zeros."""
    cols = []
    for c, vals in categories.items():
        for v in vals:
            cols.append((F.col(c).cast("string") == F.lit(v)).cast("double").alias(f"{prefix}{c}_{v}"))
    keep = [c for c in df.columns if c not in categories]
    return df.select(*keep, *cols)


def column_transformer(train: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                       out: str = "features") -> tuple[DataFrame, list[str]]:
    """Numeric block (scaled) then categorical block (one-hot), assembled
    into one vector; returns the frame and the ordered feature names."""
    stats = scale_stats(train, numeric)
    cats = train_categories(train, categorical)
    x = onehot(standard_scale(df, stats, numeric), cats)
    names = [f"num__{c}" for c in numeric] + [f"cat__{c}_{v}" for c, vals in cats.items() for v in vals]
    va = VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep")
    return va.transform(x), names


def checkout_adapter(df: DataFrame, model_features: Sequence[str]) -> DataFrame:
    """Raw checkout fields -> the model's feature columns with neutral
    defaults (numeric 0, ``_True`` flags off, ``_False`` flags on)."""
    c = F.col
    v1h = F.coalesce(c("velocity_1h").cast("double"), F.lit(0.0))
    mapped = {
        "num__Amount": F.coalesce(c("amount").try_cast("double"), F.lit(0.0)),
        "num__txn_count_60m": v1h, "num__txn_count_30m": v1h,
        "num__txn_count_5m": F.greatest(F.lit(0.0), F.floor(v1h / 3)).cast("double"),
        "cat__is_new_device_True": c("is_new_device").cast("boolean"),
        "cat__is_new_device_False": ~F.coalesce(c("is_new_device").cast("boolean"), F.lit(False)),
        "cat__is_proxy_vpn_True": c("is_proxy_vpn").cast("boolean"),
        "cat__is_proxy_vpn_False": ~F.coalesce(c("is_proxy_vpn").cast("boolean"), F.lit(False)),
        "cat__country_mismatch_True": c("ip_country").cast("string") != c("country").cast("string"),
        "cat__country_mismatch_False": c("ip_country").cast("string") == c("country").cast("string"),
        "cat__night_txn_True": F.coalesce(c("hour"), F.lit(12)).isin(0, 1, 2, 3, 4, 5),
        "cat__night_txn_False": ~F.coalesce(c("hour"), F.lit(12)).isin(0, 1, 2, 3, 4, 5),
    }
    cols = []
    for f in model_features:
        if f in mapped:
            e = mapped[f]
        elif f.startswith("cat__ip_country_"):
            e = c("ip_country").cast("string") == F.lit(f[len("cat__ip_country_"):])
        elif f.startswith("cat__billing_country_"):
            e = c("country").cast("string") == F.lit(f[len("cat__billing_country_"):])
        elif f.startswith("cat__shipping_country_"):
            e = c("country").cast("string") == F.lit(f[len("cat__shipping_country_"):])
        elif f.startswith("num__"):
            e = F.lit(0.0)
        elif f.endswith("_True"):
            e = F.lit(False)
        elif f.endswith("_False"):
            e = F.lit(True)
        else:
            e = F.lit(0.0)
        cols.append(F.coalesce(e.cast("double"), F.lit(0.0)).alias(f))
    return df.select(*[x for x in df.columns if x in ("txn_id",)], *cols)


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """scale_pos_weight = negatives / positives."""
    return df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).select(
        "neg", "pos", F.when(F.col("pos") > 0, F.col("neg") / F.col("pos")).alias("scale_pos_weight"))


# ---------------------------------------------------------------- models
def gbt_train(train: DataFrame, features: str = "features", label: str = "label", max_iter: int = 300,
              max_depth: int = 6, step: float = 0.05, subsample: float = 0.8, col_subsample: str = "0.8",
              weight_col: str | None = None, seed: int = 42):
    gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                        subsamplingRate=subsample, featureSubsetStrategy=col_subsample, seed=seed)
    if weight_col:
        gbt = gbt.setWeightCol(weight_col)
    return gbt.fit(train)


# The search space and size.
SEARCH_GRID = {
    "maxDepth": [3, 4, 5, 6],
    "stepSize": [0.01, 0.03, 0.05],
    "maxIter": [150, 200, 250, 300],
    "subsamplingRate": [0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.7", "0.8", "1.0"],
}
SEARCH_DRAWS = 30
SEARCH_AT_ONCE = 16  # more fits at once only wait for the scheduler


def draws(grid: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """``n_iter`` distinct settings (all, if there are fewer), the same for one seed."""
    total = int(np.prod([len(v) for v in grid.values()]))
    out = []
    for i in np.random.default_rng(seed).permutation(total)[:n_iter].tolist():
        setting = {}
        for name, choices in grid.items():
            i, k = divmod(i, len(choices))
            setting[name] = choices[k]
        out.append(setting)
    return out


def random_search(train: DataFrame, key: str, features: str = "features", label: str = "label", grid: dict[str, list] | None = None,
                  n_iter: int = SEARCH_DRAWS, folds: int = 3, seed: int = 42, parts: int = 1, rows_per_part: int = 250_000) -> DataFrame:
    """Mean average precision over ``folds`` of ``n_iter`` random settings,
    ``(draw, *grid, cv_average_precision)``.

    A row's fold is a hash of its key, and the rows are dealt and ordered by key
    before each fit, so the result doesn't depend on how the input is dealt.  There
    are ``parts`` parts, or as many as keep a part to ``rows_per_part`` rows.  A fit is
    a job per tree and level, so where one has too few parts for the cores, several run
    at once: as many as give each core two parts, one if a fit alone gives as many."""
    from txnguard.operators import metrics
    spark = train.sparkSession
    grid = grid or SEARCH_GRID
    parts = max(parts, -(-train.count() // rows_per_part))
    x = train.select(key, label, features).repartition(parts, key).sortWithinPartitions(key)
    x = x.withColumn("__fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds))).persist()

    def fold_score(setting: dict, f: int) -> float:
        gbt = GBTClassifier(featuresCol=features, labelCol=label, seed=seed, **setting)
        s = score(gbt.fit(x.where(F.col("__fold") != f)), x.where(F.col("__fold") == f), "__p").select(label, "__p").persist()
        ap = metrics.average_precision(s, "__p", label).first()[0] or 0.0
        s.unpersist()
        return ap

    settings = draws(grid, n_iter, seed)
    # each run has its own copy of the session's local properties
    runs = [inheritable_thread_target(spark)(partial(fold_score, s, f)) for s in settings for f in range(folds)]
    with ThreadPool(max(1, min(SEARCH_AT_ONCE, 2 * spark.sparkContext.defaultParallelism // parts))) as pool:
        scores = np.reshape(list(pool.imap(lambda run: run(), runs)), (len(settings), folds))
    x.unpersist()
    out = [(i, *s.values(), float(np.mean(scores[i]))) for i, s in enumerate(settings)]
    kinds = {int: "int", float: "double", str: "string"}
    return spark.createDataFrame(out, ", ".join(["draw int", *(f"{n} {kinds[type(v[0])]}" for n, v in grid.items()), "cv_average_precision double"]))


def score(model, df: DataFrame, out: str = "p_model") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def anomaly_train(legit: DataFrame, features: str = "features", k: int = 32) -> dict:
    """PCA fitted on legit rows only (linear autoencoder, bottleneck k).
    Returns the (d x k) components and the legit mean (both small)."""
    from pyspark.ml.stat import Summarizer
    model = PCA(k=k, inputCol=features, outputCol="__pca").fit(legit)
    mean = legit.select(Summarizer.mean(F.col(features)).alias("m")).first()["m"].toArray()
    return {"pc": model.pc.toArray(), "mean": mean}


def reconstruction_error(df: DataFrame, ae: dict, features: str = "features", out: str = "ae_err") -> DataFrame:
    """mean((x - x_hat)^2) per row with x_hat = mu + P P^T (x - mu); the
    small component matrix is broadcast and rows go through NumPy in Arrow
    batches.  The vector column is replaced by the error column."""
    bc = df.sparkSession.sparkContext.broadcast((ae["pc"], ae["mean"]))
    arr = df.select(*[c for c in df.columns if c != features], vector_to_array(features).alias("__x"))
    schema = arr.drop("__x").schema.add(out, "double")

    def run(it):
        p, mu = bc.value
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["__x"].to_numpy()) - mu
                rec = (x @ p) @ p.T
                pdf[out] = ((x - rec) ** 2).mean(axis=1)
            else:
                pdf[out] = pd.Series(dtype="float64")
            yield pdf.drop(columns=["__x"])
    return arr.mapInPandas(run, schema)


def gated_second_model(df: DataFrame, gate: Column, second, key: str) -> DataFrame:
    """Run ``second`` (a DataFrame -> DataFrame scorer adding ae_err) only on
    rows passing ``gate`` and join the result back by ``key`` (unique); other
    rows get null.  (A UDF inside ``when`` would still see every row.)"""
    scored = second(df.where(gate)).select(key, "ae_err")
    return df.join(scored, key, "left")


def pca_2d(df: DataFrame, features: str = "features") -> DataFrame:
    """Standardise (population std) then project on 2 principal components;
    each component's sign is fixed so its largest |loading| is positive."""
    from pyspark.ml.feature import StandardScaler
    sc = StandardScaler(inputCol=features, outputCol="__z", withMean=True, withStd=True).fit(df)
    z = sc.transform(df)
    pca = PCA(k=2, inputCol="__z", outputCol="__pc").fit(z)
    pc = pca.pc.toArray()
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(2)]
    t = pca.transform(z)
    arr = vector_to_array(t["__pc"])
    return t.select(*df.columns, (arr[0] * signs[0]).alias("pc1"), (arr[1] * signs[1]).alias("pc2"))


# ---------------------------------------------------------------- SMOTE
def minority_neighbours(df: DataFrame, features: str, label: str, key: str, minority: int = 1, k: int = 5, seed: int = 42) -> DataFrame:
    """``(id, neighbours)`` of the minority rows among themselves, exactly."""
    m = df.where(F.col(label) == minority).select(key, vector_to_array(features).alias("__x"))
    return knn(m, key, "__x", k, seed=seed)


def smote(df: DataFrame, features: str, label: str, key: str, minority: int = 1, k: int = 5,
          seed: int = 42) -> DataFrame:
    """Oversample the minority class to 1:1 with synthetic rows
    x + u * (nn - x), nn one of the k nearest minority neighbours (exact).

    The minority stays distributed: its neighbours come from a metric index
    (``operators.neighbours``), its rows' numbers of synthetic rows from their
    rank in key order, and each row's neighbour and u from hashes of (key,
    number, seed).  So any size works and the result does not depend on
    partitioning.  ``key`` is a unique whole number; with fewer than two
    minority rows, or a minority that is none, nothing is added."""
    kind = df.schema[label].dataType
    orig = df.select(F.col(key).cast("long").alias(key), F.lit(-1).alias("syn_idx"), features, label, F.lit(False).alias("synthetic"))
    n_min, n_maj = df.agg(F.count_if(F.col(label) == minority), F.count_if(F.col(label) != minority)).first()
    need = n_maj - n_min
    if need <= 0 or n_min < 2:
        return orig
    per, extra = divmod(need, n_min)
    m = df.where(F.col(label) == minority).select(F.col(key).cast("long").alias("id"), vector_to_array(features).alias("x"))
    near = minority_neighbours(df, features, label, key, minority, k, seed)
    rank = global_row_number(m.select("id"), ["id"], "rank")
    many = F.lit(per) + F.when(F.col("rank") <= extra, 1).otherwise(0)
    base = m.join(rank, "id").join(near, "id").withColumn("many", many).where("many > 0")
    base = base.select("id", "x", "neighbours", F.explode(F.sequence(F.lit(0), (F.col("many") - 1).cast("int"))).alias("syn_idx"))
    which = F.pmod(F.xxhash64("id", "syn_idx", F.lit(seed), F.lit("neighbour")), F.size("neighbours")).cast("int")
    u = F.shiftrightunsigned(F.xxhash64("id", "syn_idx", F.lit(seed), F.lit("u")), 11) / float(1 << 53)
    base = base.select("id", "x", "syn_idx", F.get("neighbours", which)["id"].alias("other"), u.alias("u"))
    syn = base.join(m.select(F.col("id").alias("other"), F.col("x").alias("y")), "other")
    point = F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a))
    syn = syn.select(F.col("id").alias(key), "syn_idx", array_to_vector(point).alias(features),
                     F.lit(minority).cast(kind).alias(label), F.lit(True).alias("synthetic"))
    return orig.unionByName(syn)


# ---------------------------------------------------------------- explanations
def permutation_shap(model, rows: DataFrame, names: Sequence[str], key: str, background: DataFrame,
                     n_perm: int = 4, seed: int = 42, features: str = "features") -> DataFrame:
    """Monte-Carlo Shapley values: for each row and random feature order,
    switch features from the background mean to the row value one by one
    and credit each feature with the score change.  ``rows`` is the sample
    to explain (the sample size is the operator's feature)."""
    d = len(names)
    bg = background.select(vector_to_array(features).alias("b")).agg(
        F.array(*[F.avg(F.col("b")[i]) for i in range(d)]).alias("bg"))
    x = rows.select(key, vector_to_array(features).alias("x")).crossJoin(F.broadcast(bg))
    perms = rows.sparkSession.range(n_perm).withColumnRenamed("id", "perm")
    x = x.crossJoin(F.broadcast(perms))  # fixed number of permutations
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                                                 lambda i: F.struct(F.xxhash64(F.col(key), F.col("perm"), i, F.lit(seed))
                                                                    .alias("h"), i.alias("i")))),
                        lambda s: s["i"])
    steps = rows.sparkSession.range(d + 1).withColumnRenamed("id", "step")
    x = x.withColumn("order", order).crossJoin(F.broadcast(steps))  # d + 1 prefixes per (row, perm)
    on = F.slice(F.col("order"), 1, F.col("step").cast("int"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                      lambda i: F.when(F.array_contains(on, i), F.col("x")[i]).otherwise(F.col("bg")[i]))
    pref = x.select(key, "perm", "step", "order", array_to_vector(vec).alias(features))
    sc = score(model, pref, "__p").select(key, "perm", "step", "order", "__p")
    w = Window.partitionBy(key, "perm").orderBy("step")
    delta = sc.withColumn("__d", F.col("__p") - F.lag("__p").over(w)).where(F.col("step") > 0)
    feat = F.element_at(F.col("order"), F.col("step").cast("int"))
    names_arr = F.array(*[F.lit(n) for n in names])
    contrib = delta.select(key, F.element_at(names_arr, feat + 1).alias("feature"), "__d")
    return contrib.groupBy(key, "feature").agg(F.avg("__d").alias("contribution"))


def global_importance(contrib: DataFrame, k: int = 15, required: Sequence[str] = ()) -> DataFrame:
    imp = contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    req = F.col("feature").isin(list(required)) if required else F.lit(False)
    w = Window.orderBy(req.desc(), F.col("mean_abs").desc(), F.col("feature"))
    return imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def local_top_contributors(contrib: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Top k positive and top k negative contributors per row."""
    pos = Window.partitionBy(key).orderBy(F.col("contribution").desc(), F.col("feature"))
    neg = Window.partitionBy(key).orderBy(F.col("contribution").asc(), F.col("feature"))
    p = contrib.where(F.col("contribution") > 0).withColumn("rank", F.row_number().over(pos)).where(F.col("rank") <= k) \
        .withColumn("direction", F.lit("positive"))
    n = contrib.where(F.col("contribution") < 0).withColumn("rank", F.row_number().over(neg)).where(F.col("rank") <= k) \
        .withColumn("direction", F.lit("negative"))
    return p.unionByName(n)


def pick_local_examples(df: DataFrame, label: str, p: str, key: str, n: int = 2) -> DataFrame:
    """First n fraud rows (in key order), topped up with the highest scores."""
    fraud_first = F.when(F.col(label) == 1, F.col(key))
    return df.orderBy(F.col(label).desc(), fraud_first.asc_nulls_last(), F.col(p).desc(), F.col(key)).limit(n)
