"""Review ranking: standardisation per held-out group, logistic regression for all folds at once, evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmetry.functions.expr import ratio
from voxelmetry.operators.stats import lift_at, mann_whitney, rank_rows, slab_lift_summary
from voxelmetry.session import cut_lineage

EPS = 1e-9


def fold_moments(df: DataFrame, slab: str, features: Sequence[str]) -> DataFrame:
    """Mean and population sd of all groups but one, per left-out group, from one pass over the rows.

    Each group's own count, mean and squared deviation are taken out of the totals, so no row is copied per fold.
    """
    parts = lambda tag: [
        c for f in features for c in (F.avg(f).alias(f"mean_{tag}_{f}"), (F.var_pop(f) * F.count(f)).alias(f"sq_{tag}_{f}"))
    ]
    own = df.groupBy(slab).agg(F.count(F.lit(1)).alias("n_own"), *parts("own"))
    total = df.agg(F.struct(F.count(F.lit(1)).alias("n_all"), *parts("all")).alias("t"))
    j = own.withColumn("t", total.scalar()).select("*", "t.*")
    rest = (F.col("n_all") - F.col("n_own")).cast("double")
    mu = {f: (F.col(f"mean_all_{f}") * F.col("n_all") - F.col(f"mean_own_{f}") * F.col("n_own")) / rest for f in features}
    gap = {f: F.col(f"mean_own_{f}") - mu[f] for f in features}
    sq = {f: F.col(f"sq_all_{f}") - F.col(f"sq_own_{f}") - gap[f] * gap[f] * F.col("n_own") * rest / F.col("n_all") for f in features}
    return j.where("n_all > n_own").select(
        slab,
        rest.cast("long").alias("n"),
        F.struct(*[mu[f].alias(f) for f in features]).alias("mu"),
        F.struct(*[F.sqrt(F.greatest(sq[f], F.lit(0.0)) / rest).alias(f) for f in features]).alias("sd"),
    )


def _step_sums(df: DataFrame, slab: str, features: Sequence[str], y: str, folds: np.ndarray, mu: np.ndarray, sd: np.ndarray, w: np.ndarray, hessian: bool) -> dict[int, tuple]:
    """Gradient (and curvature) sums of every fold in one job: partial sums per batch, then one small aggregate.

    Rows are standardised once, by the mean of all folds. A fold's own standardisation is an affine map of that, so its
    scores are one column of a matrix product over all folds, and its sums are mapped back after they are taken.
    """
    k, n_folds = len(features) + 1, len(folds)
    mid, scale = mu.mean(axis=0), sd.mean(axis=0)
    maps = np.zeros((n_folds, k, k))  # row of a fold's features = maps @ row of the common ones
    maps[:, 0, 0] = 1.0
    maps[:, np.arange(1, k), np.arange(1, k)] = scale / sd
    maps[:, 1:, 0] = (mid - mu) / sd
    common = np.einsum("fab,fa->bf", maps, w)
    upper = np.triu_indices(k)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h, n = np.zeros((k, n_folds)), np.zeros((len(upper[0]), n_folds)), np.zeros(n_folds)
        for b in batches:
            x = np.c_[np.ones(len(b)), (b[list(features)].to_numpy(float) - mid) / scale]
            use = b[slab].to_numpy()[:, None] != folds[None, :]
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ common, -30, 30)))
            g += x.T @ np.where(use, p - b[y].to_numpy(float)[:, None], 0.0)
            n += use.sum(axis=0)
            if hessian:
                h += (x[:, upper[0]] * x[:, upper[1]]).T @ np.where(use, p * (1 - p), 0.0)
        rows = {"fold": np.arange(n_folds), "n": n}
        rows |= {f"g{j}": g[j] for j in range(k)}
        rows |= {f"h{a}_{b}": h[i] for i, (a, b) in enumerate(zip(*upper))}
        yield pd.DataFrame(rows)

    names = [f"g{j}" for j in range(k)] + [f"h{a}_{b}" for a, b in zip(*upper)]
    schema = "fold LONG, n DOUBLE, " + ", ".join(f"{c} DOUBLE" for c in names)
    sums = df.select(slab, y, *features).mapInPandas(partial, schema).groupBy("fold").agg(*[F.sum(c).alias(c) for c in ["n", *names]])
    out = {}
    for r in sums.collect():  # one row of model-sized numbers per fold
        hess = np.zeros((k, k))
        for a, b in zip(*upper):
            hess[a, b] = hess[b, a] = r[f"h{a}_{b}"]
        m = maps[r["fold"]]
        out[r["fold"]] = (m @ np.array([r[f"g{j}"] for j in range(k)]), m @ hess @ m.T, r["n"])
    return out


def fold_gradients(df: DataFrame, slab: str, features: Sequence[str], y: str, models: DataFrame) -> DataFrame:
    """slab, n, gradient: rows that each fold is fitted on, and the largest component of the mean gradient at its weights,
    zero where the fit has converged."""
    rows = models.orderBy(slab).collect()  # one row per slab
    folds = np.array([r[slab] for r in rows])
    mu, sd, w = (np.array([r[c] for r in rows], float) for c in ("mu", "sd", "weights"))
    sums = _step_sums(df, slab, features, y, folds, mu, sd, w, False)
    found = [(folds[i].item(), int(n), float(np.abs(g).max() / n)) for i, (g, _, n) in sums.items()]
    return df.sparkSession.createDataFrame(found, f"{slab} {dict(df.dtypes)[slab]}, n LONG, gradient DOUBLE")


def fit_folds(df: DataFrame, slab: str, features: Sequence[str], y: str, method: str = "newton", iterations: int = 8, rate: float = 0.5) -> DataFrame:
    """Unregularised logistic regression with each group left out in turn: slab, mu, sd, weights.

    All folds advance together, one job per iteration. ``newton`` converges in a few steps; ``gradient`` takes plain
    full-batch steps of the given rate (the published fit uses 400 of 0.5).
    """
    data = cut_lineage(df.select(slab, y, *features), "fit")
    moments = fold_moments(data, slab, features).orderBy(slab).collect()  # one row per slab
    folds = np.array([r[slab] for r in moments])
    mu = np.array([[r["mu"][f] for f in features] for r in moments], float)
    sd = np.array([[r["sd"][f] for f in features] for r in moments], float) + EPS
    w = np.zeros((len(folds), len(features) + 1))
    for _ in range(iterations):
        sums = _step_sums(data, slab, features, y, folds, mu, sd, w, method == "newton")
        for i, (g, h, n) in sums.items():
            w[i] -= np.linalg.solve(h + 1e-9 * n * np.eye(len(g)), g) if method == "newton" else rate * g / n
    rows = [(f.item(), mu[i].tolist(), sd[i].tolist(), w[i].tolist()) for i, f in enumerate(folds)]
    kind = dict(df.dtypes)[slab]
    return df.sparkSession.createDataFrame(rows, f"{slab} {kind}, mu ARRAY<DOUBLE>, sd ARRAY<DOUBLE>, weights ARRAY<DOUBLE>")


def linear_score(features: Sequence[str]):
    """w . [1, (x - mu) / sd] with the model's arrays as columns."""
    s = F.get("weights", 0)
    for i, f in enumerate(features):
        s = s + F.get("weights", i + 1) * (F.col(f) - F.get("mu", i)) / F.get("sd", i)
    return s


def held_out_scores(df: DataFrame, slab: str, features: Sequence[str], y: str, **fit) -> DataFrame:
    """Every row scored by the model that never saw its group."""
    models = fit_folds(df, slab, features, y, **fit)
    return df.join(models, slab).withColumn("score", linear_score(features)).drop("mu", "sd", "weights")


def evaluate(df: DataFrame, slab: str, item: str, features: Sequence[str], y: str, tag: str, floor: float = 2.0, **fit) -> DataFrame:
    """Held-out AUC, pooled lift at 10% and 20%, and the per-group robustness summary: one row."""
    scored = cut_lineage(held_out_scores(df, slab, features, y, **fit).select(slab, item, y, "score"), "scores")
    order = [F.desc("score"), F.asc(item)]
    auc = mann_whitney(scored, "score", F.col(y) == 1).select("auc").scalar()
    pooled = lift_at(rank_rows(scored, [], order), [], y, [0.1, 0.2])
    within = lift_at(rank_rows(scored, [slab], order), [slab], y, [0.1])
    means = scored.groupBy(slab).agg(F.avg("score").alias("mean_score"))
    robust = slab_lift_summary(within.join(means, slab), floor)
    lift = lambda b: pooled.where(F.col("budget") == b).select("lift").scalar()
    out = robust.withColumns({"tag": F.lit(tag), "auc": auc, "lift10": lift(0.1), "lift20": lift(0.2)})
    return out.withColumn("passed", F.col("lift10") >= floor)


def training_manifest(df: DataFrame, slab: str, item: str, features: Sequence[str], y: str) -> DataFrame:
    """slab, n, n_bad, bad_rate, digest: what a model was trained on, in any order of the rows.

    A row's digest is of its item, target and features (to nine decimals); a slab's is the sum of those.
    """
    number = lambda c: F.round(F.col(c).cast("double") * 1e9).cast("decimal(38,0)").cast("string")
    text = F.concat_ws("|", F.col(item).cast("string"), F.col(y).cast("long").cast("string"), *[F.coalesce(number(f), F.lit("")) for f in features])
    row = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(slab).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("n_bad"), ratio(F.sum(y), F.count(F.lit(1))).alias("bad_rate"), F.sum(row).cast("string").alias("digest"))


def manifest_digest(manifest: DataFrame, slab: str) -> str:
    """SHA-256 over the slabs of a manifest in order, one line each."""
    line = F.concat_ws(":", F.col(slab).cast("string"), F.col("n").cast("string"), F.col("digest"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(slab).alias("s"), line.alias("line"))))  # one short line per slab
    return manifest.agg(F.sha2(F.array_join(lines["line"], "\n"), 256)).first()[0]


def fit_deployment(df: DataFrame, features: Sequence[str], y: str, slab: str | None = None, item: str | None = None, validation: dict | None = None) -> dict:
    """One model on everything, through MLlib on standardised features: names, mean, sd, weights, what it was trained on.

    With ``slab`` and ``item`` the record also tells the number of slabs and the digest of the training rows;
    ``validation`` (held-out figures of ``evaluate``) is stored beside it.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_bad"),
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
    ).first()
    mean = [stats[f"m_{f}"] for f in features]
    sd = [stats[f"s_{f}"] + EPS for f in features]
    std = df.select(F.col(y).cast("double").alias("label"), *[((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, mean, sd)])
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(std)
    model = LogisticRegression(regParam=0.0, maxIter=200, tol=1e-10, standardization=False).fit(data)
    training = {"n": stats["n"], "n_bad": int(stats["n_bad"]), "bad_rate": stats["n_bad"] / stats["n"]}
    if slab is not None and item is not None:
        manifest = cut_lineage(training_manifest(df, slab, item, features, y), "manifest")
        training |= {"n_slabs": manifest.count(), "manifest_sha256": manifest_digest(manifest, slab)}
    record = {
        "features": list(features),
        "serialization_decimals": 15,
        "standardization_mean": [round(v, 15) for v in mean],
        "standardization_sd": [round(v, 15) for v in sd],
        "weights_intercept_then_features": [round(v, 15) for v in [model.intercept, *model.coefficients.toArray().tolist()]],
        "training": training,
    }
    return record if validation is None else record | {"validation": validation}


def checked_model(model: dict, features: Sequence[str] | None = None) -> dict:
    """A loaded model record whose fields have the lengths its features ask for; another schema fails."""
    names = model.get("features")
    if not names or (features is not None and list(names) != list(features)):
        raise ValueError(f"model has the features {names}, not {features}")
    for key, more in (("standardization_mean", 0), ("standardization_sd", 0), ("weights_intercept_then_features", 1)):
        if len(model.get(key, [])) != len(names) + more:
            raise ValueError(f"model field {key} has {len(model.get(key, []))} values, not {len(names) + more}")
    return model


def score_with(df: DataFrame, model: dict) -> DataFrame:
    """Adds ``score`` of a deployment model."""
    model = checked_model(model)
    missing = [f for f in model["features"] if f not in df.columns]
    if missing:
        raise ValueError(f"features missing: {missing}")
    w = model["weights_intercept_then_features"]
    s = F.lit(float(w[0]))
    for f, m, sd, c in zip(model["features"], model["standardization_mean"], model["standardization_sd"], w[1:]):
        s = s + F.lit(float(c)) * (F.col(f) - F.lit(float(m))) / F.lit(float(sd))
    return df.withColumn("score", s)


def rank_for_review(df: DataFrame, model: dict, budget: float, slab: str = "slab", item: str = "patch", digits: int = 15) -> DataFrame:
    """Score, rank within the group by score then name, and flag what fits the budget."""
    from voxelmetry.operators.stats import selected_within

    scored = score_with(df, model).withColumn("score", F.round("score", digits))
    ranked = rank_rows(scored, [slab], [F.desc("score"), F.asc(item)])
    return ranked.withColumn("selected", selected_within(budget)).withColumnRenamed("rank", "rank_within_slab").withColumnRenamed("n_in_group", "n_in_slab")
