"""Impact scores, feature preparation, folds and the regression (#149-#160)."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.functions.columns import clip_negative, numeric_or
from citegraph.operators import aggregates as A
from citegraph.operators import joins as J
from citegraph.operators.windows import group_transform_nunique, minmax_normalise, row_number_global
from citegraph.session import cut_lineage

# Fixed values of the reference: impact-score weights per normalised component.
IMPACT_WEIGHTS = {
    "field_citation_ratio": 0.2,
    "altmetric_score": 0.2,
    "Diff": 0.2,
    "num_publications": 0.2,
    "patent_count": 0.05,
    "dataset_count": 0.05,
    "grant_count": 0.05,
    "num_unique_orgs": 0.05,
}


def linear_fit_predict(df: DataFrame, x: str, y: str, out: str = "predicted") -> DataFrame:
    """Least-squares line of y on x fitted over the table, applied to every row."""
    fit = df.agg(F.struct(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b")).alias("s")).scalar()
    return df.withColumn(out, fit["b"] + fit["a"] * F.col(x))


def impact_score(author_rows: DataFrame, weights: dict[str, float] | None = None, name: str = "concatenated_name", pub: str = "publication_id") -> DataFrame:
    """Weighted sum of min-max normalised components per (publication, author) row (#149).

    Steps as in the reference: negative residuals clipped to 0 (#26), distinct
    publications per author (#83), bad numbers -> 0 (#16), min-max over the
    table (#89), then one weighted expression.
    """
    from pyspark.sql import types as T

    from citegraph.session import cut_lineage

    w = weights or IMPACT_WEIGHTS
    x = author_rows.withColumn("Diff", clip_negative("Diff"))
    x = group_transform_nunique(x, name, pub, "num_publications")
    types = {f.name: f.dataType for f in x.schema.fields}
    for c in w:
        if isinstance(types[c], T.NumericType):
            x = x.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        else:  # text or mixed input: bad numbers -> NULL -> 0
            x = x.withColumn(c, numeric_or(F.col(c).cast("string")))
    # the component table is read twice (min/max pass, then scoring): write it once
    x = cut_lineage(x)
    x = minmax_normalise(x, list(w))
    score = sum((F.lit(v) * F.col(f"normalized_{c}") for c, v in w.items()), F.lit(0.0))
    return x.withColumn("impact_score", score)


def _leaderboard_rows(scored: DataFrame, author_org: DataFrame, corrected: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """(author rows with their organisation, scores summed on the join keys, the join keys).

    The scores are summed before they meet the authors, so that a publication
    of m authors gives m rows and not m x m.
    """
    keys = ["publication_id", "concatenated_name"] if corrected else ["publication_id"]
    pairs = scored.select("publication_id", "concatenated_name").distinct()
    orgs = author_org.select(F.col("author_name").alias("concatenated_name"), "highest_level_organization_name")
    # first organisation per (publication, author): deterministic min
    metrics = pairs.join(orgs, "concatenated_name", "left").groupBy("publication_id", "concatenated_name").agg(
        F.min("highest_level_organization_name").alias("highest_level_organization_name")
    )
    return metrics, scored.groupBy(*keys).agg(F.sum("impact_score").alias("impact_score")), keys


def author_leaderboard(scored: DataFrame, author_org: DataFrame, n: int = 30, corrected: bool = False) -> DataFrame:
    """Top-n authors by total impact, with the median of their rows' scores (#150, #64).

    Only the n authors' rows are joined score by score for the median.
    """
    metrics, sums, keys = _leaderboard_rows(scored, author_org, corrected)
    totals = metrics.join(sums, keys, "left").groupBy("concatenated_name").agg(F.sum("impact_score").alias("total_impact_score"))
    top = cut_lineage(totals.orderBy(F.col("total_impact_score").desc(), F.col("concatenated_name")).limit(n))
    rows = metrics.join(F.broadcast(top.select("concatenated_name")), "concatenated_name")  # n rows
    impact = J.fanout_join(rows, scored, "publication_id", "concatenated_name", corrected=corrected)
    return top.join(A.exact_median(impact, "concatenated_name", "impact_score", "median_impact_score"), "concatenated_name", "left")


def organization_leaderboard(scored: DataFrame, author_org: DataFrame, n: int = 30, corrected: bool = False) -> DataFrame:
    """Top-n organisations by total impact, their authors and impact per author (#150, #65)."""
    metrics, sums, keys = _leaderboard_rows(scored, author_org, corrected)
    out = A.ratio_of_aggregates(metrics.join(sums, keys, "left"), "highest_level_organization_name", "impact_score", "concatenated_name")
    return out.orderBy(F.col("total_impact_score").desc(), F.col("highest_level_organization_name")).limit(n)


def author_org_leaderboard(scored: DataFrame, author_org: DataFrame, n: int = 30, corrected: bool = False) -> tuple[DataFrame, DataFrame]:
    """Author and organisation top-n lists (#150, with #52, #64, #65, #71, #97).

    ``scored``: (publication_id, concatenated_name, impact_score) one row per
    pair; ``author_org``: (author_name, highest_level_organization_name).
    Faithful mode joins scores on the publication only (each author gets every
    co-author's score); corrected joins on (publication, author).
    """
    return author_leaderboard(scored, author_org, n, corrected), organization_leaderboard(scored, author_org, n, corrected)


def residual(df: DataFrame, actual: str, pred: str, out: str = "Diff") -> DataFrame:
    """actual - predicted (#151)."""
    return df.withColumn(out, F.col(actual) - F.col(pred))


def one_hot_drop_first(df: DataFrame, c: str, prefix: str | None = None) -> DataFrame:
    """Dummy columns for every category but the alphabetically first (#152).

    Categories are learnt with ``StringIndexer`` (a distinct aggregation; its
    size is the column's cardinality), then one ``when`` column each.
    """
    from pyspark.ml.feature import StringIndexer

    model = StringIndexer(inputCol=c, outputCol="_idx", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    labels = list(model.labels)
    p = prefix or c
    return df.select("*", *[(F.col(c) == F.lit(lab)).cast("int").alias(f"{p}_{lab}") for lab in labels[1:]]).drop(c)


def date_parse_coerce(df: DataFrame, cols: list[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Unparseable dates -> NULL (#153)."""
    for c in cols:
        df = df.withColumn(c, F.to_date(F.try_to_timestamp(F.col(c), F.lit(fmt))))
    return df


def feature_table(pw: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """Feature preparation of the regression (#154), one pass over pubWhole.

    Counts from the text lists are computed before the state column is
    one-hot encoded (the reference reads it after dropping it).
    """
    from citegraph.functions.columns import token_count, token_distinct_count

    x = pw.drop(*(drop or []))
    x = x.withColumn("num_authors", F.coalesce(F.size("authors"), F.lit(0)))
    x = x.withColumn("is_open_access", F.col("is_open_access").cast("int"))
    x = date_parse_coerce(x, ["date"])
    x = x.filter(F.col("altmetric_score").isNotNull())
    x = x.fillna({"field_citation_ratio": 0.0, "citation_count": 0.0, "relative_citation_ratio": 0.0})
    x = x.withColumn("num_clinical_trial_ids", token_count("clinical_trial_ids"))
    x = x.withColumn("num_unique_city_ids", token_distinct_count("research_org_city_ids"))
    x = x.withColumn("num_unique_country_codes", token_distinct_count("research_org_country_codes"))
    x = x.withColumn("num_unique_state_codes", token_distinct_count("research_org_state_codes"))
    x = one_hot_drop_first(x, "publication_type")
    x = one_hot_drop_first(x.withColumn("research_org_state_codes", F.coalesce(F.nullif("research_org_state_codes", F.lit("")), F.lit("Unknown"))), "research_org_state_codes")
    return x.drop("clinical_trial_ids", "field", "funding_details", "unique_org_ids", "research_org_city_ids", "research_org_country_codes")


def standard_scale(train: DataFrame, test: DataFrame, cols: list[str], suffix: str = "_z") -> tuple[DataFrame, DataFrame, DataFrame]:
    """z-scores fitted on train (population sd), applied to both (#155). Returns (train, test, stats)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mu"), F.stddev_pop(c).alias(f"{c}__sd")]
    stats = train.agg(*aggs)
    st = train.agg(F.struct(*aggs).alias("s")).scalar()  # fitted on train only

    def apply(df):
        x = df
        for c in cols:
            sd = st[f"{c}__sd"]
            x = x.withColumn(f"{c}{suffix}", (F.col(c) - st[f"{c}__mu"]) / F.when(sd > 0, sd).otherwise(F.lit(1.0)))
        return x

    return apply(train), apply(test), stats


def forward_chain_blocks(df: DataFrame, order: list[str], n_splits: int = 4, out: str = "block") -> DataFrame:
    """Expanding-window blocks (#156): rows in (date, id) order; the last ``n_splits``
    blocks have ``n // (n_splits + 1)`` rows each, block 0 the rest. Fold f trains on
    blocks < f and tests on block f.
    """
    rn = row_number_global(df, order, "_rn")
    total = rn.count()
    size = total // (n_splits + 1)
    first = total - n_splits * size
    blk = F.when(F.col("_rn") <= first, F.lit(0)).otherwise(((F.col("_rn") - first - 1) / F.lit(max(size, 1))).cast("int") + 1)
    return rn.withColumn(out, blk).drop("_rn")


def forward_chain_folds(df: DataFrame, order: list[str], n_splits: int = 4) -> DataFrame:
    """(fold, role) rows for every fold: role 'train' for earlier blocks, 'test' for the fold's block."""
    b = forward_chain_blocks(df, order, n_splits)
    x = b.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(n_splits)))).filter(
        F.col("block") <= F.col("fold")
    )
    return x.withColumn("role", F.when(F.col("block") == F.col("fold"), F.lit("test")).otherwise(F.lit("train")))


def group_folds(df: DataFrame, group: str, n: int = 3, out: str = "fold") -> DataFrame:
    """Folds that never split a group, balanced by size (#157).

    Groups are ranked by size (desc, then key) with the distributed
    numbering and dealt in snake order 0..n-1, n-1..0, which keeps fold sizes
    close without a sequential greedy loop.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    ranked = row_number_global(sizes, [F.col("_size").desc(), F.col(group)], "_r")
    pos = (F.col("_r") - 1) % (2 * n)
    fold = F.when(pos < n, pos).otherwise(2 * n - 1 - pos).cast("int")
    return df.join(ranked.select(group, fold.alias(out)), group)


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def _with_indicators(df: DataFrame, features: list[str]) -> DataFrame:
    x = df
    for c in features:
        x = x.withColumn(f"{c}__missing", (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")).withColumn(c, F.col(c).cast("double"))
    return x


def feature_pipeline(train: DataFrame, features: list[str]):
    """Missing values imputed by the training median, with an indicator for each feature, as one vector column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler

    imp = Imputer(inputCols=features, outputCols=[f"{c}__imp" for c in features], strategy="median")
    va = VectorAssembler(inputCols=[f"{c}__imp" for c in features] + [f"{c}__missing" for c in features], outputCol="features")
    return Pipeline(stages=[imp, va]).fit(_with_indicators(train, features))


def gbt_regression(train: DataFrame, features: list[str], target: str, params: dict | None = None):
    """Gradient-boosted trees with missing values imputed (+ missing indicators) (#158)."""
    from pyspark.ml.regression import GBTRegressor

    p = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0, "seed": 42, **(params or {})}
    prepared = feature_pipeline(train, features)
    x = prepared.transform(_with_indicators(train, features)).select("features", F.col(target).cast("double").alias(target))
    return prepared, GBTRegressor(featuresCol="features", labelCol=target, **p).fit(x)


def gbt_predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    prepared, trees = model
    return trees.transform(prepared.transform(_with_indicators(df, features)))


def draw_params(draws: int, seed: int = 42) -> list[dict]:
    """Seeded random draws over the reference's search space (#159).

    trees 50-5000, depth 3-15, learning rate log-uniform 0.01-0.2, subsample 0.5-1.
    """
    rng = random.Random(seed)
    out = []
    for _ in range(draws):
        out.append(
            {
                "maxIter": rng.randint(50, 5000),
                "maxDepth": rng.randint(3, 15),
                "stepSize": math.exp(rng.uniform(math.log(0.01), math.log(0.2))),
                "subsamplingRate": rng.uniform(0.5, 1.0),
            }
        )
    return out


def hyperparameter_search(
    train: DataFrame, features: list[str], target: str, fold_col: str, space: list[dict], rungs: tuple[int, ...] = (25, 100, 400), keep: float = 1 / 3, max_trees: int | None = None, parallelism: int = 4,
):
    """Search over parameter draws with a group fold column, by successive halving over trees (#159).

    Features are imputed and assembled once. Every draw is fitted with the
    first rung's number of trees on all folds but one and scored on that one
    (mean squared error over the folds); the best ``keep`` share goes on to the
    next rung. A draw never gets more trees than its own ``maxIter``. The
    best of the last rung is fitted again on all rows, with its ``maxIter``
    trees or ``max_trees``.

    Returns (model for ``gbt_predict``, best draw, rows (candidate, rung,
    trees, mse)).
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.regression import GBTRegressor

    prepared = feature_pipeline(train, features)
    x = prepared.transform(_with_indicators(train, features)).select("features", F.col(target).cast("double").alias(target), F.col(fold_col).alias("_fold"))
    x = cut_lineage(x.filter(F.col(target).isNotNull()))
    folds = sorted(r[0] for r in x.select("_fold").distinct().collect())

    def error(job):
        candidate, trees, fold = job
        p = {**space[candidate], "maxIter": trees}
        fit = GBTRegressor(featuresCol="features", labelCol=target, seed=42, **p).fit(x.filter(F.col("_fold") != fold))
        d = fit.transform(x.filter(F.col("_fold") == fold))
        return d.agg(F.avg((F.col("prediction") - F.col(target)) ** 2)).first()[0]

    alive, rows = list(range(len(space))), []
    for rung, most in enumerate(rungs):
        jobs = [(c, min(most, space[c].get("maxIter", most)), f) for c in alive for f in folds]
        with ThreadPoolExecutor(parallelism) as pool:
            errors = list(pool.map(error, jobs))
        mse = {c: sum(e for (j, _, _), e in zip(jobs, errors) if j == c) / len(folds) for c in alive}
        rows += [(c, rung, min(most, space[c].get("maxIter", most)), float(mse[c])) for c in alive]
        alive = sorted(alive, key=lambda c: (mse[c], c))[: max(1, math.ceil(len(alive) * keep))]
    best = space[alive[0]]
    trees = best.get("maxIter", rungs[-1]) if max_trees is None else min(max_trees, best.get("maxIter", max_trees))
    model = GBTRegressor(featuresCol="features", labelCol=target, seed=42, **{**best, "maxIter": trees}).fit(x)
    return (prepared, model), best, rows


def nested_cv_predict(
    df: DataFrame, features: list[str], target: str, key: str, order: list[str], group: str,
    n_outer: int = 4, n_inner: int = 3, space: list[dict] | None = None, **search,
) -> DataFrame:
    """Outer forward-chaining folds -> leakage filter -> scaling -> inner group-fold
    search -> prediction (#160). Returns (fold, key, actual, predicted).

    ``search`` goes to ``hyperparameter_search``.
    """
    space = space or draw_params(80)
    blocks = cut_lineage(forward_chain_blocks(df, order, n_outer))
    res = None
    for f in range(1, n_outer + 1):
        test = blocks.filter(F.col("block") == f)
        train = J.anti_join_leakage(blocks.filter(F.col("block") < f), test, group)
        tr, te, _ = standard_scale(train, test, features + [target])
        zf = [f"{c}_z" for c in features]
        tr = cut_lineage(group_folds(tr, group, n_inner, "_fold"))
        model, _, _ = hyperparameter_search(tr, zf, f"{target}_z", "_fold", space, **search)
        stats = train.agg(F.struct(F.avg(target).alias("mu"), F.stddev_pop(target).alias("sd")).alias("s")).scalar()
        pred = gbt_predict(model, te, zf).select(
            F.lit(f).alias("fold"),
            F.col(key),
            F.col(target).alias("actual"),
            (F.col("prediction") * F.when(stats["sd"] > 0, stats["sd"]).otherwise(1.0) + stats["mu"]).alias("predicted"),
        )
        res = pred if res is None else res.unionByName(pred)
    return res
