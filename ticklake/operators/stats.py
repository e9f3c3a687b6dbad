"""Statistics: regressions, multiple testing, Sharpe corrections, splits, classification scores, cointegration."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from .ordering import numbered

DAYS = 365
NORMAL = NormalDist()


def pearson(x: str, y: str, least: int = 30) -> Column:
    """Correlation of pairs without nulls, null under least pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when((F.count(a) >= least) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.corr(a, b))


def beta_alpha(rows: DataFrame, keys: list[str], strategy: str, benchmark: str) -> DataFrame:
    """Per key: beta, alpha a year, alpha's t and R2 of daily returns; zeros under 30 days or without benchmark variance."""
    r = rows.where(F.col(strategy).isNotNull() & F.col(benchmark).isNotNull())
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(strategy).alias("ms"), F.avg(benchmark).alias("mb"), F.var_samp(benchmark).alias("vb"), F.var_samp(strategy).alias("vs"), F.covar_samp(strategy, benchmark).alias("c"))
    ok = (F.col("n") >= 30) & (F.col("vb") > 0)
    beta, alpha = F.col("c") / F.col("vb"), F.col("ms") - F.col("c") / F.col("vb") * F.col("mb")
    rss = (F.col("n") - 1) * (F.col("vs") - F.col("c") * F.col("c") / F.col("vb"))
    se = F.sqrt(rss / (F.col("n") - 2) * (1 / F.col("n") + F.col("mb") * F.col("mb") / ((F.col("n") - 1) * F.col("vb"))))
    z = lambda c: F.when(ok, c).otherwise(F.lit(0.0))
    return g.select(*keys, z(beta).alias("beta"), z(alpha * DAYS).alias("alpha_annual"), z(F.when(se > 0, alpha / se).otherwise(0.0)).alias("alpha_t"), z(F.when(F.col("vs") > 0, 1 - rss / ((F.col("n") - 1) * F.col("vs"))).otherwise(0.0)).alias("r_squared"))


def sharpe(value: str, risk_free: float = 0.0, periods: int = DAYS) -> Column:
    sd = F.stddev_samp(value)
    return F.when((F.count(value) >= 3) & (sd > 0), (F.avg(value) - risk_free / periods) / sd * math.sqrt(periods)).otherwise(F.lit(0.0))


def max_drawdown(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = rows.withColumn("__e", F.sum(value).over(w)).withColumn("__p", F.max("__e").over(w))
    return r.groupBy(*keys).agg(F.min(F.col("__e") - F.col("__p")).alias("max_drawdown"))


def up_down(rows: DataFrame, keys: list[str], order: str, value: str, close: str, window: int = 30) -> DataFrame:
    """Per key: days and annual returns in rising and falling benchmark trends (over window rows)."""
    past = F.lag(close, window).over(Window.partitionBy(*keys).orderBy(order))
    r = rows.withColumn("__t", F.when(past > 0, F.col(close) / past - 1))
    pick = lambda cond: F.avg(F.when(cond, F.col(value))) * DAYS
    return r.groupBy(*keys).agg(F.count_if(F.col("__t") > 0).alias("up_days"), F.count_if(F.col("__t") <= 0).alias("down_days"), pick(F.col("__t") > 0).alias("up_annual"), pick(F.col("__t") <= 0).alias("down_annual"))


def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: n, mean, sample deviation, and skew and kurtosis (not excess) over the sample deviation."""
    # The library's moments are over the population deviation; they come from mergeable sums, without an ordering.
    n = F.count(value)
    shrink = F.sqrt((n - 1) / n)
    deep = n > 1
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.when(deep, F.skewness(value) * F.pow(shrink, F.lit(3.0))).alias("skew"), F.when(deep, (F.kurtosis(value) + 3) * F.pow(shrink, F.lit(4.0))).alias("kurtosis"),
    )


def expected_max_sharpe(trials: int, sharpe_sd: float) -> float:
    """What the best of so many worthless trials shows on average."""
    if trials < 2 or sharpe_sd <= 0:
        return 0.0
    g = 0.5772156649015329
    return sharpe_sd * ((1 - g) * NORMAL.inv_cdf(1 - 1 / trials) + g * NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe_: float, n: int, trials: int, skew: float, kurtosis: float, sharpe_sd: float) -> float:
    """The chance that a Sharpe ratio (a period) beats the best of so many worthless trials."""
    if n < 2:
        return 0.0
    var = 1 - skew * sharpe_ + (kurtosis - 1) / 4 * sharpe_**2
    if var <= 0:
        return 0.0
    return NORMAL.cdf((sharpe_ - expected_max_sharpe(trials, sharpe_sd)) * math.sqrt(n - 1) / math.sqrt(var))


def benjamini_hochberg(rows: DataFrame, keys: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """rows with q (the adjusted p) and rejected; null p-values aren't tests."""
    r = rows.where(F.col(p).isNotNull())
    up, down = Window.partitionBy(*keys).orderBy(p), Window.partitionBy(*keys).orderBy(F.col(p).desc(), F.col("__rank").desc())
    r = r.withColumn("__rank", F.row_number().over(up)).withColumn("__m", F.count("*").over(Window.partitionBy(*keys)))
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.withColumn("q", q).withColumn("rejected", F.col("q") <= alpha).drop("__rank", "__m")


def t_quantile(q: float, df: int) -> float:
    """Student's t by bisection of its distribution function (incomplete beta)."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < q else (lo, mid)
    return (lo + hi) / 2


def t_cdf(t: float, df: int) -> float:
    tail = 0.5 * _beta_inc(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / max(1 + num * d, 1e-300)
            c = max(1 + num / c, 1e-300)
            total *= c * d
    return front * total


# --- classification ------------------------------------------------------------------------------


def auc(rows: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Per key: area under the ROC curve with average ranks; null with one class only. Scores are ranked by distinct value, summed first."""
    v = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("r", below + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n")
    return v.groupBy(*keys).agg(F.when((p > 0) & (p < n), (F.sum(F.col("r") * F.col("pos")) - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


def calibration(rows: DataFrame, keys: list[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return rows.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("rate"), F.avg(F.pow(F.col(prob) - F.col(label), F.lit(2.0))).alias("brier"))


def precision_at_recall(rows: DataFrame, keys: list[str], label: str, score: str, recall: float = 0.5) -> DataFrame:
    """Per key: the best precision at a threshold that recalls enough; equal scores pass together."""
    v = rows.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.withColumn("tp", F.sum("pos").over(w)).withColumn("all", F.sum("n").over(w)).withColumn("p", F.sum("pos").over(Window.partitionBy(*keys)))
    v = v.withColumn("precision", F.col("tp") / F.col("all")).where((F.col("p") > 0) & (F.col("tp") >= recall * F.col("p")))
    return v.groupBy(*keys).agg(F.max("precision").alias("precision"), F.max_by(score, "precision").alias("threshold"))


def trade_scores(rows: DataFrame, keys: list[str], sign: str, ret: str, cost: Column | float) -> DataFrame:
    """Per key over rows with a position: hit rate, expected value net of cost, gross capture; null without any."""
    c = cost if isinstance(cost, Column) else F.lit(float(cost))
    on = (F.col(sign) != 0) & F.col(ret).isNotNull()
    gain = F.col(sign) * F.col(ret)
    return rows.groupBy(*keys).agg(F.count_if(on).alias("trades"), F.avg(F.when(on, (gain > 0).cast("double"))).alias("hit_rate"), F.avg(F.when(on, gain - c)).alias("ev_bps"), F.avg(F.when(on, gain)).alias("gross_bps"))


def confidence_bins(rows: DataFrame, keys: list[str], conf: str, value: str, bins: int = 10) -> DataFrame:
    """Mean value by quantile bin of confidence, and over the top tenth."""
    w = Window.partitionBy(*keys).orderBy(conf)
    return rows.withColumn("bin", F.ntile(bins).over(w)).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(conf).alias("confidence"), F.avg(value).alias("value"))


# --- splits --------------------------------------------------------------------------------------


def purged_folds(rows: DataFrame, keys: list[str], ts: str, folds: int, horizon: int, embargo: int | None = None) -> DataFrame:
    """(fold, is_test, rows): contiguous test folds; training rows whose label reaches a test fold, or that follow it within the embargo, are left out.

    Rows are numbered stretch by stretch; the folds' bounds are a table of folds rows that joins back.
    """
    embargo = horizon if embargo is None else embargo
    if embargo < horizon:
        raise ValueError("an embargo below the label's horizon leaks")
    r = numbered(rows, keys, ts, "__i", "__n")
    r = r.withColumn("__own", F.least(F.floor(F.col("__i") / F.greatest(F.floor(F.col("__n") / folds), F.lit(1))), F.lit(folds - 1))).drop("__i", "__n")
    bounds = r.groupBy(*keys, F.col("__own").alias("fold")).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    both = r.join(bounds, keys) if keys else r.join(bounds)
    test = F.col("__own") == F.col("fold")
    near = (F.col(ts) + horizon >= F.col("__lo")) & (F.col(ts) <= F.col("__hi") + embargo)
    return both.where(test | ~near).withColumn("is_test", test).drop("__own", "__lo", "__hi")


def walk_forward(rows: DataFrame, ts: str, train: int, test: int, *, step: int | None = None, horizon: int = 0) -> DataFrame:
    """rows with fold and is_test: training spans of a fixed length, each before its test span; training rows whose label reaches the test span are left out."""
    step = step or test
    lim = rows.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    starts = lim.where(F.col("lo") + train <= F.col("hi")).select(F.posexplode(F.sequence("lo", F.col("hi") - train, F.lit(step))).alias("fold", "__s"))
    # A row belongs to at most (train + test) / step spans: they are computed from its time, not tried.
    r = rows.join(lim.select(F.col("lo").alias("__lo")))
    first, last = F.greatest(F.lit(0), F.ceil((F.col(ts) - F.col("__lo") - train - test + 1) / step)), F.floor((F.col(ts) - F.col("__lo")) / step)
    r = r.where(first <= last).withColumn("fold", F.explode(F.sequence(first.cast("int"), last.cast("int")))).join(starts, "fold")
    is_test = F.col(ts) >= F.col("__s") + train
    return r.where(is_test | (F.col(ts) + horizon < F.col("__s") + train)).withColumn("is_test", is_test).drop("__s", "__lo")


def walk_forward_capacity(rows: DataFrame, ts: str, train: int, test: int, *, horizon: int = 0) -> DataFrame:
    """(fold, train_rows, test_rows): the folds that the rows' span supports at fixed lengths; lengths are never shrunk to make more."""
    folds = walk_forward(rows, ts, train, test, horizon=horizon)
    return folds.groupBy("fold").agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"))


def block_folds(rows: DataFrame, keys: list[str], order: str, size: int, least: int = 60) -> DataFrame:
    r = numbered(rows, keys, order, "__i").withColumn("fold", F.floor(F.col("__i") / size)).drop("__i")
    full = r.groupBy(*keys, "fold").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    return r.join(full, [*keys, "fold"], "left_semi")


# --- models --------------------------------------------------------------------------------------


def ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients on columns scaled by population deviation, with means and deviations; no intercept."""
    mean, sd = np.nan_to_num(np.nanmean(x, 0)), np.nanstd(x, 0)
    sd[~np.isfinite(sd) | (sd == 0)] = 1.0
    z = (x - mean) / sd
    return np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ y), mean, sd


def gradient_boosting(train: DataFrame, test: DataFrame, features: list[str], label: str, *, trees: int = 50, depth: int = 4, seed: int = 1, **more) -> DataFrame:
    """test with the probability of label 1 by boosted trees of train; missing values take the better side."""
    return boosting.train(train, features, label, trees=trees, max_depth=depth, seed=seed, **more).predict(test)


def perceptron(train: DataFrame, test: DataFrame, features: list[str], label: str, *, hidden: tuple[int, ...] = (16,), seed: int = 1) -> DataFrame:
    """test with probability of label 1 by a feed-forward network; scaling learns from the training rows alone."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    steps = [VectorAssembler(inputCols=features, outputCol="__r"), StandardScaler(inputCol="__r", outputCol="__x", withMean=True), MultilayerPerceptronClassifier(featuresCol="__x", labelCol=label, layers=[len(features), *hidden, 2], seed=seed)]
    model = Pipeline(stages=steps).fit(train.fillna(0.0, subset=features))
    return model.transform(test.fillna(0.0, subset=features)).withColumn("probability", vector_to_array("probability")[1]).drop("__r", "__x", "rawPrediction", "prediction")


def out_of_fold(folds: DataFrame, features: list[str], label: str, n_folds: int, **how) -> DataFrame:
    """Predictions of each fold's test rows by a model of its training rows; folds come from purged_folds."""
    out = None
    for k in range(n_folds):
        of = folds.where(F.col("fold") == k)
        got = gradient_boosting(of.where("NOT is_test"), of.where("is_test"), features, label, **how)
        out = got if out is None else out.union(got)
    return out


# --- cointegration -------------------------------------------------------------------------------

# MacKinnon's response surface for the residual test of two series with a constant (tau max, min, star,
# and polynomials for small and large statistics), and the 95 % trace value of two series with a constant.
TAU = {"max": 0.92, "min": -18.86, "star": -2.62, "small": (2.92, 1.5012, 0.039796), "large": (2.1945, 0.64695, -0.29198, -0.042377)}
TRACE_95 = 15.4943


def adf(u: np.ndarray, most: int | None = None) -> tuple[float, int]:
    """The t statistic of the lagged level without a constant, and the lags chosen by AIC on a common sample."""
    n = len(u)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2) if most is None else most
    d = np.diff(u)

    def design(k: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(start, len(d))
        return np.column_stack([u[rows], *[d[rows - j] for j in range(1, k + 1)]]), d[rows]

    best = (math.inf, 0)
    for k in range(most + 1):
        x, y = design(k, most)
        b, *_ = np.linalg.lstsq(x, y, rcond=None)
        rss = float(((y - x @ b) ** 2).sum())
        best = min(best, (len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * x.shape[1], k))
    x, y = design(best[1], best[1])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    s2 = float(((y - x @ b) ** 2).sum()) / (len(y) - x.shape[1])
    return float(b[0] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0])), best[1]


def tau_p(t: float) -> float:
    if t > TAU["max"]:
        return 1.0
    if t < TAU["min"]:
        return 0.0
    return NORMAL.cdf(sum(c * t**k for k, c in enumerate(TAU["small"] if t <= TAU["star"] else TAU["large"])))


def engle_granger(y: np.ndarray, x: np.ndarray) -> tuple[float, float, float, float]:
    """t, p, slope and intercept of y on x."""
    (slope, icpt), *_ = np.linalg.lstsq(np.column_stack([x, np.ones_like(x)]), y, rcond=None)
    t, _ = adf(y - slope * x - icpt)
    return t, tau_p(t), float(slope), float(icpt)


def johansen_trace(y: np.ndarray, x: np.ndarray, lags: int = 1) -> float:
    """The trace statistic of no cointegration between two series, with a constant."""
    data = np.column_stack([y, x])
    d = np.diff(data, axis=0)
    d = d - d.mean(0)
    z = np.hstack([d[lags - j : len(d) - j] for j in range(1, lags + 1)])
    r0, rk = d[lags:] - d[lags:].mean(0), data[lags:-1] - data[lags:-1].mean(0)
    z = z - z.mean(0)
    fit = lambda a: a - z @ np.linalg.lstsq(z, a, rcond=None)[0]
    r0, rk = fit(r0), fit(rk)
    n = len(r0)
    s00, s0k, skk = r0.T @ r0 / n, r0.T @ rk / n, rk.T @ rk / n
    lam = np.linalg.eigvals(np.linalg.solve(skk, s0k.T @ np.linalg.solve(s00, s0k))).real
    return float(-n * np.log(np.clip(1 - lam, 1e-12, 1)).sum())


def screen(pairs: DataFrame, *, least: int = 250, alpha: float = 0.05) -> DataFrame:
    """(left, right, n, t_stat, p, beta, intercept, trace, q, rejected) of pairs (left, right, date, y, x); a pair of too few dates is no test.

    A pair's series is a group in one task: it holds a price a date, so its size is bounded by the calendar.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        if len(pdf) < least:
            return pd.DataFrame(columns=["left", "right", "n", "t_stat", "p", "beta", "intercept", "trace"])
        y, x = np.log(pdf["y"].to_numpy(float)), np.log(pdf["x"].to_numpy(float))
        return pd.DataFrame([(pdf["left"].iloc[0], pdf["right"].iloc[0], len(pdf), *engle_granger(y, x), johansen_trace(y, x))], columns=["left", "right", "n", "t_stat", "p", "beta", "intercept", "trace"])

    got = pairs.groupBy("left", "right").applyInPandas(run, "left STRING, right STRING, n LONG, t_stat DOUBLE, p DOUBLE, beta DOUBLE, intercept DOUBLE, trace DOUBLE")
    return benjamini_hochberg(got, [], alpha=alpha)


def persistence(formation: DataFrame, holdout: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How many of the formation's survivors are found again, against the share of all pairs that are."""
    s = formation.where("rejected").select("left", "right")
    again = holdout.join(s, ["left", "right"], "left_semi").agg(F.count("*").alias("retested"), F.count_if(F.col("p") < alpha).alias("persisted"), F.count_if("rejected").alias("persisted_bh"))
    base = holdout.agg(F.avg((F.col("p") < alpha).cast("double")).alias("base_rate"))
    out = again.join(base).join(s.agg(F.count("*").alias("survivors")))
    rate = F.when(F.col("retested") > 0, F.col("persisted") / F.col("retested"))
    return out.withColumn("rate", rate).withColumn("lift", F.when(F.col("base_rate") > 0, rate / F.col("base_rate")))


def newey_west(rows: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """Per key: the mean's standard error with Bartlett weights; one window of lagged products."""
    w, all_ = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    r = rows.withColumn("__d", F.col(value) - F.avg(value).over(all_))
    sums = [F.sum(F.col("__d") * F.col("__d"))] + [2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col(f"__l{k}")), F.lit(0.0)) for k in range(1, lags + 1)]
    r = r.withColumns({f"__l{k}": F.col("__d") * F.lag("__d", k).over(w) for k in range(1, lags + 1)})
    total = sums[0]
    for s in sums[1:]:
        total = total + s
    return r.groupBy(*keys).agg((F.sqrt(F.greatest(total, F.lit(0.0))) / F.count("*")).alias("se"), F.count("*").alias("n"))


def block_bootstrap_lower(x: np.ndarray, block: int, reps: int = 300, q: float = 0.05, seed: int = 1) -> float:
    """The lower quantile of means of series put together from blocks."""
    rng = np.random.default_rng(seed)
    n = len(x)
    if n == 0:
        return float("nan")
    starts = rng.integers(0, max(1, n - block + 1), (reps, -(-n // block)))
    at = (starts[:, :, None] + np.arange(min(block, n))).reshape(reps, -1)[:, :n]
    return float(np.quantile(x[at].mean(1), q))
