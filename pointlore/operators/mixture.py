"""Non-negative mixtures of modes, cross-validation, information criteria (H).

occ_cell: measure, mode, cell_id, i, x, occupancy. occ_comb: measure, mode, i, x, occupancy. Folds and repeats are rows, so one plan
fits all of them.
"""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.special import nnls
from ..functions.storage import written
from .curves import interp

JOINT = "joint"


def baseline_cells(occ: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Cells of the baseline in its first measure, and (measure, cell) where another measure differs from it."""
    cells = occ.filter(F.col("mode") == mode).select("measure", "cell_id").distinct()
    first = cells.agg(F.min("measure").alias("measure"))
    chosen = cells.join(F.broadcast(first), "measure", "left_semi").select("cell_id")
    expected = chosen.crossJoin(F.broadcast(cells.select("measure").distinct())).select("measure", "cell_id")
    return chosen, expected.exceptAll(cells).withColumn("side", F.lit("missing")).unionByName(cells.exceptAll(expected).withColumn("side", F.lit("extra")))


def baseline_grid(occ_comb: DataFrame, baseline: str) -> DataFrame:
    return occ_comb.filter(F.col("mode") == baseline).select("measure", "i", "x")


def baseline_curves(occ: DataFrame, grid: DataFrame, baseline: str) -> DataFrame:
    """Every cell's baseline curve on the grid, 0 outside the cell's range: measure, cell_id, i, x, y."""
    curves = occ.filter(F.col("mode") == baseline).select("measure", "cell_id", "i", "x", F.col("occupancy").alias("y"))
    return interp(curves, grid, ["measure", "cell_id"], ["measure"], "zero")


def mean_curve(occ: DataFrame, cells: DataFrame, grid: DataFrame, baseline: str, keys: list[str]) -> DataFrame:
    """Mean baseline curve of the cells of each key on the baseline grid, 0 outside a cell's range. ``cells``: keys, cell_id."""
    return cells.join(baseline_curves(occ, grid, baseline), "cell_id").groupBy(*keys, "measure", "i").agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("b"))


def design(occ_comb: DataFrame, grid: DataFrame, modes: list[str]) -> DataFrame:
    """One column per mode on the baseline grid: array ``a`` in the order of ``modes``."""
    curves = occ_comb.filter(F.col("mode").isin(modes)).select("measure", "mode", "i", "x", F.col("occupancy").alias("y"))
    wide = interp(curves, grid, ["measure", "mode"], ["measure"], "zero").groupBy("measure", "i").pivot("mode", modes).agg(F.first("y"))
    return wide.select("measure", "i", F.array(*[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)) for m in modes]).alias("a"))


def _with_joint(rows: DataFrame) -> DataFrame:
    """Every row once for its measure and once for all measures stacked."""
    return rows.withColumn("scope", F.explode(F.array(F.col("measure"), F.lit(JOINT))))


def fit_mixture(target: DataFrame, matrix: DataFrame, modes: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Coefficients and shares per key, scope and mode, and the error of the fit.

    The normal equations are sums per key and scope; a solver sees k*k + k numbers per fit. ``target``: keys, measure, i, b.
    """
    k = len(modes)
    rows = _with_joint(target.join(matrix, ["measure", "i"]))
    a = lambda j: F.col("a")[j]
    gram = F.array(*[F.sum(a(p) * a(q)) for p in range(k) for q in range(k)])
    right = F.array(*[F.sum(a(p) * F.col("b")) for p in range(k)])
    sums = rows.groupBy(*keys, "scope").agg(gram.alias("_g"), right.alias("_r"), F.sum(F.col("b") * F.col("b")).alias("_bb"), F.count(F.lit(1)).alias("n"))
    fit = sums.withColumn("coef", solve(k, "_g", "_r"))
    total = F.aggregate("coef", F.lit(0.0), lambda s, c: s + c)
    fit = fit.withColumn("_total", total)
    # The error needs the rows again only for its digits; the sums give the same number.
    quad = sum((F.col("coef")[p] * F.col("coef")[q] * F.col("_g")[p * k + q] for p in range(k) for q in range(k)), F.lit(0.0))
    cross = sum((F.col("coef")[p] * F.col("_r")[p] for p in range(k)), F.lit(0.0))
    rss = F.greatest(F.lit(0.0), F.col("_bb") - 2 * cross + quad)
    mse = fit.select(*keys, "scope", "n", rss.alias("rss"), (rss / F.col("n")).alias("mse"))
    names = F.array(*[F.lit(m) for m in modes])
    rel = F.when(F.col("_total") > 0, F.col("c.coef") / F.col("_total")).otherwise(0.0)
    coefs = fit.select(*keys, "scope", "_total", F.explode(F.arrays_zip(names.alias("mode"), "coef")).alias("c"))
    return coefs.select(*keys, "scope", F.col("c.mode").alias("mode"), F.col("c.coef").alias("coef"), rel.alias("share")), mse


def solve(k: int, g: str, r: str) -> Column:
    """Closed form for one or two columns, the Arrow solver for more."""
    G, R = F.col(g), F.col(r)
    one = lambda j: F.coalesce(F.greatest(F.lit(0.0), F.try_divide(R[j], G[j * k + j])), F.lit(0.0))
    if k == 1:
        return F.array(one(0))
    if k > 2:
        return nnls(G, R)
    det = G[0] * G[3] - G[1] * G[2]
    c0, c1 = F.try_divide(R[0] * G[3] - R[1] * G[1], det), F.try_divide(R[1] * G[0] - R[0] * G[2], det)
    gain = lambda j: one(j) * one(j) * G[j * k + j] - 2 * one(j) * R[j]
    edge = F.when(gain(0) <= gain(1), F.array(one(0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), one(1)))
    return F.when((c0 >= 0) & (c1 >= 0), F.array(c0, c1)).otherwise(edge)


def reconstruction(coefs: DataFrame, matrix: DataFrame, modes: list[str], keys: list[str]) -> DataFrame:
    """Fitted curve of every key and scope: keys, scope, measure, i, fit."""
    by = coefs.groupBy(*keys, "scope").agg(F.map_from_entries(F.collect_list(F.struct("mode", "coef"))).alias("_c"))  # one entry a mode
    fit = sum((F.col("_c")[m] * F.col("a")[j] for j, m in enumerate(modes)), F.lit(0.0))
    of = by.filter(F.col("scope") == JOINT).crossJoin(F.broadcast(matrix)).unionByName(by.filter(F.col("scope") != JOINT).withColumn("measure", F.col("scope")).join(F.broadcast(matrix), "measure"), allowMissingColumns=True)
    return of.select(*keys, "scope", "measure", "i", fit.alias("fit"))


def fit_single(target: DataFrame, matrix: DataFrame, modes: list[str], keys: list[str]) -> DataFrame:
    """Best non-negative multiple of each mode alone: keys, scope, mode, coef, rss, n."""
    each = F.posexplode("a").alias("_j", "_a")
    rows = _with_joint(target.join(matrix, ["measure", "i"])).select(*keys, "scope", "b", each)
    g = rows.groupBy(*keys, "scope", "_j").agg(F.sum(F.col("_a") * F.col("b")).alias("_ab"), F.sum(F.col("_a") * F.col("_a")).alias("_aa"), F.sum(F.col("b") * F.col("b")).alias("_bb"), F.count(F.lit(1)).alias("n"))
    c = F.coalesce(F.greatest(F.lit(0.0), F.try_divide("_ab", "_aa")), F.lit(0.0))
    rss = F.greatest(F.lit(0.0), F.col("_bb") - 2 * F.col("coef") * F.col("_ab") + F.col("coef") * F.col("coef") * F.col("_aa"))
    return g.withColumn("coef", c).select(*keys, "scope", F.array(*[F.lit(m) for m in modes])[F.col("_j")].alias("mode"), "coef", rss.alias("rss"), "n")


def evaluate(occ: DataFrame, coefs: DataFrame, matrix: DataFrame, grid: DataFrame, cells: DataFrame, modes: list[str], baseline: str, keys: list[str], grouping: str = "combined") -> DataFrame:
    """Error on held-out cells (keys, cell_id): of each cell, or of the mean curve of the key's cells (cell_id null)."""
    if grouping == "combined":
        observed = mean_curve(occ, cells, grid, baseline, keys).withColumn("cell_id", F.lit(None).cast("string"))
    else:
        observed = mean_curve(occ, cells, grid, baseline, [*keys, "cell_id"])
    return _errors(observed, coefs, matrix, modes, keys)


def _errors(observed: DataFrame, coefs: DataFrame, matrix: DataFrame, modes: list[str], keys: list[str]) -> DataFrame:
    fit = reconstruction(coefs, matrix, modes, keys)
    err = F.col("b") - F.col("fit")
    joined = observed.join(fit, [*keys, "measure", "i"])
    return joined.groupBy(*keys, "scope", "cell_id").agg(F.avg(err * err).alias("test_mse"))


def assign_folds(cells: DataFrame, folds: int, repeats: int, seed: str) -> DataFrame:
    """Near-equal folds (the first ones larger) in md5 order, for every repeat: repeat, fold, cell_id."""
    r = cells.select("cell_id").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    by = W.partitionBy("repeat").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("repeat").cast("string"), "cell_id")), "cell_id")
    return r.withColumn("fold", F.ntile(folds).over(by) - 1)


def cross_validate(occ: DataFrame, occ_comb: DataFrame, modes: list[str], baseline: str, folds: int = 5, repeats: int = 10, seed: str = "cv", grouping: str = "combined") -> dict[str, DataFrame]:
    """Repeated k-fold over the baseline's cells. Gives coefficients, train errors and test errors, keyed by (repeat, fold)."""
    keys = ["repeat", "fold"]
    cells, _ = baseline_cells(occ, baseline)
    placed = assign_folds(cells, folds, repeats, seed)
    # Every fold uses these small tables; they are computed once.
    grid = written(baseline_grid(occ_comb, baseline), "grid")
    matrix = written(design(occ_comb, grid, modes), "design")
    few = F.when(F.count(F.lit(1)) < folds, F.raise_error(F.lit("fewer cells than folds")).cast("int")).otherwise(0)
    placed = placed.join(placed.groupBy("repeat").agg(few.alias("_few")), "repeat").filter("_few = 0").drop("_few")
    curves = written(baseline_curves(occ, grid, baseline), "curves")
    # Each fold's sums once: its own mean curve is the test's, that of all others is what the repeat's sums leave.
    sums = placed.join(curves, "cell_id").groupBy(*keys, "measure", "i").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    sums = written(sums, "fold-sums")
    every = sums.groupBy("repeat", "measure", "i").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rest = every.join(sums, [*keys, "measure", "i"], "left").withColumn("_rest", F.col("_n") - F.coalesce("n", F.lit(0)))
    train = rest.select(*keys, "measure", "i", F.coalesce(F.try_divide(F.col("_s") - F.coalesce("s", F.lit(0.0)), "_rest"), F.lit(0.0)).alias("b"))
    coefs, mse = fit_mixture(written(train, "train"), matrix, modes, keys)
    coefs = written(coefs, "coefs")
    if grouping == "combined":
        observed = sums.select(*keys, "measure", "i", F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("b"), F.lit(None).cast("string").alias("cell_id"))
    else:
        observed = placed.join(curves, "cell_id").select(*keys, "measure", "i", F.coalesce("y", F.lit(0.0)).alias("b"), "cell_id")
    test = _errors(observed, coefs, matrix, modes, keys)
    return {"folds": placed, "coefs": coefs, "train": mse, "test": test, "grid": grid, "matrix": matrix}


def cv_summary(cv: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Mean and deviation of coefficients; mean train and test errors, deviation of the folds' mean errors."""
    coefs = cv["coefs"].groupBy("scope", "mode").agg(F.avg("coef").alias("coef_mean"), F.stddev_pop("coef").alias("coef_std"), F.avg("share").alias("share_mean"), F.stddev_pop("share").alias("share_std"))
    per = cv["test"].groupBy("repeat", "fold", "scope").agg(F.avg("test_mse").alias("_t"))
    test = per.groupBy("scope").agg(F.avg("_t").alias("test_mse"), F.stddev_pop("_t").alias("test_mse_std"))
    train = cv["train"].groupBy("scope").agg(F.avg("mse").alias("train_mse"), F.stddev_pop("mse").alias("train_mse_std"))
    return coefs, train.join(test, "scope")


def cv_long(cv: dict[str, DataFrame]) -> DataFrame:
    """A train row per fold, a test row per held-out cell (or per fold, without a cell)."""
    train = cv["train"].select("repeat", "fold", "scope", F.lit("train").alias("split"), F.lit(None).cast("string").alias("cell_id"), "mse")
    return train.unionByName(cv["test"].select("repeat", "fold", "scope", F.lit("test").alias("split"), "cell_id", F.col("test_mse").alias("mse")))


def fit_from_cv(cv: dict[str, DataFrame], occ_comb: DataFrame, modes: list[str], baseline: str) -> tuple[DataFrame, DataFrame]:
    """Mean coefficients of the folds, and their error against the combined baseline curve."""
    coefs = cv_summary(cv)[0].select("scope", "mode", F.col("coef_mean").alias("coef"))
    observed = occ_comb.filter(F.col("mode") == baseline).select("measure", "i", F.coalesce("occupancy", F.lit(0.0)).alias("b"))
    fit = reconstruction(coefs, cv["matrix"], modes, [])
    err = F.col("b") - F.col("fit")
    return coefs, fit.join(observed, ["measure", "i"]).groupBy("scope").agg(F.avg(err * err).alias("mse"))


def mixture_weights(cv: dict[str, DataFrame], names: DataFrame, scope: str = JOINT) -> DataFrame:
    """Coefficients over their total, per fold and over all folds (fold null), for modes that have a gradient name only."""
    c = cv["coefs"].filter(F.col("scope") == scope)
    both = c.select("repeat", "fold", "mode", "coef").unionByName(c.groupBy("mode").agg(F.avg("coef").alias("coef")).select(F.lit(None).cast("int").alias("repeat"), F.lit(None).cast("int").alias("fold"), "mode", "coef"))
    total = F.sum("coef").over(W.partitionBy("repeat", "fold"))
    w = both.withColumn("_t", total).withColumn("weight", F.when(F.col("_t") <= 0, F.raise_error(F.lit("the coefficients add up to nothing")).cast("double")).otherwise(F.col("coef") / F.col("_t")))
    return w.join(names, "mode").select("repeat", "fold", "mode", "gradient", "weight")


def information_criteria(df: DataFrame) -> DataFrame:
    """N, k, rss -> aic, aicc (infinite for few points), bic; the variance counts as a parameter."""
    n, p = F.col("n").cast("double"), F.col("k") + 1
    fit = n * F.ln(F.col("rss") / n)
    aic = fit + 2 * p
    small = F.when(F.col("n") <= F.col("k") + 2, float("inf")).otherwise(aic + 2 * p * (p + 1) / F.when(F.col("n") > F.col("k") + 2, n - p - 1))
    return df.select("*", aic.alias("aic"), small.alias("aicc"), (fit + p * F.ln(n)).alias("bic"))


def compare_candidates(target: DataFrame, matrix: DataFrame, modes: list[str]) -> DataFrame:
    """Mixed, single and null model per scope: criteria, differences, weights, best. ``target``: measure, i, b."""
    coefs, mse = fit_mixture(target, matrix, modes, [])
    mixed = mse.select("scope", F.lit("mixed").alias("model"), "n", F.lit(len(modes)).alias("k"), "rss")
    single = fit_single(target, matrix, modes, []).select("scope", F.concat(F.lit("single:"), "mode").alias("model"), "n", F.lit(1).alias("k"), "rss")
    null = _with_joint(target).groupBy("scope").agg(F.lit("null").alias("model"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("k"), (F.var_pop("b") * F.count(F.lit(1))).alias("rss"))
    rows = mixed.unionByName(single).unionByName(null).withColumn("rss", F.greatest("rss", F.lit(1e-300)))
    c = information_criteria(rows)
    by = W.partitionBy("scope")
    for name in ("aic", "bic"):
        c = c.withColumn(f"delta_{name}", F.col(name) - F.min(name).over(by))
        w = F.exp(-F.col(f"delta_{name}") / 2)
        c = c.withColumn(f"weight_{name}", w / F.sum(w).over(by))
    return c.withColumn("best", F.min_by("model", "aic").over(by) == F.col("model"))


def comparison_table(candidates: DataFrame) -> DataFrame:
    """With evidence ratios: best weight over the model's own, infinite at 0."""
    top = F.max("weight_aic").over(W.partitionBy("scope"))
    ratio = F.when(F.col("weight_aic") > 0, top / F.col("weight_aic")).otherwise(float("inf"))
    return candidates.select("scope", "model", "n", "k", "rss", "aic", "aicc", "bic", "delta_aic", "weight_aic", "delta_bic", "weight_bic", "best", ratio.alias("evidence_ratio"))


def fit_table(coefs: DataFrame, mse: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficients, shares and errors by scope, in one table."""
    return coefs.join(mse.select(*keys, "scope", "mse"), [*keys, "scope"])
