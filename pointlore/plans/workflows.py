"""End-to-end pipelines (Q): one lazy plan per output table, composed of the operators."""

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written
from ..operators import curves as D
from ..operators import envelopes as E
from ..operators import geometry as C
from ..operators import mixture as H
from ..operators import occupancy as G
from ..operators import twosample as T
from ..operators.expressions import effect_label, filter_samples, normalize_samples


class Tables(Mapping):
    """The tables of an analysis by name, each made when it is first asked for: some operators write what they share."""

    def __init__(self, **made: Callable[[], DataFrame]):
        self._made = {name: cache(f) for name, f in made.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._made[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)


def distance_analysis(points: DataFrame, cells: DataFrame, baseline: str, measures: list[str], triangles: DataFrame | None = None, normalization: str | None = None, modes: DataFrame | None = None, bin_width: float = 0.2, minimum: float = -1.0, bootstrap: int = 100) -> Mapping[str, DataFrame]:
    """Q01: distances, cleaning, normalisation, densities, distances between samples, KS tests, envelopes."""
    raw = C.distances(points, measures, cells, triangles)
    samples, emptied = filter_samples(raw, minimum)
    if normalization:
        samples = normalize_samples(samples, cells, modes, normalization)
    samples = written(samples, "samples")
    pdfs = cache(lambda: D.distance_pdfs(samples, "discrete", bin_width))
    pairs = cache(lambda: T.emd_all_pairs(samples))
    ks = cache(lambda: T.ks_all_baselines(samples, samples.select(F.col("mode").alias("baseline")).distinct()))
    envelopes = cache(lambda: E.pairwise_curve_test(E.sample_curves(samples)))
    return Tables(
        samples=lambda: samples, emptied=lambda: emptied, pdfs=lambda: pdfs()[0], pdf_envelope=lambda: pdfs()[1], emd=pairs, emd_vs_baseline=lambda: T.emd_vs_baseline(pairs(), baseline),
        ks=ks, ks_bootstrap=lambda: T.ks_bootstrap(ks(), bootstrap), tests=lambda: envelopes()[0], rates=lambda: envelopes()[1], envelopes=lambda: E.own_envelopes(samples),
        summary=lambda: T.emd_summary(pairs()).select("mode_a", "mode_b", "measure", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean", "std", "median", "lo", "hi")]),
    )


def occupancy_analysis(samples: DataFrame, available: DataFrame, modes: DataFrame, baseline: str, method: str = "discrete", width: float = 0.2, bootstrap: int = 100, **how) -> Mapping[str, DataFrame]:
    """Q02: occupancy by histogram or kernel density; then its distances, KS tests with bootstrap, envelopes."""
    if method == "discrete":
        cell, combined = G.occupancy_binned(samples, available, modes, width, **how)
    else:
        cell, combined = G.occupancy_kde(samples, available, modes, **how)
    cell = written(cell, "occupancy")
    pairs = cache(lambda: G.occupancy_emd(cell))
    ks = cache(lambda: G.occupancy_ks(cell, samples.sparkSession.createDataFrame([(baseline,)], "baseline string")))
    envelopes = cache(lambda: E.pairwise_envelope_test_occupancy(cell))
    return Tables(cell=lambda: cell, combined=lambda: combined, emd=pairs, emd_means=lambda: T.emd_means(pairs()), ks=ks, ks_bootstrap=lambda: T.ks_bootstrap(ks(), bootstrap), tests=lambda: envelopes()[0], rates=lambda: envelopes()[1])


def randomness_test(observed: DataFrame, simulated: DataFrame, n_grid: int = 100, statistic: str = "integrated", alpha: float = 0.05) -> DataFrame:
    """Q03: every cell against the null models of the same cell (joined on the cell's id), then rates over cells."""
    return E.summarize_cells(E.monte_carlo_per_cell(observed, simulated, n_grid, statistic), alpha)[1]


def mixed_rule(occ: DataFrame, occ_comb: DataFrame, modes: list[str], baseline: str, names: DataFrame, folds: int = 5, repeats: int = 10) -> Mapping[str, DataFrame]:
    """Q04: fit by cross-validation, average, turn into weights; compare candidate models and occupancy distances."""
    cv = H.cross_validate(occ, occ_comb, modes, baseline, folds, repeats)
    fit = cache(lambda: H.fit_from_cv(cv, occ_comb, modes, baseline))
    target = occ_comb.filter(F.col("mode") == baseline).select("measure", "i", F.col("occupancy").alias("b"))
    return Tables(coefs=lambda: fit()[0], mse=lambda: fit()[1], weights=lambda: H.mixture_weights(cv, names), cv=lambda: H.cv_long(cv), candidates=lambda: H.comparison_table(H.compare_candidates(target, cv["matrix"], modes)))


def validate_rule(samples: DataFrame, occ: DataFrame, baseline: str, bootstrap: int = 100, method: str = "exact") -> dict[str, DataFrame]:
    """Q04, second part: simulations of the mixed rule beside all other modes, by occupancy and by distances.

    ``samples`` and ``occ`` (occupancy per cell) hold the baseline, the plain rules and the mixed one. Distances between all samples,
    tests against the baseline with their bootstrap, pairwise envelopes; ``summary``: mean distance of each pair of modes and share of
    similar samples of each mode, for occupancy and for distances.
    """
    samples, occ = written(samples, "samples"), written(occ, "occupancy")
    base = samples.sparkSession.createDataFrame([(baseline,)], "baseline string")
    pairs = {"occupancy": written(G.occupancy_emd(occ), "occupancy-emd"), "distance": written(T.emd_all_pairs(samples), "emd")}
    tests = {"occupancy": written(G.occupancy_ks(occ, base, method=method), "occupancy-ks"), "distance": written(T.ks_all_baselines(samples, base, method=method), "ks")}
    parts = []
    for kind in pairs:
        parts.append(T.emd_means(pairs[kind]).select(F.lit(f"{kind}_emd").alias("kind"), "measure", "mode_1", "mode_2", F.col("mean_emd").alias("value")))
        parts.append(T.ks_means(tests[kind]).select(F.lit(f"{kind}_similar").alias("kind"), "measure", F.col("mode").alias("mode_1"), F.lit(baseline).alias("mode_2"), F.col("similar_share").alias("value")))
    summary = parts[0]
    for p in parts[1:]:
        summary = summary.unionByName(p)
    envelope, rates, _ = E.pairwise_envelope_test(samples)
    out = {f"{kind}_emd": p for kind, p in pairs.items()} | {f"{kind}_ks": t for kind, t in tests.items()}
    return out | {"ks_bootstrap": T.ks_bootstrap(tests["distance"], bootstrap), "envelope": envelope, "envelope_rates": rates, "summary": summary}


def colocalisation(pairs: DataFrame, baseline: str, with_mode: str, without_mode: str, k_with: int = 5, k_without: int = 4) -> DataFrame:
    """Q05: distances of the baseline to a mode with and to one without the extra structure, as two models.

    A cell of the baseline counts once, with its mean distance to a mode. Per measure: means, counts, AIC of both models and their
    verdict; Cohen's d of the two sets with its size in words; the signed-rank test of the cells that both have.
    """
    cells = T.emd_by_cell(pairs, baseline).filter(F.col("mode").isin(with_mode, without_mode)).withColumn("side", F.when(F.col("mode") == with_mode, "w").otherwise("o"))
    cells = written(cells, "cell-means")
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("mean_emd")))
    both = cells.groupBy("measure", "cell_id").agg(pick("w").alias("w"), pick("o").alias("wo"))
    sizes = both.groupBy("measure").agg(F.avg("w").alias("mean_with"), F.avg("wo").alias("mean_without"), F.count("w").alias("n_with"), F.count("wo").alias("n_without")).filter("n_with > 0 and n_without > 0")
    models = T.compare_models(both, "w", "wo", k_with, k_without, ["measure"])
    effects = T.cohens_d(cells, "side", "w", "o", "mean_emd", ["measure"]).select("measure", F.col("d").alias("cohens_d"), effect_label(F.col("d")).alias("effect"))
    ranks = T.wilcoxon(both, "w", "wo", ["measure"]).select("measure", "p_value", F.col("statistic").alias("test_statistic"), F.col("effect").alias("r_effect"))
    out = sizes.join(models, "measure").join(effects, "measure").join(ranks, "measure", "left")
    return out.withColumn("mean_difference", F.col("mean_with") - F.col("mean_without"))


def variation_analysis(samples: DataFrame, baseline: str, bandwidth: float = 0.4, limits: tuple[float, float] | None = None, minimum: float = 0.0, alpha: float = 0.05, n_grid: int = 100) -> Mapping[str, DataFrame]:
    """Q06: everything that Q01 compares, on modes that are levels of a variation or grid spacings: kernel densities with a fixed factor,
    central tendencies, distances of all pairs inside a mode and against the baseline, pairwise envelopes for each measure and jointly."""
    samples = written(samples, "samples")
    pdfs = cache(lambda: D.distance_pdfs(samples, "kde", limits=limits, minimum=minimum, alpha=alpha, bandwidth=bandwidth))
    pairs = cache(lambda: T.emd_all_pairs(samples))
    envelopes = cache(lambda: E.pairwise_curve_test(E.sample_curves(samples, n_grid), alpha=alpha, joint_n=n_grid))
    views = lambda: T.emd_intra(pairs()).withColumn("kind", F.lit("intra")).unionByName(T.emd_vs_baseline(pairs(), baseline).withColumn("kind", F.lit("baseline")))
    return Tables(
        pdfs=lambda: pdfs()[0], pdf_envelope=lambda: pdfs()[1], distances=lambda: T.distance_summary(samples), emd=pairs, emd_views=views, emd_summary=lambda: T.emd_summary(pairs()),
        tests=lambda: envelopes()[0], rates=lambda: envelopes()[1], envelopes=lambda: E.own_envelopes(samples, alpha, n_grid), ks=lambda: variation(samples, baseline),
    )


def variation(samples: DataFrame, baseline: str, method: str = "exact") -> DataFrame:
    """Q06: per mode, mean KS and earth mover's distance to the baseline and the share of similar samples."""
    ks = T.ks_test(samples, baseline, method=method)
    return ks.groupBy("measure", "mode").agg(F.count(F.lit(1)).alias("n"), F.avg("ks").alias("mean_ks"), F.avg("emd").alias("mean_emd"), F.avg(F.col("similar").cast("double")).alias("similar_share"))
