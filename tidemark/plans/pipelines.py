"""Named compositions of operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import conflict, dominance, extracted, function_flags, lineage_ranks, stratum, threshold_label
from tidemark.operators import mapping as M
from tidemark.operators import matrix as X
from tidemark.operators import models as L
from tidemark.operators import ood as O
from tidemark.operators import splits as S
from tidemark.operators.contracts import checked_join
from tidemark.operators.matrix import composition
from tidemark.operators.ranges import quantiles
from tidemark.operators.shared import filled, reliable
from tidemark.operators.stats import odds_ratio, ols, rank_sum
from tidemark.sources import scans


def registry(rows: DataFrame, representative: Column, annotations: list[str], category: str, single: str) -> DataFrame:
    """Representative rows with their function flags; stateless, so it runs on batches and streams alike."""
    return rows.where(representative).withColumns(function_flags(annotations, category, single))


def phenotype(rows: DataFrame, groups: dict[str, list[str]], r2: Column, fraction: Column, limits: dict[str, float], strong: float = 0.50) -> DataFrame:
    """Top variable, negatives, score of each group, dominant group, and whether R2 passes the limit of the fraction and the strong one."""
    family = [c for columns in groups.values() for c in columns]
    scores = {f"score_{g}": s for g, s in X.group_scores(groups).items()}
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), fraction)
    return rows.withColumns({"top": X.best_two(family)["best_name"], "n_negative": X.row_counts(family)["n_negative"], **scores, "dominant": X.driver_labels(groups)["rule_c"], "predictable": r2 > limit, "strong": r2 > strong})


def taxonomy_covariates(records: DataFrame, lineages: DataFrame, group: str, name: str, pattern: str, domain: str, ranks: int) -> DataFrame:
    """By group and rank: modal value, coverage, purity, rows, annotated rows, and the group's share of domain conflicts.

    The contig key is cut from the record's name, its lineage (contig, lineage) joined where there is
    one, and the first rank compared with the record's stored domain.
    """
    keyed = records.withColumn("contig", extracted(F.col(name), pattern))
    joined = keyed.join(lineages, "contig", "left")
    parts = joined.withColumns({f"rank{i}": c for i, c in enumerate(lineage_ranks(F.col("lineage"), ranks))})
    parts = parts.withColumn("conflicts", conflict(F.col(domain), F.col("rank0")))
    columns = [f"rank{i}" for i in range(ranks)]
    wide = M.group_taxonomy(parts, group, columns, {"conflict_share": F.col("conflicts")})
    filled = parts.groupBy(group).agg(*(F.count_if(F.col(c) != "").alias(f"{c}_annotated") for c in columns))
    one = lambda c: F.struct(F.lit(c).alias("rank"), F.col(f"{c}_modal").alias("modal"), F.col(f"{c}_coverage").alias("coverage"), F.col(f"{c}_purity").alias("purity"), F.col("n").alias("n_rows"), F.col(f"{c}_annotated").alias("n_annotated"), F.col("conflict_share"))
    return wide.join(filled, group).select(group, F.inline(F.array(*map(one, columns))))


def candidate_pool(rows: DataFrame, key: str, fraction: str, score: str, label: str, cap: int, seed: int) -> DataFrame:
    """Rows with a stratum of fraction, score level and label, at most ``cap`` of each by hash order."""
    low = quantiles(rows, [fraction], score, {"__q": 0.25}).select(fraction, F.least("__q", F.lit(0.5)).alias("__low"))
    levelled = rows.join(low, fraction).withColumn("stratum", stratum(F.col(fraction), threshold_label(F.col(score), 0.5, F.col("__low")), F.col(label))).drop("__low")
    pairs = levelled.where("stratum IS NOT NULL").select("stratum", key).repartition(filled(rows), "stratum", key).distinct()
    return S.capped(pairs, ["stratum"], key, cap, seed)


def frozen_benchmark(rows: DataFrame, key: str, group: str, cell: list[str], label: str, values: tuple[str, str], seed: int) -> DataFrame:
    """Matched rows with a leakage-free split by group."""
    return S.matched(rows, cell, label, values, key, seed).withColumn("split", S.split_of(F.col(group), seed))


def open_set_scores(rows: DataFrame, key: str, vector: str, label: str, group: Column, *, least: int, seed: int, components: int) -> tuple[DataFrame, DataFrame]:
    """(key, role, method, score) of seven detectors on the rows kept aside, and (key, y) with y = 1 for held-out classes.

    Classes are held out and roles given by hash, groups that span parts go, and scaling, components
    and classifier are fitted on the train rows of the known classes.
    """
    parts = S.class_holdout(rows, label, least, seed)
    named = rows.join(F.broadcast(parts.select(label, "part")), label).withColumn("grp", group)
    safe = reliable(S.group_safe(named, "grp", "part").where("reason IS NULL").withColumn("role", S.role_of(F.col("grp"), seed)))
    train = (F.col("part") == "id") & (F.col("role") == "train")
    z = reliable(L.scaled_vectors(safe, vector, train, "__z"))
    pcs = reliable(L.pca(z, "__z", train, components, "pcs")[0].drop("__z"))
    x = reliable(L.multiclass(pcs, "pcs", label, train, "__logits").select(key, label, "part", "role", "pcs", "__logits"))
    held = x.where(~train)
    fitted = x.where(train)
    logits = held.select(key, O.msp(F.col("__logits")).alias("msp"), O.max_logit(F.col("__logits")).alias("max_logit"), O.energy(F.col("__logits")).alias("energy"))
    distances = O.distance_scores(held, key, "pcs", O.distance_state(fitted, label, "pcs"), label)
    near = O.nearest_cosine(held, fitted, key, "pcs")
    wide = reliable(held.select(key, "part", "role").join(logits, key).join(distances, key).join(near, key))
    methods = ["msp", "max_logit", "energy", "mahalanobis", "relative_mahalanobis", "prototype_cosine", "knn_cosine"]
    scores = wide.select(key, "role", F.inline(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods))))
    return scores, held.select(key, (F.col("part") != "id").cast("int").alias("y"))


def ecology_tables(spark, matrices: dict[str, str], groups: dict[str, list[str]], r2: str, limits: dict[str, float], stats: DataFrame, key: str) -> DataFrame:
    """Matrices of scores by fraction (fraction to path; the header may lack its first column), read and repaired, with phenotypes and the statistics of ``stats`` where there are any; the fraction is a column."""
    one = lambda fraction, path: scans.repaired_table(spark, path, key).withColumn("fraction", F.lit(fraction))
    rows = reduce(DataFrame.unionByName, (one(f, p) for f, p in matrices.items()))
    return checked_join(phenotype(rows, groups, F.col(r2), F.col("fraction"), limits), stats, [key], "left", "many_to_one")


def group_comparison(rows: DataFrame, fraction: str, known: str, unknown: str, category: str, excluded: str, value: str, flags: list[str]) -> DataFrame:
    """fraction, group, n, mean, q25, median, q75, and of both groups together cliffs_delta, u and an odds ratio for each flag.

    Rows of the excluded category go (a null one stays); a row belongs to the larger of its two counts,
    and to neither if they are equal.  Odds are those of the unknown group over those of the known one.
    """
    kept = rows.where(~F.col(category).eqNullSafe(excluded)).withColumn("group", dominance(F.coalesce(known, F.lit(0)), F.coalesce(unknown, F.lit(0)), ("known", "unknown"))).where("group IS NOT NULL")
    kept = reliable(kept.select(fraction, "group", value, *flags))
    facts = kept.groupBy(fraction, "group").agg(F.count(value).alias("n"), F.avg(value).alias("mean")).join(quantiles(kept, [fraction, "group"], value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), [fraction, "group"], "left")
    cell = lambda g, flag, yes: F.count_if((F.col("group") == g) & (F.col(flag) if yes else ~F.col(flag))).alias(f"{flag}_{g}_{yes}")
    cells = kept.groupBy(fraction).agg(*(cell(g, f, yes) for f in flags for g in ("unknown", "known") for yes in (True, False)))
    odds = cells.select(fraction, *(odds_ratio(F.col(f"{f}_unknown_True"), F.col(f"{f}_unknown_False"), F.col(f"{f}_known_True"), F.col(f"{f}_known_False")).alias(f"odds_{f}") for f in flags))
    names = [r[0] for r in kept.select(fraction).distinct().orderBy(fraction).collect()]  # one for each fraction
    ranks = reduce(DataFrame.unionByName, (rank_sum(kept.where(F.col(fraction) == x), value, "group", ("unknown", "known")).select(F.lit(x).alias(fraction), "u", "cliffs_delta") for x in names)) if names else None
    out = facts.join(odds, fraction)
    return out.join(ranks, fraction) if ranks is not None else out.withColumns({"u": F.lit(None).cast("double"), "cliffs_delta": F.lit(None).cast("double")})


def macro_effects(rows: DataFrame, keys: list[str], category: str, values: list[str], base: list[str]) -> DataFrame:
    """Composition of each key's rows, then one row: least squares of the entropy (to nine digits, so that equal compositions tie) on the log of the size and the share of ``base`` categories, and the rank test of keys that those dominate against the others."""
    c = composition(rows, keys, category, values)
    c = reliable(c.select(F.round("entropy", 9).alias("entropy"), F.log1p("n").alias("log_n"), sum((F.col(f"share_{values.index(b)}") for b in base), F.lit(0.0)).alias("share"), F.when(F.col("dominant").isin(base), "base").otherwise("other").alias("side")))
    fit = ols(c, "entropy", ["share", "log_n"])
    ranks = rank_sum(c, "entropy", "side", ("base", "other"))
    return ranks.select(*(F.lit(fit[t][k]).alias(f"{t}_{k}") for t in ("intercept", "share", "log_n") for k in ("beta", "se")), "n1", "n2", "u", "cliffs_delta")
