"""The whole analysis of all stations that share a column set, as one set of plans.

Stations differ in which columns they drop, impute or treat.  These decisions
are tables keyed by station, so no step loops over stations and a failing
station is a row with a status instead of a failing job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.config import Settings
from colweave.functions.stats import is_float, is_numeric, normalise_nan
from colweave.operators import (centrality, clean, embed, graphs, iforest, impute, learned, metrics, outliers, profile,
                                quality, reports, roles, scale, similarity)
from colweave.operators.ordered import numbered
from colweave.session import GROUP_ROW_LIMIT, materialise, side_by_side
from colweave.sources.discovery import in_time_order, load_stations, with_times
from colweave.sources.results import ResultStore, global_report, metadata

UNNAMED = "(none)"
IMPUTED_ROLES = (roles.NUMERIC, roles.CATEGORICAL, roles.UNKNOWN)


@dataclass
class StationRun:
    """Result tables, all keyed by station."""

    audit: DataFrame
    roles: DataFrame
    drops: DataFrame
    cleaning: DataFrame
    outliers: DataFrame
    cleaned: DataFrame
    scaled: DataFrame
    features: DataFrame
    guard: DataFrame
    nodes: DataFrame
    edges: DataFrame
    metrics: DataFrame
    centralities: DataFrame
    embeddings: DataFrame
    run_reports: DataFrame
    quality: DataFrame
    projections: DataFrame
    report: DataFrame
    failures: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def where_flagged(df: DataFrame, cols: list[str], flags: DataFrame,
                  change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``change`` to the columns a station has flagged; leave the others alone.

    ``flags(station, column)``.  Unflagged columns are hidden as NULL from
    ``change`` and put back afterwards.
    """
    # A left join: stations without any flag need no row.
    sets = materialise(flags.groupBy("station").agg(F.collect_set("column").alias("_on")))
    on = {c: F.coalesce(F.array_contains("_on", c), F.lit(False)) for c in cols}
    shown = df.join(sets, "station", "left").withColumns({f"_keep_{c}": F.when(~on[c], F.col(c)) for c in cols})
    shown = shown.withColumns({c: F.when(on[c], F.col(c)) for c in cols})
    changed = change(shown)
    return changed.withColumns({c: F.when(on[c], F.col(c)).otherwise(F.col(f"_keep_{c}")) for c in cols}).drop(
        "_on", *[f"_keep_{c}" for c in cols])


def _reasons(found: DataFrame, reason) -> DataFrame:
    return found.select("station", "column", reason.alias("reason"))


def run_stations(df: DataFrame, cols: list[str], settings: Settings | None = None,
                 limit: int = GROUP_ROW_LIMIT) -> StationRun:
    """Profile, clean, scale, link, measure and embed every station of ``df(station, row_id, cols)``."""
    cfg = settings or Settings()
    # Joins on the station must not lose rows, so it is never NULL.
    named = F.coalesce(F.col("station").cast("string"), F.lit(UNNAMED)).alias("station")
    df = normalise_nan(df.select(named, "row_id", *cols))
    dated, invalid = in_time_order(df, cols, cfg.timestamp_col)
    failures = materialise(invalid)
    dated = materialise(dated.join(failures.select("station"), "station", "left_anti"))
    order = ["_order_ts", "row_id"]
    stations = materialise(similarity.row_counts(dated))

    # Cleaning, in this order: repeated rows, infinities, sparse, constant, missing, redundant, outliers.
    rows = numbered(dated)
    if cfg.drop_duplicates:
        rows = clean.dedupe_rows(rows, [*cols, "_order_ts"])
    floats = [c for c in cols if is_float(df.schema[c].dataType)]
    rows = materialise(clean.infinite_to_missing(rows, floats))
    kept_rows = materialise(similarity.row_counts(rows))

    stats = materialise(profile.column_profile(dated, cols, written=True))
    # The time is read off a column, so rows equal in all columns are those that were dropped.
    audit = materialise(profile.audit(dated, cols, limit, stats, kept_rows if cfg.drop_duplicates else None))
    found = materialise(roles.column_roles(dated, cols, order, cfg.strict_time_names, limit, stats))

    sparse = clean.sparse_columns(rows, cols, cfg.missing_threshold_drop, found)
    drops = materialise(_reasons(sparse, F.format_string("Excessive missingness (%.1f%%)", F.col("null_ratio") * 100)))
    rows, left = clean.apply_drops(rows, drops, cols)

    numbers = [c for c in left if is_numeric(df.schema[c].dataType)]
    if numbers:
        constant = clean.constant_columns(rows, numbers, cfg.near_constant_threshold, found).join(
            drops.select("station", "column"), ["station", "column"], "left_anti")
        constant = materialise(_reasons(constant, F.concat(
            F.lit("Constant / Near-constant (variance = "), F.coalesce(F.col("variance").cast("string"), F.lit("nan")),
            F.lit(")"))))
        rows, left = clean.apply_drops(rows, constant, left)
        drops = materialise(drops.unionByName(constant))
        numbers = [c for c in left if c in numbers]

    rows, strategies, unordered = _impute(rows, left, found, drops, kept_rows, cfg, limit)
    failures = materialise(failures.unionByName(unordered))
    found, kept_rows, stations = (t.join(unordered.select("station"), "station", "left_anti")
                                  for t in (found, kept_rows, stations))

    redundant = None
    if len(numbers) > 1:
        redundant = materialise(clean.redundant_columns(
            similarity.pearson_pairs(rows, numbers), cfg.redundant_correlation_threshold))
        if cfg.drop_redundant_columns:
            rows, left = clean.apply_drops(rows, redundant, left)
            drops = materialise(drops.unionByName(_reasons(redundant, F.concat(
                F.lit("Highly correlated with "), F.concat_ws(", ", "correlated_with")))))
            numbers = [c for c in left if c in numbers]

    features = materialise(clean.selected_features(found, drops).where(F.col("column").isin(numbers)))
    # Only columns that are a feature of some station take part from here on.
    nodes_left = [c for c in numbers if c in {r["column"] for r in features.select("column").distinct().collect()}]
    rows, outlier_report = _treat(rows, nodes_left, features, cfg, limit)
    cleaned = materialise(rows)
    scaled = cleaned
    if nodes_left:
        # A projection over the cleaned rows and one statistics row per station: not worth a copy.
        scaled = where_flagged(cleaned, nodes_left, features,
                               lambda shown: scale.standard_scale(shown, nodes_left))
    guard = materialise(clean.feature_guard(features, stations))
    failures = materialise(failures.unionByName(guard.where("status = 'Failed'").select(
        "station", "status", F.concat(F.lit("Insufficient features ("), F.col("features").cast("string"),
                                      F.lit(") to build graph.")).alias("reason"))))
    if cfg.strict_mode:
        clean.split_by_status(failures, strict=True)

    dropped = stations.join(kept_rows.withColumnRenamed("rows", "kept"), "station", "left").select(
        "station", (F.col("rows") - F.coalesce("kept", F.lit(0))).alias("dropped_rows"))
    cleaning = dropped.join(strategies, "station", "left").withColumnRenamed("strategy", "imputation_strategy")
    if redundant is not None and not cfg.drop_redundant_columns:
        cleaning = cleaning.join(redundant.groupBy("station").agg(F.sort_array(F.collect_list(
            F.struct("column", "correlated_with"))).alias("redundant_columns_detected")), "station", "left")
    cleaning = materialise(cleaning)

    return _graphs_and_reports(scaled, cleaned, nodes_left, features, guard, audit, found, drops, cleaning,
                               outlier_report, failures, cfg)


def _impute(rows: DataFrame, left: list[str], found: DataFrame, drops: DataFrame, kept_rows: DataFrame,
            cfg: Settings, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Impute the eligible columns of every station.

    Also which strategy each station used, and the stations to be interpolated that
    lack a time in some row: these fail alone and their rows go.
    """
    no_failures = rows.sparkSession.createDataFrame([], "station string, status string, reason string")
    eligible = (found.where(F.col("role").isin(*IMPUTED_ROLES)).select("station", "column")
                .where(F.col("column").isin(left))
                .join(drops.select("station", "column"), ["station", "column"], "left_anti"))
    gaps = rows.groupBy("station").agg(*[F.max(F.col(c).isNull()).alias(c) for c in left]) if left else None
    if gaps is None:
        return rows, kept_rows.select("station", F.lit(None).cast("string").alias("strategy")), no_failures
    gappy = gaps.select("station", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("gap")) for c in left]))).where("gap")
    eligible = materialise(eligible.join(gappy.select("station", "column"), ["station", "column"], "left_semi"))
    wanted = [r["column"] for r in eligible.select("column").distinct().collect()]
    targets = [c for c in left if c in wanted]
    if not targets:
        return rows, kept_rows.select("station", F.lit(None).cast("string").alias("strategy")), no_failures
    # The time to interpolate over is the first column with that role.
    clock = found.where(F.col("role") == roles.TIMESTAMP).groupBy("station").agg(
        F.min_by("column", "idx").alias("_time"))
    facts = (kept_rows.join(eligible.select("station").distinct(), "station", "left_semi")
             .join(clock, "station", "left").withColumn("has_timestamp", F.col("_time").isNotNull()))
    strategies = materialise(impute.choose_strategy(facts, cfg.missing_impute_strategy))
    timed = with_times(rows, strategies.select("station", "_time"), "_impute_ts")
    failed = materialise(
        timed.where("_impute_ts is null").join(strategies.where("strategy = 'interpolate'"), "station", "left_semi")
        .groupBy("station").agg(F.first("_time").alias("_time")).select(
            "station", F.lit("Failed").alias("status"),
            F.coalesce(F.concat(F.lit("Not every row has a time in '"), "_time", F.lit("' to interpolate over.")),
                       F.lit("No time column to interpolate over.")).alias("reason")))
    timed = timed.drop("_time").join(failed.select("station"), "station", "left_anti")
    strategies = materialise(strategies.join(failed.select("station"), "station", "left_anti"))
    idle = timed.join(strategies.select("station"), "station", "left_anti").drop("_impute_ts")
    busy = timed.join(strategies.select("station"), "station", "left_semi")
    done = where_flagged(busy, targets, eligible,
                         lambda shown: impute.impute(shown, targets, strategies, "_impute_ts", limit)).drop("_impute_ts")
    idle = idle.select(*[F.col(c).cast(done.schema[c].dataType).alias(c) for c in done.columns])
    return materialise(done.unionByName(idle)), strategies.select("station", "strategy"), failed


def _treat(rows: DataFrame, cols: list[str], features: DataFrame, cfg: Settings,
           limit: int) -> tuple[DataFrame, DataFrame]:
    """Treat outliers of feature columns and report what was found."""
    empty = features.select("station", "column", F.lit(0).cast("long").alias("outliers"),
                            F.lit(0.0).alias("lower_bound"), F.lit(0.0).alias("upper_bound")).where("false")
    if not cols:
        return rows, empty
    if cfg.outlier_method == "isolation_forest":
        held: dict[str, DataFrame] = {}

        def by_forest(shown: DataFrame) -> DataFrame:
            treated, held["found"] = iforest.treat_by_forest(
                shown, cols, cfg.outlier_treatment, cfg.random_seed, limit)
            return treated

        out = where_flagged(rows, cols, features, by_forest)
        report = held["found"].where("outliers > 0").select(
            "station", F.lit("*").alias("column"), "outliers", F.lit(None).cast("double").alias("lower_bound"),
            F.lit(None).cast("double").alias("upper_bound"))
        return out, materialise(report)
    report = materialise(outliers.outlier_report(rows, cols, cfg.outlier_method, limit)
                         .join(features.select("station", "column"), ["station", "column"], "left_semi"))
    out = where_flagged(rows, cols, features,
                        lambda shown: outliers.treat_outliers(shown, cols, cfg.outlier_method,
                                                              cfg.outlier_treatment, limit, report))
    return out, report


def _graphs_and_reports(scaled: DataFrame, cleaned: DataFrame, cols: list[str], features: DataFrame, guard: DataFrame,
                        audit: DataFrame, found: DataFrame, drops: DataFrame, cleaning: DataFrame,
                        outlier_report: DataFrame, failures: DataFrame, cfg: Settings) -> StationRun:
    """Graphs, measures, embeddings and reports of the stations with at least two features."""
    good = guard.where("status = 'Success'").select("station")
    # Positions within the columns that are left.
    place = F.array_position(F.array(*[F.lit(c) for c in cols]) if cols else F.array().cast("array<string>"), F.col("column"))
    own = materialise(features.join(good, "station", "left_semi").select(
        "station", "column", (place - 1).cast("int").alias("idx")))
    matrix = scaled.join(good, "station", "left_semi")
    # One scan of the rows yields correlations, inner products and row counts.
    sums = materialise(_own_pairs(similarity.pair_sums(matrix, cols, centred=True), own) if cols
                       else _no_sums(scaled))
    names = cols or [""]
    pairs = materialise(similarity.pairs_from_sums(sums, names))
    grams = similarity.grams_from_sums(sums, names)
    counts = materialise(sums.where("i = j").groupBy("station").agg(F.max("n").alias("rows")))

    nodes = materialise(own.select("station", F.explode(F.array(*[F.lit(t) for t in graphs.GRAPH_TYPES])).alias("graph_type"),
                                   F.col("column").alias("node"), "idx"))
    ranked = {"top_k": materialise(similarity.cosines_from_grams(grams))} if cfg.top_k_similarity == "cosine" else {}
    edges = [graphs.BUILDERS[name](ranked.get(name, pairs), cfg) for name in graphs.BUILDERS]
    edges.append(learned.learned_graph(grams, pairs, counts, names, cfg.learnable_epochs, cfg.learnable_lr,
                                       cfg.learnable_weight_decay))
    merged = edges[0]
    for part in edges[1:]:
        merged = merged.unionByName(part)
    merged = materialise(merged)

    measured = materialise(metrics.graph_metrics(nodes, merged))
    central = materialise(centrality.centralities(nodes, merged))
    vectors = embed.node_features(grams, own, counts, names, cfg.node_feature_dim)
    runs = materialise(embed.embedding_runs(vectors, merged, embed.feature_width(names, cfg.node_feature_dim),
                                            cfg.gnn_embedding_dim))
    run_reports = materialise(embed.run_reports(runs))
    stored = materialise(embed.stored_embeddings(runs, run_reports))
    scored = materialise(quality.embedding_quality(stored))
    projected = quality.project_2d(stored)
    report = reports.station_report(audit.join(good, "station", "left_semi"), found, drops, cleaning, outlier_report,
                                    measured, central, run_reports, scored, guard)
    profiles = audit.select("station", "rows", "cols", "bytes")
    return StationRun(
        audit=audit, roles=found, drops=drops, cleaning=cleaning, outliers=outlier_report, cleaned=cleaned,
        scaled=scaled, features=own, guard=guard, nodes=nodes, edges=merged, metrics=measured, centralities=central,
        embeddings=stored, run_reports=run_reports, quality=scored, projections=projected, report=report,
        failures=failures, tables={
            "comparison": reports.comparison_table(profiles.join(good, "station", "left_semi"), guard),
            "density": reports.density_table(measured),
            "distance": reports.distance_table(scored),
            "metrics": reports.metric_table(measured),
            "node_features": reports.node_feature_table(
                nodes, profile.node_stats(scaled, cols) if cols else _no_stats(scaled), central),
        })


def _own_pairs(sums: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs of which both columns are nodes of the station."""
    left = own.select("station", F.col("idx").alias("i"))
    right = own.select("station", F.col("idx").alias("j"))
    return sums.join(left, ["station", "i"], "left_semi").join(right, ["station", "j"], "left_semi")


def _no_sums(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], similarity.PARTIAL_SCHEMA)


def _no_stats(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "station string, node string, mean double, std double, min double, max double")


def run_folder(spark: SparkSession, data_dir: str, settings: Settings | None = None) -> tuple[list[StationRun], DataFrame]:
    """Load a folder of stations and analyse them, one run per column set.

    Also returns the stations that could not be loaded or analysed.
    """
    cfg = settings or Settings()
    loaded = load_stations(spark, data_dir, cfg.strict_mode)
    runs = side_by_side([partial(run_stations, df, cols, cfg) for cols, df in loaded.tables])
    failures = loaded.failures
    for run in runs:
        failures = failures.unionByName(run.failures)
    return runs, failures


# Tables of a run by the name they are saved under.
SAVED = ("edges", "nodes", "metrics", "centralities", "embeddings", "run_reports", "quality", "audit", "roles", "drops",
         "cleaning", "outliers", "features", "report")


def saved_tables(run: StationRun) -> dict[str, DataFrame]:
    """Every table of a run that is saved."""
    drop = ["row_id", "_order_ts"]
    return {"cleaned": run.cleaned.drop(*drop), "scaled": run.scaled.drop(*drop),
            **{name: getattr(run, name) for name in SAVED}, **run.tables}


def save_runs(runs: list[StationRun], failures: DataFrame, results_dir: str, name: str,
              settings: Settings | None = None) -> ResultStore:
    """Save the runs of all column sets of a folder, and its failures, as one run of the results folder.

    Earlier runs and saves stay as they are.  Everything appears at once, with the
    manifest.
    """
    spark = failures.sparkSession
    store = ResultStore(spark, results_dir)
    sets = [([c for c in run.cleaned.columns if c not in ("station", "row_id", "_order_ts")], saved_tables(run)) for run in runs]
    cfg = settings or Settings()
    store.save(name, sets, {"failures": failures, "metadata": metadata(spark, name, cfg.to_dict())})
    return store


def save_run(run: StationRun, results_dir: str, name: str = "run") -> ResultStore:
    """Save one column set's run; see :func:`save_runs`."""
    return save_runs([run], run.failures, results_dir, name)


def export_run(run: StationRun, folder: str, fmt: str = "parquet") -> None:
    """One column set's tables as plain folders of files for other tools; an export replaces the one before."""
    from colweave.sources.artefacts import write_adjacency, write_embeddings, write_report, write_table

    drop = ["row_id", "_order_ts"]
    write_table(run.cleaned.drop(*drop), f"{folder}/cleaned", fmt)
    write_table(run.scaled.drop(*drop), f"{folder}/scaled", fmt)
    write_table(run.edges, f"{folder}/edges", fmt)
    write_adjacency(run.nodes, run.edges, f"{folder}/adjacency")
    write_embeddings(run.embeddings, f"{folder}/embeddings")
    for part, df in (("audit", run.audit), ("stations", run.report), ("failures", run.failures), *(
            (f"summary_{name}", df) for name, df in run.tables.items())):
        write_report(df, f"{folder}/{part}")


def export_global_report(store: ResultStore, folder: str, run: str | None = None) -> None:
    """The report over all stations as JSON: how the run was made, one summary line and one nested report per station."""
    from colweave.sources.artefacts import write_report

    write_report(store.read("metadata", run), f"{folder}/metadata")
    write_report(global_report(store, run), f"{folder}/summary")
    write_report(store.read("report", run), f"{folder}/stations")
    write_report(store.read("failures", run), f"{folder}/failures")
