"""Annual groupings: training and evaluation windows of each year's active set, clusters, gaps, agreement, and group returns.

Every step is keyed by year (and by variant and grouping where there are several), so all years are worked on side by side;
matrix kernels see one year at a time.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cluster, dependence
from .quality import ConstraintError, finite, require_none


def array_sha256(values: np.ndarray) -> str:
    """Digest of an array's doubles in row order."""
    return hashlib.sha256(np.ascontiguousarray(values, "<f8").tobytes()).hexdigest()


def label_map_sha256(labels: dict[str, str]) -> str:
    """Digest of a label map as canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(labels, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def label_document(labels: DataFrame) -> dict[str, dict[str, str]]:
    """labels (year, security, group_id) as {year: {security: group}}; a year's map is small by nature."""
    rows = labels.groupBy("year").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("security", "group_id")))).alias("m")).orderBy("year")
    return {str(r.year): dict(r.m) for r in rows.collect()}


def labels_of_document(spark: SparkSession, document: dict[str, dict[str, str]]) -> DataFrame:
    rows = [(int(y), s, g) for y, own in document.items() for s, g in own.items()]
    return spark.createDataFrame(rows, "year int, security string, group_id string")


def included_labels(constituents: DataFrame) -> DataFrame:
    """(security, group_id) of the included constituents; an included one without a group fails."""
    rows = constituents.where("included").select("security", "group_id")
    require_none(rows.where("group_id is null or trim(group_id) = ''"), "an included constituent has no group")
    return rows


def of_grouping(assignments: DataFrame, grouping_id: str) -> DataFrame:
    """The rows of one grouping, of which there must be some."""
    rows = assignments.where(F.col("grouping_id") == grouping_id)
    if rows.isEmpty():
        raise ConstraintError(f"no assignment of {grouping_id}")
    return rows


def windows(panel: DataFrame, schedule: DataFrame, years: int = 3) -> DataFrame:
    """(year, role, security, date, simple_return) of each year's active set: ``training`` in the ``years`` before its rebalance date,
    ``evaluation`` from it to the end of its year. schedule (year, rebalance_date, security). A row serves the years whose windows
    it lies in, so it is joined by security and year, not by range."""
    near = panel.select("security", "date", "simple_return", F.explode(F.sequence(F.year("date"), F.year("date") + years)).alias("year"))
    rows = near.join(schedule.select("year", "security", "rebalance_date"), ["year", "security"])
    training = (F.col("date") >= F.add_months("rebalance_date", -12 * years)) & (F.col("date") < F.col("rebalance_date"))
    evaluation = (F.col("date") >= F.col("rebalance_date")) & (F.year("date") == F.col("year"))
    role = F.when(training, "training").when(evaluation, "evaluation")
    return rows.withColumn("role", role).where("role is not null").select("year", "role", "security", "date", "simple_return")


def _active(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("year").agg(F.count("*").alias("active"))


def complete_training(rows: DataFrame, schedule: DataFrame, least: int = 1) -> DataFrame:
    """The training rows of dates on which the whole active set has a finite return; a year with fewer than ``least`` such dates
    fails. rows: of ``windows``."""
    good = rows.where((F.col("role") == "training") & finite(F.col("simple_return")))
    days = good.groupBy("year", "date").agg(F.count("*").alias("n")).join(_active(schedule), "year").where("n = active").select("year", "date")
    short = schedule.select("year").distinct().join(days.groupBy("year").agg(F.count("*").alias("days")), "year", "left").where(F.coalesce("days", F.lit(0).cast("long")) < least)
    require_none(short, "too few complete training days")
    return good.join(days, ["year", "date"], "left_semi")


def evaluation_gaps(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """(year, date, missing): evaluation days on which part of the active set has no finite return; there may be none of them."""
    own = rows.where("role = 'evaluation'")
    days = own.groupBy("year", "date").agg(F.count_if(finite(F.col("simple_return"))).alias("n")).join(_active(schedule), "year")
    return days.where("n < active").select("year", "date", (F.col("active") - F.col("n")).alias("missing"))


def annual_correlations(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """(year, role, a, b, n, spearman)."""
    return dependence.pairwise_spearman(rows, least, "year", "role")


def one_per_issuer(schedule: DataFrame, issuers: DataFrame) -> DataFrame:
    """The schedule with one security an issuer, the first by name; securities without an issuer stand for themselves."""
    named = schedule.join(issuers.select("security", "issuer"), "security", "left").withColumn("issuer", F.coalesce("issuer", "security"))
    first = F.row_number().over(Window.partitionBy("year", "issuer").orderBy("security"))
    return named.withColumn("k", first).where("k = 1").select("year", "rebalance_date", "security")


def group_counts(schedule: DataFrame, labels: DataFrame) -> DataFrame:
    """(year, group_count): how many of the given groups a year's active set has. Fewer than two, or as many as securities, fail."""
    out = schedule.join(labels.select("security", "group_id"), "security").groupBy("year").agg(F.countDistinct("group_id").cast("int").alias("group_count"), F.count("*").alias("active"))
    require_none(out.where("group_count < 2 or group_count >= active"), "invalid number of groups")
    return out.select("year", "group_count")


def assignments(training: DataFrame, counts: DataFrame, methods: tuple[str, ...] = ("hierarchical", "spectral", "pca"), seed: int = 5110) -> DataFrame:
    """(year, grouping_id, security, group_id): each year's training correlations (year, a, b, spearman) clustered by each method
    into as many groups as ``counts`` says."""
    pairs = training.join(counts, "year")
    parts = [cluster.cluster_by(pairs, "year", m, None, seed).withColumn("grouping_id", F.lit("pca_kmeans" if m == "pca" else m)) for m in methods]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("year", "grouping_id", "security", "group_id")


def gaps(pairs: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """Within- and between-group means of correlations, over pairs and balanced over groups, for each of ``by``. pairs (by, a, b,
    spearman), labels (by, security, group_id), where labels may lack some of ``by``."""
    shared = [k for k in by if k in labels.columns]

    def side(name: str) -> DataFrame:
        return labels.select(*shared, F.col("security").alias(name), F.col("group_id").alias(f"{name}_group"))

    rows = pairs.join(side("a"), [*shared, "a"]).join(side("b"), [*shared, "b"]).withColumn("within", F.col("a_group") == F.col("b_group"))
    cells = rows.groupBy(*by, "within", F.least("a_group", "b_group").alias("g"), F.greatest("a_group", "b_group").alias("h")).agg(
        F.avg("spearman").alias("mean"), F.sum("spearman").alias("total"), F.count("spearman").alias("n")
    )
    pick = lambda column, yes: F.when(F.col("within") == F.lit(yes), F.col(column))
    out = cells.groupBy(*by).agg(
        *[F.try_divide(F.sum(pick("total", yes)), F.sum(pick("n", yes))).alias(f"{name}_mean") for yes, name in ((True, "within"), (False, "between"))],
        (F.avg(pick("mean", True)) - F.avg(pick("mean", False))).alias("balanced_gap"),
        F.sum(pick("n", True)).alias("within_pairs"),
        F.sum(pick("n", False)).alias("between_pairs"),
    )
    return out.withColumn("gap", F.col("within_mean") - F.col("between_mean"))


def _two(n: Column) -> Column:
    return n * (n - 1) / 2


def agreement(rows: DataFrame, left: str, right: str, *by: str) -> DataFrame:
    """(by, n, ari, nmi) of two partitions of the rows, from their contingency tables. ari is 1 where chance and most agreement
    coincide and are reached, else 0; nmi is 1 where both partitions are trivial."""
    cells = rows.groupBy(*by, F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count("*").cast("double").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*by, *c))
    cells = cells.withColumns({"nl": over("l"), "nr": over("r"), "t": over()})
    share = F.col("n") / F.col("t")
    # a row sum is counted once for each of its cells, so it is weighed by the cell's part of it
    out = cells.groupBy(*by).agg(
        F.max("t").alias("t"),
        F.sum(_two(F.col("n"))).alias("same"),
        *[F.sum(_two(F.col(x)) * F.col("n") / F.col(x)).alias(f"same_{x}") for x in ("nl", "nr")],
        F.sum(share * F.log(F.col("n") * F.col("t") / (F.col("nl") * F.col("nr")))).alias("mutual"),
        *[F.sum(-share * F.log(F.col(x) / F.col("t"))).alias(f"entropy_{x}") for x in ("nl", "nr")],
    )
    expected, most = F.try_divide(F.col("same_nl") * F.col("same_nr"), _two(F.col("t"))), (F.col("same_nl") + F.col("same_nr")) / 2
    flat = F.abs(most - F.coalesce(expected, F.lit(0.0))) < 1e-12
    ari = F.when(flat, F.when(F.abs(F.col("same") - most) < 1e-9, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("same") - expected, most - expected))
    mean = (F.col("entropy_nl") + F.col("entropy_nr")) / 2
    return out.select(*by, F.col("t").cast("long").alias("n"), ari.alias("ari"), F.when(mean < 1e-15, 1.0).otherwise(F.try_divide(F.col("mutual"), mean)).alias("nmi"))


def consecutive_agreement(labels: DataFrame, *by: str) -> DataFrame:
    """(by, year, common, ari, nmi): each year's groups against the year before's, over the securities of both."""
    earlier = labels.select(*by, (F.col("year") + 1).alias("year"), "security", F.col("group_id").alias("previous"))
    both = labels.select(*by, "year", "security", "group_id").join(earlier, [*by, "year", "security"])
    return agreement(both, "group_id", "previous", *by, "year").withColumnRenamed("n", "common")


def cluster_sizes(labels: DataFrame, *by: str) -> DataFrame:
    return labels.groupBy(*by, "group_id").agg(F.count("*").alias("members"))


def annual_group_returns(rows: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """(by, year, role, date, group_id): mean return, members, weight in the portfolio and log return, of complete groups. rows: of
    ``windows``; labels (by, year, security, group_id). A group that lacks a member's return on a date has none."""
    sizes = cluster_sizes(labels, *by, "year")
    cells = rows.where(finite(F.col("simple_return"))).join(labels.select(*by, "year", "security", "group_id"), ["year", "security"])
    means = cells.groupBy(*by, "year", "role", "date", "group_id").agg(F.avg("simple_return").alias("simple_return"), F.count("*").alias("n"))
    total = Window.partitionBy(*by, "year")
    whole = means.join(sizes.withColumn("all", F.sum("members").over(total)), [*by, "year", "group_id"]).where("n = members")
    return whole.select(
        *by, "year", "role", "date", "group_id", "simple_return", F.col("members").alias("group_size"), (F.col("members") / F.col("all")).alias("portfolio_weight"), F.log1p("simple_return").alias("log_return")
    )


def assignment_record(schedule: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """By year: rebalance date, active securities, training and evaluation days, and for each grouping its number of groups and
    the digest of its label map in one struct."""
    days = rows.groupBy("year").agg(
        F.countDistinct(F.when(F.col("role") == "training", F.col("date"))).alias("training_days"),
        F.countDistinct(F.when(F.col("role") == "evaluation", F.col("date"))).alias("evaluation_days"),
        F.min(F.when(F.col("role") == "training", F.col("date"))).alias("training_start"),
        F.max(F.when(F.col("role") == "training", F.col("date"))).alias("training_end"),
    )
    entries = F.array_sort(F.collect_list(F.struct("security", "group_id")))
    pairs = F.transform(entries, lambda x: F.concat(F.lit('"'), x["security"], F.lit('":"'), x["group_id"], F.lit('"')))
    maps = labels.groupBy("year", "grouping_id").agg(F.countDistinct("group_id").alias("groups"), F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), 256).alias("sha256"))
    by_grouping = maps.groupBy("year").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grouping_id", F.struct("groups", "sha256"))))).alias("groupings"))
    sets = schedule.groupBy("year", "rebalance_date").agg(F.count("*").alias("active"))
    return sets.join(days, "year").join(by_grouping, "year")


def labels_problems(labels: DataFrame, panel: DataFrame) -> DataFrame:
    """(year, security, code): securities labelled twice in a year or not in the panel."""
    twice = labels.groupBy("year", "security").count().where("count > 1").select("year", "security", F.lit("duplicate_label").alias("code"))
    foreign = labels.join(panel.select("security").distinct(), "security", "left_anti").select("year", "security", F.lit("not_in_panel").alias("code"))
    return twice.unionByName(foreign.distinct())


def bound_gaps(observed: DataFrame, stored: DataFrame, *by: str, tolerance: float = 1e-12) -> DataFrame:
    """``observed`` gaps, if they are the stored ones to within ``tolerance`` and for the same keys."""
    a, b = observed.select(*by, F.col("gap").alias("observed_gap")), stored.select(*by, F.col("gap").alias("stored_gap"))
    both = a.join(b, list(by), "full_outer")
    off = F.col("observed_gap").isNull() | F.col("stored_gap").isNull() | (F.abs(F.col("observed_gap") - F.col("stored_gap")) > tolerance)
    require_none(both.where(off), "gaps differ from the stored ones")
    return observed


def annual_groupings(panel: DataFrame, schedule: DataFrame, labels: DataFrame, issuers: DataFrame | None = None, years: int = 3, least: int = 1) -> dict[str, DataFrame]:
    """The whole step for the full universe and, with ``issuers``, for one security an issuer: windows, assignments of the given and the
    hierarchical groups, gaps in both, agreement of the two and with the year before, group returns, and a record a year."""
    variants = {"full_universe": schedule} | ({"issuer_deduplicated": one_per_issuer(schedule, issuers)} if issuers is not None else {})
    out: dict[str, DataFrame] = {}

    def add(name: str, rows: DataFrame, variant: str) -> None:
        rows = rows.withColumn("universe_variant", F.lit(variant))
        out[name] = out[name].unionByName(rows) if name in out else rows

    for variant, own in variants.items():
        rows = windows(panel, own, years)
        require_none(evaluation_gaps(rows, own), f"{variant}: missing returns in an evaluation window")
        training = complete_training(rows, own, least)
        pairs = annual_correlations(training.unionByName(rows.where("role = 'evaluation'")))
        given = own.select("year", "security").join(labels.select("security", "group_id"), "security").withColumn("grouping_id", F.lit("gics"))
        made = assignments(pairs.where("role = 'training'").drop("role"), group_counts(own, labels), ("hierarchical",))
        both = given.unionByName(made)
        evaluation = pairs.where("role = 'evaluation'").drop("role")
        add("assignments", both, variant)
        add("gaps", gaps(evaluation.crossJoin(F.broadcast(both.select("grouping_id").distinct())), both, "grouping_id", "year"), variant)
        add("agreement", agreement(given.select("year", "security", F.col("group_id").alias("given")).join(made, ["year", "security"]), "given", "group_id", "year"), variant)
        add("consecutive", consecutive_agreement(made, "grouping_id"), variant)
        add("group_returns", annual_group_returns(training.unionByName(rows.where("role = 'evaluation'")), both, "grouping_id"), variant)
        add("record", assignment_record(own, rows, both), variant)
    return out


def ml_groupings(panel: DataFrame, schedule: DataFrame, labels: DataFrame, hierarchical: DataFrame, years: int = 3, least: int = 700, seed: int = 5110) -> dict[str, DataFrame]:
    """Spectral and principal-component groups of each year beside the given and hierarchical ones: assignments, method
    diagnostics with their seeds, gaps, agreement with both, and group returns. A security without a given or hierarchical group
    fails, as do fewer than ``least`` complete training days."""
    for name, own in (("given", labels), ("hierarchical", hierarchical)):
        keys = [k for k in ("year", "security") if k in own.columns]
        require_none(schedule.select("year", "security").join(own.select(*keys), keys, "left_anti"), f"no {name} group")
    rows = windows(panel, schedule, years)
    require_none(evaluation_gaps(rows, schedule), "missing returns in an evaluation window")
    training = complete_training(rows, schedule, least)
    pairs = annual_correlations(training).drop("role")
    counts = group_counts(schedule, labels)
    made = assignments(pairs, counts, ("spectral", "pca"), seed)
    evaluation = annual_correlations(rows.where("role = 'evaluation'")).drop("role")
    named = made.join(labels.select("security", F.col("group_id").alias("given")), "security").join(hierarchical.select("year", "security", F.col("group_id").alias("hierarchical")), ["year", "security"])
    return {
        "assignments": made,
        "diagnostics": cluster.method_diagnostics(pairs.join(counts, "year"), "year", seed),
        "gaps": gaps(evaluation.crossJoin(F.broadcast(made.select("grouping_id").distinct())), made, "grouping_id", "year"),
        "agreement_given": agreement(named, "group_id", "given", "grouping_id", "year"),
        "agreement_hierarchical": agreement(named, "group_id", "hierarchical", "grouping_id", "year"),
        "sizes": cluster_sizes(made, "grouping_id", "year"),
        "group_returns": annual_group_returns(training.unionByName(rows.where("role = 'evaluation'")), made, "grouping_id"),
    }
