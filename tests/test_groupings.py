"""Annual grouping steps on small panels, their rules, and the clustering kernels' contracts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import cluster, dependence
from riskloom.operators import groupings as gr
from riskloom.operators.quality import ConstraintError

NAMES = [f"S{k}" for k in range(8)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    days = [dt.date(2017, 1, 2) + dt.timedelta(days=7 * k) for k in range(52 * 5)]
    factors = rng.standard_normal((len(days), 2))
    rows = [(n, d, float(0.01 * (factors[i, k % 2] + 0.4 * rng.standard_normal()))) for i, d in enumerate(days) for k, n in enumerate(NAMES)]
    return spark.createDataFrame(rows, "security string, date date, simple_return double")


@pytest.fixture(scope="module")
def schedule(spark):
    return spark.createDataFrame([(y, dt.date(y, 1, 6), n) for y in (2020, 2021) for n in NAMES[: 8 if y == 2020 else 7]], "year int, rebalance_date date, security string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(n, "even" if k % 2 == 0 else "odd") for k, n in enumerate(NAMES)], "security string, group_id string")


def test_whole_step_finds_the_planted_groups(spark, panel, schedule, labels):
    issuers = spark.createDataFrame([("S0", "i"), ("S2", "i")], "security string, issuer string")
    found = gr.annual_groupings(panel, schedule, labels, issuers)
    assert all(r.ari == pytest.approx(1.0) for r in found["agreement"].collect()) and all(r.nmi == pytest.approx(1.0) for r in found["agreement"].collect())
    assert all(r.gap > 0.5 for r in found["gaps"].collect()) and found["gaps"].count() == 8
    sizes = {(r.universe_variant, r.year): r.n for r in found["assignments"].where("grouping_id = 'hierarchical'").groupBy("universe_variant", "year").agg(F.count("*").alias("n")).collect()}
    assert sizes == {("full_universe", 2020): 8, ("full_universe", 2021): 7, ("issuer_deduplicated", 2020): 7, ("issuer_deduplicated", 2021): 6}
    assert all(r.common == 7 and r.ari == pytest.approx(1) for r in found["consecutive"].where("universe_variant = 'full_universe'").collect())
    weights = found["group_returns"].groupBy("universe_variant", "grouping_id", "year", "date").agg(F.sum("portfolio_weight").alias("w")).agg(F.min("w"), F.max("w")).first()
    assert weights[0] == pytest.approx(1) and weights[1] == pytest.approx(1)
    record = {(r.universe_variant, r.year): r for r in found["record"].collect()}["full_universe", 2020]
    document = gr.label_document(found["assignments"].where("universe_variant = 'full_universe' and grouping_id = 'hierarchical'"))
    assert record.groupings["hierarchical"].sha256 == gr.label_map_sha256(document["2020"]) and record.active == 8
    assert gr.labels_of_document(spark, document).count() == 15
    gr.bound_gaps(found["gaps"], found["gaps"], "universe_variant", "grouping_id", "year")
    with pytest.raises(ConstraintError):
        gr.bound_gaps(found["gaps"], found["gaps"].withColumn("gap", F.col("gap") + 1e-9), "universe_variant", "grouping_id", "year")


def test_ml_step(panel, schedule, labels):
    hierarchical = schedule.select("year", "security").join(labels, "security")
    found = gr.ml_groupings(panel, schedule, labels, hierarchical, least=100)
    assert {r.grouping_id for r in found["assignments"].collect()} == {"spectral", "pca_kmeans"}
    assert all(r.ari == pytest.approx(1) for r in found["agreement_given"].where("grouping_id = 'spectral'").collect())
    rows = found["diagnostics"].collect()
    assert len(rows) == 4 and {tuple(r.seeds) for r in rows} == {(5110, y, c) for y in (2020, 2021) for c in (1, 2)}
    assert all(r.explained >= 0.8 for r in rows if r.method == "pca") and all(r.least_eigenvalue > 0 for r in rows)
    with pytest.raises(ConstraintError):
        gr.ml_groupings(panel, schedule, labels.where("security <> 'S0'"), hierarchical, least=100)
    with pytest.raises(ConstraintError):
        gr.ml_groupings(panel, schedule, labels, hierarchical, least=1000)


def test_rules_of_windows(panel, schedule, labels):
    holes = panel.withColumn("simple_return", F.when((F.col("security") == "S1") & (F.year("date") == 2020) & (F.month("date") == 3), F.lit(None)).otherwise(F.col("simple_return")))
    assert gr.evaluation_gaps(gr.windows(panel, schedule), schedule).count() == 0
    assert {r.missing for r in gr.evaluation_gaps(gr.windows(holes, schedule), schedule).collect()} == {1}
    with pytest.raises(ConstraintError):
        gr.annual_groupings(holes, schedule, labels)
    rows = gr.windows(holes, schedule)
    assert gr.complete_training(rows, schedule).where("year = 2021 and month(date) = 3 and year(date) = 2020").count() == 0
    with pytest.raises(ConstraintError):
        gr.complete_training(rows, schedule, 10**6)
    with pytest.raises(ConstraintError):
        gr.group_counts(schedule, labels.withColumn("group_id", F.lit("one")))
    with pytest.raises(ConstraintError):
        gr.of_grouping(labels.withColumn("grouping_id", F.lit("gics")), "spectral")
    twice = schedule.select("year", "security").join(labels, "security").unionByName(schedule.select("year", F.lit("Q").alias("security"), F.lit("x").alias("group_id")).limit(1))
    assert {r.code for r in gr.labels_problems(twice.unionByName(twice), panel).collect()} == {"duplicate_label", "not_in_panel"}
    with pytest.raises(ConstraintError):
        gr.included_labels(labels.withColumns({"included": F.lit(True), "group_id": F.lit(" ")}))


def test_trivial_partitions_agree(spark):
    one = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y")], "security string, l string, r string")
    assert tuple(gr.agreement(one, "l", "r").first())[1:] == (1.0, 1.0)
    split = spark.createDataFrame([("a", "x", "y"), ("b", "x", "z")], "security string, l string, r string")
    assert gr.agreement(split, "l", "r").first().ari == 0.0


def test_spearman_in_blocks_with_gaps(spark, monkeypatch):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 6, (40, 9)).astype(float)
    values[rng.random(values.shape) < 0.15] = np.nan
    rows = [(f"s{j}", dt.date(2020, 1, 1) + dt.timedelta(days=i), None if np.isnan(values[i, j]) else float(values[i, j])) for i in range(40) for j in range(9)]
    frame = spark.createDataFrame(rows, "security string, date date, simple_return double")
    whole = {(r.a, r.b): (r.n, r.spearman) for r in dependence.pairwise_spearman(frame, 0.5).collect()}
    monkeypatch.setattr(dependence, "BLOCK", 2)
    parts = {(r.a, r.b): (r.n, r.spearman) for r in dependence.pairwise_spearman(frame, 0.5).collect()}
    assert whole.keys() == parts.keys() and len(whole) == 36
    for (a, b), (n, x) in whole.items():
        u, w = values[:, int(a[1])], values[:, int(b[1])]
        both = np.isfinite(u) & np.isfinite(w)
        rank = lambda z: np.array([(z < v).sum() + ((z == v).sum() + 1) / 2 for v in z])
        assert n == both.sum() == parts[a, b][0] and x == pytest.approx(np.corrcoef(rank(u[both]), rank(w[both]))[0, 1]) and x == pytest.approx(parts[a, b][1])


def plain_average_linkage(names, d, count):
    groups = [(n,) for n in sorted(names)]
    at = {n: i for i, n in enumerate(names)}
    mean = lambda g, h: np.mean([d[at[a], at[b]] for a in g for b in h])
    while len(groups) > count:
        g, h = min(((min(g, h), max(g, h)) for i, g in enumerate(groups) for h in groups[i + 1 :]), key=lambda x: (round(mean(*x), 12), *x))
        groups = [x for x in groups if x not in (g, h)] + [tuple(sorted(g + h))]
    return {n: f"cluster_{i:02d}" for i, g in enumerate(sorted(groups), 1) for n in g}


def test_average_linkage_matches_plain_version():
    rng = np.random.default_rng(3)
    for trial in range(20):
        n = int(rng.integers(4, 12))
        x = rng.integers(0, 5, (n, 2)).astype(float)  # many ties
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).round(6)
        names = [f"n{k}" for k in rng.permutation(n)]
        if trial % 2:
            d = np.abs(rng.standard_normal((n, n)))
            d = (d + d.T) / 2
            np.fill_diagonal(d, 0)
        found, merges = cluster.average_linkage(names, d, 3)
        assert len(merges) == n - 3
        if trial % 2:
            assert dict(zip(names, found)) == plain_average_linkage(names, d, 3)
    equal = np.ones((4, 4)) - np.eye(4)
    assert cluster.average_linkage(list("dcba"), equal, 2)[1][:2] == [(1.0, ["a"], ["b"]), (1.0, ["a", "b"], ["c"])]
    for bad in (equal[:3], equal - 2, np.triu(equal), equal * np.nan):
        with pytest.raises(ValueError):
            cluster.average_linkage(list("abcd"), bad, 2)


def test_k_means_seeding_contract():
    same = np.zeros((5, 2))
    rng = np.random.default_rng(0)
    state = rng.bit_generator.state
    first = int(rng.integers(0, 5))
    rng.bit_generator.state = state

    class Counting:
        draws = 0

        def integers(self, *a):
            return rng.integers(*a)

        def random(self):
            Counting.draws += 1
            return rng.random()

    rows = np.arange(5)[:, None] * 0.0
    cluster.spread_starts(rows, 3, Counting())
    assert Counting.draws == 0 and 0 <= first < 5  # equal rows are taken in order without a draw
    labels, inertia = cluster.k_means(np.r_[same, same + 9], 2, (1, 2, 3), starts=5)
    assert inertia == 0 and labels[:5].tolist() == [labels[0]] * 5 and labels[5] != labels[0]
    labels, _ = cluster.k_means(np.array([[0.0], [0.0], [0.0], [1.0]]), 3, (1,), starts=3)
    assert len(set(labels.tolist())) == 3  # an empty cluster is filled
    for bad in ((np.ones((3, 2)), 3), (np.full((5, 2), np.nan), 2), (np.ones((5, 2)), 1)):
        with pytest.raises(ValueError):
            cluster.k_means(*bad, (1,))
    with pytest.raises(ValueError):
        cluster.validated_correlation(np.array([[1.0, 2.0], [2.0, 1.0]]))


def test_array_digest():
    assert gr.array_sha256(np.arange(4.0).reshape(2, 2)) == gr.array_sha256(np.asfortranarray(np.arange(4.0).reshape(2, 2))) != gr.array_sha256(np.arange(4.0).reshape(2, 2).T)
