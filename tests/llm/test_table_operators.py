"""Operators on vectors and on whole tables against plain versions and their laws."""

import math

import numpy as np
import pytest

from riskloom.llm import ann, mixing, packing, sharding, topk

ODD = "doc_id long, text string, source string, size int, copies string, row int"
ROWS = [(1, None, None, 1, "x", 2), (2, "", None, 1, "x", 2), (3, "a b c", "x", 1, "x", 2), (3, "a b c", "x", 1, "x", 2), (4, "a b c", "x", 1, "x", 2), (None, "d", "y", 1, "x", 2), (6, "w " * 5000, "y", 1, "x", 2)]
VECTORS = [(0, None), (20, [1.0, None]), (40, [1.0, float("nan")]), (60, [0.0, 0.0]), (80, [1.0, 0.5]), (80, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [2.0]), (None, [1.0, 1.0])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


@pytest.fixture(scope="module")
def vectors(spark, small):
    return spark.read.parquet(f"{small}/embeddings.parquet")


def _arrays(vectors):
    e = vectors.toPandas().sort_values("vec_id")
    return e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)


def _nearest(ids, scores, own, k=20):
    other = ids != own
    order = np.lexsort((ids[other], -scores[other]))[:k]
    return list(zip(ids[other][order].tolist(), scores[other][order].tolist()))


def test_top_k_matches_brute_force(vectors):
    ids, rows = _arrays(vectors)
    whole = np.floor(64 * rows).astype(np.int64)
    found = topk.top_k(vectors, block=100).toPandas()
    for q in ids[ids % 20 == 0]:
        own = found[found.query_id == q].sort_values("rank")
        assert list(zip(own.vec_id, own.score)) == _nearest(ids, whole @ whole[ids == q][0], q)


def test_top_k_stops_early_and_stays_exact():
    rng = np.random.default_rng(5)
    values = np.floor(rng.standard_normal((2000, 4)) * np.array([100, 3, 2, 1]))
    ids = np.arange(2000)
    queries = np.array([[60.0, 1.0, 0.0, 0.0], [-50.0, 2.0, 1.0, 1.0]])
    for (q, got, scores, read), query in zip(sorted(topk.search(topk.SortedLists(ids, values), np.array([5, 7]), queries), key=lambda x: x[0]), queries):
        assert list(zip(got.tolist(), scores.tolist())) == _nearest(ids, (values @ query).astype(np.int64), q) and read < 1


def test_top_k_stops_before_the_lists_end_on_embeddings(spark):
    """Every query of the table stops on its bounds; a floor from another block lets it stop sooner."""
    ids, rows = _arrays(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    whole, asked = np.floor(64 * rows), ids % 20 == 0
    floors = {}
    first = list(topk.search(topk.SortedLists(ids[:1000], whole[:1000]), ids[asked], whole[asked], 20, floors))
    second = list(topk.search(topk.SortedLists(ids[1000:], whole[1000:]), ids[asked], whole[asked], 20, floors))
    assert len(first) == len(second) == asked.sum() and max(x[3] for x in first + second) < 1
    assert np.mean([x[3] for x in second]) < np.mean([x[3] for x in first])
    for q, row in zip(ids[asked], whole[asked]):
        both = [(s, i) for x in first + second if x[0] == q for i, s in zip(x[1].tolist(), x[2].tolist())]
        assert [(i, s) for s, i in sorted(both, key=lambda x: (-x[0], x[1]))[:20]] == _nearest(ids, (whole @ row).astype(np.int64), q)


def test_top_k_reads_ties_to_the_end():
    ids, values = np.arange(300), np.ones((300, 3))
    (q, got, scores, read), = topk.search(topk.SortedLists(ids, values), np.array([4]), np.ones((1, 3)))
    assert got.tolist() == [x for x in range(21) if x != 4] and set(scores.tolist()) == {3}


def test_neighbours_reach_recall(vectors):
    ids, rows = _arrays(vectors)
    found = ann.neighbours(vectors).toPandas()
    recall = []
    for q in ids[ids % 20 == 0]:
        own = found[found.query_id == q].sort_values("rank")
        truth = _nearest(ids, rows @ rows[ids == q][0], q)
        recall.append(len(set(own.vec_id) & {x for x, _ in truth}) / len(truth))
        exact = [math.fsum(rows[ids == x][0] * rows[ids == q][0]) for x in own.vec_id]
        assert own.score.tolist() == exact and own["rank"].tolist() == list(range(1, len(own) + 1))
    assert np.mean(recall) >= 0.9


def test_neighbours_reach_recall_beyond_the_sample(spark):
    """The sample holds a tenth of the rows, and the tree has many more leaves than a query visits."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, rows = _arrays(vectors)
    found = ann.neighbours(vectors, bound=400).toPandas()
    recall = [len(set(found[found.query_id == q].vec_id) & {x for x, _ in _nearest(ids, rows @ rows[ids == q][0], q)}) / 20 for q in ids[ids % 20 == 0]]
    assert np.mean(recall) >= 0.9
    tree = ann.fit(ann.usable(vectors, zero=True), len(ids))[64][0]
    assert tree.leaves >= 16 and tree.visits < tree.leaves


def test_neighbours_of_every_length(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(3 if i % 3 else 5)]) for i in range(200)]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, bound=50).collect()
    asked = {r.query_id for r in found}
    assert asked == set(range(0, 200, 20)) and all(len(rows[r.query_id][1]) == len(rows[r.vec_id][1]) for r in found)


def test_searches_of_odd_rows(spark):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(rows).collect()}
    assert {x for x in found if x[0] == 80} == {(80, 1, 1, 5120), (80, 2, 2, 5120), (80, 3, 60, 0)}
    near = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(rows).orderBy("rank").collect()]
    assert near == [(80, 1, 1, 1.25), (80, 2, 2, 1.25)]
    assert topk.top_k(rows.limit(0)).count() == ann.neighbours(rows.limit(0)).count() == 0


def plain_targets(sizes, most=3):
    """sizes: in source order."""
    total, weights = float(sum(sizes)), [(1.0, 2.0, 3.0)[i % 3] for i in range(len(sizes))]
    fixed = {}
    while True:
        left, free = total - sum(fixed.values()), [i for i in range(len(sizes)) if i not in fixed]
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free} if free else {}
        over = [i for i in free if share[i] > most * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: float(most * sizes[i]) for i in over}


def test_targets_match_plain_version(spark):
    sizes = [5, 400, 30, 0, 77, 1000, 3]
    rows = spark.createDataFrame([(f"s{i}" if i < 6 else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    for i, expected in enumerate(plain_targets(sizes)):
        assert found[f"s{i}" if i < 6 else None] == pytest.approx(expected)


def test_mix_comes_near_its_targets(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    found, again = (mixing.allocation(documents).toPandas().sort_values("doc_id") for _ in range(2))
    assert (found.copies.to_numpy() == again.copies.to_numpy()).all() and found.copies.between(0, 3).all()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in documents.collect()}
    assert (found["size"] == found.doc_id.map(words)).all()
    for _, own in found.groupby("source"):
        assert own.source_size.eq(own["size"].sum()).all()
        assert abs((own["size"] * own.copies).sum() - own.target.iloc[0]) <= own["size"].max()


def test_mix_takes_the_smallest_pareto_ratios(spark, small):
    """Against a plain version: each stratum's places go to the smallest ratios of random odds to inclusion odds."""
    documents = spark.read.parquet(f"{small}/documents.parquet")
    measured = mixing._measured(documents, 4, ["doc_id"])
    rows = measured.select("id", "name", "stratum", "size", "draw").collect()
    strata = {(r.name, r.stratum): r for r in mixing._strata(measured.drop("row"), 3, mixing.WEIGHTS, 4).collect()}
    copies = {r.doc_id: r.copies for r in mixing.allocation(documents).collect()}
    some = 0
    for (name, stratum), state in strata.items():
        own = [r for r in rows if (r.name, r.stratum) == (name, stratum)]
        assert state.documents == len(own) and state.words == sum(r.size for r in own)
        usual = sum(r.size**2 for r in own) / max(1, state.words)

        def ratio(r):
            chance = min(state.fraction * r.size / usual, 1 - 1e-9)
            return r.draw / (1 - r.draw) / (chance / (1 - chance))

        drawn = [r.id for r in own if copies[r.id] > state.copies]
        if stratum >= 0:
            assert set(drawn) == {r.id for r in sorted(own, key=ratio)[: state.places]}
            some += 0 < state.places < len(own)
        else:
            assert all(copies[r.id] == 0 for r in own)
    assert some > 5


def test_mix_draws_in_proportion_to_size(spark):
    """4,000 documents of one stratum, of 92 or 106 words, and one source that takes a part of them."""
    rows = [(i, "w " * (92 if i % 2 else 106), "a") for i in range(4000)] + [(10**6 + i, "w " * 200, "b") for i in range(800)]
    found = mixing.allocation(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0,)).collect()
    share = [np.mean([r.copies for r in found if r.source == "a" and r["size"] == n]) for n in (92, 106)]
    one = next(r for r in found if r.source == "a")
    assert 0 < one.target < one.source_size and abs(sum(r.copies * r["size"] for r in found if r.source == "a") - one.target) < 0.01 * one.target
    assert abs(share[1] / share[0] - 106 / 92) < 0.06


def test_mix_of_odd_rows(odd):
    found = mixing.mixed(odd)
    assert found.count() == len(ROWS) and all(r.copies <= 3 for r in found.collect())
    assert mixing.repeated(odd).columns == odd.columns
    assert mixing.mixed(odd.limit(0)).count() == mixing.repeated(odd.limit(0)).count() == 0


def test_shards_are_balanced_and_whole(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    found = sharding.balanced_shards(documents).toPandas().merge(documents.select("doc_id", "text").toPandas(), on="doc_id")
    assert (found["size"] == found.text.map(lambda t: len(t.encode()) + 1)).all()
    assert (found.groupby("text").shard.nunique() == 1).all()
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sums, largest = found.groupby("shard")["size"].sum(), found.groupby("text")["size"].sum().max()
    assert sums.max() <= max(found["size"].sum() / 16 * 1.02, largest) + 1


def test_differencing_beats_a_known_case():
    parts = sharding.difference([[(x, x)] for x in (8, 7, 6, 5, 4)], 2)
    assert sorted(map(sum, parts)) == [14, 16]
    assert sharding.difference([], 3) == [[], [], []]


def test_shards_of_odd_rows(odd):
    found = sharding.balanced_shards(odd, 3).collect()
    assert len(found) == len(ROWS) and len({r.shard for r in found if r.doc_id in (3, 4)}) == 1
    assert sharding.balanced_shards(odd.limit(0)).count() == 0


def plain_best_fit(items, capacity):
    bins, placed = [], {}
    for i in sorted(range(len(items)), key=lambda x: (-items[x][0], x)):
        size, source, cluster = items[i]
        fits = [b for b, (left, s, c) in enumerate(bins) if left >= size and source not in s and (cluster < 0 or cluster not in c)]
        if not fits:
            bins.append((capacity, set(), set()))
            fits = [len(bins) - 1]
        b = min(fits, key=lambda b: (bins[b][0], b))
        left, s, c = bins[b]
        placed[i] = (b, capacity - left)
        bins[b] = (left - size, s | {source}, c | {cluster})
    return [placed[i] for i in range(len(items))]


def test_packing_matches_plain_best_fit():
    rng = np.random.default_rng(6)
    items = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(1, 100, 400), rng.integers(0, 9, 400), rng.integers(-1, 30, 400))]
    assert packing.pack_group(items, 100) == plain_best_fit(items, 100)


def test_packing_laws(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    found = packing.packed(documents, capacity=512, group=64).toPandas()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in documents.collect()}
    assert found.groupby("doc_id").words.sum().to_dict() == words
    bins = found[found.bin.notna()]
    assert bins.groupby("bin").words.sum().max() <= 512
    assert not bins.duplicated(["bin", "source"]).any() and not bins.duplicated(["bin", "cluster"]).any()
    for _, own in bins.groupby("bin"):
        own = own.sort_values("bin_offset")
        assert own.bin_offset.tolist() == [0, *own.words.cumsum().tolist()[:-1]]


def test_packing_of_odd_rows(odd):
    found = packing.packed(odd, capacity=2).toPandas()
    assert set(found[found.bin.isna()].doc_id) == {1, 2} and found.words.max() == 2
    assert packing.packed(odd.limit(0)).count() == 0
