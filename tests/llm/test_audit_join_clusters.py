"""Divergence audit, n-gram join and centroid clustering against plain versions, on odd rows and at their limits."""

import hashlib
import itertools
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import centroids, divergence, ngrams

DOCS = "doc_id long, text string, lang string, source string, n int, i int, cell string, value string, p string"
EXTRA = (1, 2, "c", "v", "p")


def _docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


# divergence audit


def _audit(rows, documents, reported):
    rows = [((t or ""), (la or ""), (s or "")) for _, t, la, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for t, _, _ in rows]
    out = []
    for lang in {la for _, la, _ in rows}:
        spread = Counter(w for own, (_, la, _) in zip(words, rows) if la == lang for w in set(own))
        kept = [w for w, n in spread.items() if n >= documents]
        count = {s: Counter() for _, la, s in rows if la == lang}
        for own, (_, la, s) in zip(words, rows):
            if la == lang:
                count[s].update(w for w in own if w in set(kept))
        whole = sum(count.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in count if o != s]
            above = [(q[w] - p[s][w], w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:reported])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


WORDS = ["Alpha", "beta", "ÄÖ", "γάμμα", "x1y", "delta-eps", "日本", "don't", "ZETA", "É", "ü_ü", "lone"]


def _corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        own = rng.choice(WORDS, rng.integers(0, 12), p=np.arange(len(WORDS), 0, -1) / sum(range(len(WORDS) + 1)))
        rows.append((k, " ".join(own), str(rng.choice(["a", "b"])), f"s{rng.integers(0, 5)}"))
    return rows + [(None, None, None, None), (1, "", "a", ""), (2, "!!! 123", "c", "only"), (2, "!!! 123", "c", "only"), (3, None, "c", "other"), (5, "beta " * 40000, "a", "long"), (6, "beta\x00beta﻿", "a", None)]


@pytest.mark.parametrize(("documents", "reported", "posting"), [(3, 4, 64), (30, 50, 2), (10**6, 50, 64)])
def test_audit_is_the_plain_one(spark, monkeypatch, documents, reported, posting):
    """Also where postings are cut into blocks and where no term is kept."""
    monkeypatch.setattr(divergence, "POSTINGS", posting)
    rows = _corpus(150)
    found = divergence.audit(_docs(spark, rows), documents, reported).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found) == _audit(rows, documents, reported)


def test_audit_sends_on_what_a_task_cannot_hold(spark, monkeypatch):
    rows = _corpus(60, 5)
    monkeypatch.setattr(divergence, "HELD", 2)
    counted = {(r.lang, r.source, r.term): (r.n, r.docs) for r in divergence.occurrences(_docs(spark, rows)).collect()}
    n, d = Counter(), Counter()
    for _, t, la, s in rows:
        own = [x.decode() for x in divergence.terms((t or "").encode())]
        n.update((la or "", s or "", x) for x in own)
        d.update((la or "", s or "", x) for x in set(own))
    assert counted == {k: (n[k], d[k]) for k in n}


def test_audit_of_nothing(spark):
    assert divergence.audit(_docs(spark, [])).collect() == []


# n-gram join


def _plain_tokens(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def _plain_join(rows):
    sets, parent = [_plain_tokens(t) for _, t, *_ in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[top(i)] = top(j)
    lowest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            lowest[top(i)] = min(r[0], lowest.get(top(i), r[0]))
    return sorted(((r[0], len(s), lowest.get(top(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def _copies(rng, words, groups, size, changes):
    """Groups of texts, each text with some words of its group's text exchanged."""
    out = []
    for _ in range(groups):
        base = rng.choice(words, size)
        for _ in range(12):
            own = base.copy()
            at = rng.choice(size, rng.integers(0, changes + 1), replace=False)
            own[at] = rng.choice(words, len(at))
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("rare", "near", "chunk"), [(64, (2, 32), 1024), (0, (), 4), (3, (1,), 4)])
def test_join_is_the_plain_one(spark, rare, near, chunk):
    """Single tokens or combinations, neighbours only or chunks only: the same components."""
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(3000)])
    passage = " ".join(rng.choice(words, 60))
    texts = [x for size, changes in ((6, 1), (9, 1), (30, 2), (150, 6)) for x in _copies(rng, words, 3, size, changes)]
    texts += [f"{passage} {' '.join(rng.choice(words, k))}" for k in (3, 4, 8, 12, 15, 15, 16, 40, 200)]
    rows = [(k, t, "l", "s") for k, t in enumerate(texts)]
    rows += [(None, texts[0], "l", "s"), (None, "alone in the world", "l", "s"), (900, None, "l", "s"), (901, "", "l", "s"), (902, " \t\n", "l", "s"), (903, "One two", "l", "s"), (904, "one\x0btwo", "l", "s")]
    rows += [(5, texts[5], "l", "s"), (905, "Ä b c d e", "l", "s"), (906, "ä b c d e", "l", "s"), (907, " ".join(rng.choice(words, 30000)), "l", "s")]
    found = ngrams.similar(_docs(spark, rows), rare=rare, near=near, chunk=chunk).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == _plain_join(rows)


def test_join_of_nothing(spark):
    assert ngrams.similar(_docs(spark, [])).collect() == []
    assert ngrams.similar(_docs(spark, [(1, None, "l", "s")])).collect()[0][1:] == (0, 1)


def test_every_similar_pair_meets_in_a_cell_that_lets_it_pass():
    """Random sets at the edge of similarity, with all, some or no tokens rare."""
    rng, known = np.random.default_rng(7), 0
    for trial in range(400):
        n, m = int(rng.integers(4, 300)), 0
        m = int(rng.integers(-(-n * 4 // 5), n * 5 // 4 + 1))
        shared = -(-4 * (n + m) // 9)
        if shared > min(n, m):
            continue
        every = rng.permutation(n + m - shared).astype(np.uint64)
        spread = np.sort(rng.integers(1, 200, len(every)))[rng.permutation(len(every))]
        rare = int(rng.choice([0, 2, 60, 150, 500]))
        members = []
        for own in (every[:n], every[n - shared :]):
            held = spread[own.astype(int)] > 1
            held |= np.isin(own, every[n - shared : n])  # shared tokens are in two sets at least
            own, its = own[held], np.maximum(spread[own.astype(int)][held], 2)
            order = np.lexsort((own, its))
            cells, before, left = ngrams.signatures(n if not members else m, its[order], own[order], rare=rare)
            members.append({int(c): (b, x) for c, b, x in zip(cells, before, left)})
        met = members[0].keys() & members[1].keys()
        ok = [ngrams.possible(n, *members[0][c], m, *members[1][c]) for c in met]
        assert any(ok), (n, m, shared, rare)
        known += 1
    assert known > 300


def test_form_letters_just_below_do_not_meet(spark):
    """20,000 letters of 100 common words and 13 of their own (similarity 0.79) give no pair to verify, and 4,000 take not much less
    time."""
    rng = np.random.default_rng(2)
    common, took = " ".join(f"c{i}" for i in range(100)), []
    for n in (4000, 20000):
        own = rng.integers(0, 10**9, (n, 13))
        rows = [(k, f"{common} {' '.join(f'o{x}' for x in own[k])}", "l", "s") for k in range(n)]
        began = time.monotonic()
        found = ngrams.similar(_docs(spark, rows)).select("doc_id", "component_id").where("doc_id <> component_id").count()
        took.append(time.monotonic() - began)
        assert found == 0
    assert took[1] < 10 * took[0]


def test_sets_without_partners_are_left_out(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"u{x}" for x in rng.integers(0, 10**9, 50)) for _ in range(40)]
    docs = _docs(spark, [(k, t, "l", "s") for k, t in enumerate([*texts, texts[0] + " more", texts[1]])])
    some = ngrams.candidates(ngrams._texts(docs), ngrams._sets(ngrams._texts(docs), 5), 5, 80)
    assert sorted(r.text.decode() for r in some.select("text").collect()) == sorted([texts[0], texts[0] + " more"])


# centroid clustering


def _clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, _, v in sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v.tolist(), v) for i, v in kept), key=lambda x: x[:2])][:k]
    near = lambda v: min((int(((v - z) ** 2).sum()), j) for j, z in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        c = [np.array([int(x) // of.count(j) for x in sum(v for (_, v), z in zip(kept, of) if z == j)]) if j in of else z for j, z in enumerate(c)]
    last = [(i, near(v)) for i, v in kept]
    own = Counter()
    for _, (d, j) in last:
        own[j] += d
    return sorted((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(str(int(x)) for x in c[j]).encode()).hexdigest()) for i, (d, j) in last)


VECTORS = "vec_id long, embedding array<double>, cluster string, distance string"


def test_clusters_are_the_plain_ones(spark, monkeypatch):
    """Clumps, which prune, and noise, which does not; small trees; ties; odd rows."""
    rng = np.random.default_rng(9)
    middles = rng.standard_normal((6, 64))
    rows = [(k, (middles[k % 6] + rng.standard_normal(64) * (0.02 if k % 3 else 1)).tolist()) for k in range(700)]
    rows += [(k, rows[0][1]) for k in range(700, 800)] + [(3, rows[3][1]), (3, rows[4][1])]
    odd = [(None, rows[0][1]), (900, None), (901, [1.0]), (902, [None] * 64), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [0.0] * 64), (906, [])]
    monkeypatch.setattr(centroids, "BLOCK", 256)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows + odd], VECTORS)
    found = centroids.clusters(docs).collect()
    assert sorted(map(tuple, found)) == _clusters(rows + odd)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(k, [float(k)] * 64) for k in range(5)]
    assert sorted(map(tuple, centroids.clusters(spark.createDataFrame([(*r, "", "") for r in rows], VECTORS)).collect())) == _clusters(rows)
    assert centroids.clusters(spark.createDataFrame([], VECTORS)).collect() == []


def test_huge_components_fit(spark):
    rows = [(k, [1e308 * (k % 3 - 1)] * 64, "", "") for k in range(30)]
    found = {r.vec_id: r for r in centroids.clusters(spark.createDataFrame(rows, VECTORS), k=1).collect()}
    assert all(r.distance >= 0 for r in found.values()) and found[0].inertia is None


def test_nodes_are_pruned_and_assigned_whole():
    """On clumps most vectors are never compared one by one; a node's centroids only go if they are strictly farther everywhere."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-500, 500, (8, 64))
    points = (middles[rng.integers(0, 8, 4000)] + rng.integers(-5, 6, (4000, 64))).astype(np.int64)
    tree = centroids.build(np.arange(4000), points)
    whole, owners, places, nearest = centroids.walk(tree, middles.astype(np.int64))
    assert (tree.span[whole, 1] - tree.span[whole, 0]).sum() + len(places) == 4000 and len(places) < 400
    truth = ((points[tree.ids][:, None] - middles) ** 2).sum(axis=2).argmin(axis=1)
    for (start, end), owner in zip(tree.span[whole, :2], owners):
        assert (truth[start:end] == owner).all()
    assert (truth[places] == nearest).all()
    same = np.zeros((1, 3, 2), np.int64)
    assert not centroids.dominated(same[0, :1], same[0, :1], np.ones((1, 2), bool), np.array([[1, 0], [0, 1]])).any()


def test_join_looks_only_at_texts_that_may_be_candidates(spark):
    texts = spark.range(-3000, 3000).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("mark"))
    chosen = texts.where("doc_id % 10 = 0 OR doc_id IS NULL").select("doc_id", "mark")
    found = {tuple(r) for r in ngrams._maybe(texts, chosen).collect()}
    own = {tuple(r) for r in chosen.collect()}
    assert own <= found and len(found) < len(own) + 30 and ngrams._maybe(texts, chosen.limit(0)).count() == 0


def test_join_cells_of_one_component_and_few_others_grow_with_their_rows(spark):
    """A large component's members are sent once to what is not of it, and every possible pair of different roots is found."""
    draw = np.random.default_rng(8)
    rows = [(cell, int(100 * cell + i) * 7 % 100_003, int(draw.integers(80, 110)), int(draw.integers(0, 60)), int(draw.integers(40, 80))) for cell, size in ((1, 400), (2, 90), (3, 3)) for i in range(size)]
    rows = [(*r, 0 if r[0] == 1 and i > 5 or r[0] == 2 and i % 2 else r[1]) for i, r in enumerate(rows)]
    known = spark.createDataFrame(rows, "cell long, node long, n long, before long, left long, root long")
    last = known.groupBy("cell").agg(F.min("root").alias("lowest"))
    assert ngrams._dealt(known.where("cell = 1"), last, 80, 10).count() <= 400 + 6 * 41
    found = [tuple(sorted((r.u, r.v))) for r in ngrams._chunk_pairs(known, last, 80, 10).collect()]
    plain = set()
    for i, (cell, u, n, b, left, root) in enumerate(rows):
        for other, v, m, c, right, its in rows[:i]:
            if cell == other and root != its and 180 * min(min(b, c) + 1 + min(left, right), n, m) >= 80 * (n + m):
                plain.add(tuple(sorted((u, v))))
    assert set(found) == plain and len(plain) > 100


def test_join_drops_cells_after_which_too_little_is_left():
    own, often = np.arange(1, 101, dtype=np.uint64), np.full(100, 1000)
    n = np.int64(100)
    cells, before, left = ngrams.signatures(int(n), often, own)
    assert len(cells) and (180 * (before + 1 + left) >= 80 * 180).all()
    assert not len(ngrams.signatures(100, often[:79], own[:79])[0])


def test_sketches_show_only_pairs_that_are_not_similar():
    """Bits in which two sketches differ are at most the tokens that one set alone has, also where one sketch is twice as long."""
    rng, out = np.random.default_rng(12), 0
    for _ in range(400):
        n, m = int(rng.integers(2, 1500)), 0
        m = int(rng.integers(-(-n * 4 // 5), n * 5 // 4 + 1))
        least = -(-80 * (n + m) // 180)
        shared = min(least if rng.random() < 0.5 else int(least * rng.uniform(0.5, 1)), n, m)
        every = rng.integers(0, 1 << 63, n + m - shared).astype(np.uint64)
        marks = ngrams._Sketches(np.array([ngrams.sketch(every[:n]), ngrams.sketch(every[n - shared :])], object))
        fit = marks.fit(np.array([0]), np.array([1]), np.array([n, m]), 80)[0]
        assert fit or shared < least, (n, m, shared)
        out += not fit
    assert out > 60


def test_cells_propose_no_pairs_that_sketches_rule_out(spark):
    """200 texts, three fifths of which are one passage, are in each other's cells and may be similar by size and place, but by no sketch."""
    rng = np.random.default_rng(13)
    passage, rows = rng.integers(0, 1 << 63, 180).astype(np.uint64), []
    for node in range(200):
        own = np.r_[passage, rng.integers(0, 1 << 63, 120).astype(np.uint64)]
        rows += [(cell, place, node, 300, 0, 299, node, ngrams.sketch(own)) for cell in range(20) for place in [node]]
    known = spark.createDataFrame(rows, "cell long, place long, node long, n long, before long, left long, root long, sketch binary")
    last = known.groupBy("cell").agg(F.min("root").alias("lowest"))
    assert ngrams._neighbours(known.drop("sketch"), 2, 32, 80).count() > 5000
    assert ngrams._neighbours(known, 2, 32, 80).count() < 20 and ngrams._chunk_pairs(known, last, 80, 64).count() < 200


def test_join_packs_only_low_tokens(spark):
    rng = np.random.default_rng(14)
    texts = ngrams._texts(_docs(spark, [(k, " ".join(f"u{x}" for x in rng.integers(0, 10**9, 300)), "l", "s") for k in range(20)]))
    packed = sum(len(r.who) // 2 for r in ngrams._packed(texts, 5, 4).collect())
    sets = ngrams._sets(texts, 5).agg(F.sum("low"), F.sum("n")).first()
    assert packed == sets[0] < 0.6 * sets[1]


def test_one_of_a_pairs_cells_proposes_it(spark):
    """60 sets in nearly all of 150 cells that lie in many tasks: a round sends far fewer rows, and no pair of it is lost."""
    rng, rows = np.random.default_rng(15), []
    cells = np.sort(rng.integers(0, 1 << 64, 150, np.uint64))  # half of them are negative as long
    sizes = np.sort(rng.integers(95, 106, 60))
    seen = np.zeros(60, int)
    for cell in cells:
        own = np.flatnonzero(rng.random(60) < 0.9)
        for place, node in enumerate(own):
            n, before, left = int(sizes[node]), int(rng.integers(0, 10)), int(rng.integers(80, 100))
            rows.append((int(cell.view(np.int64)), place, int(node), n, before, left, bool(seen[node] < 4)))
        seen[own] += 1
    members = spark.createDataFrame(rows, "cell long, place long, node long, n long, before long, left long, anchor boolean")
    texts = spark.createDataFrame([(k, int(n), b"the same words in every text") for k, n in enumerate(sizes)] + [(60, 1, b"in no cell")], "node long, n long, text binary")
    marks = ngrams._marks(texts, members, 5)
    assert {r.node: len(r.firsts) for r in marks.collect()} == {**dict.fromkeys(range(60), 16), 60: 0}
    known = members.drop("anchor").withColumn("root", F.col("node")).join(marks, "node")
    last = known.groupBy("cell").agg(F.min("root").alias("lowest"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("40", "false")):
            spark.conf.set(k, v)
        for made in (lambda x: ngrams._neighbours(x, 0, 2, 80), lambda x: ngrams._neighbours(x, 2, 32, 80), lambda x: ngrams._chunk_pairs(x, last, 80, 16)):
            sent, plain = ([(r.u, r.v) for r in made(x).collect()] for x in (known, known.drop("firsts")))
            assert set(sent) == set(plain) and len(set(sent)) > 100
            assert 2 * len(sent) < len(plain)
        assert 5 * len(sent) < len(plain)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
