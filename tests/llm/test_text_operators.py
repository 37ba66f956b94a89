"""Operators on texts against plain versions, held-out accuracy, and odd rows."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import langid, pii, quality, simhash, toxicity
from riskloom.llm.components import star_components

ODD = "doc_id long, text string, lang string, source string, size int, features string, toxicity string"
ROWS = [
    (1, None, "en", None, 1, "x", "y"),
    (2, "", "fr", "a", 1, "x", "y"),
    (3, " \t\n ", None, "a", 1, "x", "y"),
    (4, "123 !!", "en", "a", 1, "x", "y"),
    (5, "the cat sat on the mat with a hat", "en", "a", 1, "x", "y"),
    (5, "the cat sat on the mat with a hat", "en", "a", 1, "x", "y"),
    (None, "le chat est sur la table", "fr", "b", 1, "x", "y"),
    (7, "ab " * 30000, "en", "b", 1, "x", "y"),
    (8, "x" * 50000, None, "b", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


def reachable(ids, prints, threshold):
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(i)
    return {i: min(ids[k] for k in own) for own in groups.values() for i in own}


@pytest.mark.parametrize("threshold,parts", [(3, None), (6, 4)])
def test_simhash_components_match_brute_force(documents, threshold, parts):
    found = simhash.near_duplicates(documents, threshold, 3, parts).orderBy("doc_id").collect()
    ids, prints = [r.doc_id for r in found], [int(r.fingerprint, 16) for r in found]
    expected = reachable(ids, prints, threshold)
    assert [r.component_id for r in found] == [expected[i] for i in range(len(ids))]


def test_fingerprint_by_definition():
    import xxhash

    text = "The Cat\tsat ON the mat  the cat sat"
    words = text.lower().split()
    counts = [0] * 64
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    assert int.from_bytes(simhash.fingerprint(text)) == sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == bytes(8)


def test_thresholds_spend_the_whole_budget():
    rng = np.random.default_rng(1)
    costs = [np.sort(rng.random((4, 50)), axis=0) for _ in range(4)]
    chosen = simhash.allocate(costs, 0)
    assert (chosen.sum(axis=0) == 0).all()
    best = min(
        (sum(costs[i][t + 1][0] for i, t in enumerate(ts)) for ts in np.ndindex(4, 4, 4, 4) for ts in [tuple(x - 1 for x in ts)] if sum(ts) == 0)
    )
    assert abs(sum(costs[i][chosen[i, 0] + 1][0] for i in range(4)) - best) < 1e-9


def test_simhash_hot_bucket_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    prints = [int(x) for x in (np.int64(0x1234567890ABCDEF) ^ (np.int64(1) << rng.integers(0, 62, 300)) ^ (np.int64(1) << rng.integers(0, 62, 300)))]
    distinct = spark.createDataFrame([(p,) for p in sorted(set(prints))], "fp long")
    parts = simhash.plan_parts(distinct, distinct.count())
    edges = simhash.verified_links(simhash.meetings(distinct, parts, 3, chunk=16), 3)
    roots = {r.node: r.root for r in star_components(edges).collect()}
    ids = sorted(set(prints))
    expected = reachable(list(range(len(ids))), [x & (2**64 - 1) for x in ids], 3)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(roots.get(x, x), set()).add(expected[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


def test_simhash_odd_rows(spark, odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ROWS) and {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.keep_one(odd.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    roots = {r.node: r.root for r in star_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert {roots[i] for i in range(41)} == {0} and {roots[i] for i in range(100, 130)} == {100}
    assert star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_state_of_edges_cannot_overflow(spark):
    from riskloom.llm.components import _state

    edges = spark.range(200_000).selectExpr("id as u", "id * 7 as v")
    plan = edges.agg(F.bit_xor(F.xxhash64("u", "v")))._jdf.queryExecution().toString()
    assert "sum" not in plan.lower()  # a sum of hashes overflows from some 16 million edges on
    assert _state(edges)[0] == 200_000 and _state(edges) == _state(edges.repartition(5)) != _state(edges.withColumn("v", F.col("v") + 1))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0
            holds = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}
            if holds[kind]:
                out.append((m.start(), k, m.end(), kind))
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))
    return [sum(o[1] == k for o in out) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest(), joined


TRICKY = [
    "a@b.com_x@y.org, a@b@c.com x@y. z@w..de mail é漢 me+x@do-main.co.uk.",
    "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3 12.34.56.78. 256.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 5 " + "7" * 400,
    "+1 (499) 555-6503 + 1 +49 30 123456789012345 +1234567890. +1 2",
    "x" * 3000 + "@",
    "a." * 600 + "a@b." + "c." * 600 + "c",
    " ".join(f"4111111111111111 a{i}@b.de" for i in range(200)),
]


def test_pii_base_spans_match_plain_version(spark, documents):
    rows = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate([*TRICKY, None, ""], 10**6)), "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in rows.collect()}
    found = pii.personal_data(rows).collect()
    assert len(found) == len(texts)
    for r in found:
        counts, digest, joined = plain_pii(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == digest, r.doc_id
        assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}


def test_pii_stays_native(documents):
    for made in (pii.proposals(documents), pii.personal_data(documents), pii.redacted(documents)):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pii_leaves_other_columns_whatever_their_names(spark):
    """No name of the caller's meets those made on the way, and none brings the text back."""
    names = ["row", "spans", "every", "stop", "near", "reached", "coming", "base", "match0", "piece0", "step0", "end0", "stop_n", "_text", "_spans", "a.b", "back`tick"]
    typed = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = spark.createDataFrame([(1, "mail a@b.org now", *names), (2, None, *names)], f"doc_id long, text string, {typed}")
    found = pii.redacted(rows)
    assert found.columns == rows.columns
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == [(1, "mail <EMAIL> now", *names), (2, None, *names)]
    assert [r.spans for r in pii.personal_data(rows).orderBy("doc_id").collect()] == ["email:5:12", ""]


def test_pii_takes_texts_of_many_spans(spark):
    """20,000 spans in one text, which overlap in part: linear-time merging, and the plain version's marks."""
    text = " ".join(f"a{i}@b.org 4111111111111111 +1 499 555 65{i % 90 + 10}" for i in range(7000))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    found, clean = pii.personal_data(rows).first(), pii.redacted(rows).first().text
    assert found.n_email == 7000 and found.n_card == 7000 and found.n_phone == 7000 and time.monotonic() - began < 120
    assert clean.count("<EMAIL>") == 7000 and "@" not in clean and "4111" not in clean


def test_pii_redaction_and_odd_rows(spark, odd):
    rows = spark.createDataFrame([(1, "mail me+x@do-main.co.uk or 12.34.56.78 now"), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r.text for r in pii.redacted(rows).orderBy("doc_id").collect()] == ["mail <EMAIL> or <IP> now", None, "clean"]
    assert pii.personal_data(odd).count() == len(ROWS) and pii.personal_data(odd.limit(0)).count() == 0


def test_pii_reliabilities_separate_good_labelers():
    patterns = [((1, 1, 1, 0, 1, 1), 80), ((-1, -1, 0, -1, -1, -1), 60), ((-1, 1, 1, 0, 1, 1), 10), ((-1, -1, 0, -1, 1, -1), 10)]
    share, tables, posterior = pii.reliabilities(patterns)
    assert 0.4 < share < 0.7 and posterior[0] > 0.9 > 0.1 > posterior[1]
    model = pii.train(patterns)
    assert model.yes[1] > model.no[1]


def test_language_held_out_accuracy(documents):
    found = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.95


def plain_kneser_ney(texts):
    """Dictionaries of strings: probability of a letter after up to three before it, as the definition says."""
    four = Counter()
    for text in texts:
        runs = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = "^^^" + re.sub(" +", " ", runs + " ").removeprefix(" ")
        four.update(padded[i - 3 : i + 1] for i in range(3, len(padded)))
    counts = {4: four}
    for n in (3, 2, 1):
        counts[n] = Counter(x[1:] for x in counts[n + 1])
    alphabet = len(counts[1]) + 1

    def p(letter, context):
        n = len(context) + 1
        own = counts[n]
        values = list(own.values())
        ones, twos = values.count(1), values.count(2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = [c for x, c in own.items() if x[:-1] == context]
        lower = p(letter, context[1:]) if context else 1 / alphabet
        if not after:
            return lower
        return max(own[context + letter] - discount, 0) / sum(after) + discount * len(after) / sum(after) * lower

    return p, counts


def test_language_model_matches_plain_kneser_ney(spark):
    texts = ["Abracadabra, abba!", "a cab; 12 cabs"]
    rows = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts, 100)], "doc_id long, text string, lang string")
    p, counts = plain_kneser_ney(texts)
    models = langid.learn(rows, modulus=1, remainder=5)
    code = lambda x: sum((1 if c == "^" else 0 if c == " " else ord(c)) << (16 * k) for k, c in enumerate(reversed(x)))
    asked = {code(x): x for x in [*counts[4], "^^^q", "zzab", "abab", "cabr", "brac", "b ab"]}
    found = langid.log_probabilities(spark.createDataFrame([(k,) for k in asked], "key long"), models).collect()
    assert len(found) == len(asked)
    for r in found:
        assert r.logp == pytest.approx(np.log(p(asked[r.key][-1], asked[r.key][:-1])), abs=1e-9), asked[r.key]
    symbols = [*counts[1]]
    for context in ("^^^", "abr", "zzz"):
        assert sum(p(x, context) for x in symbols) == pytest.approx(1, abs=1 / (len(symbols) + 1))
    held = {int(k): v for k, v in zip(models.known, models.table[:, 0])}
    assert set(held) == {code(x) for x in counts[4]} and all(held[r.key] == pytest.approx(r.logp, abs=1e-5) for r in found if r.key in held)


def test_language_results_do_not_depend_on_what_tasks_hold(documents):
    """With room for almost no sequences all others are scored by joins."""
    some = documents.where("length(text) < 3000").limit(60)
    whole, bare = ({r.doc_id: r for r in langid.identify(some, table).collect()} for table in (langid.TABLE, 40))
    assert set(whole) == set(bare)
    for i, r in whole.items():
        assert (r.lang_pred, r.rejected) == (bare[i].lang_pred, bare[i].rejected) and r.score == pytest.approx(bare[i].score, abs=1e-4)


def test_language_rejection_is_calibrated_on_every_learning_text(spark):
    draw = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], [-float(x), -float(y)], 2, int(i % 50 > 0)) for i, (x, y) in enumerate(zip(draw.gamma(2, 3, 9000), draw.gamma(3, 2, 9000)))]
    rows += [(9000, None, [-1e6, -1e6], 2, 5), (9001, "a", [-20.0, -20.0], 0, 1)]
    found = spark.createDataFrame(rows, "doc_id long, own string, totals array<double>, steps long, letters long")
    models = langid.Models(["a", "b", "c"], 5, limit=np.full(3, np.inf))
    every = [[-t[k] / max(s, 1) for _, own, t, s, n in rows if own == name and n] for k, name in enumerate("ab")]
    assert langid.calibrated(models, found).limit.tolist() == pytest.approx([1.05 * np.percentile(x, 99.9) for x in every] + [np.inf], rel=1e-12)


def test_percentiles_are_exact(spark):
    draw = np.random.default_rng(6)
    groups = {1: draw.normal(size=500).tolist(), 2: [1.5] * 40, 3: [2.0], 4: [0.0] * 90 + [1e-300, 1.0, 1e12], 5: draw.integers(0, 4, 101).astype(float).tolist()}
    values = spark.createDataFrame([(at, x) for at, own in groups.items() for x in own], "at int, x double")
    for share, bins in ((0.999, 8), (0.5, 2), (0.0, 64), (1.0, 64)):
        found = langid.percentiles(values, share, bins)
        assert found == {at: pytest.approx(np.percentile(own, 100 * share), rel=1e-12, abs=1e-300) for at, own in groups.items()}
    assert langid.percentiles(values.limit(0), 0.5) == {}


def test_sequences_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = "The cat, the DOG -- and  the éléphant 12 ran; " * 7

    def by_text():
        found = list(langid.sequences([text, "x", text]))
        number, keys = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        return [keys[number == i].tolist() for i in range(3)]

    whole = by_text()
    for step in (1, 2, 5, 11, 300):
        monkeypatch.setattr(langid, "STEP", step)
        assert by_text() == whole


def test_language_odd_rows(spark, odd):
    more = spark.createDataFrame([(100 + i, ("the dog and the hat", "le chien et la table")[i % 2], ("en", "fr")[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    found = langid.identify(odd.select("doc_id", "text", "lang").unionByName(more)).collect()
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {1, 2, 3, 4} and len(found) == len(ROWS) + 20
    assert [(r.lang_pred, r.held_out) for r in found if r.doc_id is None] == [("fr", True)]
    unlearned = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}
    assert langid.identify(odd.limit(0)).count() == 0


def _accuracy(found, labels, name):
    joined = found.join(labels, "doc_id").where("held_out")
    return joined.agg(F.avg((F.col("predicted") == F.col(name)).cast("double"))).first()[0]


def test_quality_held_out_accuracy(documents, labels):
    assert _accuracy(quality.quality_scores(documents, labels), labels, "quality") > 0.9


def test_toxicity_held_out_accuracy(documents, labels):
    found = toxicity.toxicity_scores(documents, labels)
    assert _accuracy(found, labels, "toxic") > 0.9


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(3)
    y = (rng.random(4000) < 0.2).astype(float)
    vote = lambda hit, false: np.where(y > 0, rng.random(4000) < hit, rng.random(4000) < false).astype(float)
    one, noisy = vote(0.9, 0.02), vote(0.3, 0.2)
    fired = np.stack([one, noisy, noisy, noisy, vote(0.8, 0.05)], axis=1)
    model, posterior = toxicity.label_model(fired, np.where(rng.random(4000) < 0.9, y, 1 - y))  # a tenth of the guess is wrong
    assert model.voice[1] < 0.5 < model.voice[0]
    assert ((model.posterior(fired) > 0.5) == y).mean() > 0.9 and ((posterior > 0.5) == y).mean() > 0.9


def test_label_model_recovers_planted_reliabilities():
    """From the voters' majority alone, without a label."""
    rng = np.random.default_rng(4)
    y = rng.random(20000) < 0.15
    hit, false = np.array([0.9, 0.7, 0.5, 0.8, 0.6]), np.array([0.02, 0.05, 0.01, 0.1, 0.03])
    fired = np.where(y[:, None], rng.random((20000, 5)) < hit, rng.random((20000, 5)) < false).astype(float)
    model, posterior = toxicity.label_model(fired, toxicity.majority(fired, 0.15))
    assert np.abs(model.toxic - hit).max() < 0.06 and np.abs(model.clean - false).max() < 0.03 and abs(model.prior - 0.15) < 0.02
    assert ((posterior > 0.5) == y).mean() > 0.97

def test_scores_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(2, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for found in (quality.quality_scores(odd, labels), toxicity.toxicity_scores(odd, labels)):
            rows = found.collect()
            assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    one = spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in quality.quality_scores(odd, one).collect()}) == 1
    assert quality.quality_scores(odd.limit(0), some).count() == toxicity.toxicity_scores(odd.limit(0), some).count() == 0
    kept = toxicity.without_toxic(odd, none)
    assert kept.columns == odd.columns and kept.count() == len(ROWS)


def test_toxicity_learns_from_texts_that_share_a_header(spark):
    """Labelled texts behind one header of more than 200 characters are different texts; equal ones with one label count once."""
    header = "this notice is printed above every message of the board " * 5
    ids = [i for i in range(1, 400)]
    docs = [(i, header + (f"zorblat person number {i}" if i % 2 else f"kind person number {i}")) for i in ids]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    assert "zorblat" in toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), labels).lexicons.words
    copies = [(i, header + ("zorblat" if i % 2 else "  Kind")) for i in ids]
    assert "zorblat" not in toxicity.learn(spark.createDataFrame(copies, "doc_id long, text string"), labels).lexicons.words
