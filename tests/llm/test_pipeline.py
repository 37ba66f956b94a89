"""The pipeline's stages on a small table, each against what it must keep, and the registered queries."""

import __spark_entry__ as entry
import pytest

import corpus_pipeline
from riskloom.llm.store import materialize


def test_every_operator_is_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names


def test_stages_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs.toPandas(), stage(spark, docs, small))
        docs = materialize(seen[name][1])
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["toxicity"][0], seen["near_duplicates"][0]
    toxic = spark.read.parquet(f"{small}/labels.parquet").toPandas().set_index("doc_id").toxic
    gone = set(before.doc_id) - set(after.doc_id)
    assert gone and sum(toxic.get(x, 1) == 0 for x in gone) <= 1
    kept = seen["personal_data"][0]
    assert not kept.text.duplicated().any() and set(kept.doc_id) <= set(after.doc_id)
    masked = seen["mixing"][0]
    assert set(masked.doc_id) == set(kept.doc_id) and not masked.text.str.contains(r"@[a-z0-9]+\.example\.com").any()
    mixed = seen["packing"][0]
    assert mixed.groupby("doc_id").size().max() <= 3
    packed = docs.toPandas()
    assert packed.words.sum() == sum(len(t.encode().split()) for t in mixed.text)


def test_stages_of_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small))
        assert docs.count() == 0


def _similar_pairs(texts: dict) -> set:
    """All pairs with a five-word Jaccard similarity of 0.8 or more, by brute force."""
    from collections import defaultdict

    own, holders, both = {}, defaultdict(list), defaultdict(int)
    for k, text in texts.items():
        t = text.encode().lower().split()
        own[k] = {tuple(t[i : i + 5]) for i in range(len(t) - 4)} or {tuple(t)}
        for s in own[k]:
            for other in holders[s]:
                both[other, k] += 1
            holders[s].append(k)
    return {p for p, n in both.items() if 5 * n >= 4 * (len(own[p[0]]) + len(own[p[1]]) - n)}


def test_near_copies_stage_against_brute_force(spark, small, monkeypatch):
    """Every pair at 0.8 or more shares a component, and components are those of the brute-force pairs."""
    import random

    from riskloom.llm import similar

    rng = random.Random(3)
    texts = {k: t for k, t in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if t and t.split()}
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    for k in range(90):  # copies of one text and of those copies, most around the limit
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[10**7 + k] = " ".join(words)
    for words in (5, 9, 40, 300):
        for k in range(12):
            t = [f"{words}y{rng.randrange(10**6)}" for _ in range(words)]
            texts[2 * 10**7 + 1000 * words + 2 * k] = " ".join(t)
            texts[2 * 10**7 + 1000 * words + 2 * k + 1] = " ".join(t[: words - max(1, words // 30)])
    pairs = _similar_pairs(texts)
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    for limit in (similar.NEXT, 1, 50):
        monkeypatch.setattr(similar, "NEXT", limit)
        found = dict(similar.near_copies(docs).collect())
        assert found == {k: root(k) for k in texts}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect()}
    assert kept == {k for k in texts if root(k) == k} and not any({a, b} <= kept for a, b in pairs)


def test_tables_of_a_session_can_be_cleared(spark):
    from riskloom.llm import store

    path = store.write_table(spark.range(3))
    assert spark.read.parquet(path).count() == 3 and store.clear(spark) >= 1 and store.clear(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
