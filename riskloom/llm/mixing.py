"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. Every document first gets the whole copies that are certain, floor(target / size
of its source); the rest of the target is a sample of whole documents. Documents of a source and a quarter octave of sizes
form a stratum, in which a document's inclusion probability is in proportion to its size. A stratum has a fixed number of
places, its share of the missing words over the size that a drawn document is expected to have, rounded at random; what
rounding misses or exceeds passes on to the next smaller stratum. Documents of a stratum are ranked by the ratio of their
random odds to their inclusion odds, and those with the smallest ratios get the places. Where a stratum's sample ends is
found from counts over 4096 ranges of the rank, then over 4096 ranges within the one that holds it, so none is ever sorted as
a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
#: Strata to an octave of sizes.
FINE = 4
_LEAST = -(1 << 63)
_SOURCE = ["name", "nameless"]


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> with target: weights repeat over the sources by code point, null last; targets share the
    sum of all sizes, none above ``most`` times its source, the excess going to the others by weight."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levelled = capped.withColumn("level", level)
    free = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)
    return levelled.withColumn("at", F.coalesce(free["level"], F.lit(float("inf")))).select(
        "source", "source_size", F.least("cap", F.col("w") * F.col("at")).alias("target")
    )


def _key(draw: Column, chance: Column) -> Column:
    """The Pareto ratio x of random odds to inclusion odds as x / (1 + x), which keeps its order, in 48 bits."""
    ratio = (draw / (1 - draw)) / (chance / (1 - chance))
    return F.least(F.floor(ratio / (1 + ratio) * float(1 << 48)), F.lit((1 << 48) - 1)).cast("long")


def _chance(fraction: Column, size: Column, usual: Column) -> Column:
    """Inclusion probability: in proportion to size, ``fraction`` for a document of the stratum's ``usual`` size."""
    return F.least(fraction * size / usual, F.lit(1 - 1e-9))


def _stratum(size: Column) -> Column:
    """Quarter octaves of sizes; documents without words are a stratum of their own, which nothing is drawn from."""
    return F.coalesce(F.floor(F.log2(size) * FINE).cast("int"), F.lit(-1))  # never null, so no join filters by it first


def _measured(docs: DataFrame, seed: int, kept: list[str]) -> DataFrame:
    """Each row's size, source and stratum, a random number in (0, 1) that is the same in every run, and its text hash, which
    settles ties; ``row`` holds its columns ``kept``, so that no name of them can clash."""
    text, doc_id, source = F.col("text").cast("string"), F.col("doc_id").cast("long"), F.col("source").cast("string")
    mark = F.xxhash64(text)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, mark), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    size = words(text)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.coalesce(doc_id, F.lit(_LEAST)).alias("id"),
        F.coalesce(source, F.lit("")).alias("name"),
        source.isNull().alias("nameless"),
        size.alias("size"),
        _stratum(size).alias("stratum"),
        draw.alias("draw"),
        mark.alias("mark"),
    )


def _places(strata: DataFrame, seed: int) -> DataFrame:
    """(name, nameless, stratum, places): from the largest sizes to the smallest, each stratum's share of the source's missing
    words and what the ones before left over, in documents of its usual size, rounded at random without bias."""
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "name", "nameless", "stratum"), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    items = F.sort_array(F.collect_list(F.struct("stratum", "documents", "words", "usual", "fraction", chance.alias("chance"))), asc=False)
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<stratum:int,places:bigint>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        want = x["fraction"] * x["words"] + state["left"]
        places = F.greatest(F.lit(0), F.least(x["documents"], F.floor(want / x["usual"] + x["chance"]))).cast("long")
        drawn = F.when(places == x["documents"], x["words"].cast("double")).otherwise(places * x["usual"])
        return F.struct((want - drawn).alias("left"), F.concat(state["out"], F.array(F.struct(x["stratum"].alias("stratum"), places.alias("places")))).alias("out"))

    rows = strata.where("stratum >= 0").groupBy(*_SOURCE).agg(items.alias("items"))
    return rows.select(*_SOURCE, F.explode(F.aggregate("items", start, step)["out"]).alias("x")).select(*_SOURCE, "x.stratum", "x.places")


def _strata(sized: DataFrame, most: int, weights: tuple[float, ...], seed: int) -> DataFrame:
    """One row for each source and stratum: targets, certain copies, places, and the first rank that gets none."""
    group = [*_SOURCE, "stratum"]
    known = materialize(
        sized.groupBy(*group).agg(
            F.count("*").alias("documents"), F.sum("size").alias("words"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares")
        )
    )
    totals = known.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size"))
    totals = totals.withColumn("source", F.when(~F.col("nameless"), F.col("name")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = (
        source_targets(totals.select("source", "source_size"), weights, most)
        .withColumn("copies", F.floor(rate).cast("long"))
        .withColumn("fraction", rate - F.floor(rate))
        .select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"), "source_size", "target", "copies", "fraction")
    )
    strata = known.withColumn("usual", F.try_divide("squares", "words")).drop("squares").join(targets, _SOURCE)
    strata = materialize(strata)
    strata = materialize(strata.join(_places(strata, seed), group, "left").withColumn("places", F.coalesce("places", F.lit(0).cast("long"))))
    drawn = strata.where("places > 0 and places < documents").select(*group, "places", "fraction", "usual")
    ranked = materialize(
        sized.join(drawn, group).select(*group, "places", _key(F.col("draw"), _chance(F.col("fraction"), F.col("size"), F.col("usual"))).alias("key"), "id", "mark")
    )

    def crossing(of: DataFrame, by: list, base: str | None) -> DataFrame:
        """Of ranges ``by``, the one in which the running count passes the places, with the count before it."""
        upto = Window.partitionBy(*group).orderBy(*by)
        start = F.col(base) if base else F.lit(0)
        run = of.withColumn("run", F.sum("n").over(upto) + start)
        first = F.row_number().over(upto)
        return run.where("run > places").withColumn("first", first).where("first = 1").withColumn("base", F.col("run") - F.col("n")).drop("run", "first")

    top = ranked.groupBy(*group, "places", F.shiftright("key", 36).alias("b1")).agg(F.count("*").alias("n"))
    at1 = crossing(top, ["b1"], None).select(*group, "b1", F.col("base").alias("base1"))
    inner = ranked.join(at1, group).where(F.shiftright("key", 36) == F.col("b1"))
    second = inner.groupBy(*group, "places", "b1", "base1", F.shiftright("key", 24).alias("b2")).agg(F.count("*").alias("n"))
    at2 = materialize(crossing(second, ["b2"], "base1").select(*group, "b2", F.col("base").alias("base2")))
    last = (
        ranked.join(at2, group)
        .where(F.shiftright("key", 24) == F.col("b2"))
        .groupBy(*group, "places", "base2", "key", "id", "mark")
        .agg(F.count("*").alias("n"))
    )
    # the first that gets no place; repeated rows, which rank alike, get them together if that comes nearer
    over = crossing(last, ["key", "id", "mark"], "base2").select(
        *group, F.struct("key", "id", "mark").alias("over"), (F.col("base") + F.col("n") - F.col("places") < F.col("places") - F.col("base")).alias("with_it")
    )
    return materialize(strata.join(over, group, "left"))


def _with_copies(measured: DataFrame, strata: DataFrame) -> DataFrame:
    """(row, size, source_size, target, copies)."""
    rows = measured.join(strata.withColumnRenamed("words", "all_words"), [*_SOURCE, "stratum"])
    me = F.struct(_key(F.col("draw"), _chance(F.col("fraction"), F.col("size"), F.col("usual"))).alias("key"), F.col("id"), F.col("mark"))
    among = F.coalesce((me < F.col("over")) | (F.col("with_it") & (me == F.col("over"))), F.lit(True))
    sampled = (F.col("places") == F.col("documents")) | ((F.col("places") > 0) & among)
    copies = F.when(F.col("size") > 0, F.col("copies") + sampled.cast("long")).otherwise(0).cast("long")
    return rows.select("row", "size", "source_size", "target", copies.alias("copies"))


def _whole_rows(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int) -> DataFrame:
    narrow = materialize(_measured(docs, seed, ["doc_id"]).drop("row"))
    return _with_copies(_measured(docs, seed, docs.columns), _strata(narrow, most, weights, seed))


def allocation(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 4) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): what ``mixed`` decides, from one reading of the texts."""
    narrow = materialize(_measured(docs, seed, ["doc_id", "source"]))
    found = _with_copies(narrow, _strata(narrow.drop("row"), most, weights, seed))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 4) -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix repeats the document, 0 to ``most``.

    size counts words; a null text has none and gets no copies. A null source is a source of its own. Columns of ``docs``
    that have one of the four names are replaced; no other name clashes. Reruns give the same copies. Rows that repeat both
    doc_id and text are drawn together. An empty table gives an empty result.
    """
    new = ("size", "source_size", "target", "copies")
    given = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in new]
    return _whole_rows(docs, weights, most, seed).select(*given, *new)


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 4) -> DataFrame:
    """The mix itself: the rows of ``docs`` with their own columns, each as often as ``mixed`` repeats it."""
    found = _whole_rows(docs, weights, most, seed).where("copies > 0")
    again = found.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
