"""Source divergence audit over a baseline-correction inverted index.

How far two sources of a language lie apart is the sum of |p - q| over all kept terms of the language, and most terms are missing in most
sources. So each pair starts at V times the difference that a term has which neither source holds; a source's own terms, counted by
their shares, add what they change against sources without them; and the postings of a term add, for the pairs of sources that
both hold it, the correction between the true difference and those two one-sided ones. Nothing is ever written for a term that a
pair lacks. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: A term is kept in a language with so many documents that hold it; so many of a source's terms are reported.
DOCUMENTS, TERMS = 30, 50
#: What every count is raised by, and the unit of shares.
RAISE, UNIT = 5, 1_000_000_000
#: Terms that a task holds before it sends their counts on.
HELD = 400_000
#: Sources of a term's postings that meet those of another such block in one row.
POSTINGS = 64
#: Letters as they are, A-Z as a-z, all other ASCII as blanks.
_LETTERS = bytes(b if b >= 0x80 else (b | 0x20 if chr(b).isalpha() else 0x20) for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters of UTF-8 text, only A-Z lower-cased."""
    return text.translate(_LETTERS).split() if text else []


def occurrences(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often each term is in each source, and in how many of its rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = defaultdict(Counter), defaultdict(Counter)

        def drained() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in words.items():
                n, spread = len(own), rows[lang, source]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, n), pa.repeat(source, n), pa.array(own, pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64()), pa.array(map(spread.__getitem__, own), pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            words.clear()
            rows.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = terms(text)
                if found:
                    words[lang, source].update(found)
                    rows[lang, source].update(set(found))
            if sum(map(len, rows.values())) > HELD:
                yield from drained()
        yield from drained()

    parted = docs.select(_named("lang"), _named("source"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = parted.mapInArrow(each, "lang string, source string, term string, n long, docs long")
    # a term's rows are few, as tasks have counted them, so one shuffle serves these sums and those of the language
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def _share(count: str, total: str, kept: str = "v") -> Column:
    """1 + floor(UNIT * (count + RAISE) / (total + RAISE * kept)), exactly."""
    return F.expr(f"1 + ({UNIT} * cast({count} + {RAISE} as decimal(20, 0))) div cast({total} + {RAISE} * {kept} as decimal(20, 0))")


def index(docs: DataFrame, documents: int = DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(groups, postings). groups (lang, source, i, v, zero): the sources of each language, numbered; how many terms the language
    keeps; the share of a term that the source lacks (null if no term is kept). postings (lang, i, source, term, p, q): the share
    of each kept term that the source has, there and in the language."""
    counts = occurrences(docs)
    own = Window.partitionBy("lang", "term")
    with_totals = counts.withColumn("spread", F.sum("docs").over(own)).withColumn("total", F.sum("n").over(own))
    kept = materialize(with_totals.where(F.col("spread") >= documents).select("lang", "source", "term", "n", "total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    languages = sizes.groupBy("lang").agg(F.sum("size").alias("lang_size")).join(
        kept.groupBy("lang", "term").count().groupBy("lang").agg(F.count("*").alias("v")), "lang"
    )
    every = docs.select(_named("lang"), _named("source")).distinct()
    numbered = every.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    joined = numbered.join(sizes, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0, ["size", "v", "lang_size"])
    groups = materialize(joined.withColumn("zero", F.when(F.col("v") > 0, _share("0", "size"))))
    shares = kept.join(groups, ["lang", "source"]).select("lang", "i", "source", "term", "zero", _share("n", "size").alias("p"), _share("total", "lang_size").alias("q"))
    return groups.select("lang", "source", "i", "v", "zero"), materialize(shares)


def pair_sums(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, i, j, value), i < j: the sum of |p - q| over the kept terms, for every two sources of a language."""
    a, b = (groups.select("lang", F.col("i").alias(i), F.col("zero").alias(z), "v") for i, z in (("i", "z"), ("j", "y")))
    base = a.join(b.drop("v"), "lang").where("i < j").select("lang", "i", "j", F.coalesce(F.col("v") * F.abs(F.col("z") - F.col("y")), F.lit(0)).alias("value"))

    # what a source's terms change against each other source, as if that one had none of them: terms of one share count together
    alike = postings.groupBy("lang", "i", "p", "zero").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("i").alias("j"), F.col("zero").alias("y"))
    change = F.col("m") * (F.abs(F.col("p") - F.col("y")) - F.abs(F.col("zero") - F.col("y")))
    alone = alike.join(other, "lang").where("i <> j").select("lang", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), change.alias("value"))

    # sources that share a term: the true difference in place of the two one-sided changes
    part = F.floor(F.col("i") / POSTINGS)
    lists = postings.groupBy("lang", "term", part.alias("part")).agg(F.collect_list(F.struct("i", "p", "zero")).alias("own"))
    left = lists.select("lang", "term", F.col("part").alias("part_a"), F.col("own").alias("own_a"))
    right = lists.select("lang", "term", F.col("part").alias("part_b"), F.col("own").alias("own_b"))
    met = left.join(right, ["lang", "term"]).where("part_a <= part_b").select("lang", F.explode("own_a").alias("a"), "own_b")
    each = met.select("lang", "a", F.explode("own_b").alias("b")).where("a.i < b.i")
    ground = F.abs(F.col("a.zero") - F.col("b.zero"))
    correction = F.abs(F.col("a.p") - F.col("b.p")) - F.abs(F.col("a.p") - F.col("b.zero")) - F.abs(F.col("a.zero") - F.col("b.p")) + ground
    both = each.select("lang", F.col("a.i").alias("i"), F.col("b.i").alias("j"), correction.alias("value")).where("value <> 0")
    return base.unionByName(alone).unionByName(both).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, documents: int = DOCUMENTS, reported: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    ``pair``: every other source of the language by how far it lies apart, the farthest first (0 where no term is kept).
    ``term``: the ``reported`` terms whose share in the source exceeds that in the language by most. Ties go to the smaller item in
    UTF-8. Null text, lang and source count as empty; repeated rows count as often as they are there; other columns take no part; a
    source without terms has its pairs. An empty table gives an empty result.
    """
    groups, postings = index(docs, documents)
    sums = pair_sums(groups, postings)
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    one, other = groups.select("lang", "i", "source"), groups.select("lang", F.col("i").alias("j"), F.col("source").alias("item"))
    pairs = both.join(one, ["lang", "i"]).join(other, ["lang", "j"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    above = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return pairs.select("*", rank).unionByName(above.select("*", rank).where(F.col("rank") <= reported))
