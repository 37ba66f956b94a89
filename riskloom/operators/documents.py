"""Documents as data: label maps to canonical JSON and back, and the file records that documents name, found at any depth.

A table has many documents, one a row. They are read as VARIANT; what lies inside is walked by recursive SQL, level by level over all
documents at once, so no document passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = "map<string,map<string,string>>"
#: Levels of nesting, and of facts that need each other, beyond which a run fails.
DEPTH, CHAIN = 200, 50
#: What can be wrong with a record, and what is said of one that is right.
ISSUES = ("malformed", "outside", "missing", "stale")
CURRENT = "current"

# JSON's short escapes, by UTF-16 unit.
_SHORT = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}


def quoted(text: Column) -> Column:
    """A JSON string in ASCII: what is not printable ASCII is escaped by its UTF-16 units."""
    units = F.hex(F.encode(text, "UTF-16BE"))

    def escaped(unit: Column) -> Column:
        out = F.when((unit >= "0020") & (unit <= "007E"), F.char(F.conv(unit, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(unit)))
        for code, short in _SHORT.items():
            out = F.when(unit == code, F.lit(short)).otherwise(out)
        return out

    each = F.transform(F.regexp_extract_all(units, F.lit("[0-9A-F]{4}"), F.lit(0)), escaped)
    plain = text.rlike(r'^[\x20-\x21\x23-\x5B\x5D-\x7E]*$')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(each, "")), F.lit('"'))


def json_object(items: Column) -> Column:
    """entries (key, JSON of the value) as one JSON object without spaces, keys in order of code points."""
    parts = F.transform(F.sort_array(items), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def label_maps(labels: DataFrame, *by: str) -> DataFrame:
    """labels (by, year, security, group_id) -> (by, year, members, body, sha256): each year's labels as canonical JSON, and its digest.
    A security with two groups in a year, and a null in either, fail the run."""
    entry = F.struct(F.col("security").alias("key"), quoted(F.col("group_id")).alias("value"))
    rows = labels.groupBy(*by, "year").agg(
        F.collect_list(F.when(F.col("security").isNotNull() & F.col("group_id").isNotNull(), entry)).alias("items"), F.countDistinct("security").alias("distinct"), F.count("*").alias("members")
    )
    whole = (F.size("items") == F.col("members")) & (F.col("distinct") == F.col("members"))
    body = F.when(whole, json_object(F.col("items"))).otherwise(F.raise_error(F.concat(F.lit("labels are missing or repeated in "), F.col("year").cast("string"))))
    return rows.select(*by, "year", "members", body.alias("body")).withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256))


def label_documents(labels: DataFrame, *by: str) -> DataFrame:
    """labels (by, year, security, group_id) -> (by, body, sha256): {year: {security: group}} as canonical JSON."""
    entry = F.struct(F.col("year").cast("string").alias("key"), F.col("body").alias("value"))
    rows = label_maps(labels, *by).groupBy(*by).agg(json_object(F.collect_list(entry)).alias("body"))
    return rows.where("body <> '{}'").withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256))


def label_rows(documents: DataFrame, *by: str) -> DataFrame:
    """(by, body) -> (by, year, security, group_id): the labels that documents hold. A body that is no label document fails the run."""
    found = F.from_json("body", LABELS, {"mode": "FAILFAST"})
    years = documents.select(*by, F.explode(F.coalesce(found, F.raise_error(F.lit("a label document is null")).cast(LABELS))).alias("year", "own"))
    return years.select(*by, F.col("year").cast("int").alias("year"), F.explode("own").alias("security", "group_id"))


def containers(documents: DataFrame) -> DataFrame:
    """(document, body) -> (document, place, node): every object and array in the JSON of ``body``, with its place ($, $.key, $[0]).
    A body that is null has none; one that is not JSON fails the run."""
    return documents.sparkSession.sql(
        f"""
        WITH RECURSIVE walked(document, place, node) MAX RECURSION LEVEL {DEPTH} AS (
          SELECT document, '$', parse_json(body) FROM {{documents}} WHERE body IS NOT NULL
          UNION ALL
          SELECT w.document, concat(w.place, coalesce(concat('.', e.key), concat('[', e.pos, ']'))), e.value
          FROM walked w, LATERAL variant_explode(w.node) e
          WHERE schema_of_variant(e.value) LIKE 'OBJECT%' OR schema_of_variant(e.value) LIKE 'ARRAY%'
        )
        SELECT document, place, node FROM walked LIMIT ALL
        """,
        documents=documents.select("document", "body"),
    )


def hash_records(documents: DataFrame) -> DataFrame:
    """(document, place, path, sha256) of every object that has both a path and a sha256; null where one is no string, JSON's null included."""
    text = "CASE WHEN schema_of_variant(variant_get(node, '$.{0}')) = 'STRING' THEN variant_get(node, '$.{0}', 'string') END AS {0}"
    objects = containers(documents).where("schema_of_variant(node) LIKE 'OBJECT%'")
    return objects.where("variant_get(node, '$.path') IS NOT NULL AND variant_get(node, '$.sha256') IS NOT NULL").selectExpr("document", "place", text.format("path"), text.format("sha256"))


def _leaves(path: Column) -> Column:
    """Whether a relative path leads out of its root."""
    step = lambda depth, part: F.when(depth < 0, depth).when(part == "..", depth - 1).when(part.isin("", "."), depth).otherwise(depth + 1)
    return path.startswith("/") | (F.aggregate(F.split(path, "/"), F.lit(0), step) < 0)


def hash_status(records: DataFrame, files: DataFrame) -> DataFrame:
    """records (document, place, path, sha256) against files (path, sha256), one row a path -> the records with their status: current,
    or what is wrong with them, the first of ISSUES. Files are as many as records, so they are sorted and never broadcast, however small they look."""
    known = files.select(F.col("path").alias("path"), F.col("sha256").alias("found")).hint("merge")
    wrong = F.col("path").isNull() | (F.col("path") == "") | F.col("sha256").isNull() | ~F.col("sha256").rlike("^[0-9a-f]{64}$")
    status = (
        F.when(wrong, "malformed").when(_leaves(F.col("path")), "outside").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "stale").otherwise(CURRENT)
    )
    return records.join(known, "path", "left").select("document", "place", "path", "sha256", status.alias("status"))


def lineage(documents: DataFrame, files: DataFrame, absent_below: tuple[str, ...] = ()) -> DataFrame:
    """By document: how many records it has, how many have each issue, whether it passes (records and no issue), and whether all that is
    wrong are files that are absent below the given folders, as in a copy without generated files."""
    checked = hash_status(hash_records(documents), files)
    below = F.lit(False)
    for folder in absent_below:
        below = below | F.col("path").startswith(folder.rstrip("/") + "/")
    by_document = checked.groupBy("document").agg(
        F.count("*").alias("records"), *[F.count_if(F.col("status") == x).alias(x) for x in ISSUES], F.count_if((F.col("status") == "missing") & below).alias("generated")
    )
    rows = documents.select("document").distinct().join(by_document, "document", "left").na.fill(0)
    issues = sum((F.col(x) for x in ISSUES), F.lit(0))
    return rows.select(
        "document", "records", *ISSUES, F.when((F.col("records") > 0) & (issues == 0), "pass").otherwise("fail").alias("status"), ((issues > 0) & (issues == F.col("generated"))).alias("only_generated_missing")
    )


def blocked(facts: DataFrame, needs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """facts (run, fact, holds), needs (fact, needs) -> (run, fact, holds, asked, causes): a fact is asked only where nothing that it needs,
    directly or not, fails. causes: the facts that fail and are asked on which it hangs, itself included, in order; empty for none. Needs that go round in
    a circle or hang on each other in more than ``chain`` steps, and facts that are null, fail the run."""
    known = facts.select("run", "fact", F.coalesce("holds", F.raise_error(F.lit("a fact is unknown")).cast("boolean")).alias("holds"))
    reached = facts.sparkSession.sql(
        f"""
        WITH RECURSIVE hit(run, fact, cause) MAX RECURSION LEVEL {chain} AS (
          SELECT run, fact, fact FROM {{facts}} WHERE NOT holds
          UNION ALL
          SELECT h.run, n.fact, h.cause FROM hit h JOIN {{needs}} n ON n.needs = h.fact
        )
        SELECT run, fact, cause FROM hit LIMIT ALL
        """,
        facts=known,
        needs=needs.distinct(),
    ).distinct()
    unasked = reached.where("fact <> cause").select("run", "fact").distinct().withColumn("unasked", F.lit(True))
    first = reached.join(unasked.select("run", F.col("fact").alias("cause")), ["run", "cause"], "left_anti")
    causes = first.groupBy("run", "fact").agg(F.array_sort(F.collect_set("cause")).alias("causes"))
    rows = known.join(unasked, ["run", "fact"], "left").join(causes, ["run", "fact"], "left")
    return rows.select("run", "fact", "holds", F.col("unasked").isNull().alias("asked"), F.coalesce("causes", F.array().cast("array<string>")).alias("causes"))
