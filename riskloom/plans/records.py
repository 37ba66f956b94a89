"""Queries of documents as data: label maps, file records at any depth, lineage, gates over facts that need each other, with their SQL.

Documents are made of the driver's tables: the market segments of a nation's customers by year, the manifest of a customer's orders, and
a run of the foundation gate for each customer, with faults planted by key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as doc
from ..sources import views as v
from . import gates


def _labels(s, d):
    """(nation, year, security, group_id): customers with orders in a year, by market segment."""
    customers = v.table(s, d, "customer").join(v.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = v.table(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).distinct().join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("n_name").alias("nation"), "year", F.col("c_name").alias("security"), F.col("c_mktsegment").alias("group_id"))


def label_maps(s, d):
    return doc.label_maps(_labels(s, d), "nation")


def label_documents(s, d):
    return doc.label_documents(_labels(s, d), "nation")


def label_round_trip(s, d):
    return doc.label_rows(doc.label_documents(_labels(s, d), "nation"), "nation")


def _digest(text):
    return F.sha2(F.concat(text).cast("binary"), 256)


def _order_documents(s, d):
    """(document, body): by customer, a manifest that names its orders in a list, and the nation's and region's files inside one another."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("orders/"), key.cast("string"))
    path = F.when(key % 13 == 0, F.concat(F.lit("orders/../../"), key.cast("string"))).otherwise(name)
    digest = F.when(key % 11 == 0, F.lit("unknown")).otherwise(_digest(name))
    orders = v.table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(path.alias("path"), digest.alias("sha256"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    at = lambda kind, k: [F.concat(F.lit(kind), F.col(k).cast("string")).alias("path"), _digest(F.concat(F.lit(kind), F.col(k).cast("string"))).alias("sha256")]
    nation = F.struct(*at("nation/", "n_nationkey"), F.struct(F.struct(*at("region/", "n_regionkey")).alias("of")).alias("made"))
    rows = v.table(s, d, "customer").join(v.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("document"), F.to_json(F.struct(F.col("c_name").alias("path"), F.struct("orders").alias("outputs"), F.array(nation).alias("inputs"))).alias("body"))


def _files(s, d):
    """(path, sha256) of the files that are there: some orders' are not, and some have changed."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("orders/"), key.cast("string"))
    orders = v.table(s, d, "orders").where(key % 17 != 0).select(name.alias("path"), _digest(F.when(key % 19 == 0, F.concat(name, F.lit("!"))).otherwise(name)).alias("sha256"))
    nations = v.table(s, d, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("path"))
    regions = v.table(s, d, "region").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("path"))
    return orders.unionByName(nations.unionByName(regions).select("path", _digest(F.col("path")).alias("sha256")))


def hash_record_leaves(s, d):
    return doc.hash_records(_order_documents(s, d))


def hash_record_status(s, d):
    return doc.hash_status(doc.hash_records(_order_documents(s, d)), _files(s, d)).select("document", "place", "status")


def document_lineage(s, d):
    return doc.lineage(_order_documents(s, d), _files(s, d), ("orders",))


#: What an order's states need.
ORDER_NEEDS = (("shipped", "placed"), ("received", "shipped"), ("billed", "received"), ("billed", "priced"), ("closed", "billed"), ("closed", "shipped"))


def order_gates(s, d):
    """Of each order's states, which hold, which are asked, and what they hang on."""
    lines = v.table(s, d, "lineitem").groupBy("l_orderkey").agg((F.max("l_discount") < 0.1).alias("shipped"), (F.max("l_quantity") < 49).alias("received"), (F.min("l_tax") > 0).alias("billed"))
    orders = v.table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    states = {"placed": F.col("o_orderkey") % 5 != 0, "priced": F.col("o_totalprice") > 60000, "shipped": F.col("shipped"), "received": F.col("received"), "billed": F.col("billed"), "closed": F.col("o_orderkey") % 7 != 0}
    facts = orders.select(F.col("o_orderkey").alias("run"), F.explode(F.create_map(*[x for name, ok in states.items() for x in (F.lit(name), ok)])).alias("fact", "holds"))
    found = doc.blocked(facts, s.createDataFrame(ORDER_NEEDS, "fact string, needs string"))
    return found.withColumn("causes", F.array_join("causes", ","))


def _runs(s, d):
    """One run of the gate for each customer, with its documents and, by key, its faults."""
    k = F.col("c_custkey")
    off = lambda n: k % n == 0
    universe = F.struct(
        F.when(off(3), "pass").otherwise("blocked").alias("status"),
        F.when(~off(3), F.when(off(11), F.array(F.lit(gates.WAIVED), F.lit("universe_unread"))).otherwise(F.array(F.lit(gates.WAIVED)))).alias("blockers"),
        F.lit("u").alias("public_universe_sha256"), F.when(off(13), "x").otherwise("m").alias("source_manifest_sha256"),
    )
    model = F.struct(
        F.struct(F.lit("PA").alias("amendment_id"), F.lit(gates.PROVISIONAL).alias("reporting_scope"), (~off(17)).alias("allow_modelling_with_provisional_universe"), F.lit(False).alias("licensed_provenance_claim_allowed")).alias("provenance"),
        F.struct(F.lit(True).alias("allow_provisional_universe_provenance")).alias("quality_gates"),
        F.when(off(19), "open").otherwise(gates.FROZEN_STATUS).alias("protocol_status"),
    )
    amendment = F.struct(
        F.when(off(5), "draft").otherwise("active").alias("status"), F.lit("PA").alias("amendment_id"), F.lit(True).alias("modelling_allowed"), F.lit(False).alias("licensed_provenance_claim_allowed"),
        F.lit(gates.PROVISIONAL).alias("reporting_scope"), F.lit("u").alias("expected_public_universe_sha256"), F.lit("m").alias("expected_universe_source_manifest_sha256"),
        F.lit(9).alias("minimum_metadata_matches"), F.lit(9).alias("minimum_price_matches"), F.array(F.lit("Z")).alias("accepted_missing_tickers"),
    )
    reference = F.struct(
        F.lit("provisional_non_licensed").alias("status"), F.when(off(29), 9).otherwise(10).alias("row_count"), F.lit(9).alias("metadata_found_count"), F.lit(10).alias("price_found_count"),
        F.array(F.struct(F.when(off(31), "Y").otherwise("Z").alias("ticker"))).alias("request_failures"), F.struct(F.lit(False).alias("foundation_v2_universe_provenance")).alias("gate_eligibility"), F.lit("o").alias("output_sha256"),
    )
    rows = v.table(s, d, "customer")
    return rows.select(
        k.alias("run"), F.to_json(universe).alias("universe"), F.to_json(model).alias("model"), F.when(~off(23), F.to_json(amendment)).alias("amendment"),
        F.to_json(reference).alias("reference"), F.lit(10).cast("long").alias("n_rows"), F.lit("o").alias("current_sha256"),
    )


def _run_facts(s, d):
    k = F.col("c_custkey")
    stated = {"market_pass": 7, "market_file_current": 31, "construction_pass": 37, "construction_universe_bound": 41, "construction_market_bound": 43, "arithmetic_pass": 47, "arithmetic_bound": 53}
    rows = v.table(s, d, "customer").select(k)
    facts = rows.select(k.alias("run"), F.explode(F.create_map(*[x for name, n in stated.items() for x in (F.lit(name), k % n != 0)])).alias("fact", "holds"))
    kind = F.explode(F.array(*[F.lit(x) for x in gates.FILES.values()])).alias("kind")
    path = F.concat("kind", F.lit("/"), k.cast("string"))
    own = rows.select(k, kind).withColumn("path", path)
    documents = own.select(k.alias("run"), "kind", F.to_json(F.struct(F.struct(F.struct("path", _digest(F.col("path")).alias("sha256")).alias("file")).alias("outputs"))).alias("body"))
    there = own.where(~((F.col("kind") == "construction") & (k % 61 == 0)))
    changed = ((F.col("kind") == "universe") & (k % 59 == 0)) | ((F.col("kind") == "arithmetic") & (k % 67 == 0))
    files = there.select("path", _digest(F.when(changed, F.concat("path", F.lit("!"))).otherwise(F.col("path"))).alias("sha256"))
    return facts.unionByName(gates.file_facts(documents, files))


def amendment_issues(s, d):
    return gates.amendment_issues(_runs(s, d)).select("run", F.explode("issues").alias("issue"))


def foundation_status(s, d):
    return gates.foundation_status(_runs(s, d), _run_facts(s, d)).withColumn("blockers", F.array_join("blockers", ","))


_QUERIES = (label_maps, label_documents, label_round_trip, hash_record_leaves, hash_record_status, document_lineage, order_gates, amendment_issues, foundation_status)

_LABELS = """labels AS (SELECT DISTINCT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, c_name AS security, c_mktsegment AS group_id
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
years AS (SELECT nation, year, count(*) AS members, '{' || string_agg(CAST(to_json(security) AS VARCHAR) || ':' || CAST(to_json(group_id) AS VARCHAR), ',' ORDER BY security) || '}' AS body FROM labels GROUP BY nation, year)"""

#: Every object with a path and a sha256, by recursion over each document's nodes.
_LEAVES = """docs AS (SELECT c_custkey AS document, to_json({'path': c_name, 'outputs': {'orders': o.orders},
            'inputs': [{'path': 'nation/' || n_nationkey, 'sha256': sha256('nation/' || n_nationkey), 'made': {'of': {'path': 'region/' || n_regionkey, 'sha256': sha256('region/' || n_regionkey)}}}]}) AS body
          FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN
          (SELECT o_custkey, list(x ORDER BY x) AS orders FROM
            (SELECT o_custkey, {'path': CASE WHEN o_orderkey % 13 = 0 THEN 'orders/../../' ELSE 'orders/' END || o_orderkey, 'sha256': CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE sha256('orders/' || o_orderkey) END,
                                'status': o_orderstatus} AS x FROM orders) GROUP BY o_custkey) o ON o_custkey = c_custkey),
nodes AS (SELECT document, '$' AS place, CAST(body AS JSON) AS node FROM docs
          UNION ALL SELECT n.document, n.place || CASE WHEN json_type(n.node) = 'ARRAY' THEN '[' || e.key || ']' ELSE '.' || e.key END, e.value
          FROM nodes n, json_each(n.node) e WHERE json_type(e.value) IN ('OBJECT', 'ARRAY')),
leaves AS (SELECT document, place, node ->> '$.path' AS path, node ->> '$.sha256' AS sha256 FROM nodes
           WHERE json_type(node) = 'OBJECT' AND node ->> '$.path' IS NOT NULL AND node ->> '$.sha256' IS NOT NULL),
files AS (SELECT 'orders/' || o_orderkey AS path, sha256('orders/' || o_orderkey || CASE WHEN o_orderkey % 19 = 0 THEN '!' ELSE '' END) AS found FROM orders WHERE o_orderkey % 17 <> 0
          UNION ALL SELECT 'nation/' || n_nationkey, sha256('nation/' || n_nationkey) FROM nation UNION ALL SELECT 'region/' || r_regionkey, sha256('region/' || r_regionkey) FROM region),
checked AS (SELECT document, place, path, CASE WHEN NOT regexp_full_match(sha256, '[0-9a-f]{64}') THEN 'malformed' WHEN path LIKE 'orders/../../%' THEN 'outside' WHEN found IS NULL THEN 'missing'
                   WHEN found <> sha256 THEN 'stale' ELSE 'current' END AS status FROM leaves LEFT JOIN files USING (path))"""

_ISSUES = f"""k AS (SELECT c_custkey AS run FROM customer),
issues AS (SELECT run, CASE WHEN run % 23 = 0 THEN ['provisional_amendment_absent'] ELSE list_sort(list_filter([
    CASE WHEN run % 5 = 0 THEN 'provisional_amendment_not_active' END,
    CASE WHEN run % 13 = 0 THEN 'provisional_amendment_source_manifest_hash_mismatch' END,
    CASE WHEN run % 17 = 0 THEN 'model_config_provisional_modelling_disabled' END,
    CASE WHEN run % 29 = 0 THEN 'reference_row_count_invalid' END,
    CASE WHEN run % 31 = 0 THEN 'reference_missing_tickers_differ_from_amendment' END,
    CASE WHEN run % 3 = 0 OR run % 11 = 0 THEN 'universe_has_nonwaivable_provenance_issue' END], lambda x: x IS NOT NULL)) END AS issues FROM k),
asked AS (SELECT *, run % 3 = 0 AS licensed, len(issues) = 0 AS waived, run % 3 = 0 OR len(issues) = 0 AS accepted FROM issues),
found AS (SELECT run, licensed, list_sort(list_distinct(list_filter(list_concat(
    CASE WHEN accepted THEN [] ELSE list_concat(CASE WHEN run % 11 = 0 THEN ['{gates.WAIVED}', 'universe_unread'] ELSE ['{gates.WAIVED}'] END, issues) END, [
    CASE WHEN accepted AND run % 59 = 0 THEN 'universe_files_changed_since_audit' END,
    CASE WHEN run % 7 = 0 THEN 'market_input_integrity_not_passed' END,
    CASE WHEN run % 7 <> 0 AND run % 31 = 0 THEN 'market_manifest_changed_since_integrity_audit' END,
    CASE WHEN run % 37 = 0 THEN 'data_construction_not_passed' END,
    CASE WHEN run % 37 <> 0 AND accepted AND run % 41 = 0 THEN 'data_construction_not_bound_to_approved_universe' END,
    CASE WHEN run % 7 <> 0 AND run % 43 = 0 THEN 'data_construction_not_bound_to_verified_market_manifest' END,
    CASE WHEN run % 37 <> 0 AND run % 61 = 0 THEN 'construction_inputs_or_outputs_changed_since_audit' END,
    CASE WHEN run % 47 = 0 THEN 'portfolio_arithmetic_not_passed' END,
    CASE WHEN run % 47 <> 0 AND run % 53 = 0 THEN 'portfolio_arithmetic_not_bound_to_current_panels' END,
    CASE WHEN run % 47 <> 0 AND run % 53 <> 0 AND run % 67 = 0 THEN 'portfolio_arithmetic_inputs_changed_since_audit' END,
    CASE WHEN run % 19 = 0 THEN 'method_freeze_not_passed' END]), lambda x: x IS NOT NULL))) AS blockers FROM asked)"""

_GATES = f"""needs AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in ORDER_NEEDS)}) AS t(fact, needs)),
lines AS (SELECT l_orderkey, max(l_discount) < 0.1 AS shipped, max(l_quantity) < 49 AS received, min(l_tax) > 0 AS billed FROM lineitem GROUP BY 1),
o AS (SELECT * FROM orders JOIN lines ON o_orderkey = l_orderkey),
facts AS (SELECT o_orderkey AS run, 'placed' AS fact, o_orderkey % 5 <> 0 AS holds FROM o UNION ALL SELECT o_orderkey, 'priced', o_totalprice > 60000 FROM o UNION ALL SELECT o_orderkey, 'shipped', shipped FROM o
          UNION ALL SELECT o_orderkey, 'received', received FROM o UNION ALL SELECT o_orderkey, 'billed', billed FROM o UNION ALL SELECT o_orderkey, 'closed', o_orderkey % 7 <> 0 FROM o),
hit AS (SELECT run, fact, fact AS cause FROM facts WHERE NOT holds UNION SELECT h.run, n.fact, h.cause FROM hit h JOIN needs n ON n.needs = h.fact),
hidden AS (SELECT DISTINCT run, fact FROM hit WHERE fact <> cause),
causes AS (SELECT h.run, h.fact, string_agg(h.cause, ',' ORDER BY h.cause) AS causes FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hidden x WHERE x.run = h.run AND x.fact = h.cause) GROUP BY 1, 2)"""


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    status = "CASE WHEN len(blockers) > 0 THEN 'blocked' WHEN licensed THEN 'pass' ELSE 'provisional_pass' END"
    return {
        "label_maps": f"WITH {_LABELS} SELECT nation, year, members, body, sha256(body) AS sha256 FROM years",
        "label_documents": f"""WITH {_LABELS}, d AS (SELECT nation, '{{' || string_agg('"' || year || '":' || body, ',' ORDER BY year) || '}}' AS body FROM years GROUP BY nation) SELECT nation, body, sha256(body) AS sha256 FROM d""",
        "label_round_trip": f"WITH {_LABELS} SELECT nation, year, security, group_id FROM labels",
        "hash_record_leaves": f"WITH RECURSIVE {_LEAVES} SELECT document, place, path, sha256 FROM leaves",
        "hash_record_status": f"WITH RECURSIVE {_LEAVES} SELECT document, place, status FROM checked",
        "document_lineage": f"""WITH RECURSIVE {_LEAVES}, n AS (SELECT document, count(*) AS records, {", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in doc.ISSUES)},
            count(*) FILTER (WHERE status <> 'current') AS issues FROM checked GROUP BY document)
            SELECT document, records, {", ".join(doc.ISSUES)}, CASE WHEN issues = 0 THEN 'pass' ELSE 'fail' END AS status, issues > 0 AND issues = missing AS only_generated_missing FROM n""",
        "order_gates": f"""WITH RECURSIVE {_GATES} SELECT f.run, f.fact, f.holds, h.run IS NULL AS asked, coalesce(c.causes, '') AS causes
            FROM facts f LEFT JOIN hidden h ON h.run = f.run AND h.fact = f.fact LEFT JOIN causes c ON c.run = f.run AND c.fact = f.fact""",
        "amendment_issues": f"WITH {_ISSUES} SELECT run, unnest(issues) AS issue FROM issues",
        "foundation_status": f"""WITH {_ISSUES} SELECT run, {status} AS status, array_to_string(blockers, ',') AS blockers,
            CASE {status} WHEN 'pass' THEN '{gates.CONFIRMATORY}' WHEN 'provisional_pass' THEN '{gates.PROVISIONAL}' ELSE '{gates.DIAGNOSTICS}' END AS reporting_scope,
            CASE {status} WHEN 'pass' THEN 'pass' WHEN 'provisional_pass' THEN 'pass_provisional' ELSE 'blocked' END AS readiness FROM found""",
    }
