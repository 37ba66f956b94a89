"""Verification of input files against their manifest: every defect is a row (scope, reason), so one run finds them all.

Files are read by tasks (text lines, whole binaries, JSON documents); what a manifest declares meets what was observed by joins.
Paths in manifests are relative to a root folder and are canonical: one place for each date, and for each ticker and kind.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import safe_path

# Columns of a daily file; kinds of reference documents and the date that each result of a kind has; folders.
DAILY_COLUMNS = ("close", "high", "low", "open", "ticker", "transactions", "volume", "window_start")
EVENT_DATES = {"splits": "execution_date", "dividends": "ex_dividend_date"}
DAILY_FOLDER = "day_aggs"
DAILY_FIELDS = ("date", "key", "local_path", "size", "row_count", "sha256", "etag", "columns")
REFERENCE_FIELDS = ("ticker", "event_type", "local_path", "payload_bytes", "rows", "sha256", "schema_version", "sample_start", "sample_end", "request")
DAILY_RECORD = "date string, key string, local_path string, size long, row_count long, sha256 string, etag string, columns array<string>, status string"
REFERENCE_RECORD = (
    "ticker string, event_type string, local_path string, payload_bytes long, rows long, sha256 string, schema_version int, sample_start string, sample_end string, status string"
)
STATUSES = ("downloaded", "existing")


def daily_key(day: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.date_format(day, "yyyy/MM/yyyy-MM-dd"), F.lit(".csv.gz"))


def daily_path(day: Column, market_folder: str) -> Column:
    return daily_key(day, f"{market_folder.rstrip('/')}/{DAILY_FOLDER}")


def reference_path(ticker: Column, kind: Column, folder: str) -> Column:
    return F.concat_ws("/", F.lit(folder.rstrip("/")), kind, F.concat(F.replace(ticker, F.lit("."), F.lit("_")), F.lit(".json")))


def inspected_daily(spark: SparkSession, root: str, paths: list[str], required: DataFrame | None = None) -> DataFrame:
    """(local_path, columns, row_count, wrong_fields, wrong_times, session, off_date_rows, required_dates) of gzipped CSV files: the
    header, rows, rows with another number of fields than it, rows without a timestamp, the commonest UTC date (the first of equal
    ones), rows of other dates, and the dates that rows of ``required`` tickers have."""
    base = Path(root).resolve().as_posix()
    lines = spark.read.text([safe_path(root, p).as_posix() for p in paths]).withColumn("file", F.input_file_name())
    local = F.regexp_replace(F.regexp_replace("file", "^file:/+", "/"), "^" + base.replace(".", r"\.") + "/", "")
    lines = lines.withColumn("local_path", local).where("trim(value) <> ''").withColumn("fields", F.split("value", ","))
    is_header = F.array_contains("fields", "window_start") & F.array_contains("fields", "ticker")
    header = lines.where(is_header).groupBy("local_path").agg(F.min("fields").alias("columns"))
    rows = lines.where(~is_header).join(header, "local_path", "left")
    cell = lambda name: F.try_element_at("fields", F.coalesce(F.array_position("columns", name).cast("int"), F.lit(1 << 20)))
    stamp = F.expr("try_cast(stamp as bigint)")
    rows = rows.withColumns({"stamp": cell("window_start"), "ticker": cell("ticker"), "whole": F.size("fields") == F.size("columns")})
    rows = rows.withColumn("day", F.when(stamp >= 0, F.to_date(F.timestamp_seconds(F.floor(stamp / 1_000_000_000)))))
    wanted = required.select("ticker").distinct().withColumn("needed", F.lit(True)) if required is not None else None
    rows = rows.join(F.broadcast(wanted), "ticker", "left") if wanted is not None else rows.withColumn("needed", F.lit(None).cast("boolean"))
    days = rows.groupBy("local_path", "day").agg(
        F.count("*").alias("n"), F.count_if(~F.col("whole")).alias("wrong"), F.count_if(F.col("needed")).alias("needed"), F.min("columns").alias("columns")
    )
    found = days.groupBy("local_path").agg(
        F.sum("n").alias("row_count"),
        F.sum("wrong").alias("wrong_fields"),
        F.sum(F.when(F.col("day").isNull(), F.col("n")).otherwise(0)).alias("wrong_times"),
        F.max(F.struct(F.when(F.col("day").isNotNull(), F.col("n")).alias("n"), (-F.unix_date("day")).alias("order"), "day")).alias("best"),
        F.sort_array(F.collect_set(F.when(F.col("needed") > 0, F.col("day")))).alias("required_dates"),
    )
    out = header.join(found, "local_path", "full_outer")
    return out.select(
        "local_path", F.sort_array("columns").alias("columns"), F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"), F.coalesce("wrong_fields", F.lit(0).cast("long")).alias("wrong_fields"),
        F.coalesce("wrong_times", F.lit(0).cast("long")).alias("wrong_times"), F.col("best.day").alias("session"), (F.col("row_count") - F.coalesce("best.n", F.lit(0).cast("long"))).alias("off_date_rows"), "required_dates",
    )


def digests(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(local_path, size, sha256) of the files that exist."""
    there = [(p, safe_path(root, p).as_posix()) for p in paths if safe_path(root, p).is_file()]
    if not there:
        return spark.createDataFrame([], "local_path string, size long, sha256 string")
    names = spark.createDataFrame(there, "local_path string, file string")
    read = spark.read.format("binaryFile").load([f for _, f in there])
    found = read.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return names.join(found, "file").drop("file")


def _reasons(rows: DataFrame, scope: Column, rules: dict[str, Column]) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(reason)) for reason, test in rules.items()]))
    return rows.select(scope.alias("scope"), F.explode(codes).alias("reason"))


def _is_digest(c: str) -> Column:
    return F.col(c).rlike("^[0-9a-f]{64}$")


def daily_defects(spark: SparkSession, root: str, records: list[dict], prefix: str, market_folder: str, required: DataFrame | None = None) -> DataFrame:
    """(scope, reason) of every daily record that is incomplete, not canonical, or not what its file is."""
    frame = _frame(spark, records, DAILY_RECORD)
    day = F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd")).cast("date")
    frame = frame.withColumn("day", day)
    paths = sorted({r["local_path"] for r in records if isinstance(r, dict) and isinstance(r.get("local_path"), str) and safe_path(root, r["local_path"]).is_file()})
    seen = digests(spark, root, paths)
    if paths:
        content = inspected_daily(spark, root, paths, required)
        seen = seen.join(content, "local_path", "left")
    else:
        seen = seen.withColumns({c: F.lit(None).cast(t) for c, t in (("columns", "array<string>"), ("row_count", "long"), ("wrong_fields", "long"), ("wrong_times", "long"), ("session", "date"), ("off_date_rows", "long"), ("required_dates", "array<date>"))})
    seen = seen.select(F.col("local_path"), *[F.col(c).alias(f"seen_{c}") for c in ("size", "sha256", "columns", "row_count", "wrong_fields", "wrong_times", "session", "required_dates")], F.lit(True).alias("there"))
    both = frame.join(seen, "local_path", "left")
    there = F.coalesce("there", F.lit(False))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("columns", "date", "key", "local_path", "row_count", "sha256", "size")]))
    frozen = F.array(*map(F.lit, DAILY_COLUMNS))
    rules = {
        "missing_required_field": F.size(missing) > 0,
        "invalid_date": F.col("day").isNull(),
        "key_not_canonical": ~F.col("key").eqNullSafe(daily_key(F.col("day"), prefix)),
        "local_path_not_canonical": ~F.col("local_path").eqNullSafe(daily_path(F.col("day"), market_folder)),
        "invalid_sha256": ~F.coalesce(_is_digest("sha256"), F.lit(False)),
        "invalid_count": (F.coalesce("size", F.lit(-1)) <= 0) | (F.coalesce("row_count", F.lit(-1)) <= 0),
        "invalid_status": F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES),
        "columns_not_frozen": ~F.col("columns").eqNullSafe(frozen),
        "file_absent": ~there,
        "unexpected_schema": there & ~F.col("seen_columns").eqNullSafe(frozen),
        "row_with_wrong_fields": there & (F.col("seen_wrong_fields") > 0),
        "invalid_window_start": there & (F.col("seen_wrong_times") > 0),
        "no_data_rows": there & (F.col("seen_row_count") <= 0),
        "modal_date_differs": there & ~F.col("seen_session").eqNullSafe(F.col("day")),
        "required_ticker_date_differs": there & F.exists(F.coalesce("seen_required_dates", F.array().cast("array<date>")), lambda x: x != F.col("day")),
        "size_differs": there & (F.col("size") != F.col("seen_size")),
        "row_count_differs": there & (F.col("row_count") != F.col("seen_row_count")),
        "sha256_differs": there & (F.col("sha256") != F.col("seen_sha256")),
    }
    known = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    return _reasons(both, F.concat(F.lit("daily:"), F.coalesce("date", F.lit("unknown"))), known)


def _frame(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    rows = [tuple(r.get(n) for n in names) for r in records if isinstance(r, dict)]
    return spark.createDataFrame(rows, schema)


def calendar_defects(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Recorded dates that repeat or are no session, and sessions without a record. records (date), sessions (date)."""
    counts = records.groupBy("date").agg(F.count("*").alias("n"))
    scope, day = F.lit("daily_calendar").alias("scope"), F.col("date").cast("string")
    twice = counts.where("n > 1").select(scope, F.concat(F.lit("duplicate_date:"), day).alias("reason"))
    missing = sessions.select("date").join(counts, "date", "left_anti").select(scope, F.concat(F.lit("missing_session:"), day).alias("reason"))
    foreign = counts.join(sessions.select("date"), "date", "left_anti").select(scope, F.concat(F.lit("non_session_date:"), day).alias("reason"))
    return twice.unionByName(missing).unionByName(foreign)


def expected_identities(tickers: DataFrame, kinds: tuple[str, ...] = tuple(EVENT_DATES)) -> DataFrame:
    """(ticker, event_type): every ticker with every kind of event."""
    return tickers.select("ticker").distinct().select("ticker", F.explode(F.array(*map(F.lit, kinds))).alias("event_type"))


def identity_defects(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Identities that are recorded twice, missing, or not expected."""
    keys = ["ticker", "event_type"]
    counts = records.groupBy(*keys).agg(F.count("*").alias("n"))
    scope, name = F.lit("reference_manifest").alias("scope"), F.concat_ws(":", *keys)
    say = lambda rows, what: rows.select(scope, F.concat(F.lit(f"{what}:"), name).alias("reason"))
    return say(counts.where("n > 1"), "duplicate_identity").unionByName(say(expected.join(counts, keys, "left_anti"), "missing_record")).unionByName(say(counts.join(expected, keys, "left_anti"), "unexpected_record"))


PAYLOAD = "schema_version int, provider string, ticker string, event_type string, sample_start string, sample_end string, results array<map<string,string>>"


def inspected_references(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(local_path, the document's head, rows, and what is wrong with the dates of its results)."""
    base = Path(root).resolve().as_posix()
    docs = spark.read.schema(PAYLOAD).option("multiLine", True).option("mode", "PERMISSIVE").json([safe_path(root, p).as_posix() for p in paths])
    local = F.regexp_replace(F.regexp_replace(F.input_file_name(), "^file:/+", "/"), "^" + base.replace(".", r"\.") + "/", "")
    docs = docs.withColumn("local_path", local)
    name = F.when(F.col("event_type") == "splits", "execution_date").otherwise("ex_dividend_date")
    texts = F.transform("results", lambda r: F.when(r.isNotNull(), F.try_element_at(r, name)))
    docs = docs.withColumn("texts", texts)
    dates = F.transform("texts", lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"))
    docs = docs.withColumn("dates", dates)
    low, high = (F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).cast("date") for c in ("sample_start", "sample_end"))
    return docs.select(
        "local_path", "schema_version", "provider", "ticker", "event_type", "sample_start", "sample_end", F.col("results").isNotNull().alias("is_list"), F.size("results").cast("long").alias("rows"),
        F.exists("texts", lambda x: x.isNull() | (F.trim(x) == "")).alias("without_date"),
        F.exists(F.arrays_zip("texts", "dates"), lambda x: x["texts"].isNotNull() & (F.trim(x["texts"]) != "") & x["dates"].isNull()).alias("invalid_date"),
        F.exists("dates", lambda x: (x < low) | (x > high)).alias("outside_sample"),
        (F.col("dates") != F.array_sort("dates")).alias("not_sorted"),
    )


def reference_defects(spark: SparkSession, root: str, records: list[dict], folder: str, provider: str, sample: tuple[str, str]) -> DataFrame:
    """(scope, reason) of every reference record that is incomplete, not canonical, or not what its document is."""
    frame = _frame(spark, records, REFERENCE_RECORD)
    paths = sorted({r["local_path"] for r in records if isinstance(r, dict) and isinstance(r.get("local_path"), str) and safe_path(root, r["local_path"]).is_file()})
    if paths:
        docs = inspected_references(spark, root, paths)
        seen = docs.select("local_path", *[F.col(c).alias(f"seen_{c}") for c in docs.columns if c != "local_path"]).join(digests(spark, root, paths).withColumnsRenamed({"size": "seen_size", "sha256": "seen_sha256"}), "local_path").withColumn("there", F.lit(True))
    else:
        seen = frame.limit(0).select("local_path", *[F.lit(None).cast(t).alias(f"seen_{c}") for c, t in (
            ("schema_version", "int"), ("provider", "string"), ("ticker", "string"), ("event_type", "string"), ("sample_start", "string"), ("sample_end", "string"), ("is_list", "boolean"), ("rows", "long"),
            ("without_date", "boolean"), ("invalid_date", "boolean"), ("outside_sample", "boolean"), ("not_sorted", "boolean"), ("size", "long"), ("sha256", "string"), ("there", "boolean"),
        )]).withColumnRenamed("seen_there", "there")
    both = frame.join(seen, "local_path", "left")
    there = F.coalesce("there", F.lit(False))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("event_type", "local_path", "payload_bytes", "rows", "sample_end", "sample_start", "schema_version", "sha256", "ticker")]))
    differs = lambda a, b: there & ~F.col(a).eqNullSafe(F.col(b))
    rules = {
        "missing_required_field": F.size(missing) > 0,
        "local_path_not_canonical": ~F.col("local_path").eqNullSafe(reference_path(F.col("ticker"), F.col("event_type"), folder)),
        "invalid_sha256": ~F.coalesce(_is_digest("sha256"), F.lit(False)),
        "schema_version_not_frozen": F.col("schema_version") != 1,
        "sample_not_frozen": (F.col("sample_start") != sample[0]) | (F.col("sample_end") != sample[1]),
        "invalid_status": F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES),
        "file_absent": ~there,
        "unsupported_schema": there & ~F.col("seen_schema_version").eqNullSafe(F.lit(1)),
        "provider_differs": there & ~F.col("seen_provider").eqNullSafe(F.lit(provider)),
        "identity_differs": differs("ticker", "seen_ticker") | differs("event_type", "seen_event_type"),
        "sample_differs": there & (~F.col("seen_sample_start").eqNullSafe(F.lit(sample[0])) | ~F.col("seen_sample_end").eqNullSafe(F.lit(sample[1]))),
        "results_not_a_list": there & ~F.coalesce("seen_is_list", F.lit(False)),
        "result_without_date": there & F.col("seen_without_date"),
        "result_with_invalid_date": there & F.col("seen_invalid_date"),
        "result_outside_sample": there & F.col("seen_outside_sample"),
        "results_not_sorted": there & F.col("seen_not_sorted"),
        "payload_bytes_differs": differs("payload_bytes", "seen_size"),
        "rows_differs": differs("rows", "seen_rows"),
        "sha256_differs": differs("sha256", "seen_sha256"),
    }
    known = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    return _reasons(both, F.concat(F.lit("reference:"), F.coalesce("ticker", F.lit("")), F.lit(":"), F.coalesce("event_type", F.lit(""))), known)


def manifest_defects(manifest: dict, expected_references: int) -> list[tuple[str, str]]:
    """Totals that a manifest declares and its lists do not have, and entries that are no records."""
    daily, refs = manifest.get("daily_files") or [], manifest.get("reference_downloads") or []
    sizes = sum(int(r.get("size") or 0) for r in daily if isinstance(r, dict))
    tests = (
        (manifest.get("schema_version") == 2, "manifest", "unsupported_schema_version"),
        (manifest.get("daily_file_count") == len(daily), "daily_manifest", "daily_file_count_mismatch"),
        (manifest.get("daily_compressed_bytes") == sizes, "daily_manifest", "daily_compressed_bytes_mismatch"),
        (manifest.get("reference_status") == "complete", "reference_manifest", "reference_status_not_complete"),
        (manifest.get("reference_file_count") == len(refs), "reference_manifest", "reference_file_count_mismatch"),
        (len(refs) == expected_references, "reference_manifest", "reference_count_mismatch"),
    )
    odd = [(f"{kind}:unknown", "record_not_object") for kind, rows in (("daily", daily), ("reference", refs)) for r in rows if not isinstance(r, dict)]
    return [(scope, reason) for ok, scope, reason in tests if not ok] + odd


def verify_inputs(
    spark: SparkSession, root: str, manifest: dict, sessions: DataFrame, tickers: DataFrame, prefix: str, market_folder: str, reference_folder: str, provider: str, sample: tuple[str, str], required: DataFrame | None = None
) -> dict:
    """Everything above in one result: status, errors in order, and the counts of verified files."""
    daily, refs = ([r for r in manifest.get(k) or [] if isinstance(r, dict)] for k in ("daily_files", "reference_downloads"))
    expected = expected_identities(tickers)
    parts = [
        daily_defects(spark, root, daily, prefix, market_folder, required),
        calendar_defects(_frame(spark, daily, DAILY_RECORD).select(F.to_date("date").alias("date")), sessions),
        identity_defects(_frame(spark, refs, REFERENCE_RECORD), expected),
        reference_defects(spark, root, refs, reference_folder, provider, sample),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    found = sorted({(r.scope, r.reason) for r in rows.collect()} | set(manifest_defects(manifest, expected.count())))
    broken = {scope for scope, _ in found}
    return {
        "status": "fail" if found else "pass",
        "errors": [{"scope": s, "reason": r} for s, r in found],
        "verified_daily_files": sum(f"daily:{r.get('date')}" not in broken for r in daily),
        "verified_reference_files": sum(f"reference:{r.get('ticker')}:{r.get('event_type')}" not in broken for r in refs),
    }


def upgraded_manifest(spark: SparkSession, root: str, manifest: dict, reference_folder: str) -> dict:
    """A manifest of version 1 with what version 2 declares besides, observed anew: rows and columns of daily files, and the canonical
    path of each reference document. Other versions stay as they are."""
    if manifest.get("schema_version") != 1:
        return manifest
    daily, refs = manifest.get("daily_files"), manifest.get("reference_downloads")
    if not isinstance(daily, list) or not isinstance(refs, list) or not all(isinstance(r, dict) for r in [*daily, *refs]):
        raise ValueError("a manifest of version 1 needs lists of records")
    paths = [r["local_path"] for r in daily]
    absent = [p for p in paths if not safe_path(root, p).is_file()]
    if absent:
        raise ValueError(f"daily files are absent: {absent[:5]}")
    seen = {r.local_path: r for r in inspected_daily(spark, root, paths).collect()} if paths else {}
    return manifest | {
        "schema_version": 2,
        "daily_files": [r | {"row_count": seen[r["local_path"]].row_count, "columns": list(seen[r["local_path"]].columns)} for r in daily],
        "reference_downloads": [r | {"local_path": f"{reference_folder.rstrip('/')}/{r['event_type']}/{r['ticker'].replace('.', '_')}.json"} for r in refs],
        "reference_file_count": len(refs),
    }


def public_manifest(manifest: dict) -> dict:
    """What identifies the inputs, without times, statuses and whatever else the run of a download left."""
    pick = lambda rows, names: [{n: r[n] for n in names if n in r} for r in rows or []]
    daily = sorted(pick(manifest.get("daily_files"), DAILY_FIELDS), key=lambda r: r["date"])
    refs = sorted(pick(manifest.get("reference_downloads"), REFERENCE_FIELDS), key=lambda r: (r["ticker"], r["event_type"]))
    return {
        "schema_version": 2, "manifest_type": "market_input_manifest", **{k: manifest.get(k) for k in ("provider", "sample_start", "sample_end")},
        "verification_status": "pending_independent_verification", "daily_file_count": len(daily), "daily_compressed_bytes": sum(int(r.get("size", 0)) for r in daily), "daily_files": daily,
        "reference_file_count": len(refs), "reference_status": "complete" if manifest.get("reference_status") == "complete" else "incomplete", "reference_files": refs,
    }


def without_volatile(root: str, manifest: dict, field: str = "downloaded_at") -> dict:
    """Takes a field out of every reference document on disk and gives the manifest with their new sizes and digests."""
    from .files import sha256, write_json

    records = []
    for r in manifest.get("reference_downloads", []):
        path = safe_path(root, r["local_path"])
        payload = json.loads(path.read_text("utf-8"))
        if payload.pop(field, None) is not None:
            write_json(path, payload)
        records.append({k: v for k, v in r.items() if k != field} | {"payload_bytes": path.stat().st_size, "sha256": sha256(path)})
    return manifest | {"reference_downloads": records}


def primary_and_ancillary(daily: DataFrame, segments: DataFrame, ancillary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified daily rows as mapped primary rows, and closes of ancillary tickers, of which there may be one a date."""
    from ..operators.panel import map_segments
    from ..operators.quality import require_unique

    closes = daily.join(ancillary.select("ticker").distinct(), "ticker", "left_semi").select("ticker", "date", "close")
    require_unique(closes, ["ticker", "date"], "ancillary closes")
    return map_segments(daily, segments), closes


def bound_table(spark: SparkSession, path: str, audit: dict, columns: list[str], models: set[str] | None = None, root: str = ".") -> DataFrame:
    """A Parquet table, if the audit passed and names the file's digest, with exactly ``columns`` present and all of ``models``."""
    from .files import sha256, table

    record = next((o for o in audit.get("outputs", []) if o.get("path") == path), None)
    if audit.get("status") != "pass" or record is None or sha256(safe_path(root, path)) != record.get("sha256"):
        raise ValueError(f"{path} is not bound to a passed audit")
    rows = table(spark, safe_path(root, path).as_posix(), columns)
    if models is not None:
        found = {r[0] for r in rows.select("model_id").distinct().collect()}
        if not models <= found:
            raise ValueError(f"{path}: no rows of {sorted(models - found)}")
        rows = rows.where(F.col("model_id").isin(*models))
    return rows
