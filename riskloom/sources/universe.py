"""Universe documents: wiki tables, quote searches, chart observations, licensed lists, and their reconciliation."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import require_none, require_unique
from . import files

# Named HTML entities that wiki tables use, the sectors of a licensed list, identifiers made of tickers, share classes
# and issuers that a ticker does not tell, and the columns of the licensed list and of its worksheet.
ENTITIES = {"&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&eacute;": "é", "&amp;": "&"}
SECTORS = (
    "Communication Services", "Consumer Discretionary", "Consumer Staples", "Energy", "Financials", "Health Care", "Industrials", "Information Technology",
    "Materials", "Real Estate", "Utilities",
)
SECURITY_PREFIX, ISSUER_PREFIX, SOURCE_PREFIX = "SP100-20200102:", "ISSUER:", "wikipedia:"
SHARE_CLASSES = {"GOOG": "Class C", "GOOGL": "Class A"}
ISSUERS = {"GOOG": "ALPHABET", "GOOGL": "ALPHABET"}
LICENSED_COLUMNS = ("security_id", "issuer_id", "ticker", "share_class", "company_name", "gics_sector", "gics_sub_industry", "membership_date", "as_of_date", "source_record_id")
REFERENCE_COLUMNS = ("ticker", "company_name", "gics_sector", "gics_sub_industry", "as_of_date")
WORKSHEET_COLUMNS = (*(f"reference_{c}" for c in REFERENCE_COLUMNS), *(f"licensed_{c}" for c in LICENSED_COLUMNS), "entry_status", "review_notes")
PENDING = "pending_authorized_source"


def clean_wikitext(text: Column) -> Column:
    """Text of a wiki cell: without references, tags, templates and quotes; links by their label; entities decoded."""
    out = F.regexp_replace(text, r"(?s)<ref[^>]*/>|<ref.*?</ref>", "")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    out = F.regexp_replace(out, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1")
    out = F.regexp_replace(out, r"\[\[([^\]]+)\]\]", "$1")
    out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "'{2,}", ""), r"\s+", " "))
    return _without_entities(out)


def _without_entities(text: Column) -> Column:
    """Numbered entities, then named ones; an ampersand comes last, so that nothing is decoded twice."""
    number = r"&#(x?)([0-9A-Fa-f]+);"

    def decoded(part: Column) -> Column:
        hexadecimal = F.regexp_extract(part, number, 1) == "x"
        digits = F.regexp_extract(part, number, 2)
        code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32")

    found = F.regexp_extract_all(text, F.lit(number), F.lit(0))
    plain = F.aggregate(F.array_distinct(found), text, lambda a, part: F.replace(a, part, decoded(part)))
    for entity, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def wiki_rows(pages: DataFrame, content: str = "content") -> DataFrame:
    """The rows of all tables of a page as arrays of clean cells, in order; header rows have none."""
    rows = pages.select("*", F.posexplode(F.split(F.col(content), r"\n\|-[^\n]*\n")).alias("row", "_text"))
    cells = F.split(F.regexp_replace("_text", r"\n\|(?![-}])", "||"), r"\|\|")
    cleaned = F.transform(F.slice(cells, F.lit(2), F.size(cells)), lambda c: clean_wikitext(F.regexp_replace(c, r"(?s)\n\|\}.*$", "")))
    lead = F.when(F.ltrim("_text").startswith("|"), F.array(clean_wikitext(F.regexp_replace(F.element_at(cells, 1), r"^\s*\|", ""))))
    both = F.when(F.ltrim("_text").startswith("||"), cleaned).otherwise(F.concat(lead, cleaned))
    return rows.withColumn("cells", both).where("size(cells) > 1").drop("_text", content)


def select_quote(quotes: Column, symbol: Column) -> Column:
    """The first search result of exactly the symbol, in any case."""
    return F.try_element_at(F.filter(quotes, lambda q: F.upper(q["symbol"]) == F.upper(symbol)), F.lit(1))


def chart_observation(timestamps: Column, closes: Column, adjusted: Column, day: Column) -> Column:
    """(ts, close, adjusted) of parallel arrays at a date; null if there is none."""
    rows = F.arrays_zip(timestamps.alias("ts"), closes.alias("close"), adjusted.alias("adjusted"))
    return F.try_element_at(F.filter(rows, lambda r: F.to_date(F.timestamp_seconds(r["ts"])) == day), F.lit(1))


def research_identifiers(ticker: Column) -> Column:
    """(security_id, issuer_id, share_class) made of a ticker: the part after a point is a class, the part before it the issuer."""
    table = lambda known: F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    parts = F.split(ticker, r"\.", 2)
    return F.struct(
        F.concat(F.lit(SECURITY_PREFIX), ticker).alias("security_id"),
        F.concat(F.lit(ISSUER_PREFIX), F.coalesce(F.try_element_at(table(ISSUERS), ticker), parts[0])).alias("issuer_id"),
        F.coalesce(F.try_element_at(table(SHARE_CLASSES), ticker), F.when(F.size(parts) > 1, F.get(parts, 1)), F.lit("common")).alias("share_class"),
    )


def revision_record(path: str, root: str) -> tuple[dict, str]:
    """What a manifest says of an archived page revision, and its wikitext; the file must lie below ``root``."""
    p = files.safe_path(root, path)
    try:
        page = files.load_json(p)["query"]["pages"][0]
        revision = page["revisions"][0]
        head = {"page_title": page["title"], "revision_id": int(revision["revid"]), "revision_timestamp": revision["timestamp"]}
        content = revision["slots"]["main"]["content"]
    except (KeyError, IndexError, TypeError) as error:
        raise ValueError(f"{path}: no page revision") from error
    return head | {"payload_path": path, "payload_bytes": p.stat().st_size, "payload_sha256": files.sha256(p)}, content


def _section(pages: DataFrame, content: str, start: str, end: str) -> DataFrame:
    """The chunks of a table between two headings, one a row; a page without them fails."""
    part = F.regexp_extract(content, rf"(?is)==\s*{start}\s*==(.*?)==\s*{end}", 1)
    require_none(pages.where(part == ""), "a table is not found")
    return pages.select("*", F.posexplode(F.split(part, r"\n\|-\s*\n")).alias("row", "_chunk"))


def component_table(pages: DataFrame, content: str = "content") -> DataFrame:
    """(ticker, company_name) of the section Components: lines that begin a cell, the first a ticker, the second the name."""
    rows = _section(pages, content, "Components", r"Statistics\s*==")
    cells = F.transform(F.filter(F.split("_chunk", r"\n"), lambda x: x.startswith("| ")), lambda x: F.trim(F.substring(x, 3, 1 << 20)))
    named = rows.withColumn("cells", cells).where(F.size("cells") >= 2)
    first, second = (F.get("cells", F.lit(k)) for k in (0, 1))
    return named.where(first.rlike("^[A-Z][A-Z.]*$")).select(first.alias("ticker"), clean_wikitext(second).alias("company_name"))


def sector_table(pages: DataFrame, heading: str, content: str = "content") -> DataFrame:
    """(ticker, gics_sector, gics_sub_industry) of the section ``heading``: a symbol template, then a known sector and the cell after it."""
    rows = _section(pages, content, heading, "Selected changes")
    ticker = F.trim(F.regexp_extract("_chunk", r"\{\{[^{}|]*[Ss]ymbol\|([^}|]+)", 1))
    pattern = r"\|\|\s*(" + "|".join(SECTORS) + r")\s*(?:\|\||\n\|)\s*([^|\n]+)"
    found = rows.select(ticker.alias("ticker"), *[clean_wikitext(F.regexp_extract("_chunk", pattern, k)).alias(n) for k, n in ((1, "gics_sector"), (2, "gics_sub_industry"))])
    return found.where("ticker <> '' and gics_sector <> ''").dropDuplicates(["ticker"])


def membership_with_sectors(members: DataFrame, sectors: DataFrame, as_of: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(candidates with sectors and identifiers, members without a sector)."""
    both = members.join(sectors, "ticker", "left")
    ids = research_identifiers(F.col("ticker"))
    rows = both.where("gics_sector is not null").withColumn("_ids", ids)
    named = rows.select("ticker", "company_name", "_ids.*", "gics_sector", "gics_sub_industry", F.lit(as_of).alias("membership_date"), F.lit(as_of).alias("as_of_date"), F.concat(F.lit(f"{source}:"), "ticker").alias("source_record_id")).select(*LICENSED_COLUMNS)
    return named, both.where("gics_sector is null").select("ticker")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A candidate list with at least the reference columns; tickers are there and unique."""
    rows = spark.read.option("header", True).csv(path)
    if set(REFERENCE_COLUMNS) - set(rows.columns):
        raise ValueError(f"{path}: missing {sorted(set(REFERENCE_COLUMNS) - set(rows.columns))}")
    rows = rows.select(*[F.trim(c).alias(c) for c in rows.columns])
    if rows.isEmpty():
        raise ValueError(f"{path}: no candidates")
    require_none(rows.where("ticker is null or ticker = ''"), "a candidate has no ticker")
    require_unique(rows, ["ticker"], "candidates")
    return rows


def worksheet(candidates: DataFrame) -> list[dict]:
    """Rows to fill in by hand: the reference beside blank licensed columns, in order of ticker."""
    blank = {f"licensed_{c}": "" for c in LICENSED_COLUMNS} | {"entry_status": PENDING, "review_notes": ""}
    return [{f"reference_{c}": r[c] for c in REFERENCE_COLUMNS} | blank for r in candidates.orderBy("ticker").collect()]


def read_worksheet(path: str) -> list[dict]:
    """A filled worksheet: exactly its columns, trimmed, not empty."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        reader = csv.DictReader(f)
        if (found := set(reader.fieldnames or [])) != set(WORKSHEET_COLUMNS):
            raise ValueError(f"worksheet columns: missing {sorted(set(WORKSHEET_COLUMNS) - found)}, extra {sorted(found - set(WORKSHEET_COLUMNS))}")
        rows = [{c: (r[c] or "").strip() for c in WORKSHEET_COLUMNS} for r in reader]
    if not rows:
        raise ValueError("the worksheet is empty")
    return rows


def licensed_rows(rows: list[dict], preview: int = 8) -> list[dict]:
    """The licensed part of a worksheet; blanks fail with the first few of them."""
    out = [{c: r[f"licensed_{c}"] for c in LICENSED_COLUMNS} for r in rows]
    blanks = [f"{r['reference_ticker'] or '<unknown>'}: {', '.join(c for c in LICENSED_COLUMNS if not own[c])}" for r, own in zip(rows, out) if not all(own.values())]
    if blanks:
        raise ValueError(f"licensed fields are blank: {'; '.join(blanks[:preview])}" + (f"; plus {len(blanks) - preview} more" if len(blanks) > preview else ""))
    return out


def secondary_identifiers(rows: list[dict]) -> list[str]:
    """Identifiers that were made of tickers or taken from a secondary source; they cannot stand in a licensed list."""
    rules = (("security_id", SECURITY_PREFIX, "synthetic candidate security_id"), ("issuer_id", ISSUER_PREFIX, "synthetic candidate issuer_id"), ("source_record_id", SOURCE_PREFIX, "secondary-source record ID"))
    return [f"{r['ticker']}: {what}" for r in rows for field, prefix, what in rules if r[field].startswith(prefix)]


def licensed_summary(candidates: DataFrame, licensed: DataFrame, as_of: str) -> dict:
    """How a licensed list compares with the candidates: tickers of one side only, differing sectors, rows of another date; pass if none."""
    found = reconcile(candidates, licensed, "ticker", ["gics_sector", "gics_sub_industry"]).collect()
    other = sorted(r.ticker for r in licensed.where(~F.col("as_of_date").cast("string").eqNullSafe(F.lit(as_of))).collect())
    sides = {kind: sorted(r.ticker for r in found if r.finding == kind) for kind in ("missing", "extra")}
    differing = [{"ticker": r.ticker, "field": r.field, "candidate": r.left_value, "licensed": r.right_value} for r in sorted(found, key=lambda r: (r.ticker, r.field or "")) if r.finding == "different"]
    return {"status": "pass" if not found and not other else "fail", **{f"{k}_tickers": v for k, v in sides.items()}, "differences": differing, "as_of_mismatches": other}


def finalised_worksheet(spark: SparkSession, candidates: DataFrame, path: str, out: str, as_of: str) -> int:
    """Writes the licensed list of a filled worksheet, if its tickers are the candidates' in order, nothing is blank, no identifier is
    secondary, the strict reader accepts it and it reconciles. Nothing is written otherwise."""
    rows = read_worksheet(path)
    if [r["reference_ticker"] for r in rows] != [r.ticker for r in candidates.orderBy("ticker").collect()]:
        raise ValueError("the worksheet's tickers are not the candidates'")
    own = licensed_rows(rows)
    if secondary := secondary_identifiers(own):
        raise ValueError(f"secondary identifiers: {'; '.join(secondary[:8])}")
    fresh = Path(out).with_name(f"{Path(out).stem}.pending.csv")  # readers skip names that begin with a point
    try:
        files.write_csv(fresh, sorted(own, key=lambda r: r["ticker"]), list(LICENSED_COLUMNS))
        summary = licensed_summary(candidates, licensed_universe(spark, str(fresh)), as_of)
        if summary["status"] != "pass":
            raise ValueError(f"the licensed list does not reconcile: {summary}")
        fresh.replace(out)
    finally:
        fresh.unlink(missing_ok=True)
    return len(own)


def source_manifest(revisions: dict[str, dict], licensed_path: str, root: str, reconciliation: dict, checks: dict[str, bool], source_name: str | None = None, license_reference: str | None = None) -> dict:
    """Where a universe comes from: page revisions, the licensed list if it is there, how both compare, and whether that is enough."""
    p = files.safe_path(root, licensed_path)
    record = {"path": licensed_path, "sha256": files.sha256(p), "source_name": source_name, "license_reference": license_reference} if p.is_file() else None
    accepted = record is not None and bool(source_name) and bool(license_reference) and reconciliation.get("status") == "pass" and all(checks.values())
    return {
        "schema_version": 2, "secondary_sources": revisions, "licensed_source": record, "reconciliation": reconciliation, "checks": dict(sorted(checks.items())),
        "provenance_status": "pass" if accepted else "pending_licensed_source",
    }


def licensed_universe(spark: SparkSession, path: str) -> DataFrame:
    """A strict list, sorted by ticker: exactly the licensed columns in order, no blank, a known sector, an ISO date, unique tickers and
    security ids."""
    names = list(LICENSED_COLUMNS)
    rows = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(", ".join(f"{n} string" for n in names)).csv(path)
    plain = {n: F.trim(F.regexp_replace(n, "^\ufeff", "")) for n in names}
    days = {n: F.try_to_timestamp(plain[n], F.lit("yyyy-MM-dd")).cast("date") for n in ("membership_date", "as_of_date")}
    rows = rows.select(*[(plain | days)[n].alias(n) for n in names])
    blank = " or ".join(f"{n} is null or cast({n} as string) = ''" for n in names)
    require_none(rows.where(blank), "blank cell or invalid date")
    require_none(rows.where(~F.col("gics_sector").isin(*SECTORS)), "unknown sector")
    for key in ("ticker", "security_id"):
        require_unique(rows, [key], "licensed universe")
    return rows.orderBy("ticker")


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that only one side has, and field by field what differs, nulls being equal to nulls."""
    a, b = (df.select(key, *[F.col(f).cast("string").alias(f"{s}_{f}") for f in fields], F.lit(True).alias(f"in_{s}")) for df, s in ((left, "l"), (right, "r")))
    both = a.join(b, key, "full_outer")
    alone = both.where("in_l is null or in_r is null").select(
        key, F.when(F.col("in_r").isNull(), "missing").otherwise("extra").alias("finding"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left_value"), F.col(f"r_{f}").alias("right_value")) for f in fields]))
    differ = both.where("in_l and in_r").select(key, F.lit("different").alias("finding"), pairs.alias("p")).select(key, "finding", "p.*")
    return alone.unionByName(differ.where(~F.col("left_value").eqNullSafe(F.col("right_value"))))
