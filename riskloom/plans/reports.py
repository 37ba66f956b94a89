"""Report tables, figures and documents from audited results. Tables are small plans; figures are SVG text with nothing in them that
depends on the time or the machine; each artifact is written whole or not at all and listed with its digest."""

from __future__ import annotations

import math
from collections.abc import Iterable
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scenario
from ..operators.quality import ConstraintError
from ..sources import files


def in_order(rows: list[dict], key: str, order: list[str]) -> list[dict]:
    """Rows in a frozen order; they must be exactly those of the order, once each."""
    by_key = {r[key]: r for r in rows}
    if len(by_key) != len(rows) or set(by_key) != set(order):
        raise ConstraintError(f"{key}: {sorted(map(str, by_key))}, not {order}")
    return [by_key[x] for x in order]


def performance_rows(summaries: DataFrame, labels: dict[str, str], order: list[str]) -> list[dict]:
    rows = in_order([r.asDict() for r in summaries.collect()], "model_id", order)
    return [{"position": i, "label": labels[r["model_id"]], **r} for i, r in enumerate(rows, 1)]


def accuracy_rows(tests: DataFrame, size: int) -> list[dict]:
    """Accuracy tests by pair and score; another number of them fails."""
    rows = [r.asDict() for r in tests.orderBy("model_id", "baseline_id", "score").collect()]
    if len(rows) != size:
        raise ConstraintError(f"{len(rows)} accuracy tests, not {size}")
    return rows


def calibration_rows(calibration: DataFrame, order: list[str]) -> list[dict]:
    rows = [r.asDict() for r in scenario.calibration_table(calibration).collect()]
    place = {m: i for i, m in enumerate(order)}
    if {r["model_id"] for r in rows} != set(order):
        raise ConstraintError("calibration of other models")
    return sorted(rows, key=lambda r: (place[r["model_id"]], r["level"]))


def hypothesis_rows(gap: dict, copula: dict, integrated: dict) -> list[dict]:
    """The three conclusions, each with its evidence in one sentence."""
    return [
        {"hypothesis": "H1", "status": gap["status"], "evidence": f"mean gap difference {gap['mean']:.6g}, interval [{gap['lower']:.6g}, {gap['upper']:.6g}], {gap['replications']} replications"},
        {"hypothesis": "H2", "status": copula["status"], "evidence": f"{copula['for_model']} of {copula['tests']} adjusted tests favour the vine, {copula['for_baseline']} the Gaussian copula"},
        {"hypothesis": "H3", "status": integrated["status"], "evidence": f"first rank: {', '.join(integrated['unique_first_rank_models'])}; best eligible model: {integrated['best_eligible_model'] or 'none'}"},
    ]


def clustering_rows(gaps: DataFrame, agreement: DataFrame, order: list[str]) -> list[dict]:
    """(grouping, year): gaps, balanced gaps and agreement with the given groups, by the frozen order of groupings and by year."""
    rows = gaps.join(agreement.select("grouping_id", "year", "ari", "nmi"), ["grouping_id", "year"], "left")
    place = {g: i for i, g in enumerate(order)}
    found = [r.asDict() for r in rows.select("grouping_id", "year", "within_mean", "between_mean", "gap", "balanced_gap", "ari", "nmi").collect()]
    if {r["grouping_id"] for r in found} != set(order):
        raise ConstraintError("diagnostics of other groupings")
    return sorted(found, key=lambda r: (place[r["grouping_id"]], r["year"]))


def robustness_rows(parts: dict[str, dict]) -> list[dict]:
    """One row a robustness analysis, in the given order: tests, how many favour either side after adjustment, and what it changes."""
    return [{"analysis": name, "tests": p["tests"], "favour_variant": p["for_model"], "favour_reference": p["for_baseline"], "direction": "variant" if p["for_model"] and not p["for_baseline"] else "reference" if p["for_baseline"] and not p["for_model"] else "mixed" if p["for_model"] else "none", "core_conclusions_revised": False} for name, p in parts.items()]


def support_counts(tests: DataFrame) -> dict:
    return tests.agg(F.count("*").alias("tests"), F.count_if("favours_model").alias("for_model"), F.count_if("favours_baseline").alias("for_baseline")).first().asDict()


# Figures.

WIDTH, HEIGHT, LEFT, BOTTOM, TOP, RIGHT = 720, 420, 70, 60, 40, 20


def _n(x: float) -> str:
    return f"{x:.2f}".rstrip("0").rstrip(".")


class Canvas:
    """SVG text with axes; numbers have two places, so the same data give the same bytes."""

    def __init__(self, title: str, low: float, high: float):
        if not (math.isfinite(low) and math.isfinite(high)):
            raise ValueError("a figure's limits are not finite")
        pad = (high - low) * 0.05 or abs(high) * 0.05 or 1.0
        self.low, self.high, self.parts = low - pad, high + pad, []
        self.text(WIDTH / 2, TOP / 2 + 4, title, 15, "middle")
        for k in range(6):
            value = self.low + (self.high - self.low) * k / 5
            self.line([(LEFT, self.y(value)), (WIDTH - RIGHT, self.y(value))], "#e0e0e0", 1)
            self.text(LEFT - 6, self.y(value) + 4, f"{value:.4g}", 10, "end")

    def y(self, value: float) -> float:
        return HEIGHT - BOTTOM - (value - self.low) / (self.high - self.low) * (HEIGHT - BOTTOM - TOP)

    def x(self, share: float) -> float:
        return LEFT + share * (WIDTH - LEFT - RIGHT)

    def text(self, x: float, y: float, value: str, size: int = 11, anchor: str = "middle") -> None:
        self.parts.append(f'<text x="{_n(x)}" y="{_n(y)}" font-size="{size}" text-anchor="{anchor}" font-family="sans-serif">{escape(value)}</text>')

    def line(self, points: Iterable[tuple[float, float]], colour: str, width: float = 1.5) -> None:
        self.parts.append(f'<polyline fill="none" stroke="{colour}" stroke-width="{_n(width)}" points="{" ".join(f"{_n(a)},{_n(b)}" for a, b in points)}"/>')

    def box(self, x: float, y: float, width: float, height: float, colour: str) -> None:
        self.parts.append(f'<rect x="{_n(x)}" y="{_n(y)}" width="{_n(width)}" height="{_n(height)}" fill="{colour}"/>')

    def dot(self, x: float, y: float, colour: str) -> None:
        self.parts.append(f'<circle cx="{_n(x)}" cy="{_n(y)}" r="3" fill="{colour}"/>')

    def legend(self, entries: dict[str, str]) -> None:
        for k, (name, colour) in enumerate(entries.items()):
            self.box(LEFT + 10 + 160 * (k % 4), HEIGHT - 22 + 12 * (k // 4), 10, 10, colour)
            self.text(LEFT + 25 + 160 * (k % 4), HEIGHT - 13 + 12 * (k // 4), name, 10, "start")

    def svg(self) -> str:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}">\n<rect width="{WIDTH}" height="{HEIGHT}" fill="#ffffff"/>\n' + "\n".join(self.parts) + "\n</svg>\n"


def gap_figure(rows: list[dict], labels: dict[str, str], palette: dict[str, str]) -> str:
    """Annual dependence gaps, one line a grouping."""
    years = sorted({r["year"] for r in rows})
    c = Canvas("Annual dependence gap", min(r["gap"] for r in rows), max(r["gap"] for r in rows))
    at = {y: c.x((i + 0.5) / len(years)) for i, y in enumerate(years)}
    for y in years:
        c.text(at[y], HEIGHT - BOTTOM + 16, str(y))
    for g in palette:
        own = sorted((r for r in rows if r["grouping_id"] == g), key=lambda r: r["year"])
        c.line([(at[r["year"]], c.y(r["gap"])) for r in own], palette[g])
        for r in own:
            c.dot(at[r["year"]], c.y(r["gap"]), palette[g])
    c.legend({labels[g]: palette[g] for g in palette})
    return c.svg()


def rank_figure(rows: list[dict]) -> str:
    """Average ranks of the models, best first."""
    ordered = sorted(rows, key=lambda r: (r["average_primary_score_rank"], r["model_id"]))
    c = Canvas("Average rank over the primary scores", 0.0, max(r["average_primary_score_rank"] for r in rows))
    for i, r in enumerate(ordered):
        left, width, top = c.x((i + 0.15) / len(ordered)), c.x(0.7 / len(ordered)) - LEFT, c.y(r["average_primary_score_rank"])
        c.box(left, top, width, c.y(0.0) - top, "#4C78A8")
        c.text(left + width / 2, HEIGHT - BOTTOM + 16, r["model_id"])
        c.text(left + width / 2, top - 4, f"{r['average_primary_score_rank']:.3g}", 10)
    return c.svg()


def exception_figure(rows: list[dict], levels: tuple[float, ...] = (0.95, 0.99)) -> str:
    """Observed exception rates against the nominal ones, as lines."""
    models = list(dict.fromkeys(r["model_id"] for r in rows))
    c = Canvas("Value-at-risk exception rates", 0.0, max([r["exception_rate"] for r in rows] + [1 - min(levels)]))
    for k, level in enumerate(levels):
        colour = ("#4C78A8", "#F58518", "#54A24B")[k]
        c.line([(LEFT, c.y(1 - level)), (WIDTH - RIGHT, c.y(1 - level))], colour, 1)
        for i, m in enumerate(models):
            for r in rows:
                if r["model_id"] == m and math.isclose(r["level"], level):
                    c.dot(c.x((i + 0.4 + 0.2 * k) / len(models)), c.y(r["exception_rate"]), colour)
    for i, m in enumerate(models):
        c.text(c.x((i + 0.5) / len(models)), HEIGHT - BOTTOM + 16, m)
    c.legend({f"{level:.0%}": ("#4C78A8", "#F58518", "#54A24B")[k] for k, level in enumerate(levels)})
    return c.svg()


def loss_figure(days: list[dict], model: str) -> str:
    """Daily losses of one model's dates with its 99% value at risk, exceptions marked."""
    rows = sorted(days, key=lambda r: r["date"])
    values = [v for r in rows for v in (r["realised_loss"], r["var_99"])]
    c = Canvas(f"Daily losses and 99% value at risk, {model}", min(values), max(values))
    at = [c.x((i + 0.5) / len(rows)) for i in range(len(rows))]
    c.line([(x, c.y(r["realised_loss"])) for x, r in zip(at, rows)], "#9aa5b1", 0.75)
    c.line([(x, c.y(r["var_99"])) for x, r in zip(at, rows)], "#F58518")
    for x, r in zip(at, rows):
        if r["realised_loss"] > r["var_99"]:
            c.dot(x, c.y(r["realised_loss"]), "#d62728")
    for k in (0, len(rows) // 2, len(rows) - 1):
        c.text(at[k], HEIGHT - BOTTOM + 16, str(rows[k]["date"]))
    c.legend({"loss": "#9aa5b1", "VaR 99%": "#F58518", "exception": "#d62728"})
    return c.svg()


def contingency_figure(cells: list[dict], left: str = "l", right: str = "r") -> str:
    """How many securities two partitions share, darker for more."""
    rows, columns = sorted({c[left] for c in cells}), sorted({c[right] for c in cells})
    most = max(c["n"] for c in cells)
    canvas = Canvas("Groups in common", 0.0, 1.0)
    canvas.parts = canvas.parts[:1]
    width, height = (WIDTH - LEFT * 2 - RIGHT) / len(columns), (HEIGHT - BOTTOM - TOP) / len(rows)
    count = {(c[left], c[right]): c["n"] for c in cells}
    for i, r in enumerate(rows):
        canvas.text(LEFT * 2 - 4, TOP + (i + 0.6) * height, str(r), 9, "end")
        for j, k in enumerate(columns):
            n = count.get((r, k), 0)
            shade = int(255 - 190 * n / most)
            canvas.box(LEFT * 2 + j * width, TOP + i * height, width - 1, height - 1, f"#{shade:02x}{shade:02x}ff")
            if n:
                canvas.text(LEFT * 2 + (j + 0.5) * width, TOP + (i + 0.6) * height, str(n), 9)
    for j, k in enumerate(columns):
        canvas.text(LEFT * 2 + (j + 0.5) * width, HEIGHT - BOTTOM + 14, str(k), 9)
    return canvas.svg()


# Documents.


def _table(rows: list[dict], columns: list[str]) -> list[str]:
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)]


def quality_markdown(report: dict) -> str:
    """The panel's quality report for readers."""
    flags = [{"flag": k, "rows": v} for k, v in report["quality_flag_counts"].items()]
    fates = [{"disposition": k, "events": v} for k, v in report["reference_event_disposition_counts"].items()]
    lines = ["# Data quality report", "", f"Gate status: **{report['gate_status']}**", "", f"* Candidates: {report['candidate_securities']}, included: {report['included_securities']}"]
    lines += [f"* {name.replace('_', ' ').capitalize()}: {report[name]}" for name in ("duplicate_security_dates", "nonpositive_closes", "missing_log_returns", "lifecycle_issues")]
    lines += [f"* Missing manual actions: {', '.join(report['missing_manual_action_ids']) or 'none'}", f"* Unresolved reviews: {', '.join(report['unresolved_event_reviews']) or 'none'}"]
    lines += ["", "## Quality flags", "", *_table(flags, ["flag", "rows"]), "", "## Reference events", "", *_table(fates, ["disposition", "events"]), ""]
    return "\n".join(lines)


def results_markdown(performance: list[dict], hypotheses: list[dict], robustness: list[dict], scope: str) -> str:
    lines = ["# Results", "", f"Reporting scope: `{scope}`", "", "## Conclusions", ""]
    lines += [f"* **{h['hypothesis']}** {h['status'].replace('_', ' ')}: {h['evidence']}" for h in hypotheses]
    lines += ["", "## Models", "", *_table(performance, ["model_id", "label", "mean_quantile_loss_95", "mean_quantile_loss_99", "mean_fz0_975", "average_primary_score_rank", "overall_rank"])]
    lines += ["", "## Robustness", "", *_table(robustness, ["analysis", "tests", "favour_variant", "favour_reference", "direction"]), ""]
    return "\n".join(lines)


def write_report(root: str | Path, tables: dict[str, list[dict]], figures: dict[str, str], documents: dict[str, str], scope: str, sources: list[dict]) -> dict:
    """Writes everything below the root and a manifest of it: kind, path, size and digest of each artifact, and the sources it is from."""
    base, made = Path(root), []
    for name, rows in tables.items():
        if not rows:
            raise ConstraintError(f"{name}: an empty table")
        files.write_csv(base / "tables" / name, rows, list(rows[0]))
        made.append(("table", f"tables/{name}"))
    for name, svg in figures.items():
        files.write_text(base / "figures" / name, svg)
        made.append(("figure", f"figures/{name}"))
    for name, text in documents.items():
        files.write_text(base / name, text)
        made.append(("document", name))
    manifest = {
        "schema_version": 1, "manifest_type": "report_artifacts", "reporting_scope": scope, "sources": sources,
        "artifacts": [{"kind": kind, "path": path, "bytes": (base / path).stat().st_size, "sha256": files.sha256(base / path)} for kind, path in sorted(made)],
    }
    files.write_json(base / "report_manifest.json", manifest)
    return manifest


def submission_document(markdown: str | Path, target: str | Path, reference: str | Path | None = None) -> Path:
    """A word-processor document of a Markdown file; needs the external program pandoc."""
    import shutil
    import subprocess

    program = shutil.which("pandoc")
    if program is None:
        raise RuntimeError("a submission document needs the program pandoc")
    with files.sibling(target) as fresh:
        subprocess.run([program, str(markdown), "-f", "markdown", "-t", "docx", "-o", str(fresh), *([f"--reference-doc={reference}"] if reference else [])], check=True)
    return Path(target)
