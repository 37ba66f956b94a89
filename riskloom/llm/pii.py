"""Personal data by weak supervision, in DataFrame expressions only.

Four strict patterns with their checks always hold; looser patterns only propose. Six labelers vote on every proposal:
the strict rule, a gazetteer of endings, dialling codes and issuer prefixes, words before it that announce such data,
words before it that announce something else, its shape, and its neighbours. Votes are counted over all documents as at
most a few thousand vote patterns; expectation-maximisation on those counts estimates each labeler's reliability, and a
logistic span classifier is trained on the resulting labels. It decides which proposals join the strict spans.

Every pattern matches in one pass: runs are possessive, and a match starts only where a run starts or the last match ended.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

KINDS = ("email", "ip", "card", "phone")

# The strict patterns, and the looser ones that propose.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++"
    r"(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text with a match surely has.
MARKS = {("email", True): "@", ("phone", True): "+", ("ip", False): ":"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_PARTS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Gazetteers, cue words and shapes of the labelers.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]]?\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|us|ca)$",
    "ip": r"(?i)^(?:(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|[23][0-9a-f]{3}:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[045678]|6(?:011|4|5))",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-8])|\(?[2-9])",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|adresse|direcci[oó]n)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|mobile|cell|call|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
}
OTHER_CUES = r"(?i)\b(?:token|key|hash|isbn|issn|version|order|invoice|serial|commit|part)\b[^A-Za-z]*$"
SHAPES = {
    "email": r"(?i)^[a-z0-9][^\x20(\[]{0,63}(?:@|\x20?[(\[]at|\x20at).*[a-z]{2,}$",
    "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|:",
    "card": r"^(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{2,4}(?:[\x20-][0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
    "phone": r"[0-9]{3}[\x20().-]+[0-9]{2,4}",
}
LABELERS = ("strict", "gazetteer", "cue", "other_cue", "shape", "border")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, at: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - at, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(at % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _strictly(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_IP_PARTS)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _proposed(kind: str, match: Column, strict: bool) -> Column:
    """Failing strict matches that are still worth a vote."""
    if kind == "card":
        return F.length(_digits(match)).between(13, 19)
    return F.lit(not strict or kind == "email")


def _once(name: str, use: Column) -> Column:
    """``use`` reads column ``name`` inside a lambda. The second mention keeps the optimizer from writing the column's
    definition into the lambda, where it would be evaluated for every element."""
    return F.when(F.col(name).isNotNull(), use)


def with_running(frame: DataFrame, names: dict[str, str], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """For each (steps, results) a column of the first 1, 2, ... items of the long array ``steps``, combined from zero, by blocks of
    about the root of its size."""

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("long"), combine)

    def block(steps: str) -> Column:
        return F.ceil(F.sqrt(F.size(steps))).cast("int")

    def sums(steps: str) -> Column:
        count = ((F.size(steps) - 1) / block(steps)).cast("int")
        every = F.transform(F.sequence(F.lit(0), count), lambda b: total(F.slice(F.col(steps), b * F.col(f"{steps}_n") + 1, F.col(f"{steps}_n"))))
        return F.when(F.size(steps) > 0, every).otherwise(F.array().cast("array<bigint>"))

    def before(steps: str) -> Column:
        return _once(f"{steps}_s", F.transform(f"{steps}_s", lambda _, i: total(F.slice(F.col(f"{steps}_s"), F.lit(1), i))))

    def totals(steps: str) -> Column:
        n, start = F.col(f"{steps}_n"), F.col(f"{steps}_b")
        within = F.transform(
            steps, lambda _, i: combine(start[(i / n).cast("int")], total(F.slice(F.col(steps), (i / n).cast("int") * n + 1, i % n + 1)))
        )
        return _once(f"{steps}_b", _once(f"{steps}_n", within))

    frame = frame.withColumns({f"{x}_n": block(x) for x in names})
    frame = frame.withColumns({f"{x}_s": sums(x) for x in names})
    frame = frame.withColumns({f"{x}_b": before(x) for x in names})
    return frame.withColumns({out: totals(x) for x, out in names.items()})


def _larger(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0 if no is not None else -1)


def _votes(kind: str, match: Column, before: Column, after: Column, strict: Column) -> Column:
    joined = F.regexp_replace(match, r"[\x20()-]", "") if kind == "card" else match
    touching = F.right(before, F.lit(1)).rlike("^[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]$")
    return F.array(
        _vote(strict),
        _vote(joined.rlike(GAZETTEER[kind])),
        _vote(before.rlike(CUES[kind]), F.lit(False)),
        F.when(before.rlike(OTHER_CUES), -1).otherwise(0),
        _vote(match.rlike(SHAPES[kind])),
        _vote(~touching),
    )


def _held(docs: DataFrame) -> Column:
    """The caller's row as one column, so that no name of it meets those made here."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def proposals(docs: DataFrame) -> DataFrame:
    """(row, spans): the rows of ``docs``, each with an array of (start, kind number, end, strict, votes) of every match and proposal, in
    order; code points, end exclusive. A null text has none."""
    sources = [(k, STRICT[k], True) for k in KINDS] + [(k, p, False) for k, p in LOOSE.items()]
    frame = docs.select(_held(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    empty = F.array().cast("array<string>")

    def matches(kind: str, pattern: str, strict: bool) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        mark = MARKS.get((kind, strict))
        return F.when(F.col("text").contains(mark), found).otherwise(empty) if mark else found

    frame = frame.withColumns({f"match{i}": matches(*x) for i, x in enumerate(sources)})
    frame = frame.withColumns({f"piece{i}": F.when(F.size(f"match{i}") > 0, F.split("text", p, -1)).otherwise(empty) for i, (_, p, _) in enumerate(sources)})

    def steps(i: int) -> Column:
        return F.transform(f"match{i}", lambda m, k: (F.length(F.col(f"piece{i}")[k]) + F.length(m)).cast("long"))

    frame = frame.withColumns({f"step{i}": steps(i) for i in range(len(sources))})
    frame = with_running(frame, {f"step{i}": f"end{i}" for i in range(len(sources))}, lambda x, y: x + y)

    def spans(i: int, kind: str, strict: bool) -> Column:
        def placed(match: Column, k: Column) -> Column:
            piece, end = F.col(f"piece{i}"), F.col(f"end{i}")[k]
            return F.struct(
                (end - F.length(match)).alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                end.alias("end"),
                (_strictly(kind, match) if strict else F.lit(False)).alias("strict"),
                _proposed(kind, match, strict).alias("proposed"),
                match.alias("match"),
                F.right(piece[k], F.lit(40)).alias("before"),
                F.left(piece[k + 1], F.lit(1)).alias("after"),
            )

        def voted(s: Column) -> Column:
            votes = _votes(kind, s["match"], s["before"], s["after"], s["strict"])
            return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["strict"].alias("strict"), votes.alias("votes"))

        return F.transform(F.filter(F.transform(F.col(f"match{i}"), placed), lambda s: s["strict"] | s["proposed"]), voted)

    every = F.concat(*[spans(i, kind, strict) for i, (kind, _, strict) in enumerate(sources)])
    frame = frame.select("row", F.array_sort(every).alias("every"))
    # a proposal meets a strict span where one that starts no later reaches beyond its start, or one that starts no earlier does so before its end
    far = 1 << 40
    frame = frame.withColumns({
        "stop": F.transform("every", lambda s: F.when(s["strict"], s["end"]).otherwise(F.lit(0)).cast("long")),
        "near": F.reverse(F.transform("every", lambda s: F.when(s["strict"], F.lit(far) - s["start"]).otherwise(F.lit(0)).cast("long"))),
    })
    frame = with_running(frame, {"stop": "reached", "near": "coming"}, _larger)

    def apart(s: Column, i: Column) -> Column:
        reached, coming = F.col("reached")[i], F.lit(far) - F.col("coming")[F.size("coming") - 1 - i]
        return s["strict"] | ((reached <= s["start"]) & (coming >= s["end"]))

    return frame.select("row", _once("reached", _once("coming", F.filter("every", apart))).alias("spans"))


@dataclass
class SpanClassifier:
    """Log odds of a span: a constant, and a weight for each labeler's yes and no."""

    constant: float
    yes: list[float]
    no: list[float]

    def accepts(self, span: Column) -> Column:
        votes = span["votes"]
        odds = F.lit(self.constant)
        for k in range(len(LABELERS)):
            odds = odds + F.when(votes[k] == 1, self.yes[k]).when(votes[k] == -1, self.no[k]).otherwise(0.0)
        return span["strict"] | (odds > 0)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """Expectation-maximisation on (votes, how often): the share of true spans, each labeler's chance of each vote for true
    and for false spans, and the posterior of each pattern. It starts from the votes' majority."""
    posterior = [_sigmoid(1.5 * sum(v)) for v, _ in patterns]
    share, tables = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        true = sum(p * n for p, (_, n) in zip(posterior, patterns))
        share = (true + 1) / (total + 2)
        tables = []
        for k in range(len(LABELERS)):
            table = {}
            for vote in (-1, 0, 1):
                hits = [(p, n) for p, (v, n) in zip(posterior, patterns) if v[k] == vote]
                lean = 1.0 + 0.5 * vote  # a labeler is better than chance until shown otherwise
                table[vote] = (
                    (sum(p * n for p, n in hits) + lean) / (true + 3),
                    (sum((1 - p) * n for p, n in hits) + 2 - lean) / (total - true + 3),
                )
            tables.append(table)
        posterior = [
            _sigmoid(math.log(share / (1 - share)) + sum(math.log(tables[k][v[k]][0] / tables[k][v[k]][1]) for k in range(len(LABELERS))))
            for v, _ in patterns
        ]
    return share, tables, posterior


def train(patterns: list[tuple[tuple[int, ...], int]], steps: int = 400, rate: float = 1.0, ridge: float = 0.01) -> SpanClassifier:
    """The logistic span classifier on the patterns' posterior labels."""
    model = SpanClassifier(-0.5, [0.5] * len(LABELERS), [-1.0] * len(LABELERS))
    if not patterns:
        return model
    _, _, posterior = reliabilities(patterns)
    total = sum(n for _, n in patterns)
    for _ in range(steps):
        slope, yes, no = 0.0, [0.0] * len(LABELERS), [0.0] * len(LABELERS)
        for (votes, n), label in zip(patterns, posterior):
            odds = model.constant + sum(model.yes[k] if v == 1 else model.no[k] if v == -1 else 0.0 for k, v in enumerate(votes))
            miss = (_sigmoid(odds) - label) * n / total
            slope += miss
            for k, v in enumerate(votes):
                if v == 1:
                    yes[k] += miss
                elif v == -1:
                    no[k] += miss
        model.constant -= rate * slope
        for k in range(len(LABELERS)):
            model.yes[k] -= rate * (yes[k] + ridge * (model.yes[k] - 0.5))
            model.no[k] -= rate * (no[k] + ridge * (model.no[k] + 1.0))
    return model


def learn(docs: DataFrame) -> SpanClassifier:
    """Vote patterns of all proposals in all rows; at most 3 to the power of the labelers' number reach the driver."""
    return _learned(proposals(docs.select("text")))


def _learned(proposed: DataFrame) -> SpanClassifier:
    # explode_outer: from a plain explode the optimizer infers a filter and copies all of the above into it
    counted = proposed.select(F.explode_outer("spans").alias("s")).groupBy("s.votes").count().collect()
    return train(sorted((tuple(r.votes), r["count"]) for r in counted if r.votes))


def found(docs: DataFrame, classifier: SpanClassifier | None = None) -> DataFrame:
    """(row, spans): the rows of ``docs``, each with its strict spans and the proposals that the classifier accepts."""
    classifier = classifier or learn(docs)
    return proposals(docs).withColumn("spans", F.filter("spans", classifier.accepts))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs``.

    Null and empty texts have no spans. Strict spans of different kinds may overlap; proposals that overlap a strict span
    are left out. Repeated rows repeat their result; an empty table gives an empty result.
    """
    proposed = materialize(proposals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("row.doc_id", "spans"))
    rows = proposed.withColumn("spans", F.filter("spans", _learned(proposed).accepts)).withColumn("base", F.filter("spans", lambda s: s["strict"]))

    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, classifier: SpanClassifier | None = None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in capitals between angle brackets; other columns, whatever their names, and
    texts without spans, as they are."""
    rows = found(docs, classifier).withColumn("stop", F.transform("spans", lambda s: s["end"].cast("long")))
    rows = with_running(rows, {"stop": "reached"}, _larger)
    text, spans = F.col("row.text").cast("string"), F.col("spans")
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def piece(span: Column, i: Column) -> Column:
        before = F.when(i > 0, F.col("reached")[i - 1]).otherwise(F.lit(0).cast("long"))
        gap = F.substring(text, (before + 1).cast("int"), (span["start"] - before).cast("int"))
        return F.when(span["start"] >= before, F.concat(gap, marks[span["kind"]])).when(span["end"] <= before, "").otherwise(marks[span["kind"]])

    tail = F.substring(text, (F.element_at("reached", -1) + 1).cast("int"), F.length(text))
    masked = F.when(F.size("spans") > 0, F.concat(F.array_join(_once("reached", F.transform(spans, piece)), ""), tail)).otherwise(text)
    return rows.select(*[masked.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
