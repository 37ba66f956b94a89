"""Regular-vine copulas in NumPy: trees by largest absolute rank correlation, pair families by AIC, sequential likelihood
fits, log densities, and simulation by inverting conditional distributions variable by variable.

An edge of tree k joins two conditioned variables given k - 1 others. What a fit, a density or a simulation needs along the
way are conditional values F(variable | set), kept in a dictionary by variable and set.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..functions.special import ndtr, ndtri, t_cdf, t_ppf

LOW, HIGH = 1e-6, 1 - 1e-6
DF_LEAST, DF_MOST = 2.1, 50.0
#: Degrees of freedom that are tried, evenly in logs: every fourth first, then those around the best. Each has a table of quantiles,
#: which a worker makes once.
DF_GRID = tuple(float(x) for x in np.geomspace(DF_LEAST, DF_MOST, 45).round(4))
FAMILIES = ("gaussian", "student", "clayton", "gumbel", "frank")
_ROTATED = ("clayton", "gumbel")


def _clip(u: np.ndarray) -> np.ndarray:
    return np.clip(u, LOW, HIGH)


@lru_cache(maxsize=128)
def _table(df: float) -> tuple[np.ndarray, np.ndarray]:
    edge = np.concatenate([np.geomspace(LOW / 2, 1e-2, 250), np.linspace(1e-2, 1 - 1e-2, 501)[1:-1], 1 - np.geomspace(1e-2, LOW / 2, 250)])
    return edge, t_ppf(edge, df)


def _quantile(p: np.ndarray, df: float) -> np.ndarray:
    """Student-t quantiles read off a fine table."""
    return np.interp(p, *_table(df))


@dataclass(frozen=True)
class Pair:
    """A bivariate copula; ``turn`` flips the first, the second or both arguments: 90, 270, 180 degrees."""

    family: str = "independence"
    turn: int = 0
    theta: float = 0.0
    df: float = 0.0

    def _flip(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (1 - u if self.turn in (90, 180) else u), (1 - v if self.turn in (180, 270) else v)

    def density(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Log density."""
        u, v = self._flip(_clip(u), _clip(v))
        t = self.theta
        if self.family == "independence":
            return np.zeros_like(u)
        if self.family == "gaussian":
            x, y = ndtri(u), ndtri(v)
            return -0.5 * np.log1p(-t * t) - (t * t * (x * x + y * y) - 2 * t * x * y) / (2 * (1 - t * t))
        if self.family == "student":
            n, x, y = self.df, _quantile(u, self.df), _quantile(v, self.df)
            front = math.lgamma(n / 2 + 1) + math.lgamma(n / 2) - 2 * math.lgamma((n + 1) / 2) - 0.5 * math.log(1 - t * t)
            joint = (n + 2) / 2 * np.log1p((x * x + y * y - 2 * t * x * y) / (n * (1 - t * t)))
            return front - joint + (n + 1) / 2 * (np.log1p(x * x / n) + np.log1p(y * y / n))
        if self.family == "clayton":
            return np.log1p(t) - (1 + t) * (np.log(u) + np.log(v)) - (2 + 1 / t) * np.log(u**-t + v**-t - 1)
        if self.family == "gumbel":
            a, b = -np.log(u), -np.log(v)
            s = a**t + b**t
            r = s ** (1 / t)
            return -r + (t - 1) * (np.log(a) + np.log(b)) + a + b + (1 / t - 2) * np.log(s) + np.log(r + t - 1)
        d = -np.expm1(-t) - np.expm1(-t * u) * np.expm1(-t * v)
        return np.log(np.abs(t * -np.expm1(-t))) - t * (u + v) - 2 * np.log(np.abs(d))

    def given(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """F(u | v)."""
        u, v = self._flip(_clip(u), _clip(v))
        h = self._h(u, v)
        return _clip(1 - h if self.turn in (90, 180) else h)

    def inverse(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The u with F(u | v) = w, by bisection on the distribution, which rises in u."""
        if self.family == "independence":
            return _clip(w)
        low, high = np.full(len(w), LOW), np.full(len(w), HIGH)
        for _ in range(45):
            middle = (low + high) / 2
            below = self.given(middle, v) < w
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        return _clip((low + high) / 2)

    def turned_over(self) -> Pair:
        """The same copula with its arguments exchanged."""
        return Pair(self.family, {90: 270, 270: 90}.get(self.turn, self.turn), self.theta, self.df)

    def _h(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        t = self.theta
        if self.family == "independence":
            return u
        if self.family == "gaussian":
            return ndtr((ndtri(u) - t * ndtri(v)) / math.sqrt(1 - t * t))
        if self.family == "student":
            x, y, n = _quantile(u, self.df), _quantile(v, self.df), self.df
            return t_cdf((x - t * y) / np.sqrt((n + y * y) * (1 - t * t) / (n + 1)), n + 1)
        if self.family == "clayton":
            return v ** (-t - 1) * (u**-t + v**-t - 1) ** (-1 - 1 / t)
        if self.family == "gumbel":
            a, b = -np.log(u), -np.log(v)
            s = a**t + b**t
            return np.exp(-(s ** (1 / t))) * s ** (1 / t - 1) * b ** (t - 1) / v
        e = np.exp(-t * v) * -np.expm1(-t * u)
        return e / (-np.expm1(-t) - np.expm1(-t * u) * np.expm1(-t * v))


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Share of concordant less discordant pairs, by rows."""
    total = 0.0
    for at in range(0, len(x), 256):
        total += float(np.sum(np.sign(x[at : at + 256, None] - x) * np.sign(y[at : at + 256, None] - y)))
    return total / (len(x) * (len(x) - 1))


def _search(f, low: float, high: float, rounds: int = 40) -> float:
    """Golden-section minimum."""
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def _miss(pair: Pair, u: np.ndarray, v: np.ndarray) -> float:
    value = -float(np.sum(pair.density(u, v)))
    return value if math.isfinite(value) else 1e12


def _student(u: np.ndarray, v: np.ndarray, tau: float) -> Pair:
    """Greatest likelihood over correlation and degrees of freedom: the correlation near what Kendall's tau says for each of the grid's
    coarse values, then the values around the best, then the correlation anew."""
    near = math.sin(math.pi / 2 * tau)
    low, high = max(-0.99, near - 0.25), min(0.99, near + 0.25)

    def at(df: float, rounds: int) -> Pair:
        return Pair("student", 0, _search(lambda t: _miss(Pair("student", 0, t, df), u, v), low, high, rounds), df)

    coarse = range(0, len(DF_GRID), 4)
    tried = {k: at(DF_GRID[k], 14) for k in coarse}
    k = min(coarse, key=lambda i: _miss(tried[i], u, v))
    around = range(max(0, k - 3), min(len(DF_GRID), k + 4))
    best = min(around, key=lambda i: _miss(Pair("student", 0, tried[k].theta, DF_GRID[i]), u, v))
    return min(tried[k], at(DF_GRID[best], 24), key=lambda p: _miss(p, u, v))


def fit_pair(u: np.ndarray, v: np.ndarray, families: tuple[str, ...] = FAMILIES) -> tuple[Pair, float]:
    """The pair copula of least AIC, independence included, with its log likelihood; every parameter by likelihood."""
    tau = kendall(u, v)
    best, best_aic, best_ll = Pair(), 0.0, 0.0
    limits = {"gaussian": (-0.99, 0.99), "clayton": (0.01, 20.0), "gumbel": (1.01, 15.0), "frank": (-30.0, 30.0)}
    for family in families:
        turns = ((0, 180) if tau >= 0 else (90, 270)) if family in _ROTATED else (0,)
        for turn in turns:
            if family == "student":
                pair = _student(u, v, tau)
            else:
                make = lambda t: Pair(family, turn, t if family != "frank" or abs(t) > 1e-4 else 1e-4)  # noqa: B023, E731
                pair = make(_search(lambda t: _miss(make(t), u, v), *limits[family]))  # noqa: B023
            ll = -_miss(pair, u, v)
            aic = 2 * (2 if family == "student" else 1) - 2 * ll
            if aic < best_aic - 1e-9:
                best, best_aic, best_ll = pair, aic, ll
    return best, best_ll


@dataclass(frozen=True)
class Edge:
    """Copula of ``a`` and ``b`` given ``under``."""

    a: int
    b: int
    under: frozenset
    pair: Pair

    @property
    def whole(self) -> frozenset:
        return self.under | {self.a, self.b}


def failure(pair: Pair, families: tuple[str, ...] = FAMILIES) -> str | None:
    if pair.family not in (*families, "independence"):
        return "family"
    if pair.turn not in ((0, 90, 180, 270) if pair.family in _ROTATED else (0,)):
        return "rotation"
    if not math.isfinite(pair.theta) or (pair.family == "student" and not DF_LEAST <= pair.df <= DF_MOST):
        return "parameter"
    return None


def fit_vine(u: np.ndarray, truncation: int, families: tuple[str, ...] = FAMILIES) -> tuple[list[list[Edge]], float]:
    """(trees, log likelihood) of a (rows x variables) matrix; trees beyond ``truncation`` are independence and left out."""
    d, known, trees, likelihood = u.shape[1], {(i, frozenset()): u[:, i] for i in range(u.shape[1])}, [], 0.0
    nodes: list[tuple[frozenset, tuple]] = [(frozenset({i}), ()) for i in range(d)]
    for level in range(1, min(truncation, d - 1) + 1):
        possible = []
        for i in range(len(nodes)):
            for j in range(i):
                under = nodes[i][0] & nodes[j][0]
                if len(under) == level - 1 and len(nodes[i][0] | nodes[j][0]) == level + 1 and (level == 1 or set(nodes[i][1]) & set(nodes[j][1])):
                    (a,), (b,) = nodes[j][0] - under, nodes[i][0] - under
                    possible.append((-abs(kendall(known[a, under], known[b, under])), j, i, a, b, under))
        joined, edges, fresh = list(range(len(nodes))), [], []
        for _, j, i, a, b, under in sorted(possible, key=lambda x: x[:3]):
            if joined[i] == joined[j]:
                continue
            old, new = joined[i], joined[j]
            joined = [new if x == old else x for x in joined]
            x, y = known[a, under], known[b, under]
            pair, ll = fit_pair(x, y, families)
            likelihood += ll
            edges.append(Edge(a, b, under, pair))
            known[a, under | {b}], known[b, under | {a}] = pair.given(x, y), pair.turned_over().given(y, x)
            fresh.append((under | {a, b}, (j, i)))
        trees.append(edges)
        nodes = fresh
    return trees, likelihood


def parameters(trees: list[list[Edge]]) -> int:
    """Free numbers of all pairs: none for independence, two for a Student-t pair, else one."""
    return sum({"independence": 0, "student": 2}.get(e.pair.family, 1) for edges in trees for e in edges)


def to_document(trees: list[list[Edge]], names: list[str]) -> dict:
    """A vine as plain values: names, and for each tree its edges with their conditioned and conditioning names and pair copula."""
    edge = lambda e: {"pair": [names[e.a], names[e.b]], "given": sorted(names[k] for k in e.under), "family": e.pair.family, "rotation": e.pair.turn, "theta": e.pair.theta, "df": e.pair.df}
    return {"names": list(names), "trees": [[edge(e) for e in t] for t in trees]}


def from_document(document: dict) -> list[list[Edge]]:
    at = {n: i for i, n in enumerate(document["names"])}
    made = lambda e: Edge(at[e["pair"][0]], at[e["pair"][1]], frozenset(at[n] for n in e["given"]), Pair(e["family"], e["rotation"], e["theta"], e["df"]))
    return [[made(e) for e in t] for t in document["trees"]]


def structure_matrix(trees: list[list[Edge]], d: int) -> np.ndarray:
    """The vine's array: column j names, from its diagonal up, variable j of the simulation order and its partners by tree; -1 is none."""
    out = np.full((d, d), -1)
    for j, (x, edges) in enumerate(columns(trees, d)):
        out[j, j] = x
        for k, e in enumerate(edges):
            out[j - 1 - k, j] = e.b if e.a == x else e.a
    return out


def log_density(trees: list[list[Edge]], u: np.ndarray) -> np.ndarray:
    known = {(i, frozenset()): _clip(u[:, i]) for i in range(u.shape[1])}
    total = np.zeros(len(u))
    for edges in trees:
        for e in edges:
            x, y = known[e.a, e.under], known[e.b, e.under]
            total += e.pair.density(x, y)
            known[e.a, e.under | {e.b}], known[e.b, e.under | {e.a}] = e.pair.given(x, y), e.pair.turned_over().given(y, x)
    return total


def columns(trees: list[list[Edge]], d: int) -> list[tuple[int, list[Edge]]]:
    """Variables in an order in which each has, in every tree it reaches, one edge to the ones before it: (variable, edges
    from the first tree on). Found from the end: a variable that only one edge of each tree contains can come last."""
    left, out, alive = [list(t) for t in trees], [], set(range(d))
    while len(alive) > 1:
        for x in sorted(alive, reverse=True):
            own = [[e for e in t if x in e.whole] for t in left]
            if all(len(o) <= 1 for o in own) and all(x not in e.under for o in own for e in o):
                break
        else:
            raise ValueError("no variable can be taken off")
        out.append((x, [o[0] for o in own if o]))
        left = [[e for e in t if x not in e.whole] for t in left]
        alive.discard(x)
    return [(alive.pop(), []), *reversed(out)]


def simulate(trees: list[list[Edge]], independent: np.ndarray) -> np.ndarray:
    """Dependent uniforms from independent ones, column by column."""
    d = independent.shape[1]
    known: dict[tuple[int, frozenset], np.ndarray] = {}
    for x, edges in columns(trees, d):
        pairs = [(e.pair if e.a == x else e.pair.turned_over(), e.b if e.a == x else e.a, e.under) for e in edges]
        w = _clip(independent[:, x])
        for pair, other, under in reversed(pairs):
            w = pair.inverse(w, known[other, under])
        known[x, frozenset()] = w
        for pair, other, under in pairs:
            mine, theirs = known[x, under], known[other, under]
            known[x, under | {other}], known[other, under | {x}] = pair.given(mine, theirs), pair.turned_over().given(theirs, mine)
    return np.column_stack([known[i, frozenset()] for i in range(d)])


def vine_or_gaussian(pits: np.ndarray, truncation: int, most_failed: float = 0.1) -> tuple[list[list[Edge]] | None, str | None]:
    """The fitted vine with failing pairs made independent, or None with the reason to fall back to the Gaussian copula."""
    if not np.isfinite(pits).all():
        return None, "nonfinite_input"
    try:
        trees, likelihood = fit_vine(pits, truncation)
    except (ArithmeticError, ValueError, np.linalg.LinAlgError) as error:
        return None, type(error).__name__
    count, failed, kept = 0, 0, []
    for edges in trees:
        kept.append([])
        for e in edges:
            count += 1
            reason = failure(e.pair)
            failed += reason is not None
            kept[-1].append(e if reason is None else Edge(e.a, e.b, e.under, Pair()))
    if not math.isfinite(likelihood) or failed > most_failed * count:
        return None, "failed_pair_share"
    return kept, None
