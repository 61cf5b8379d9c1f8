"""Search over parametric formulas: many-objective selection, a rule proposer, and the pool of what was found."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import reducers
from barloom.plans.formula_b import SPACES, ParamFormula, decode, normalized, random_genes
from barloom.plans.staged import SPARK, Plan
from barloom.sources.bars import numbered

Score = Callable[[list[list[int]]], np.ndarray]


def panel_of(frame: DataFrame, formulas: list[ParamFormula]) -> DataFrame:
    """A population as one plan: (symbol, ts, f0, f1, ...), its formulas sharing windows and sorts."""
    p = Plan(SPARK)
    cols = {f"f{i}": p.let(reducers.evaluate(p, f)) for i, f in enumerate(formulas)}
    return p.spark(numbered(frame), cols | {"y": p.let(f"lead(close, 5) over ({p.k.P}) / close - 1e0")})


WINDOW, TOP, LEAST_TOP, YEAR = 20, 0.9, 5, 244


def series_objectives(frame: DataFrame, names: list[str], label: str = "y") -> DataFrame:
    """Per symbol of a panel (symbol, ts, factors, label), five figures of each factor, to be maximised:
    n_ic (absolute mean of the correlations of the 20 rows before each row), n_up (share of these above 0), and of the rows whose
    factor is in the top tenth the mean label (n_ret), its Sharpe ratio (n_sharpe, of 244 a year, within 10) and share above 0
    (n_win).  Zeros where there are under 20 rows or no window that varies; the last three also under 5 top rows.
    """
    rolled = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)"
    known = frame.where(" AND ".join(f"{c} IS NOT NULL" for c in [label])).selectExpr("symbol", "ts", f"{label} AS y", *[f"coalesce({c}, 0e0) AS {c}" for c in names], "row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i")
    whole = [f"percentile({c}, {TOP}) OVER (PARTITION BY symbol) AS {c}_cut" for c in names]
    parts = [x for c in names for x in (f"covar_pop({c}, y) {rolled} AS {c}_xy", f"stddev_pop({c}) {rolled} AS {c}_sx")]
    rows = known.selectExpr("*", *whole, *parts, f"stddev_pop(y) {rolled} AS sy")
    rows = rows.selectExpr("symbol", "y", *names, *[f"{c}_cut" for c in names], *[f"CASE WHEN i > {WINDOW} AND {c}_sx >= 1e-9 AND sy >= 1e-9 THEN {c}_xy / ({c}_sx * sy) END AS {c}_r" for c in names])
    top = lambda c: f"CASE WHEN {c} >= {c}_cut THEN y END"
    aggs = [x for c in names for x in (f"avg({c}_r) AS {c}_m", f"avg(CASE WHEN {c}_r > 0e0 THEN 1e0 WHEN {c}_r IS NOT NULL THEN 0e0 END) AS {c}_u", f"count({top(c)}) AS {c}_n", f"avg({top(c)}) AS {c}_a", f"stddev_pop({top(c)}) AS {c}_s", f"avg(CASE WHEN {top(c)} > 0e0 THEN 1e0 WHEN {top(c)} IS NOT NULL THEN 0e0 END) AS {c}_w")]
    by = rows.groupBy("symbol").agg(F.count("*").alias("n"), *map(F.expr, aggs))
    ok = lambda c: f"n >= {WINDOW} AND {c}_m IS NOT NULL"
    sharpe = lambda c: f"CASE WHEN {c}_s > 1e-9 THEN least(greatest({c}_a / ({c}_s + 1e-9) * sqrt({YEAR}e0), -10e0), 10e0) ELSE 0e0 END"
    out = []
    for c in names:
        few = f"{ok(c)} AND {c}_n >= {LEAST_TOP}"
        out += [f"CASE WHEN {ok(c)} THEN abs({c}_m) ELSE 0e0 END AS {c}_ic", f"CASE WHEN {ok(c)} THEN {c}_u ELSE 0e0 END AS {c}_up"]
        out += [f"CASE WHEN {few} THEN {e} ELSE 0e0 END AS {c}_{k}" for k, e in (("ret", f"{c}_a"), ("sharpe", sharpe(c)), ("win", f"{c}_w"))]
    return by.selectExpr("symbol", *out)


def objectives(frame: DataFrame, formulas: list[ParamFormula]) -> np.ndarray:
    """[formulas x 5]: the objectives of ``series_objectives``, their mean over symbols.

    One plan for the whole population, one aggregation per symbol and one over symbols; the driver gets five numbers a formula.
    """
    names = [f"f{i}" for i in range(len(formulas))]
    by = series_objectives(panel_of(frame, formulas), names)
    row = by.agg(*[F.avg(f"{c}_{k}") for c in names for k in ("ic", "up", "ret", "sharpe", "win")]).first()
    return np.array([0.0 if x is None or not np.isfinite(x) else float(x) for x in row]).reshape(len(formulas), 5)


def shortboard(scores: np.ndarray, weak: float = 0.10, blame: float = 0.5) -> np.ndarray:
    """scores, with each column shrunk whose median after min-max scaling is below `weak`: up to blame / 10 off, the more the
    lower a row ranks in it; a column without any range stays."""
    out = scores.astype(float).copy()
    for j, c in enumerate(scores.T):
        span = c.max() - c.min()
        if span >= 1e-12 and np.median((c - c.min()) / span) < weak:
            rank = c.argsort(kind="stable").argsort(kind="stable") / max(len(c) - 1, 1)
            out[:, j] = c * (1 - blame * 0.1 * (1 - rank))
    return out


def crossed(a: list[int], b: list[int], rng: np.random.Generator, eta: float = 15.0) -> tuple[list[int], list[int]]:
    """Simulated binary crossover (Deb and Agrawal 1995): each gene with even odds, spread by a polynomial around both parents."""
    x, y, u = np.array(a, float), np.array(b, float), rng.random(len(a))
    spread = np.where(u <= 0.5, (2 * u) ** (1 / (eta + 1)), (1 / np.maximum(2 * (1 - u), 1e-12)) ** (1 / (eta + 1)))
    spread = np.where(rng.random(len(a)) < 0.5, spread, 1.0)
    flip = rng.random(len(a)) < 0.5  # which child lies nearer to which parent
    one, two = ((1 + spread) * x + (1 - spread) * y) / 2, ((1 - spread) * x + (1 + spread) * y) / 2
    one, two = np.where(flip, two, one), np.where(flip, one, two)
    return _in_range(one), _in_range(two)


def mutated(genes: list[int], rng: np.random.Generator, share: float = 0.1, eta: float = 20.0) -> list[int]:
    """Polynomial mutation of a share of the genes."""
    high, u = np.array([len(s) - 1 for s in SPACES], float), rng.random(len(genes))
    step = np.where(u < 0.5, (2 * u) ** (1 / (eta + 1)) - 1, 1 - (2 * (1 - u)) ** (1 / (eta + 1)))
    return _in_range(np.array(genes) + np.where(rng.random(len(genes)) < share, step * high, 0.0))


def _in_range(x: np.ndarray) -> list[int]:
    return [int(min(max(round(v), 0), len(s) - 1)) for v, s in zip(x.tolist(), SPACES, strict=True)]


def fronts(scores: np.ndarray) -> list[np.ndarray]:
    """Non-dominated fronts of rows to be maximised."""
    better = (scores[:, None] >= scores[None]).all(2) & (scores[:, None] > scores[None]).any(2)
    left, out = np.ones(len(scores), bool), []
    while left.any():
        front = left & ~(better & left[:, None]).any(0)
        out.append(np.flatnonzero(front))
        left &= ~front
    return out


def reference_points(dims: int, parts: int = 4) -> np.ndarray:
    """All weights in steps of 1 / parts that sum to 1."""
    if dims == 1:
        return np.array([[1.0]])
    return np.array([[i / parts, *(p * (1 - i / parts))] for i in range(parts + 1) for p in (reference_points(dims - 1, parts - i) if i < parts else np.eye(1, dims - 1))])


def select(scores: np.ndarray, n: int, parts: int = 4) -> np.ndarray:
    """n rows: whole fronts while they fit, then those nearest to the reference directions with the fewest so far."""
    kept: list[int] = []
    for front in fronts(scores):
        if len(kept) + len(front) <= n:
            kept += front.tolist()
            continue
        low, high = scores.min(0), scores.max(0)
        unit = (high - scores) / np.where(high > low, high - low, 1)
        refs = reference_points(scores.shape[1], parts)
        ways = refs / np.linalg.norm(refs, axis=1, keepdims=True)
        along = unit @ ways.T
        gap = np.linalg.norm(unit[:, None] - along[:, :, None] * ways[None], axis=2)
        own = gap.argmin(1)
        used = np.bincount(own[kept], minlength=len(refs)) if kept else np.zeros(len(refs), int)
        pool = front.tolist()
        while len(kept) < n:
            pick = min(pool, key=lambda i: (used[own[i]], gap[i, own[i]], i))
            pool.remove(pick)
            kept.append(pick)
            used[own[pick]] += 1
        break
    return np.array(kept)


def parts_for(size: int) -> int:
    """Steps of the reference directions of five objectives, so that there are no more of them than rows: 35, 70, 126 or 210."""
    return 6 if size >= 210 else 5 if size >= 126 else 4 if size >= 70 else 3


def evolve(score: Score, size: int = 24, generations: int = 3, seed: int = 0, start: list[list[int]] | None = None, cross: float = 0.8) -> list[tuple[list[int], np.ndarray]]:
    """The last population, as (genes, scores).  score works on a population at once; what is selected by are its
    scores after the shortboard penalty of each generation.  No formula is in a population twice."""
    rng = np.random.default_rng(seed)
    pop = list(dict.fromkeys(tuple(normalized(_in_range(np.array(g, float)))) for g in (start or [])))[:size]
    while len(pop) < size:
        g = tuple(normalized(random_genes(rng)))
        if g not in pop:
            pop.append(g)
    told = score([list(g) for g in pop])
    for _ in range(generations):
        kids: list[tuple[int, ...]] = []
        while len(kids) < size:
            a, b = (list(pop[i]) for i in rng.integers(len(pop), size=2))
            for k in crossed(a, b, rng) if rng.random() < cross else (a, b):
                k = tuple(normalized(mutated(k, rng)))
                if k in pop or k in kids:  # a copy: one gene is drawn anew
                    i, k = int(rng.integers(len(SPACES))), list(k)
                    k[i] = int(rng.integers(len(SPACES[i])))
                    k = tuple(normalized(k))
                if k not in pop and k not in kids and len(kids) < size:
                    kids.append(k)
        both, scores = pop + kids, np.vstack([told, score([list(g) for g in kids])])
        chosen = select(shortboard(scores), size, parts_for(size))
        pop, told = [both[i] for i in chosen], scores[chosen]
    return [(list(g), s) for g, s in zip(pop, told, strict=True)]


def mine(frame: DataFrame, size: int = 12, generations: int = 2, seed: int = 0, start: list[list[int]] | None = None) -> list[tuple[ParamFormula, np.ndarray]]:
    """Formulas of the first front of the last population and their five objectives, highest correlation first."""
    found = evolve(lambda pop: objectives(frame, [decode(g) for g in pop]), size, generations, seed, start)
    front = fronts(np.array([s for _, s in found]))[0]
    return sorted(((decode(found[i][0]), found[i][1]) for i in front), key=lambda r: -r[1][0])


def propose(seed: int, parent: ParamFormula | None = None) -> ParamFormula:
    """A rule proposer: a random formula, or its parent with one gene drawn anew."""
    rng = np.random.default_rng(seed)
    genes = random_genes(rng) if parent is None else parent.genes()
    i = int(rng.integers(len(SPACES)))
    genes[i] = int(rng.integers(len(SPACES[i])))
    return decode(genes)


def upsert_pool(spark: SparkSession, pool: DataFrame | None, found: list[tuple[str, str, float]], most: int = 2000) -> DataFrame:
    """Pool of (key, formula, dsr, hits): found ones add a hit and keep the better dsr; the best `most` stay."""
    new = spark.createDataFrame(found, "key string, formula string, dsr double").withColumn("hits", F.lit(1).cast("long"))
    both = new if pool is None else pool.unionByName(new)
    merged = both.groupBy("key").agg(F.max("formula").alias("formula"), F.max("dsr").alias("dsr"), F.sum("hits").alias("hits"))
    order = Window.orderBy(F.desc("dsr"), F.desc("hits"), "key")
    return merged.orderBy(F.desc("dsr"), F.desc("hits"), "key").limit(most) if most else merged.withColumn("rank", F.row_number().over(order))
