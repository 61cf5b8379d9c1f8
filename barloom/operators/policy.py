"""Search for token formulas by a tabular policy: the next token's chances depend on the one before it and on what is valid.

A step draws a batch of formulas, has them scored at once, and moves the table along the policy gradient: rewards less their
running mean, formulas of the elite pool replayed beside the batch, and an entropy bonus while the policy is too sure.
Steps without a better formula lead to a restart of the table with the pool kept.  The whole state, the
generator's included, is one log entry a step, so a search that is cut off goes on as if it hadn't been.

The table has as many rows and columns as there are tokens and lives on the driver; scoring is a Spark plan over all bars.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from barloom.operators import reward
from barloom.operators.language_a import OPERATORS
from barloom.plans.formula_a import MAX_TOKENS, Vocabulary, depth_after, execute, valid_next
from barloom.plans.staged import SPARK, Plan
from barloom.sources.bars import numbered
from barloom.sources.log import Log

Score = Callable[[list[list[int]]], list[float]]


class Pool:
    """The best formulas, each once, as a bounded heap whose top is the worst."""

    def __init__(self, most: int, entries: list | None = None):
        self.most = most
        self.heap = [(x, tuple(t)) for x, t in entries or []]
        heapq.heapify(self.heap)

    def add(self, score: float, tokens: list[int]) -> bool:
        """Whether it is in the pool now with this score."""
        key = tuple(tokens)
        held = next((i for i, (_, t) in enumerate(self.heap) if tuple(t) == key), None)
        if held is not None:
            if score <= self.heap[held][0]:
                return False
            self.heap[held] = (score, key)
            heapq.heapify(self.heap)
        elif len(self.heap) < self.most:
            heapq.heappush(self.heap, (score, key))
        elif score > self.heap[0][0]:
            heapq.heapreplace(self.heap, (score, key))
        else:
            return False
        return True

    def best(self) -> list[tuple[float, tuple[int, ...]]]:
        return sorted(((s, tuple(t)) for s, t in self.heap), key=lambda e: (-e[0], e[1]))


@dataclass
class Settings:
    length: int = MAX_TOKENS
    batch: int = 16
    rate: float = 0.5
    smoothing: float = 0.9
    entropy: float = 0.02
    floor: float = 1.0
    replay: int = 4
    pool: int = 20
    patience: int = 12
    restarts: int = 3
    noise: float = 0.1
    seed: int = 0


@dataclass
class State:
    step: int = 0
    table: list = field(default_factory=list)
    baseline: float | None = None
    best: float = float("-inf")
    stale: int = 0
    restarts: int = 0
    pool: list = field(default_factory=list)
    rng: dict = field(default_factory=dict)
    history: list = field(default_factory=list)


class PolicySearch:
    def __init__(self, score: Score, vocab: Vocabulary | None = None, settings: Settings | None = None, log: Log | None = None):
        self.score, self.vocab, self.set, self.log = score, vocab or Vocabulary.default(), settings or Settings(), log
        self.n = len(self.vocab.names)
        self.shrink = max((OPERATORS[o].arity for o in self.vocab.operator_names), default=1) - 1  # operands that one token can take off
        self.rng = np.random.default_rng(self.set.seed)
        self.table = np.zeros((self.n + 1, self.n))  # the last row: no token before
        self.pool, self.state = Pool(self.set.pool), State()
        self._valid: dict[tuple[int, ...], np.ndarray] = {}
        if log:
            number, entry = log.last()
            if entry:
                if entry["settings"] != asdict(self.set) or entry["version"] != self.vocab.version:
                    raise ValueError("the log is of a search with other settings or another vocabulary")
                self._restore(State(**entry["state"]))

    def _restore(self, state: State) -> None:
        self.state, self.table, self.pool = state, np.array(state.table), Pool(self.set.pool, state.pool)
        self.rng.bit_generator.state = state.rng

    def _save(self) -> None:
        if self.log:
            s = State(**{f.name: getattr(self.state, f.name) for f in fields(State)})
            s.table, s.pool, s.rng = self.table.tolist(), [[x, list(t)] for x, t in self.pool.heap], self.rng.bit_generator.state
            if not self.log.append(self.log.last()[0], {"settings": asdict(self.set), "version": self.vocab.version, "state": asdict(s)}):
                raise RuntimeError("another search writes to this log")

    def valid(self, tokens: list[int]) -> np.ndarray:
        key = tuple(tokens)
        if key not in self._valid:
            if len(self._valid) > 50_000:
                self._valid.clear()
            left = self.set.length - len(tokens) - 1
            can = valid_next(tokens, self.vocab, self.set.length)
            self._valid[key] = np.array([t for t in can if depth_after([*tokens, t], self.vocab) <= 1 + self.shrink * left])
        return self._valid[key]

    def chances(self, tokens: list[int]) -> tuple[int, np.ndarray, np.ndarray]:
        """Row of the table, tokens that may follow, and their probabilities."""
        row = tokens[-1] if tokens else self.n
        can = self.valid(tokens)
        z = self.table[row, can]
        p = np.exp(z - z.max())
        return row, can, p / p.sum()

    def draw(self) -> list[int]:
        out: list[int] = []
        while len(out) < self.set.length:
            _, can, p = self.chances(out)
            out.append(int(can[self.rng.choice(len(can), p=p)]))
        return out

    def _learn(self, tokens: list[int], advantage: float, change: np.ndarray) -> None:
        for i, t in enumerate(tokens):
            row, can, p = self.chances(tokens[:i])
            change[row, can] -= advantage * p
            change[row, t] += advantage
            h = -(p * np.log(np.maximum(p, 1e-12))).sum()
            if h < self.set.floor and len(can) > 1:  # towards the mean surprise, away from being sure
                change[row, can] -= self.set.entropy * p * (np.log(np.maximum(p, 1e-12)) + h)

    def step(self) -> float:
        """One batch; its mean reward."""
        c, s = self.set, self.state
        batch = [self.draw() for _ in range(c.batch)]
        told = [x if np.isfinite(x) else -5.0 for x in self.score(batch)]
        mean = float(np.mean(told))
        s.baseline = mean if s.baseline is None else c.smoothing * s.baseline + (1 - c.smoothing) * mean
        spread = float(np.std(told)) + 1e-6
        old = self.pool.best()[: c.replay]
        change = np.zeros_like(self.table)
        for t, x in zip(batch, told, strict=True):
            self._learn(t, (x - s.baseline) / spread / c.batch, change)
            self.pool.add(float(x), t)
        for x, t in old:
            self._learn(list(t), min(3.0, max(0.0, (x - s.baseline) / spread)) / c.batch, change)
        self.table += c.rate * change
        if max(told) > s.best + 1e-9:
            s.best, s.stale = float(max(told)), 0
        else:
            s.stale += 1
        if s.stale >= c.patience and s.restarts < c.restarts:
            self.table = self.rng.normal(0, c.noise, self.table.shape)
            s.restarts, s.stale, s.baseline = s.restarts + 1, 0, None
        s.step += 1
        s.history.append(mean)
        self._save()
        return mean

    def run(self, steps: int) -> list[tuple[float, tuple[int, ...]]]:
        """Goes on to so many steps in all; the pool, best first."""
        while self.state.step < steps:
            self.step()
        return self.pool.best()


def spark_score(bars: DataFrame, vocab: Vocabulary | None = None, mode: str = "ftmo", **options) -> Score:
    """Rewards of a batch over walk-forward folds of all bars, in one plan; -5 for a formula that isn't well formed."""
    vocab = vocab or Vocabulary.default()

    def score(batch: list[list[int]]) -> list[float]:
        p, cols = Plan(SPARK), {}
        for i, tokens in enumerate(batch):
            made = execute(p, tokens, vocab)
            if made is not None:
                cols[f"f{i}"] = p.let(made)
        made = p.spark(numbered(bars), cols | {"ret": p.let(f"coalesce(lead(close) over ({p.k.P}) / close - 1e0, 0e0)")})
        made = made.persist(StorageLevel.MEMORY_AND_DISK)  # scores read it several times; lost parts are made again
        long = made.selectExpr("symbol", "ts", "ret", f"stack({len(cols)}, {', '.join(f'{c!r}, {c}' for c in cols)}) AS (formula, f)")
        try:
            found = {r.formula: r.reward for r in reward.rewards(long, mode=mode, **options).select("formula", "reward").collect()}  # one number a formula
        finally:
            made.unpersist()
        return [found.get(f"f{i}", reward.NO_FACTOR) for i in range(len(batch))]

    return score


def mine_policy(bars: DataFrame, steps: int = 4, vocab: Vocabulary | None = None, settings: Settings | None = None, log: Log | None = None, mode: str = "ftmo") -> list[tuple[float, list[str]]]:
    """The pool of a search over bars, as (reward, names of tokens)."""
    vocab = vocab or Vocabulary.default()
    found = PolicySearch(spark_score(bars, vocab, mode), vocab, settings, log).run(steps)
    return [(x, [vocab.names[i] for i in t]) for x, t in found]
