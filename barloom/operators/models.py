"""Walk-forward models on long feature tables (ts, symbol, label, features).

Models read their training rows in chunks, as many times as they need to, so memory doesn't grow with the rows but for
a count of two bytes a row where rows are drawn with repetition, and where trees see so many columns that combinations
of bins are no fewer than rows (a byte a value there, and 16 a row).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barloom.sources.timed import Timed

Predict = Callable[[np.ndarray], np.ndarray]
Model = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]

#: Rows that are worked on at once, and bytes up to which a training set is held instead of being read again.
CHUNK, KEEP = 1 << 15, 96 << 20
#: Combinations of bins up to which rows are added up by combination.
CELLS = 1 << 16


class Rows:
    """Features and labels of a training set in their order, in chunks; read again for each pass unless they are few."""

    def __init__(self, n: int, width: int, read: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]], hold: bool = True):
        self.n, self.width, self.read, self.held = n, width, read, None
        self.hold = hold and 8 * n * (width + 1) <= KEEP

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Rows:
        return cls(len(x), x.shape[1], lambda: ((x[i : i + CHUNK], y[i : i + CHUNK]) for i in range(0, len(x), CHUNK)), hold=False)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.hold:
            return self.read()
        if self.held is None:
            x, y, at = np.empty((self.n, self.width)), np.empty(self.n), 0
            for a, b in self.read():
                x[at : at + len(a)], y[at : at + len(a)] = a, b
                at += len(a)
            self.held = Rows.of(x, y)
        return self.held.read()

    def part(self, lo: int, hi: int) -> Rows:
        def read() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at = 0
            for x, y in self:
                a, b = max(lo - at, 0), min(hi - at, len(y))
                if a < b:
                    yield x[a:b], y[a:b]
                at += len(y)
                if at >= hi:
                    break

        return Rows(hi - lo, self.width, read, hold=False)

    def repeated(self, times: np.ndarray) -> Rows:
        """Each row so many times."""

        def read() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at = 0
            for x, y in self:
                n = times[at : at + len(y)]
                at += len(y)
                yield np.repeat(x, n, 0), np.repeat(y, n)

        return Rows(int(times.sum()), self.width, read, hold=False)

    def through(self, fits: list[Predict]) -> Rows:
        """What fits tell, as features."""
        return Rows(self.n, len(fits), lambda: ((np.column_stack([f(x) for f in fits]), y) for x, y in self))

    def mean(self) -> float:
        return sum(float(y.sum()) for _, y in self) / self.n


def on_arrays(fit: Callable[..., Predict]) -> Model:
    """The model as a function of training features, labels and the features that are told; .fit takes Rows and gives what tells."""

    @functools.wraps(fit)
    def run(x: np.ndarray, y: np.ndarray, to: np.ndarray, *args: object, **options: object) -> np.ndarray:
        return fit(Rows.of(x, y), *args, **options)(to)

    run.fit = fit
    return run


def _ranked(chunks: Callable[[], Iterator[np.ndarray]], ranks: np.ndarray) -> np.ndarray:
    """The values of these ranks (from 0) among numbers without order: 16 bits of them with each pass."""
    head, left = np.zeros(len(ranks), np.uint64), np.array(ranks, np.int64)
    for shift in (48, 32, 16, 0):
        heads, of = np.unique(head, return_inverse=True)
        counts = np.zeros(len(heads) << 16, np.int64)
        for v in chunks():
            k = (np.asarray(v, float) + 0.0).view(np.uint64)
            k = np.where(k >> np.uint64(63), ~k, k | np.uint64(1 << 63))
            i = np.zeros(len(k), np.int64)
            if shift < 48:
                top = k >> np.uint64(shift + 16)
                i = np.minimum(np.searchsorted(heads, top), len(heads) - 1)
                k, i = k[heads[i] == top], i[heads[i] == top]
            np.add.at(counts, (i << 16) + ((k >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64), 1)
        ends = counts.reshape(-1, 1 << 16)
        np.cumsum(ends, 1, out=ends)
        for r, h in enumerate(of):
            digit = int(np.searchsorted(ends[h], left[r], "right"))
            left[r] -= ends[h][digit - 1] if digit else 0
            head[r] = (head[r] << np.uint64(16)) | np.uint64(digit)
        del counts, ends
    return np.where(head >> np.uint64(63), head & np.uint64((1 << 63) - 1), ~head).view(float)


def quantiles(chunks: Callable[[], Iterator[np.ndarray]], n: int, q: np.ndarray) -> np.ndarray:
    """np.quantile of n finite numbers that come in chunks, held at once only if they are few."""
    if 32 * n <= KEEP:
        return np.quantile(np.concatenate(list(chunks())), q)
    at = q * (n - 1)
    lo = np.floor(at).astype(np.int64)
    a, b = _ranked(chunks, np.concatenate([lo, np.minimum(lo + 1, n - 1)])).reshape(2, -1)
    t = at - lo
    return np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t))


class Scale:
    """Features in units of their deviations in the training rows, missing ones at the mean."""

    def __init__(self, rows: Rows):
        n = sum((np.isfinite(x).sum(0) for x, _ in rows), np.zeros(rows.width))
        total = sum((np.where(np.isfinite(x), x, 0.0).sum(0) for x, _ in rows), np.zeros(rows.width))
        self.mean = total / np.maximum(n, 1)
        square = sum((np.where(np.isfinite(x), x - self.mean, 0.0) ** 2).sum(0) for x, _ in rows)
        sd = np.sqrt(square / np.maximum(n, 1))
        self.sd = np.where(np.isfinite(sd) & (sd > 1e-12), sd, 1.0)

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(x), (x - self.mean) / self.sd, 0.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The values, flags of missing ones, and a one."""
        return np.column_stack([self.values(x), ~np.isfinite(x), np.ones(len(x))])


@on_arrays
def ridge(rows: Rows, weight: float = 1.0) -> Predict:
    scale, wide = Scale(rows), 2 * rows.width + 1
    own, on = np.zeros((wide, wide)), np.zeros(wide)
    for x, y in rows:
        a = scale(x)
        own += a.T @ a
        on += a.T @ y
    w = np.linalg.solve(own + weight * np.eye(wide), on)
    return lambda x: scale(x) @ w


@on_arrays
def stumps(rows: Rows, rounds: int = 60, rate: float = 0.1, bins: int = 16) -> Predict:
    """Gradient boosting of depth-one trees on quantile bins.

    The fit is a sum over features of a value per bin, so what rows have in common bins, two features at a time, and the
    labels' sums by bin are all that is needed of the rows.
    """
    scale, p = Scale(rows), rows.width
    column = lambda j: (scale.values(x)[:, j] for x, _ in rows)
    cuts = [np.unique(quantiles(lambda j=j: column(j), rows.n, np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = lambda x: np.column_stack([np.searchsorted(cut, c, "right") for cut, c in zip(cuts, scale.values(x).T, strict=True)])
    common, total = np.zeros((p, bins, p, bins)), np.zeros((p, bins))
    for x, y in rows:
        b = binned(x)
        for j in range(p):
            total[j] += np.bincount(b[:, j], y, bins)
            for i in range(j, p):
                common[j, :, i] += np.bincount(b[:, j] * bins + b[:, i], minlength=bins * bins).reshape(bins, bins)
    for j in range(p):
        for i in range(j):
            common[j, :, i] = common[i, :, j].T
    counts = np.stack([common[j, :, j].diagonal() for j in range(p)])
    mean, fit = rows.mean(), np.zeros((p, bins))
    for _ in range(rounds):
        e, best = total - mean * counts - np.tensordot(common, fit, 2), (0.0, None)
        for j, cut in enumerate(cuts):
            s, n = e[j].cumsum()[: len(cut)], counts[j].cumsum()[: len(cut)]
            ok = (n > 0) & (n < rows.n)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (e[j].sum() - s) ** 2 / np.maximum(rows.n - n, 1), 0)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), (j, k, s[k] / n[k], (e[j].sum() - s[k]) / (rows.n - n[k])))
        if best[1] is None:
            break
        j, k, lo, hi = best[1]
        fit[j, : k + 1] += rate * lo
        fit[j, k + 1 :] += rate * hi
    return lambda x: mean + sum(fit[j][b] for j, b in enumerate(binned(x).T))


class Trees:
    """Regression trees of a given depth on quantile bins, grown level by level from histograms of (node, feature, bin).

    Missing values have the lowest bin of their own, so a split can set them apart; others are cut at training quantiles.
    A tree is arrays over its complete binary heap; a node that no split improves sends all its rows left.
    """

    def __init__(self, x: np.ndarray | Rows, bins: int = 32):
        rows = x if isinstance(x, Rows) else Rows.of(x, np.zeros(len(x)))
        q = np.linspace(0, 1, bins + 1)[1:-1]
        finite = lambda j: (c[np.isfinite(c)] for c in (a[:, j] for a, _ in rows))
        known = sum((np.isfinite(a).sum(0) for a, _ in rows), np.zeros(rows.width, int))
        self.cuts = [np.unique(quantiles(lambda j=j: finite(j), int(known[j]), q)) if known[j] else np.empty(0) for j in range(rows.width)]
        self.bins = bins + 1
        self.gain = np.zeros(rows.width)
        #: Places of all combinations of bins, if they are few.
        self.places = self.bins**rows.width if self.bins**rows.width <= CELLS else None

    def binned(self, x: np.ndarray) -> np.ndarray:
        """1 + the number of cuts at or below each value; 0 for a missing one."""
        return np.column_stack([np.where(np.isfinite(c), 1 + np.searchsorted(cut, c, "right"), 0) for cut, c in zip(self.cuts, x.T, strict=True)]).astype(np.int32)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The number of each row's combination of bins."""
        return self.binned(x) @ self.bins ** np.arange(x.shape[1])

    def combinations(self) -> np.ndarray:
        """The bins of each place."""
        return (np.arange(self.places)[:, None] // self.bins ** np.arange(len(self.cuts)) % self.bins).astype(np.int32)

    def told_by(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], scale: float, start: float = 0.0) -> Predict:
        """start and scale times the sum of the trees, told for rows."""
        if self.places is None:
            return lambda x: sum((scale * self.told(tree, b) for b in [self.binned(x)] for tree in trees), np.full(len(x), start))
        b, out = self.combinations(), np.full(self.places, start)
        for tree in trees:
            out += scale * self.told(tree, b)
        return lambda x: out[self.place(x)]

    def grow(self, b: np.ndarray, y: np.ndarray, depth: int, least: int, features: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, last bin that goes left) of the inner nodes, and the values of the leaves; if count is given, an item of b
        stands for so many rows and y is their sum."""
        n, wide = len(y), self.bins
        feature, at = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, wide, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.zeros(many)
            for j in features:
                key = node * wide + b[:, j]
                s, c = (np.bincount(key, w, many * wide).reshape(many, wide) for w in (y, count))
                ls, lc = s.cumsum(1)[:, :-1], c.cumsum(1)[:, :-1]
                ts, tc = s.sum(1, keepdims=True), c.sum(1, keepdims=True)
                ok = (lc >= least) & (tc - lc >= least)
                gain = np.where(ok, ls**2 / np.maximum(lc, 1) + (ts - ls) ** 2 / np.maximum(tc - lc, 1) - ts**2 / np.maximum(tc, 1), 0.0)
                k = gain.argmax(1)
                won = gain[np.arange(many), k]
                better = won > best + 1e-12
                best[better], feature[first : first + many][better], at[first : first + many][better] = won[better], j, k[better]
            np.add.at(self.gain, feature[first : first + many], best)
            node = 2 * node + (b[np.arange(n), feature[first + node]] > at[first + node])
        total, many = np.bincount(node, y, 1 << depth), np.bincount(node, count, 1 << depth)
        return feature, at, total / np.maximum(many, 1)

    @staticmethod
    def told(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, at, leaf = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for level in range((len(leaf) - 1).bit_length()):
            here = (1 << level) - 1 + node
            node = 2 * node + (b[rows, feature[here]] > at[here])
        return leaf[node]


class _Sums:
    """Counts and label sums of chosen rows by combination of bins; by row where combinations are many."""

    def __init__(self, t: Trees, rows: Rows):
        self.t, self.rows, self.by_place = t, rows, t.places is not None
        self.items = t.places if self.by_place else rows.n
        kind = np.uint8 if t.bins <= 256 else np.int32
        self.bins = t.combinations() if self.by_place else np.concatenate([t.binned(x).astype(kind) for x, _ in rows])
        self.kept = self._read() if self.by_place and 12 * rows.n <= KEEP else None

    def _read(self) -> tuple[np.ndarray, np.ndarray]:
        at, places, labels = 0, np.empty(self.rows.n, np.int32), np.empty(self.rows.n)
        for x, y in self.rows:
            places[at : at + len(y)], labels[at : at + len(y)] = self.t.place(x), y
            at += len(y)
        return places, labels

    def _chunks(self) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
        if self.kept:
            yield from ((self.kept[0][i : i + CHUNK], self.kept[1][i : i + CHUNK]) for i in range(0, self.rows.n, CHUNK))
        else:
            yield from ((self.t.place(x) if self.by_place else None, y) for x, y in self.rows)

    def at_once(self, a_row: int = 0) -> int:
        """Choices that are worth a pass of the rows together, if each needs so many bytes a row as well."""
        return max(1, KEEP // (16 * self.items + a_row * self.rows.n))

    def of(self, choices: list[Callable[[int, int], np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(counts, sums) for each choice: a function that gives how often rows lo .. hi - 1 count, called in order."""
        out, at = [(np.zeros(self.items), np.zeros(self.items)) for _ in choices], 0
        for place, y in self._chunks():
            for (n, s), chosen in zip(out, choices, strict=True):
                w = chosen(at, at + len(y))
                some = np.flatnonzero(w)
                w = w[some]
                if place is None:
                    n[at + some], s[at + some] = w, w * y[some]
                else:
                    n += np.bincount(place[some], w, self.items)
                    s += np.bincount(place[some], w * y[some], self.items)
            at += len(y)
        return out


def _drawn(rng: np.random.Generator, n: int) -> np.ndarray:
    """How often each of n rows is drawn in n draws; the draws are those of one call."""
    out = np.zeros(n, np.uint16)
    for i in range(0, n, 1 << 20):
        np.add.at(out, rng.integers(0, n, min(1 << 20, n - i)), 1)
    return out


def _ahead(rng: np.random.Generator, n: int) -> np.random.Generator:
    """A generator that draws the next n random() of rng, which goes on after them."""
    own = np.random.Generator(type(rng.bit_generator)())
    own.bit_generator.state = before = rng.bit_generator.state
    rng.bit_generator.advance(n)
    rng.bit_generator.state = rng.bit_generator.state | {k: before[k] for k in ("has_uint32", "uinteger")}  # a half word kept from integers
    return own


def _weights(t: Trees, gains: list | None) -> None:
    if gains is not None:
        gains.append(t.gain / max(t.gain.sum(), 1e-300))


@on_arrays
def boosted(over: Rows, rounds: int = 300, rate: float = 0.05, depth: int = 5, least: int = 30, rows: float = 0.8, columns: float = 0.8, seed: int = 42, gains: list | None = None) -> Predict:
    """Gradient boosting of squared errors; each tree sees shares of the rows and columns."""
    rng, t = np.random.default_rng(seed), Trees(over)
    sums, mean, trees = _Sums(t, over), over.mean(), []
    fit, left = np.full(sums.items, mean), rounds
    while left > 0:
        some = min(left, sums.at_once())
        left -= some
        choices, few = [], []
        for _ in range(some):
            own = _ahead(rng, over.n) if rows < 1 else None
            choices.append((lambda lo, hi, own=own: (own.random(hi - lo) < rows).astype(float)) if own else lambda lo, hi: np.ones(hi - lo))
            few.append(np.sort(rng.permutation(over.width)[: max(1, round(columns * over.width))]))
        for (n, s), features in zip(sums.of(choices), few, strict=True):
            if n.sum() < 2 * least:
                left = 0
                break
            seen = np.flatnonzero(n)
            trees.append(t.grow(sums.bins[seen], (s - n * fit)[seen], depth, least, features, n[seen]))
            fit += rate * t.told(trees[-1], sums.bins)
    _weights(t, gains)
    return t.told_by(trees, rate, mean)


@on_arrays
def forest(rows: Rows, n: int = 100, depth: int = 8, least: int = 5, seed: int = 42, gains: list | None = None) -> Predict:
    """Mean of trees on rows drawn with repetition; all columns are looked at."""
    rng, t = np.random.default_rng(seed), Trees(rows)
    sums, trees = _Sums(t, rows), []
    while len(trees) < n:
        drawn = [_drawn(rng, rows.n) for _ in range(min(n - len(trees), sums.at_once(2)))]
        for count, s in sums.of([lambda lo, hi, d=d: d[lo:hi].astype(float) for d in drawn]):
            seen = np.flatnonzero(count)
            trees.append(t.grow(sums.bins[seen], s[seen], depth, least, np.arange(rows.width), count[seen]))
    _weights(t, gains)
    return t.told_by(trees, 1 / n)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place of x, by exp, which numpy has in vector instructions; off by rounding of ones."""
    x *= 2
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


@on_arrays
def mlp(rows: Rows, hidden: int = 16, rounds: int = 200, seed: int = 0) -> Predict:
    """One hidden layer of tanh units, full-batch Adam; a batch is added up from chunks."""
    scale, wide, mean = Scale(rows), 2 * rows.width + 1, rows.mean()
    rng, sd = np.random.default_rng(seed), np.sqrt(sum(float(((y - mean) ** 2).sum()) for _, y in rows) / rows.n) or 1.0
    w = [rng.normal(0, 1 / np.sqrt(wide), (wide, hidden)), rng.normal(0, 1 / np.sqrt(hidden), hidden)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for k in range(1, rounds + 1):
        grads = [1e-4 * p for p in w]
        for x, y in rows:
            for i in range(0, len(y), 1 << 12):  # such parts of a layer stay in a core's cache
                a = scale(x[i : i + (1 << 12)])
                h = _tanh(a @ w[0])
                e = (h @ w[1] - (y[i : i + (1 << 12)] - mean) / sd) / rows.n
                grads[1] += h.T @ e
                h *= h
                np.subtract(1, h, out=h)
                h *= e[:, None]
                grads[0] += a.T @ h * w[1]
        for p, g, i in zip(w, grads, (0, 1), strict=True):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g**2
            p -= 0.02 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return lambda x: _tanh(scale(x) @ w[0]) @ w[1] * sd + mean


def bagged(model: Model, n: int = 5, seed: int = 42) -> Model:
    """Mean of fits on resampled rows, of seeds 17 apart."""

    @on_arrays
    def run(rows: Rows) -> Predict:
        fits = [model.fit(rows.repeated(_drawn(np.random.default_rng(seed + 17 * i), rows.n))) for i in range(n)]
        return lambda x: np.mean([f(x) for f in fits], 0)

    return run


def stacked(models: list[Model], share: float = 0.7, gap: int = 0) -> Model:
    """Ridge on the models' predictions of the last part of the rows (in time order), `gap` rows apart from the first."""

    @on_arrays
    def run(rows: Rows) -> Predict:
        cut = int(rows.n * share)
        early = rows.part(0, cut)
        top = ridge.fit(rows.part(min(cut + gap, rows.n - 1), rows.n).through([m.fit(early) for m in models]))
        fits = [m.fit(rows) for m in models]
        return lambda x: top(np.column_stack([f(x) for f in fits]))

    return run


MODELS: dict[str, Model] = {"ridge": ridge, "stumps": stumps, "mlp": mlp, "bagging": bagged(ridge), "stacking": stacked([ridge, stumps]), "trees": boosted, "forest": forest}


class _Folds:
    """A table kept by time, cut into folds: fold k is fitted on `train` times from time k * step on, and predicts the `step`
    times that begin `gap` times after them."""

    def __init__(self, table: DataFrame, features: list[str], train: int, step: int, gap: int):
        self.kept, self.features = Timed(table, ["label", *features], "label"), features
        self.train, self.step, self.gap = train, step, gap

    def __len__(self) -> int:
        return max(0, -(-(len(self.kept) - self.train - self.gap) // self.step))

    def _read(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for t in self.kept.batches(k * self.step, k * self.step + self.train, ["label", *self.features]):
            y = t["label"].to_numpy()
            some = ~np.isnan(y)
            held.append((np.column_stack([t[c].to_numpy()[some] for c in self.features]), y[some]))
            n += len(held[-1][1])
            if n >= CHUNK:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def rows(self, k: int) -> Rows:
        lo = k * self.step
        return Rows(self.kept.known(lo, lo + self.train), len(self.features), lambda: self._read(k))

    def told(self, k: int) -> Iterator[pa.Table]:
        lo = k * self.step + self.train + self.gap
        return self.kept.batches(lo, lo + self.step, ["ts", "symbol", *self.features])

    def each(self, spark: SparkSession, run: Callable[[int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """The rows that run gives for each fold, a task of its own."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    yield from run(k)

        return spark.range(0, len(self), 1, max(1, len(self))).mapInArrow(task, schema)

    def predictions(self, spark: SparkSession, model: str, least: int, name: str = "pred") -> DataFrame:
        fit = MODELS[model].fit

        def run(k: int) -> Iterator[pa.RecordBatch]:
            rows = self.rows(k)
            if rows.n < least:
                return
            tells = fit(rows)
            for t in self.told(k):
                pred = tells(np.column_stack([t[c].to_numpy() for c in self.features]))
                yield from pa.table({"ts": t["ts"], "symbol": t["symbol"], name: pred, "fold": np.full(len(pred), k, np.int32)}).to_batches()

        return self.each(spark, run, f"ts long, symbol string, {name} double, fold int")

    def importances(self, spark: SparkSession, model: str, least: int) -> DataFrame:
        fit = MODELS[model].fit

        def run(k: int) -> Iterator[pa.RecordBatch]:
            rows, gains = self.rows(k), []
            if rows.n >= least:
                fit(rows, gains=gains)
                yield pa.record_batch({"fold": np.full(len(self.features), k, np.int32), "factor": self.features, "importance": gains[0]})

        return self.each(spark, run, "fold int, factor string, importance double")


def walk_forward(table: DataFrame, features: list[str], model: str = "ridge", train: int = 120, step: int = 20, gap: int = 1, least: int = 100) -> DataFrame:
    """(ts, symbol, pred, fold): each fold fits on the `train` times that end `gap` times before it, and predicts `step` times.

    Folds are cut from the time axis and fitted apart from each other.  Times after the last whole fold make a shorter one.
    The table is written once, in order of time; each fold's task reads what it needs of that.
    """
    return _Folds(table, features, train, step, gap).predictions(table.sparkSession, model, least)


def combine_ml(factors: DataFrame, names: list[str], label: str = "label", window: int = 120, step: int = 20, gap: int = 1, least: int = 60, model: str = "forest") -> tuple[DataFrame, DataFrame]:
    """Factors combined by trees: scores (ts, symbol, score, fold), and each fold's importance of each factor.

    A fold of `step` times is fitted on the `window` times before it, less the `gap` whose labels aren't known yet; folds with
    fewer than `least` known rows give no score.  Missing factors are told apart, not filled in.
    """
    folds = _Folds(factors.withColumnRenamed(label, "label") if label != "label" else factors, names, window, step, gap)
    return folds.predictions(factors.sparkSession, model, least, "score"), folds.importances(factors.sparkSession, model, least)
