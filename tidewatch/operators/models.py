"""Online detectors with state, in numpy. Each scores a vector against what it has learnt, then learns it.

Models take vectors in the order of their sorted feature names, have ``score(x)`` (pure), ``step(x)`` and plain-data
state, and are seeded. Formulas are those of the original scheme; networks and random trees are drawn from other
generators, so their scores agree in meaning, not in digits.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_right, insort
from collections import deque
from itertools import chain
from statistics import NormalDist

import numpy as np

from tidewatch.operators.native import HASH_BINS, kind_of

_NORMAL = NormalDist()


class Model:
    scaling = "exp1m"

    def __init__(self, names: list[str], **params):
        self.names, self.n = list(names), 0
        for k, v in {**self.defaults, **params}.items():
            if k not in self.defaults:
                raise ValueError(f"{type(self).__name__} has no parameter {k!r}")
            setattr(self, k, v)
        self.start()

    defaults: dict = {}

    def start(self) -> None: ...

    def score(self, x: np.ndarray) -> float:
        return 0.0

    def update(self, x: np.ndarray, raw: float) -> None: ...

    def step(self, x: np.ndarray) -> float:
        """The score before learning, never negative or undefined."""
        raw = self.score(x)
        raw = max(0.0, float(raw)) if np.isfinite(raw) else 0.0
        self.update(x, raw)
        self.n += 1
        return raw

    def steps(self, x: np.ndarray) -> list[float]:
        """``step`` of each row in turn."""
        return [self.step(v) for v in x]

    def horizon(self) -> int | None:
        """How many rows before a row its score depends on, if no more than these; such models have ``prime``."""
        return None

    def scaled(self, raw: float) -> float:
        return {"raw": raw, "ratio": raw / (1 + raw), "exp1m": 1 - math.exp(-raw)}[self.scaling]


def combine(values: np.ndarray, how: str, k: int, temperature: float = 0.25) -> float:
    if how == "sum":
        return float(values.sum())
    if how == "mean":
        return float(values.mean())
    best = np.sort(values)[::-1][:k]
    if how == "topk_mean":
        return float(best.mean())
    w = np.exp((best - best[0]) / temperature)
    return float((w * best).sum() / w.sum())


def combined(values: np.ndarray, how: str, k: int, temperature: float = 0.25) -> np.ndarray:
    """``combine`` of each row."""
    if how in ("sum", "mean"):
        return values.sum(1) if how == "sum" else values.mean(1)
    best = np.sort(values, axis=1)[:, ::-1][:, :k]
    if how == "topk_mean":
        return best.mean(1)
    w = np.exp((best - best[:, :1]) / temperature)
    return (w * best).sum(1) / w.sum(1)


def sane(raw: np.ndarray) -> list[float]:
    """Scores as ``Model.step`` gives them."""
    return np.where(np.isfinite(raw), np.maximum(raw, 0.0), 0.0).tolist()


def pieces(x: np.ndarray, size: int) -> list[np.ndarray]:
    return [x[i : i + size] for i in range(0, len(x), size)]


class ZScore(Model):
    defaults = {"min_count": 20, "std_floor": 1e-3, "topk": 8}

    def start(self):
        self.mean, self.m2 = np.zeros(len(self.names)), np.zeros(len(self.names))

    def score(self, x):
        if self.n < self.min_count:
            return 0.0
        std = np.sqrt(np.maximum(self.m2 / max(1, self.n - 1), self.std_floor**2))
        return combine(np.abs(x - self.mean) / std, "topk_mean", self.topk)

    def update(self, x, raw):
        d = x - self.mean
        self.mean = self.mean + d / (self.n + 1)
        self.m2 = self.m2 + d * (x - self.mean)

    def steps(self, x):
        """Blocks of rows at once: running sums of distances from the mean at the block's start."""
        out = []
        for part in pieces(x, 1024):
            start = self.mean if self.n else part[0]
            d, n = part - start, self.n + np.arange(len(part) + 1)[:, None]
            one, two = (np.concatenate([np.zeros_like(d[:1]), np.cumsum(v, axis=0)]) for v in (d, d * d))
            mean, m2 = start + one / np.maximum(n, 1), self.m2 + np.maximum(0.0, two - one * one / np.maximum(n, 1))
            std = np.sqrt(np.maximum(m2[:-1] / np.maximum(1, n[:-1] - 1), self.std_floor**2))
            raw = combined(np.abs(part - mean[:-1]) / std, "topk_mean", self.topk)
            out += sane(np.where(n[:-1, 0] < self.min_count, 0.0, raw))
            self.mean, self.m2, self.n = mean[-1], m2[-1], self.n + len(part)
        return out


class Marginals:
    """Decayed counts of each feature's values, with surprisal and cumulative shares. Counts are kept in units that
    shrink with the decay, so that only what is new needs a write; numeric values and hashes count in prefix sums."""

    def __init__(self, names: list[str], bins: int, alpha: float, decay: float, inflated: bool = True, cap: int = 65536, ordered: bool = True):
        self.kinds, self.bins, self.alpha, self.decay, self.inflated, self.cap = [kind_of(n) for n in names], bins, alpha, decay, inflated, cap
        self.counts: list[dict[int, float]] = [{} for _ in names]
        self.upto = [Prefix(bins if k == "numeric" else HASH_BINS if k == "hash" else 2) for k in self.kinds] if ordered else []
        self.sums, self.scale = [0.0] * len(names), 1.0  # sums: with categories beyond the cap

    def key(self, j: int, v: float) -> int:
        kind = self.kinds[j]
        if kind == "hash":
            return min(max(int(math.floor(v * HASH_BINS + 1e-6)), 0), HASH_BINS - 1)
        if kind == "binary":
            return int(v >= 0.5)
        return 0 if v <= 0 else self.bins - 1 if v >= 1 else int(v * self.bins)

    def keys(self, j: int, v: np.ndarray) -> np.ndarray:
        """``key`` of each value."""
        if self.kinds[j] == "hash":
            return np.clip(np.floor(v * HASH_BINS + 1e-6), 0, HASH_BINS - 1).astype(np.int64)
        if self.kinds[j] == "binary":
            return (v >= 0.5).astype(np.int64)
        return np.where(v <= 0, 0, np.where(v >= 1, self.bins - 1, np.clip(v, 0, 1) * self.bins)).astype(np.int64)

    def bounded(self) -> bool:
        """Whether there can be more categories than the cap: then rows are learnt one by one."""
        return any(self.cap < (HASH_BINS if k == "hash" else 2) for k in self.kinds if k != "numeric")

    def weights(self, most: int) -> np.ndarray:
        """The scale behind each of the next rows, up to the next rescaling; none if it comes with the next row."""
        scale = np.multiply.accumulate(np.concatenate([[self.scale], np.full(most, self.decay)]))[1:]
        low = np.flatnonzero(scale < 1e-6)
        return scale[: low[0]] if len(low) else scale

    def surprisals(self, x: np.ndarray) -> np.ndarray:
        """``surprisal`` of each row, then ``learn``: of as many of the rows as come before the next rescaling."""
        scale = self.weights(len(x))
        if not len(scale):
            out = self.surprisal(x[0])[None]
            self.learn(x[0])
            return out
        x, w, before = x[: len(scale)], 1 / scale, np.concatenate([[self.scale], scale[:-1]])
        unit, out = np.ones(len(x)) if self.inflated else 1 / before, np.zeros((len(scale), len(self.kinds)))
        for j, counts in enumerate(self.counts):
            values, at = np.unique(self.keys(j, x[:, j]), return_inverse=True)
            held = [counts.get(v) for v in values.tolist()]
            base = np.array([h or 0.0 for h in held])
            order = np.argsort(at, kind="stable")
            sofar = np.cumsum(w[order]) - w[order]
            first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
            earlier = np.zeros(len(x))
            earlier[order] = sofar - sofar[first][at[order]]
            sums = np.cumsum(np.concatenate([[self.sums[j]], w]))
            if self.kinds[j] == "numeric":
                size = np.full(len(x), float(self.bins))
            else:
                new = np.zeros(len(x))
                new[order[first]] = [h is None for h in held]
                size = np.maximum(2.0, len(counts) + np.cumsum(new) - new + 1.0)
            a = self.alpha * unit
            out[:, j] = np.maximum(0.0, -np.log((base[at] + earlier + a) / (sums[:-1] + a * size)) - np.log(size))
            counts.update(zip(values.tolist(), (base + np.bincount(at, w, len(values))).tolist(), strict=True))
            self.sums[j] = float(sums[-1])
        self.scale = float(scale[-1])
        return out

    def _size(self, j: int) -> float:
        return float(self.bins) if self.kinds[j] == "numeric" else max(2.0, len(self.counts[j]) + 1.0)

    def surprisal(self, x: np.ndarray) -> np.ndarray:
        out, unit = np.zeros(len(x)), 1.0 if self.inflated else 1.0 / self.scale
        for j, v in enumerate(x):
            size, a = self._size(j), self.alpha * unit
            out[j] = max(0.0, -math.log((self.counts[j].get(self.key(j, v), 0.0) + a) / (self.sums[j] + a * size)) - math.log(size))
        return out

    def cdf(self, x: np.ndarray) -> np.ndarray:
        """Of each value the share of values up to it, smoothed by one alpha against one a category."""
        out = np.zeros(len(x))
        for j, v in enumerate(x):
            out[j] = (self.upto[j].sum(self.key(j, v)) + self.alpha) / (self.sums[j] + self.alpha * self._size(j))
        return np.clip(out, 1e-12, 1 - 1e-12)

    def learn(self, x: np.ndarray) -> None:
        self.scale *= self.decay
        if self.scale < 1e-6:
            self.counts = [{k: w * self.scale for k, w in c.items()} for c in self.counts]
            for p in self.upto:
                p.held = [x * self.scale for x in p.held]
            self.sums, self.scale = [x * self.scale for x in self.sums], 1.0
        for j, v in enumerate(x):
            k, w = self.key(j, v), 1 / self.scale
            self.sums[j] += w
            if self.kinds[j] != "numeric" and k not in self.counts[j] and len(self.counts[j]) >= self.cap:
                continue
            self.counts[j][k] = self.counts[j].get(k, 0.0) + w
            if self.upto:
                self.upto[j].add(k, w)


class Opened:
    """Marginals as arrays while a block of rows is learnt; ``close`` puts them back."""

    def __init__(self, m: Marginals):
        self.m, self.held = m, []
        for counts, p in zip(m.counts, m.upto, strict=True):
            held = np.zeros(len(p.held) - 1)
            held[list(counts)] = list(counts.values())
            self.held.append(held)

    def cdfs(self, x: np.ndarray) -> np.ndarray:
        """``cdf`` of each row, then ``learn``: of as many of the rows as come before the next rescaling."""
        m = self.m
        scale = m.weights(len(x))
        if not len(scale):
            self.close()
            out = m.cdf(x[0])[None]
            m.learn(x[0])
            self.__init__(m)
            return out
        x, w = x[: len(scale)], 1 / scale
        out, earlier = np.zeros_like(x), np.tri(len(x), k=-1, dtype=bool)
        for j, held in enumerate(self.held):
            key, size = m.keys(j, x[:, j]), float(m.bins)
            if m.kinds[j] != "numeric":
                new = np.zeros(len(x))
                values, first = np.unique(key, return_index=True)
                new[first] = held[values] == 0
                size = np.maximum(2.0, np.count_nonzero(held) + np.cumsum(new) - new + 1.0)
            upto = np.cumsum(held)[key] + ((key[None, :] <= key[:, None]) & earlier) @ w
            sums = np.cumsum(np.concatenate([[m.sums[j]], w]))
            out[:, j] = (upto + m.alpha) / (sums[:-1] + m.alpha * size)
            np.add.at(held, key, w)
            m.sums[j] = float(sums[-1])
        m.scale = float(scale[-1])
        return np.clip(out, 1e-12, 1 - 1e-12)

    def close(self) -> None:
        for j, held in enumerate(self.held):
            at = np.flatnonzero(held)
            self.m.counts[j] = dict(zip(at.tolist(), held[at].tolist(), strict=True))
            upto, i = np.concatenate([[0.0], np.cumsum(held)]), np.arange(len(held) + 1)
            self.m.upto[j].held = (upto - upto[i - (i & -i)]).tolist()


class Prefix:
    """Sums of the first numbers of an array that changes, by a binary indexed tree."""

    def __init__(self, n: int):
        self.held = [0.0] * (n + 1)

    def add(self, i: int, x: float) -> None:
        i += 1
        while i < len(self.held):
            self.held[i] += x
            i += i & -i

    def sum(self, i: int) -> float:
        """Of the numbers 0 to i."""
        out, i = 0.0, i + 1
        while i:
            out += self.held[i]
            i -= i & -i
        return out


class Freq1D(Model):
    """decay_mode 'reference' adds alpha to inflated counts; 'corrected' inflates alpha as well."""

    defaults = {"bins": 65536, "alpha": 1.0, "decay": 1.0, "cap": 65536, "how": "mean", "topk": 8, "temperature": 0.25, "decay_mode": "reference"}

    def start(self):
        self.m = Marginals(self.names, self.bins, self.alpha, self.decay, self.decay_mode == "reference", self.cap, False)

    def score(self, x):
        return combine(self.m.surprisal(x), self.how, self.topk, self.temperature)

    def update(self, x, raw):
        self.m.learn(x)

    def steps(self, x):
        """Blocks of rows at once: what a block's rows add to counts is summed up by value."""
        if self.m.bounded():
            return super().steps(x)
        out = []
        for part in pieces(x, 4096):
            done = 0
            while done < len(part):
                got = self.m.surprisals(part[done:])
                out += sane(combined(got, self.how, self.topk, self.temperature))
                done += len(got)
        self.n += len(x)
        return out


def normal(u: np.ndarray, clamp: float) -> np.ndarray:
    return np.array([_NORMAL.inv_cdf(v) for v in np.clip(u, clamp, 1 - clamp).tolist()])


def spanning_tree(weight: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning tree, by Prim's method."""
    d = len(weight)
    best, via, inside, out = np.full(d, -np.inf), np.zeros(d, int), np.zeros(d, bool), []
    best[0] = np.inf
    for _ in range(d):
        v = int(np.argmax(np.where(inside, -np.inf, best)))
        if best[v] < np.inf:
            out.append((int(via[v]), v))
        inside[v] = True
        closer = ~inside & (weight[v] > best)
        best[closer], via[closer] = weight[v][closer], v
    return out


class CopulaTree(Model):
    scaling = "ratio"
    defaults = {"bins": 4096, "alpha": 1.0, "decay": 1.0, "reg": 0.05, "u_clamp": 1e-6, "window": 500, "interval": 100, "max_features": 30, "how": "mean", "topk": 8}

    def start(self):
        d = len(self.names)
        self.m, self.pair, self.tree, self.weight = Marginals(self.names, self.bins, self.alpha, self.decay), np.zeros((d, d)), [], np.zeros(d)
        self.used = np.arange(d)

    def z(self, x):
        return normal(self.m.cdf(x), self.u_clamp)

    def rho(self):
        s = self.pair.copy()
        np.fill_diagonal(s, np.maximum(np.diag(s), self.reg))
        r = np.clip(s / np.sqrt(np.outer(np.diag(s), np.diag(s))), -0.995, 0.995)
        return r

    def score(self, x):
        if self.n < 2 or not self.tree:
            return 0.0
        z, r = self.z(x), self.rho()
        edges = []
        for i, j in self.tree:
            p = r[i, j]
            edges.append(max(0.0, 0.5 * math.log(1 - p * p) + 0.5 * (p * p * (z[i] ** 2 + z[j] ** 2) - 2 * p * z[i] * z[j]) / (1 - p * p)))
        return combine(np.array(edges), self.how, self.topk)

    def update(self, x, raw):
        z, keep = self.z(x), 1 - 1 / self.interval
        self.m.learn(x)
        self.weight = (1 - 1 / self.window) * self.weight + np.abs(z) / self.window
        if 0 < self.max_features < len(x) and self.n and self.n % self.window == 0:
            used = np.sort(np.argsort(-self.weight, kind="stable")[: self.max_features])
            if len(used) != len(self.used) or (used != self.used).any():
                self.used, self.pair, self.tree = used, np.zeros_like(self.pair), []
        self.pair = keep * self.pair + (1 - keep) * np.outer(z, z)
        if not self.tree or self.n % self.interval == 0:
            r = np.abs(self.rho())[np.ix_(self.used, self.used)]
            self.tree = [(int(self.used[i]), int(self.used[j])) for i, j in spanning_tree(r)]

    def steps(self, x):
        """Blocks of rows at once, with what lies between two trees by powers of the moving averages' share."""
        d = len(self.names)
        if self.m.bounded() or d < 2 or 0 < self.max_features < d or self.interval < 2:
            return super().steps(x)
        out, done, held, keep, stay = [], 0, Opened(self.m), 1 - 1 / self.interval, 1 - 1 / self.window
        power, late = keep ** np.arange(257), np.arange(256)[:, None] - 1 - np.arange(256)[None, :]
        shares, ahead = np.where(late >= 0, power[np.maximum(late, 0)], 0.0), np.zeros((0, d))
        while done < len(x):
            if not len(ahead):
                u = held.cdfs(x[done : done + 256])
                ahead = normal(u.ravel(), self.u_clamp).reshape(u.shape)
            n = min(len(ahead), -self.n % self.interval + 1) if self.tree else 1
            here, ahead = ahead[:n], ahead[n:]
            pairs = (here[:, :, None] * here[:, None, :]).reshape(n, -1)
            before = (power[:n, None] * self.pair.ravel() + (1 - keep) * (shares[:n, :n] @ pairs)).reshape(n, d, d)
            if self.tree:
                i, j = np.array(self.tree).T
                own = np.maximum(before[:, np.arange(d), np.arange(d)], self.reg)
                p, a, b = np.clip(before[:, i, j] / np.sqrt(own[:, i] * own[:, j]), -0.995, 0.995), here[:, i], here[:, j]
                edges = np.maximum(0.0, 0.5 * np.log(1 - p * p) + 0.5 * (p * p * (a**2 + b**2) - 2 * p * a * b) / (1 - p * p))
                out += sane(np.where(self.n + np.arange(n) < 2, 0.0, combined(edges, self.how, self.topk)))
            else:
                out += [0.0] * n
            self.pair = keep * before[-1] + (1 - keep) * pairs[-1].reshape(d, d)
            self.weight = stay**n * self.weight + (stay ** np.arange(n)[::-1]) @ np.abs(here) / self.window
            self.n, done = self.n + n, done + n
            if not self.tree or (self.n - 1) % self.interval == 0:
                self.tree = [(int(self.used[i]), int(self.used[j])) for i, j in spanning_tree(np.abs(self.rho())[np.ix_(self.used, self.used)])]
        held.close()
        return out


class LatentCluster(Model):
    scaling = "ratio"
    defaults = {"bins": 4096, "alpha": 1.0, "decay": 1.0, "clusters": 8, "u_clamp": 1e-6, "reg": 0.25, "rate": 0.05, "spawn": 6.0}

    def start(self):
        self.m = Marginals(self.names, self.bins, self.alpha, self.decay)
        self.centre, self.var, self.seen = [], [], []
        self.ema, self.emvar = None, 0.0
        self.accepted = 0

    def _distances(self, z):
        return np.array([(((c - z) ** 2) / np.maximum(v, self.reg)).sum() for c, v in zip(self.centre, self.var, strict=True)])

    def _z(self, x):
        return normal(self.m.cdf(x), self.u_clamp)

    def score(self, x):
        return float(self._distances(self._z(x)).min()) if self.centre else 0.0

    def update(self, x, raw):
        z = self._z(x)
        if self.ema is None:
            self.ema = raw
        else:
            gap = raw - self.ema
            self.ema += self.rate * gap
            self.emvar = (1 - self.rate) * self.emvar + self.rate * gap * gap
        if not self.centre or (raw > self.spawn and len(self.centre) < self.clusters):
            self.centre.append(z), self.var.append(np.ones_like(z)), self.seen.append(1)
        elif self.accepted < max(16, 4 * self.clusters) or raw <= max(1.5, self.ema + 2.5 * math.sqrt(self.emvar)):
            k = int(self._distances(z).argmin())
            eta = max(self.rate, 1 / (self.seen[k] + 1))
            self.centre[k] = (1 - eta) * self.centre[k] + eta * z
            d = z - self.centre[k]  # from the centre as it is now
            self.var[k] = np.maximum(self.reg, (1 - eta) * self.var[k] + eta * d * d)
            self.seen[k] += 1
        else:
            return
        self.accepted += 1
        self.m.learn(x)

    def steps(self, x):
        """Whether a row is learnt depends on the row before, so rows go one by one, in plain numbers; each one's place
        among the clusters is found once."""
        m, out, to_z, lo, hi = self.m, [], _NORMAL.inv_cdf, max(self.u_clamp, 1e-12), 1 - max(self.u_clamp, 1e-12)
        if m.bounded() or m.decay != 1 or not len(x):
            return super().steps(x)
        alpha, total, free = m.alpha, m.sums[0], [float(m.bins) if k == "numeric" else None for k in m.kinds]
        parts = list(zip([p.held for p in m.upto], m.counts, free, strict=True))
        keys = np.column_stack([m.keys(j, x[:, j]) for j in range(len(self.names))]).tolist()
        centre, var, seen, few = [c.tolist() for c in self.centre], [v.tolist() for v in self.var], [*self.seen], max(16, 4 * self.clusters)
        reg, ema, emvar, rate, accepted = self.reg, self.ema, self.emvar, self.rate, self.accepted
        wide = [[max(v, reg) for v in row] for row in var]
        for key in keys:
            z = []
            for k, (held, counts, size) in zip(key, parts):  # noqa: B905
                i, upto = k + 1, 0.0
                while i:
                    upto += held[i]
                    i &= i - 1
                u = (upto + alpha) / (total + alpha * (size or max(2.0, len(counts) + 1.0)))
                z.append(to_z(lo if u < lo else hi if u > hi else u))
            raw, near = math.inf, 0
            for q, (c, w) in enumerate(zip(centre, wide)):  # noqa: B905
                far = 0.0
                for a, b, v in zip(c, z, w):  # noqa: B905
                    a -= b
                    far += a * a / v
                    if far >= raw:
                        break
                else:
                    raw, near = far, q
            raw = raw if centre else 0.0
            out.append(raw)
            if ema is None:
                ema = raw
            else:
                off = raw - ema
                ema += rate * off
                emvar = (1 - rate) * emvar + rate * off * off
            if not centre or (raw > self.spawn and len(centre) < self.clusters):
                centre.append(z), var.append([1.0] * len(z)), wide.append([max(1.0, reg)] * len(z)), seen.append(1)
            elif accepted < few or raw <= max(1.5, ema + 2.5 * math.sqrt(emvar)):
                eta = max(rate, 1 / (seen[near] + 1))
                stay = 1 - eta
                centre[near] = c = [stay * a + eta * b for a, b in zip(centre[near], z)]  # noqa: B905
                var[near] = wide[near] = [max(reg, stay * v + eta * (b - a) * (b - a)) for v, a, b in zip(var[near], c, z)]  # noqa: B905
                seen[near] += 1
            else:
                continue
            accepted += 1
            total += 1.0
            for k, (held, counts, _) in zip(key, parts):  # noqa: B905
                counts[k] = counts.get(k, 0.0) + 1.0
                i, end = k + 1, len(held)
                while i < end:
                    held[i] += 1.0
                    i += i & -i
        self.centre, self.var, self.seen = [np.array(c) for c in centre], [np.array(v) for v in var], seen
        self.ema, self.emvar, self.accepted, m.sums = ema, emvar, accepted, [total] * len(m.sums)
        self.n += len(x)
        return sane(np.array(out))


class Knn(Model):
    defaults = {"k": 5, "memory": 1024, "metric": "euclidean"}

    def start(self):
        if self.metric not in ("euclidean", "manhattan", "chebyshev", "cosine"):
            raise ValueError(f"unknown metric {self.metric!r}")
        self.ring = np.zeros((self.memory, len(self.names)))

    def score(self, x):
        filled = self.ring[: min(self.n, self.memory)]
        if not len(filled):
            return 0.0
        d = filled - x
        if self.metric == "euclidean":
            d = np.sqrt((d * d).sum(1))
        elif self.metric == "manhattan":
            d = np.abs(d).sum(1)
        elif self.metric == "chebyshev":
            d = np.abs(d).max(1)
        else:
            norm = np.linalg.norm(filled, axis=1) * np.linalg.norm(x)
            d = 1 - np.divide(filled @ x, norm, out=np.zeros(len(filled)), where=norm > 0)
        k = min(self.k, len(d))
        return float(np.partition(d, k - 1)[:k].mean())

    def update(self, x, raw):
        self.ring[self.n % self.memory] = x

    def horizon(self):
        return self.memory

    def prime(self, x):
        """Learn rows that nobody asks the scores of."""
        last = x[-self.memory :]
        self.ring[(self.n + len(x) - len(last) + np.arange(len(last))) % self.memory] = last
        self.n += len(x)

    def steps(self, x):
        """Blocks of rows at once: each row is held against the memory and the rows before it in the block."""
        if self.metric == "cosine":
            return super().steps(x)
        out = super().steps(x[: max(0, self.k - self.n)])
        x, block = x[len(out) :], max(1, min(256, (1 << 22) // ((self.memory + 256) * max(1, len(self.names)))))
        for part in np.split(x, range(block, len(x), block)) if len(x) else ():
            at = self.n % self.memory
            past = self.ring[: self.n] if self.n < self.memory else np.concatenate([self.ring[at:], self.ring[:at]])
            seen = np.concatenate([past, part])
            d = seen[None, :, :] - part[:, None, :]
            d = np.sqrt((d * d).sum(2)) if self.metric == "euclidean" else np.abs(d).sum(2) if self.metric == "manhattan" else np.abs(d).max(2)
            age = np.arange(len(part))[:, None] + len(past) - np.arange(len(seen))[None, :]
            d[(age < 1) | (age > self.memory)] = np.inf
            raw = np.partition(d, self.k - 1, axis=1)[:, : self.k].mean(1)
            out += np.where(np.isfinite(raw), raw, 0.0).tolist()
            self.ring[(self.n + np.arange(len(part))) % self.memory] = part
            self.n += len(part)
        return out


class HalfSpaceTrees(Model):
    """Random axis-parallel cuts of a work space; masses of one window score the next."""

    scaling = "raw"
    defaults = {"trees": 25, "height": 8, "window": 250, "seed": 42}

    def start(self):
        rng, nodes = np.random.default_rng(self.seed), (1 << self.height) - 1
        self.dim = rng.integers(0, len(self.names), (self.trees, nodes))
        self.cut = np.zeros((self.trees, nodes))
        for t in range(self.trees):
            s = rng.random(len(self.names))
            lo, hi = s - 2 * np.maximum(s, 1 - s), s + 2 * np.maximum(s, 1 - s)
            stack = [(0, lo, hi)]
            while stack:
                v, lo, hi = stack.pop()
                if v < nodes:
                    q = self.dim[t, v]
                    self.cut[t, v] = (lo[q] + hi[q]) / 2
                    left, right = hi.copy(), lo.copy()
                    left[q] = right[q] = self.cut[t, v]
                    stack += [(2 * v + 1, lo, left), (2 * v + 2, right, hi)]
        self.old, self.new = (np.zeros((self.trees, 2 * nodes + 1)) for _ in "ab")

    def _path(self, x):
        v, rows = np.zeros(self.trees, int), np.arange(self.trees)
        out = [v]
        for _ in range(self.height):
            v = 2 * v + 1 + (x[self.dim[rows, v]] >= self.cut[rows, v])
            out.append(v)
        return np.array(out)

    def score(self, x):
        if self.n < self.window:
            return 0.0
        path, rows = self._path(x), np.arange(self.trees)
        most = self.window * 2.0**self.height
        return 1 - float((self.old[rows, path[-1]] * 2.0**self.height).mean()) / most

    def update(self, x, raw):
        for v in self._path(x):
            self.new[np.arange(self.trees), v] += 1
        if (self.n + 1) % self.window == 0:
            self.old, self.new = self.new, np.zeros_like(self.new)

    def steps(self, x):
        """The rows of a window at once, as their scores rest on the window before."""
        out, done, trees, leaves = [], 0, np.arange(self.trees), 1 << self.height
        while done < len(x):
            part = x[done : done + min(4096, self.window - self.n % self.window)]
            v, rows = np.zeros((len(part), self.trees), int), np.arange(len(part))[:, None]
            for _ in range(self.height):
                v = 2 * v + 1 + (part[rows, self.dim[trees, v]] >= self.cut[trees, v])
            if self.n < self.window:
                out += [0.0] * len(part)
            else:
                out += sane(1 - (self.old[trees, v] * 2.0**self.height).mean(1) / (self.window * 2.0**self.height))
            mass = np.bincount((v - (leaves - 1) + trees * leaves).ravel(), minlength=self.trees * leaves).reshape(self.trees, leaves)
            for h in range(self.height, -1, -1):  # each node holds what those below it do
                self.new[:, (1 << h) - 1 : (2 << h) - 1] += mass
                mass = mass.reshape(self.trees, -1, 2).sum(2) if h else mass
            self.n, done = self.n + len(part), done + len(part)
            if self.n % self.window == 0:
                self.old, self.new = self.new, np.zeros_like(self.new)
        return out


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def __call__(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            params[k] = params[k] - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class AutoEncoder:
    """One tanh layer in, one linear layer out; squared error, one step at a time."""

    def __init__(self, d: int, hidden: int, rate: float, rng: np.random.Generator):
        s = 1 / math.sqrt(d)
        self.p = {"w": rng.uniform(-s, s, (d, hidden)), "b": np.zeros(hidden), "u": rng.uniform(-s, s, (hidden, d)), "c": np.zeros(d)}
        self.adam = Adam(rate)

    def encode(self, x):
        return np.tanh(x @ self.p["w"] + self.p["b"])

    def error(self, x):
        return float(np.sqrt(np.mean((self.encode(x) @ self.p["u"] + self.p["c"] - x) ** 2)))

    def errors(self, x):
        """``error`` of each row."""
        return np.sqrt(np.mean((self.encode(x) @ self.p["u"] + self.p["c"] - x) ** 2, axis=1))

    def learn(self, x, target=None):
        target = x if target is None else target
        h = self.encode(x)
        e = 2 * (h @ self.p["u"] + self.p["c"] - target) / len(x)
        dh = (e @ self.p["u"].T) * (1 - h * h)
        self.adam(self.p, {"w": np.outer(x, dh), "b": dh, "u": np.outer(h, e), "c": e})


class KitNet(Model):
    """An ensemble of small autoencoders over correlated features, and one over their errors."""

    defaults = {"grace_map": 500, "grace_train": 2000, "width": 0, "rate": 0.01, "seed": 42}

    def start(self):
        d = len(self.names)
        self.limit = min(d, self.width) if self.width else max(2, min(32, math.ceil(math.sqrt(d))))
        self.sum, self.res, self.res2, self.outer = np.zeros(d), np.zeros(d), np.zeros(d), np.zeros((d, d))
        self.parts, self.low, self.high = None, np.full(d, np.inf), np.full(d, -np.inf)

    def _build(self):
        d, rng = len(self.names), np.random.default_rng(self.seed)
        scale = np.sqrt(np.outer(self.res2, self.res2))
        gap = 1 - np.divide(self.outer, scale, out=np.zeros((d, d)), where=scale > 0)
        parts = [[i] for i in range(d)]
        while len(parts) > 1:  # single linkage up to the widest part allowed
            pairs = [(min(gap[i, j] for i in a for j in b), x, y) for x, a in enumerate(parts) for y, b in enumerate(parts[:x]) if len(a) + len(b) <= self.limit]
            if not pairs:
                break
            _, x, y = min(pairs)
            parts[y] = parts[y] + parts.pop(x)
        self.parts = [np.array(sorted(p)) for p in parts]
        self.nets = [AutoEncoder(len(p), max(1, math.ceil(0.75 * len(p))), self.rate, rng) for p in self.parts]
        self.last = AutoEncoder(len(parts), max(1, math.ceil(0.75 * len(parts))), self.rate, rng)

    def _unit(self, x):
        return np.clip((x - self.low) / np.where(self.high > self.low, self.high - self.low, 1.0), -1, 2)

    def _errors(self, x):
        u = self._unit(x)
        return np.array([n.error(u[p]) for n, p in zip(self.nets, self.parts, strict=True)])

    def score(self, x):
        if self.parts is None or self.n < self.grace_map + self.grace_train:
            return 0.0
        return self.last.error(self._errors(x))

    def update(self, x, raw):
        if self.n < self.grace_map + self.grace_train:
            self.low, self.high = np.minimum(self.low, x), np.maximum(self.high, x)
        if self.parts is None:
            self.sum = self.sum + x
            r = x - self.sum / (self.n + 1)
            self.res, self.res2, self.outer = self.res + r, self.res2 + r * r, self.outer + np.outer(r, r)
            if self.n + 1 >= self.grace_map:
                self._build()
            return
        if self.n < self.grace_map + self.grace_train:
            u = self._unit(x)
            for n, p in zip(self.nets, self.parts, strict=True):
                n.learn(u[p])
            self.last.learn(self._errors(x))

    def steps(self, x):
        """All rows at once, once nothing is learnt any more."""
        some = max(0, self.grace_map + self.grace_train - self.n)
        out = super().steps(x[:some])
        if self.parts is None:
            return out + super().steps(x[some:])
        for part in pieces(x[some:], 4096):
            u = self._unit(part)
            out += sane(self.last.errors(np.column_stack([n.errors(u[:, p]) for n, p in zip(self.nets, self.parts, strict=True)])))
            self.n += len(part)
        return out


class MemStream(Model):
    """Nearest latent memories of a denoising autoencoder; only rows near what is known enter the memory."""

    defaults = {"memory": 512, "rate": 0.01, "beta": 0.1, "k": 3, "gamma": 0.0, "warmup": 512, "mode": "raw", "bins": 4096, "seed": 42}

    def start(self):
        d = len(self.names)
        self.front = Marginals(self.names, self.bins, 1.0, 1.0) if self.mode != "raw" else None
        self.width = d * (2 if self.mode == "freq1d_z_surprisal" else 1)
        self.rng = np.random.default_rng(self.seed)
        self.net = AutoEncoder(self.width, 2 * self.width, self.rate, self.rng)
        self.mem, self.inputs, self.filled = np.zeros((self.memory, 2 * self.width)), np.zeros((self.memory, self.width)), 0
        self.mean, self.std = np.zeros(self.width), np.ones(self.width)
        self.debug = {"accepted": 0}

    def _in(self, x):
        if self.front is None:
            return x
        u = self.front.cdf(x)
        z = normal(u, 1e-6)
        return {"freq1d_u": u, "freq1d_z": z}.get(self.mode, self.front.surprisal(x) if self.mode == "freq1d_surprisal" else np.concatenate([z, self.front.surprisal(x)]))

    def _norm(self, v):
        return (v - self.mean) / self.std

    def score(self, x):
        have = min(self.filled, self.memory)
        if not have:
            return 0.0
        d = np.sort(np.abs(self.mem[:have] - self.net.encode(self._norm(self._in(x)))).sum(1))[: min(self.k, have)]
        w = self.gamma ** np.arange(len(d)) if self.gamma > 0 else np.eye(1, len(d))[0]
        return float((d * w).sum() / w.sum())

    def update(self, x, raw):
        v = self._in(x)
        if self.filled < self.warmup or raw <= self.beta:
            u = self._norm(v)
            noisy = u + self.rng.normal(0, 1e-3, len(u))
            at = self.filled % self.memory
            self.inputs[at], self.mem[at] = v, self.net.encode(noisy)  # as it is before the step
            self.net.learn(noisy, u)
            self.filled += 1
            have = self.inputs[: min(self.filled, self.memory)]
            std = have.std(0)
            self.mean, self.std = have.mean(0), np.where(std > 1e-6, std, 1.0)
            self.debug["accepted"] += 1
        if self.front is not None:
            self.front.learn(x)

    def _nearest(self, e: np.ndarray, have: int) -> np.ndarray:
        """The distance of each encoded row to the nearest memory, of a few rows at a time, so that these stay in the cache."""
        size = max(1, 65_536 // have)
        mem, out, held = np.ascontiguousarray(self.mem[:have].T), np.empty(len(e)), np.empty((2, size, have))
        for i in range(0, len(e), size):
            part = e[i : i + size]
            far, gap = held[:, : len(part)]
            far[:] = 0.0
            for j, known in enumerate(mem):
                np.subtract(known, part[:, j : j + 1], gap)
                np.abs(gap, gap)
                np.add(far, gap, far)
            out[i : i + size] = far.min(1)
        return out

    def steps(self, x):
        """Rows up to the next one that enters the memory at once: nothing changes in between."""
        if self.front is not None or self.gamma > 0:
            return super().steps(x)
        out, done, many = [], 0, 1
        while done < len(x):
            have = min(self.filled, self.memory)
            part = x[done : done + many] if self.filled >= self.warmup and have else x[:0]
            if not len(part):
                out.append(self.step(x[done]))
                done += 1
                continue
            raw = np.array(sane(self._nearest(self.net.encode(self._norm(part)), have)))
            low = np.flatnonzero(raw <= self.beta)
            n = low[0] + 1 if len(low) else len(part)
            self.n += n - 1
            if len(low):
                self.update(part[n - 1], raw[n - 1])
            self.n += 1
            out += raw[:n].tolist()
            done, many = done + n, min(256, 2 * many) if not len(low) else max(1, min(many, 2 * n))
        return out


class Loda(Model):
    """Sparse random projections with histograms of values normalised by moving averages."""

    defaults = {"projections": 20, "bins": 64, "reach": 3.0, "rate": 0.01, "decay": 1.0, "seed": 42}

    def start(self):
        d = len(self.names)
        n, rng = max(self.projections, max(8, min(256, math.ceil(2 * math.sqrt(d))))), np.random.default_rng(self.seed)
        self.w = np.zeros((n, d))
        for r in self.w:
            at = rng.choice(d, max(1, int(math.sqrt(d))), replace=False)
            r[at] = rng.normal(size=len(at))
            r /= np.linalg.norm(r) or 1.0
        self.mean, self.var, self.hist = np.zeros(n), np.ones(n), np.zeros((n, self.bins))

    def _bin(self, x):
        u = np.clip((self.w @ x - self.mean) / np.sqrt(self.var + 1e-6), -self.reach, self.reach)
        return np.minimum(((u + self.reach) / (2 * self.reach) * self.bins).astype(int), self.bins - 1)

    def score(self, x):
        h = self.hist * self.decay
        p = (h[np.arange(len(h)), self._bin(x)] + 1) / (h.sum(1) + self.bins)
        return float(np.maximum(0.0, -np.log(p) - math.log(self.bins)).mean())

    def update(self, x, raw):
        self.hist = self.hist * self.decay
        self.hist[np.arange(len(self.hist)), self._bin(x)] += 1
        y = self.w @ x
        gap = y - self.mean
        self.mean = self.mean + self.rate * gap
        self.var = (1 - self.rate) * self.var + self.rate * gap * gap

    def steps(self, x):
        """Blocks of rows at once: moving averages by powers of their share, counts by bin within the block."""
        if self.decay != 1:
            return super().steps(x)
        out, rows, stay = [], np.arange(len(self.hist)), 1 - self.rate
        for part in pieces(x, 128):
            n = len(part)
            power, late = stay ** np.arange(n + 1), np.arange(n + 1)[:, None] - 1 - np.arange(n)[None, :]
            share = self.rate * np.where(late >= 0, power[np.maximum(late, 0)], 0.0)
            y = part @ self.w.T
            mean = power[:, None] * self.mean + share @ y
            var = power[:, None] * self.var + share @ (y - mean[:-1]) ** 2
            u = np.clip((y - mean[:-1]) / np.sqrt(var[:-1] + 1e-6), -self.reach, self.reach)
            bin_ = np.minimum(((u + self.reach) / (2 * self.reach) * self.bins).astype(int), self.bins - 1).T
            order = np.argsort(bin_.astype(np.int16) if self.bins < 1 << 15 else bin_, axis=1, kind="stable")
            sorted_, place = np.take_along_axis(bin_, order, 1), np.arange(n)[None, :]
            first = np.maximum.accumulate(np.where(np.diff(sorted_, axis=1, prepend=-1) > 0, place, 0), axis=1)
            earlier = np.empty_like(bin_)
            np.put_along_axis(earlier, order, place - first, 1)
            p = (self.hist[rows[:, None], bin_] + earlier + 1) / (self.hist.sum(1)[:, None] + place + self.bins)
            out += sane(np.maximum(0.0, -np.log(p) - math.log(self.bins)).T.mean(1))
            self.hist = self.hist + np.bincount((bin_ + rows[:, None] * self.bins).ravel(), minlength=self.hist.size).reshape(self.hist.shape)
            self.mean, self.var, self.n = mean[-1], var[-1], self.n + n
        return out


class NextToken(Model):
    """A multilayer perceptron over the context that predicts the next token; its output grows with new tokens. The
    score is one minus the token's probability after the step that learns it."""

    defaults = {"hidden": 64, "layers": 2, "rate": 0.003, "dropout": 0.5, "seed": 42}

    def start(self):
        self.rng, self.classes, self.t = np.random.default_rng(self.seed), 0, 0
        sizes, parts = [len(self.names)] + [self.hidden] * self.layers, []
        for a, b in zip(sizes, sizes[1:], strict=False):
            parts += [self.rng.uniform(-1, 1, (a, b)).ravel() / math.sqrt(a), np.zeros(b)]
        self.p = np.concatenate(parts)
        self._rest()

    def _rest(self) -> None:
        """Moments of 0. ``low`` is the part from which on parameters move, ``since`` the step at which each last did."""
        self.m, self.v = np.zeros_like(self.p), np.zeros_like(self.p)
        self.t, self.low, self.since = 0, 0, [0] * (2 * self.layers + 2)

    def _views(self, flat: np.ndarray) -> list[np.ndarray]:
        """The weights of each layer and of the output, biases as their last rows, in one array of all parameters."""
        out, at, a = [], 0, len(self.names)
        for b in [self.hidden] * self.layers + [self.classes]:
            out.append(flat[at : at + (a + 1) * b].reshape(a + 1, b))
            at, a = at + (a + 1) * b, b
        return out

    def _grow(self, classes: int) -> None:
        *below, last = self._views(self.p)
        more = classes - self.classes
        last = np.vstack([np.hstack([last[:-1], self.rng.uniform(-1, 1, (self.hidden, more)) / math.sqrt(self.hidden)]), np.concatenate([last[-1], np.zeros(more)])])
        self.p, self.classes = np.concatenate([x.ravel() for x in (*below, last)]), classes
        self._rest()

    _work = None

    def _room(self) -> tuple:
        """Views and space that one step after the other uses; not a part of the state."""
        if self._work is None or self._work[0] is not self.p:
            g = np.zeros_like(self.p)
            hs = [np.ones(n + 1) for n in (len(self.names), *[self.hidden] * self.layers)]
            views = self._views(self.p)
            ends = np.cumsum([0] + [n for w in views for n in (w.size - w.shape[1], w.shape[1])]).tolist()  # weights, biases
            self._work = self.p, views, g, self._views(g), np.empty_like(self.p), hs, [h[:-1] for h in hs], ends
        return self._work

    def _learn(self, g: np.ndarray, room: np.ndarray, ends: list[int], least: int) -> None:
        """A step of Adam, in place, over the parameters from the first part that moves on: below it gradients and means
        are 0, as behind units that are silent, so nothing would change but spreads, which shrink when a part wakes.
        Corrections that have become 1 are left out, and what is too small to move anything becomes 0."""
        for i in range(least, self.low):  # it wakes
            self.v[ends[i] : ends[i + 1]] *= 0.999 ** (self.t - self.since[i])
        self.low = min(self.low, least)
        self.t += 1
        one, two = 1 - 0.9**self.t, 1 - 0.999**self.t
        at = ends[self.low]
        p, m, v, g, room = self.p[at:], self.m[at:], self.v[at:], g[at:], room[at:]
        m *= 0.9
        m += np.multiply(g, 0.1, out=room)
        np.multiply(g, 0.001, out=room)
        room *= g
        v *= 0.999
        v += room
        np.sqrt(v if two == 1 else np.divide(v, two, out=room), out=room)
        room += 1e-8
        step = np.multiply(m if one == 1 else np.divide(m, one, out=g), self.rate, out=g)
        step /= room
        p -= step
        if self.t % 128 == 0:
            m[np.abs(m) < 1e-280] = 0.0
            v[v < 1e-280] = 0.0
            while self.low < least and not self.m[ends[self.low] : ends[self.low + 1]].any():
                self.since[self.low] = self.t
                self.low += 1

    def _chances(self, views: list[np.ndarray], hs: list[np.ndarray], inner: list[np.ndarray], masks: np.ndarray | None) -> np.ndarray:
        for i in range(self.layers):
            h = inner[i + 1]
            np.dot(hs[i], views[i], out=h)
            if masks is not None:
                h *= masks[i]
            np.maximum(h, 0.0, out=h)
        z = hs[-1].dot(views[-1])
        z -= np.maximum.reduce(z)
        e = np.exp(z, out=z)
        e /= np.add.reduce(e)
        return e

    def observe(self, x: np.ndarray, target: int, classes: int) -> float:
        if classes > self.classes:
            self._grow(classes)
        _, views, grads, out, room, hs, inner, ends = self._room()
        inner[0][:] = x
        masks = (self.rng.random((self.layers, self.hidden)) >= self.dropout) / (1 - self.dropout)
        back = self._chances(views, hs, inner, masks)
        back[target] -= 1
        for i in range(self.layers, -1, -1):
            least = 2 * i if np.count_nonzero(inner[i]) else 2 * i + 1
            np.multiply(hs[i][:, None], back, out=out[i])
            if i:
                back = views[i][:-1].dot(back)
                back *= masks[i - 1]
                back *= inner[i] > 0
                if not np.count_nonzero(back):
                    grads[ends[min(self.low, 2 * i)] : ends[2 * i]] = 0.0
                    break
        self._learn(grads, room, ends, least)
        self.n += 1
        return float(1 - self._chances(views, hs, inner, None)[target])


#: Tokens up to which all pairs of them are looked at.
FEW = 32


class Word2Vec:
    """Skip-gram with negative sampling over sliding sentences of each actor, learnt every so many tokens; after the
    warm-up at a share ``later`` of the rate. A sentence's pairs are one step."""

    def __init__(self, dim: int = 5, sentence: int = 7, window: int = 5, every: int = 250, rate: float = 0.025, negative: int = 5, seed: int = 42, warmup: int = 10_000, later: float = 0.1):
        self.dim, self.sentence, self.window, self.every, self.rate, self.negative, self.warmup, self.later = dim, sentence, window, every, rate, negative, warmup, later
        self.rng, self.ids, self.recent, self.pending, self.n = np.random.default_rng(seed), {}, {}, [], 0
        self.vec, self.out, self.freq = np.zeros((0, dim)), np.zeros((0, dim)), []
        i, j = np.indices((sentence, sentence)).reshape(2, -1)
        near = (i != j) & (abs(i - j) <= window)
        self.center, self.other = i[near], j[near]

    def add(self, actor: str, token: str) -> np.ndarray:
        """The token is taken up; its vector as learnt by then (zeros if unknown)."""
        self._take(actor, token)
        i = self.ids.get(token)
        return self.vec[i].copy() if i is not None else np.zeros(self.dim)

    def adds(self, actors: list[str], tokens: list[str]) -> list[list[float]]:
        """``add`` of each token in turn: vectors stand still between two lessons."""
        out, known = [], {}
        for actor, token in zip(actors, tokens, strict=True):
            if self._take(actor, token):
                known = {}
            v = known.get(token)
            if v is None:
                i = self.ids.get(token)
                v = known[token] = self.vec[i].tolist() if i is not None else [0.0] * self.dim
            out.append(v)
        return out

    def _take(self, actor: str, token: str) -> bool:
        """Whether anything was learnt."""
        q = self.recent.get(actor)
        if q is None:
            q = self.recent[actor] = deque(maxlen=self.sentence)
        q.append(token)
        if len(q) == self.sentence:
            self.pending.append(list(q))
        self.n += 1
        if self.n % self.every or not self.pending:
            return False
        self._train()
        return True

    def _train(self):
        for t in dict.fromkeys(chain.from_iterable(self.pending)):
            if t not in self.ids:
                self.ids[t] = len(self.ids)
                self.freq.append(0)
                self.vec = np.vstack([self.vec, self.rng.uniform(-0.5, 0.5, (1, self.dim)) / self.dim])
                self.out = np.vstack([self.out, np.zeros((1, self.dim))])
        words = np.array([self.ids[t] for t in chain.from_iterable(self.pending)]).reshape(-1, self.sentence)
        self.freq = (np.array(self.freq) + np.bincount(words.ravel(), minlength=len(self.freq))).tolist()
        upto = np.cumsum(np.array(self.freq, float) ** 0.75)
        rate = self.rate * (1 if self.n <= self.warmup else self.later)
        chance = self.rng.random((len(words), len(self.center), self.negative)) * upto[-1]
        drawn = sum((chance >= u for u in upto[:-1]), np.zeros(chance.shape, int)) if len(upto) <= 8 else np.searchsorted(upto, chance, "right")
        at = np.concatenate([words[:, self.other, None], np.minimum(drawn, len(upto) - 1)], axis=2)
        c = words[:, self.center]
        if len(upto) <= FEW:
            self._all_pairs(at, c, rate)
            self.pending = []
            return
        for at, c in zip(at, c, strict=True):
            g = 1 / (1 + np.exp(-np.einsum("ijk,ik->ij", self.out[at], self.vec[c])))
            g[:, 0] -= 1
            g *= rate
            back = np.einsum("ij,ijk->ik", g, self.out[at])
            np.subtract.at(self.out, at, g[:, :, None] * self.vec[c][:, None, :])
            np.subtract.at(self.vec, c, back)
        self.pending = []

    def _all_pairs(self, at: np.ndarray, c: np.ndarray, rate: float) -> None:
        """Of few tokens, each sentence's step by how often it has each pair: its pairs are learnt from the same vectors."""
        n, many = len(self.vec), len(at)
        place = (np.arange(many)[:, None, None] * n + at) * n + c[:, :, None]
        both = rate * np.bincount(place.ravel(), minlength=many * n * n).reshape(many, n, n)
        true = rate * np.bincount(place[:, :, 0].ravel(), minlength=many * n * n).reshape(many, n, n)
        # both tables by the root of a half, so that products are halved, and the logistic function by way of tanh
        u, v = self.out * math.sqrt(0.5), self.vec * math.sqrt(0.5)
        g, du, dv = np.empty((n, n)), np.empty_like(u), np.empty_like(v)
        vt, gt, half = v.T, g.T, both / 2
        for pairs, less in zip(half, half - true, strict=True):
            np.dot(u, vt, g)
            np.tanh(g, g)
            np.multiply(g, pairs, g)
            np.add(g, less, g)
            np.dot(g, v, du)
            np.dot(gt, u, dv)
            np.subtract(u, du, u)
            np.subtract(v, dv, v)
        self.out, self.vec = u * math.sqrt(2), v * math.sqrt(2)


class RollingRank:
    """The share of the last ``window`` scores not above a new one; scores that differ by rounding only are equal."""

    def __init__(self, window: int = 2048, warmup: int = 128):
        self.window, self.warmup, self.order, self.sorted = window, warmup, deque(), []

    def step(self, raw: float) -> float:
        x = round(math.log1p(max(0.0, raw)), 12)
        out = bisect_right(self.sorted, x) / len(self.sorted) if len(self.sorted) >= max(1, self.warmup) else 0.0
        self.order.append(x)
        insort(self.sorted, x)
        if len(self.order) > self.window:
            old = self.order.popleft()
            del self.sorted[bisect_right(self.sorted, old) - 1]
        return out

    def take(self, raws: list[float]) -> None:
        """``step`` of each score in turn, where no shares are asked for: the last ones are all that stays."""
        self.order.extend(round(math.log1p(max(0.0, r)), 12) for r in raws[-self.window :])
        while len(self.order) > self.window:
            self.order.popleft()
        self.sorted = sorted(self.order)


def plain(value: object) -> object:
    """Of a model or a part of one, what JSON can hold: numbers, lists, arrays as text, and parts by the name of
    their class, of which ``restored`` knows a fixed set."""
    if isinstance(value, np.ndarray):
        return {"array": base64.b64encode(np.ascontiguousarray(value).tobytes()).decode(), "type": value.dtype.str, "shape": list(value.shape)}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.random.Generator):
        return {"random": value.bit_generator.state}
    if isinstance(value, deque):
        return {"deque": [plain(x) for x in value], "most": value.maxlen}
    if isinstance(value, dict):
        return {"pairs": [[plain(k), plain(v)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if type(value).__name__ in PARTS:
        return {"part": type(value).__name__, "of": {k: plain(v) for k, v in vars(value).items() if not k.startswith("_")}}
    return value


def restored(value: object) -> object:
    if isinstance(value, list):
        return [restored(x) for x in value]
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.frombuffer(base64.b64decode(value["array"]), np.dtype(value["type"])).reshape(value["shape"]).copy()
    if "random" in value:
        rng = np.random.default_rng()
        rng.bit_generator.state = value["random"]
        return rng
    if "deque" in value:
        return deque((restored(x) for x in value["deque"]), value["most"])
    if "pairs" in value:
        return {restored(k): restored(v) for k, v in value["pairs"]}
    out = object.__new__(PARTS[value["part"]])
    vars(out).update({k: restored(v) for k, v in value["of"].items()})
    return out


MODELS: dict[str, type[Model]] = {
    "zscore": ZScore, "freq1d": Freq1D, "copulatree": CopulaTree, "latentcluster": LatentCluster, "knn": Knn,
    "halfspacetrees": HalfSpaceTrees, "kitnet": KitNet, "memstream": MemStream, "loda_ema": Loda,
}


PARTS: dict[str, type] = {c.__name__: c for c in (*MODELS.values(), NextToken, Word2Vec, RollingRank, Marginals, Prefix, Adam, AutoEncoder)}


def make(name: str, names: list[str], **params) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown algorithm {name!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name](names, **params)


def attribution(score, x: np.ndarray, eps: float = 0.01) -> np.ndarray:
    """How the score depends on each feature: at 0 or 1 by flipping it, else by a central difference, times its value."""
    out = np.zeros(len(x))
    for j, v in enumerate(x):
        at = lambda t, j=j: score(np.where(np.arange(len(x)) == j, t, x))
        if v <= 0.01 or v >= 0.99:
            out[j] = (at(1.0) - at(0.0)) * v
        else:
            out[j] = (at(min(1.0, v + eps)) - at(max(0.0, v - eps))) / (2 * eps) * v
    return out
