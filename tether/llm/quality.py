"""Quality scores from a sparse rule ensemble over text statistics.

Small boosted trees are grown on a bounded labelled sample; the path to each of their nodes is a rule, a conjunction of
bounds on statistics. A logistic model with a lasso penalty keeps few rules, which become one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tether.llm.kernels import Rolling, chunks, texts_of, words

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "newline", "beyond_ascii", "symbol", "pipe",
    "comma_stop", "bang", "slash", "at_sign", "bracket", "distinct_words", "top_word", "distinct_lines", "log_line", "distinct_grams", "short_words",
)


def _class(*spans) -> np.ndarray:
    out = np.zeros(256)
    for a, b in spans:
        out[a : b + 1] = 1
    return out


_chars = lambda s: sum((_class((ord(c), ord(c))) for c in s), np.zeros(256))
_CLASSES = np.stack([_class((65, 90)), _class((48, 57)), _chars(" \t\n\r"), _chars("\n"), _class((128, 255)), _chars("#$%&*^~=_+<>"), _chars("|"), _chars(",.;:"), _chars("!?"), _chars("/\\"), _chars("@"), _chars("()[]{}")], axis=1)


def _distinct(keys: np.ndarray, first: np.ndarray, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each text: distinct keys over keys, and the commonest key's share (1 and 0 where there is none)."""
    n = len(first) - 1
    share, top = np.ones(n), np.zeros(n)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        b -= width - 1
        if b > a:
            _, c = np.unique(keys[a:b], return_counts=True)
            share[k], top[k] = len(c) / (b - a), c.max() / (b - a)
    return share, top


def measure(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each text, one row a text; all are finite, also of empty texts."""
    n, size = len(offsets) - 1, np.diff(offsets)
    who = np.repeat(np.arange(n), size)
    counts = np.bincount(who * 256 + buf, minlength=n * 256).reshape(n, 256)
    share = (counts @ _CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, first = words(buf, offsets)
    hashes = Rolling(buf)
    w = hashes.of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n_words = np.diff(first)
    some = np.maximum(n_words, 1)
    length = np.bincount(np.searchsorted(first, np.arange(len(starts)), "right") - 1, ends - starts, n) / some
    short = np.bincount(np.searchsorted(first, np.arange(len(starts)), "right") - 1, ends - starts <= 2, n) / some
    grams = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7) if len(w) > 2 else np.zeros(0, np.uint64)
    breaks = np.flatnonzero(buf == 10)
    line_start = np.union1d(offsets[:-1][size > 0], np.setdiff1d(breaks + 1, offsets[1:]))
    line_end = np.append(line_start[1:], len(buf))
    lines = hashes.of(line_start, line_end) if len(line_start) else np.zeros(0, np.uint64)
    line_first = np.searchsorted(line_start, offsets)
    distinct_words, top = _distinct(w, first)
    distinct_grams, _ = _distinct(grams, first, 3)
    distinct_lines, _ = _distinct(lines, line_first)
    upper, digit, space, newline, beyond, symbol, pipe, stop, bang, slash, at, bracket = share.T
    cols = (
        np.log1p(size), np.log1p(n_words), length, upper, digit, space, newline, beyond, symbol, pipe, stop, bang, slash, at, bracket,
        distinct_words, top, distinct_lines, np.log1p(size / np.maximum(np.diff(line_first), 1)), distinct_grams, short,
    )
    return np.stack(cols, axis=1)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics (a struct ``s``) of each row of ``docs(doc_id, text, ...)``; null text counts as empty."""

    def run(batches):
        for batch in batches:
            rows = [measure(b, o) for _, _, b, o in chunks(*texts_of(batch.column(1)))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            # rounding keeps a threshold's side the same whatever the batch
            cols = [pa.array(np.round(c, 9)) for c in x.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """A rule is ((statistic, at most?, bound), ...); the score is the logistic of bias + the weights of rules that hold."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self) -> Column:
        terms = [F.lit(float(self.bias))]
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for k, most, bound in rule:
                c = F.col(STATISTICS[k])
                holds = holds & ((c <= F.lit(bound)) if most else (c > F.lit(bound)))
            terms.append(F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # a balanced sum keeps the expression shallow
            terms = [sum(terms[i + 1 : i + 2], terms[i]) for i in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))


def _grow(bins: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int, path: Rule, rules: dict, out: np.ndarray, least: int = 20) -> None:
    """Splits rows where the squared sums of residuals gain most; adds each child's path, and Newton steps to ``out``."""
    best = (1e-6, None)
    g, h = residual[rows], weight[rows]
    base = g.sum() ** 2 / (h.sum() + 1)
    if depth and len(rows) >= 2 * least:
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            gs = np.bincount(bins[rows, k], g, len(c) + 1).cumsum()[:-1]
            hs = np.bincount(bins[rows, k], h, len(c) + 1).cumsum()[:-1]
            ns = np.bincount(bins[rows, k], minlength=len(c) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (k, at))
    if best[1] is None:
        out[rows] = g.sum() / (h.sum() + 1)
        return
    k, at = best[1]
    low = bins[rows, k] <= at
    for most, own in ((True, rows[low]), (False, rows[~low])):
        longer = (*path, (k, most, float(cuts[k][at])))
        rules.setdefault(longer)
        _grow(bins, cuts, own, residual, weight, depth - 1, longer, rules, out, least)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 0.0015, steps: int = 300, seed: int = 5) -> RuleModel:
    """Rules and weights from statistics ``x`` and labels ``y`` (0 or 1); without both labels, a constant score."""
    mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    bias = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return RuleModel((), (), bias)
    # leaves of a fifth of the rows where there are few
    least = min(20, max(1, len(y) // 5))
    rng = np.random.default_rng(seed)
    cuts = []
    for col in x.T:
        q = np.unique(np.quantile(col, np.linspace(0.01, 0.99, 64)))
        cuts.append(np.unique((q[1:] + q[:-1]) / 2))
    bins = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], axis=1)
    rules: dict[Rule, None] = {}
    raw = np.full(len(y), bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        half = np.sort(rng.permutation(len(y))[: max(100, len(y) // 2)])
        found: dict[Rule, None] = {}
        step = np.zeros(len(y))
        _grow(bins, cuts, half, y - p, p * (1 - p), depth, (), found, step, least)
        # the rows left out move with the leaf they fall in
        leaves = [r for r in found if not any(len(o) > len(r) and o[: len(r)] == r for o in found)]
        for r in leaves:
            hold = _holds(x, r)
            inside = np.intersect1d(half, np.flatnonzero(hold))
            if len(inside):
                raw[hold] += rate * step[inside[0]]
        rules |= found
    names = list(rules)
    z = np.stack([_holds(x, r) for r in names], axis=1).astype(np.float32) if names else np.zeros((len(y), 0), np.float32)
    keep = z.std(axis=0) > 0.02
    names, z = [r for r, k in zip(names, keep) if k], z[:, keep]
    if not names:
        return RuleModel((), (), bias)
    # accelerated proximal gradient; the intercept is not penalised
    w, b, v, vb, t = np.zeros(z.shape[1]), bias, np.zeros(z.shape[1]), bias, 1.0
    probe = rng.normal(size=z.shape[1])
    for _ in range(20):
        probe = z.T @ (z @ probe.astype(np.float32))
        top = np.linalg.norm(probe)
        probe = probe / top
    pace = 1 / (0.25 * (top / len(y) + 1) * 1.2)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v.astype(np.float32) + vb))) - y
        new = v - pace * (z.T @ r.astype(np.float32)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - pace * penalty, 0)
        nb = vb - pace * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(tuple(names[k] for k in used), tuple(float(w[k]) for k in used), float(b))


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, most, bound in rule:
        out &= (x[:, k] <= bound) if most else (x[:, k] > bound)
    return out


def learn(stats: DataFrame, labels: DataFrame, rows: int = 20_000) -> RuleModel:
    """A model from about ``rows`` rows of ``labels(doc_id, quality)``, taken by a hash of doc_id; null labels are left out."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    n = known.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1_000_003)) / 1_000_003.0
    taken = known.where(u < min(1.0, rows / max(n, 1)))
    table = stats.join(taken, "doc_id").orderBy("doc_id", "quality").toArrow()
    x = np.stack([table[c].to_numpy() for c in STATISTICS], axis=1) if table.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, (table["quality"].to_numpy() >= 1).astype(float))


def score(stats: DataFrame, model: RuleModel) -> DataFrame:
    """``stats`` with ``score`` from 0 to 1 and ``predicted`` (1 from 0.5 on)."""
    return stats.withColumn("score", model.column()).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
