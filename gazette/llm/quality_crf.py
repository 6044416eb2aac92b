"""Document quality from a linear-chain conditional random field over lines (operator 10).

Every line is described by a few measures (letter case, signs, digits, length, repetition, ...), each cut
into bins. A line's score for good against bad sums weights of its own bins and of those of its neighbours;
transition weights join neighbouring labels. Forward-backward gives each line's probability of being good,
and the mean over lines, weighted by their length, set on the scale of a probability by a logistic curve over
the learned documents, is the document's quality.

Lines have no labels of their own: they start with their document's, and after a first fit the lines of bad
documents that look good beyond doubt are relabelled and the field is fitted again. Fitted on at most
``train_rows`` labelled documents, those with the least hash of doc_id.

Defined results: blank lines are skipped; a null, empty or blank text has quality 0.0; null labels are not
learned from; without labelled documents of both classes every line has the same even odds. Whole texts are
read; a sequence may have any number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.linear import sigmoid
from gazette.llm.shared import refuse, sample_labels, tidy

#: Bounds of the bins of each measure.
SHARES = (0.001, 0.02, 0.06, 0.12, 0.2, 0.35, 0.6)
CUTS = {
    "upper": SHARES, "digit": SHARES, "sign": SHARES, "exclaim": SHARES, "bar": SHARES, "space": (0.05, 0.1, 0.14, 0.18, 0.22, 0.3, 0.5),
    "length": (8, 20, 40, 80, 160, 320, 1280), "word": (2, 3, 4, 5, 6, 8, 12), "words": (1.5, 3.5, 6.5, 12.5, 25.5, 60.5, 200.5),
    "echo": SHARES, "distinct": (0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.999), "again": (0.5, 1.5, 2.5, 4.5, 8.5, 16.5, 32.5),
}
K, BINS, NONE = len(CUTS), 9, 8
_CUTS = [np.array(x, np.float64) for x in CUTS.values()]


def _classes() -> np.ndarray:
    table = np.full(0x250, 4, np.uint8)
    for c in range(0x250):
        x = chr(c)
        table[c] = 1 if x.isupper() else 0 if x.isalpha() else 2 if x.isdigit() else 3 if x.isspace() else 5 if x == "!" else 6 if x == "|" else 7 if x in ".,;:'\"-()?" else 4
    return table


_CLASS = _classes()


def line_bins(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the measures of each line that is not blank, the text it is of, and its length."""
    lines, owner, word_stats, again = [], [], [], []
    for i, text in enumerate(texts):
        seen: dict[str, int] = {}
        for line in (text or "").split("\n"):
            w = line.split()
            if not w:
                continue
            n = len(w)
            k = seen[line] = seen.get(line, -1) + 1
            lines.append(line)
            owner.append(i)
            again.append(k)
            word_stats.append((n, len(set(w)) / n, sum(map(eq, w, w[1:])) / n))
    if not lines:
        return np.zeros((0, K), np.uint8), np.zeros(0, np.int64), np.zeros(0)
    sizes = np.array([len(x) for x in lines])
    p = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(p < 0x250, _CLASS[np.where(p < 0x250, p, 0)], np.uint8(0))
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    share = lambda k: np.add.reduceat((kind == k).astype(np.int32), at) / sizes
    stats = np.array(word_stats, np.float64)
    space = share(3)
    measures = [share(1), share(2), share(4), share(5), share(6), space, sizes, sizes * (1 - space) / stats[:, 0], stats[:, 0], stats[:, 2], stats[:, 1], np.array(again, np.float64)]
    bins = np.stack([np.searchsorted(c, m, "left") for c, m in zip(_CUTS, measures, strict=True)], 1).astype(np.uint8)
    return bins, np.array(owner), sizes.astype(np.float64)


class Chains:
    """Lines of several sequences, longest first, to be walked step by step over all of them at once."""

    def __init__(self, owner: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(owner)))
        order = np.argsort(-size, kind="stable")
        self.first, self.size = first[order], size[order]
        self.steps = [self.first[: np.searchsorted(-self.size, -t, "left")] + t for t in range(self.size[0])] if len(size) else []
        starts = np.zeros(len(owner), bool)
        starts[first] = True
        self.starts, self.ends = starts, np.append(starts[1:], True) if len(owner) else starts


@dataclass
class LineField:
    """own, before, after: weights of each bin of a line, its predecessor and its successor; pair[i, j]: of label i then j."""

    weights: np.ndarray
    pair: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def unary(self, bins: np.ndarray, chains: Chains) -> np.ndarray:
        k = np.arange(K)
        before, after = np.full_like(bins, NONE), np.full_like(bins, NONE)
        before[1:], after[:-1] = bins[:-1], bins[1:]
        before[chains.starts], after[chains.ends] = NONE, NONE
        self.parts = (bins, before, after)
        return sum(w[k, b].sum(1) for w, b in zip(self.weights, self.parts, strict=True)) if len(bins) else np.zeros(0)

    def messages(self, u: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
        """Forward log odds of each line, its own score included, and backward ones."""
        t = self.pair
        f, b = u.copy(), np.zeros_like(u)
        for was, now in zip(chains.steps, chains.steps[1:], strict=False):
            a = f[was[: len(now)]]
            f[now] += np.logaddexp(a + t[1, 1], t[0, 1]) - np.logaddexp(a + t[1, 0], t[0, 0])
        for was, now in zip(chains.steps[-2::-1], chains.steps[:0:-1], strict=False):
            x = u[now] + b[now]
            b[was[: len(now)]] = np.logaddexp(x + t[1, 1], t[1, 0]) - np.logaddexp(x + t[0, 1], t[0, 0])
        return f, b

    def marginals(self, bins: np.ndarray, chains: Chains) -> np.ndarray:
        """Probability that each line is good."""
        f, b = self.messages(self.unary(bins, chains), chains)
        return sigmoid(f + b)

    def gradient(self, bins: np.ndarray, chains: Chains, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = self.unary(bins, chains)
        f, b = self.messages(u, chains)
        gap = y - sigmoid(f + b)
        node = np.stack([np.stack([np.bincount(part[:, k], gap, BINS) for k in range(K)]) for part in self.parts])
        left = np.flatnonzero(~chains.ends)
        a, x = f[left], u[left + 1] + b[left + 1]
        joint = np.stack([np.full(len(a), self.pair[0, 0]), x + self.pair[0, 1], a + self.pair[1, 0], a + x + self.pair[1, 1]])
        joint = np.exp(joint - np.logaddexp.reduce(joint, 0))
        seen = np.bincount((2 * y[left] + y[left + 1]).astype(np.int64), minlength=4)
        return node, (seen - joint.sum(1)).reshape(2, 2)


def _train(bins: np.ndarray, chains: Chains, y: np.ndarray, steps: int = 120, l2: float = 2e-3, rate: float = 0.15) -> LineField:
    """Adam on the mean log-likelihood of lines."""
    field = LineField(np.zeros((3, K, BINS)), np.zeros((2, 2)))
    state = [[np.zeros_like(field.weights), np.zeros_like(field.weights)], [np.zeros((2, 2)), np.zeros((2, 2))]]
    n = max(len(y), 1)
    for step in range(1, steps + 1):
        grads = field.gradient(bins, chains, y)
        for x, g, s in zip((field.weights, field.pair), grads, state, strict=True):
            g = g / n - l2 * x
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            x += rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-6)
    return field


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text_col: str = "text", train_rows: int = 8_000, stretch: int = 64) -> LineField:
    """Long documents are learned from in stretches of lines, all of them."""
    sample = sample_labels(labels, label, train_rows)
    known = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "y")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, owner, size = line_bins(batch.column(0).to_pylist())
            cut = np.searchsorted(owner, np.arange(1, batch.num_rows))
            parts = [pa.array([x.tobytes() for x in np.split(a, cut)] if batch.num_rows else [], pa.binary()) for a in (bins, size.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *parts], names=["y", "bins", "lengths"])

    got = known.mapInArrow(run, "y int, bins binary, lengths binary").toPandas()  # train_rows documents of a few bytes a line
    got = got[got["bins"].map(len) > 0]
    if got["y"].nunique() < 2:
        return LineField(np.zeros((3, K, BINS)), np.zeros((2, 2)))
    docs_bins = [np.frombuffer(x, np.uint8).reshape(-1, K) for x in got["bins"]]
    sizes = np.array([len(x) for x in docs_bins])
    bins = np.concatenate(docs_bins)
    y = np.repeat(got["y"].to_numpy(np.float64), sizes)
    within = np.arange(len(bins)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    chains = Chains(np.cumsum((within % stretch == 0).astype(np.int64)))
    first = _train(bins, chains, y)
    sure = (y == 0) & (first.marginals(bins, chains) > 0.9)
    field = _train(bins, chains, np.where(sure, 1.0, y)) if sure.any() else first
    owner = np.repeat(np.arange(len(sizes)), sizes)
    length = np.frombuffer(b"".join(got["lengths"]), "<f8")
    field.scale = _scale(_mean(field.marginals(bins, Chains(owner)), owner, length, len(sizes)), got["y"].to_numpy(np.float64))
    return field


def _mean(p: np.ndarray, owner: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, length * p, n) / np.maximum(np.bincount(owner, length, n), 1)


def _log_odds(m: np.ndarray) -> np.ndarray:
    m = np.clip(m, 1e-3, 1 - 1e-3)
    return np.log(m / (1 - m))


def _scale(mean: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the log odds of the means, by Newton steps."""
    x = np.stack([_log_odds(mean), np.ones(len(y))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([0.05, 0.05])
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * (w - [1.0, 0.0]))
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def quality(texts: list[str | None], field: LineField) -> np.ndarray:
    bins, owner, size = line_bins(texts)
    if not len(owner):
        return np.zeros(len(texts))
    mean = _mean(field.marginals(bins, Chains(owner)), owner, size, len(texts))
    return np.where(np.isin(np.arange(len(texts)), owner), sigmoid(field.scale[0] * _log_odds(mean) + field.scale[1]), 0.0)


def score_quality(docs: DataFrame, field: LineField, text_col: str = "text", score_col: str = "quality") -> DataFrame:
    """Add score_col, from 0 to 1."""
    refuse(docs, score_col)
    held = docs.sparkSession.sparkContext.broadcast((field.weights, field.pair, field.scale))
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = LineField(*held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quality(batch.column(at).to_pylist(), field), pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
