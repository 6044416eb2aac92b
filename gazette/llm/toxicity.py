"""Toxicity with noisy-channel deobfuscation (operator 3).

A character trigram model is counted over all documents. A span that looks disguised (digits or signs within
a word or behind it, single letters set apart, a letter three times or more, all letters doubled) becomes a lattice: each place offers the
letters that it may stand for, one or two letters for a run, nothing or a word break for a separator. The
Viterbi path under channel costs and the character model is the restored span. The restored text is scored
by a logistic model on hashed character grams: five-grams and the first 6 to 8 letters of words. Each gram
counts on several levels: that it is there, and that it is there repeatedly with a share of the text's words.

What is broadcast has a fixed size: the character model (V**3 floats) and the features of 2**20 hashes by level. The
classifier is fitted on at most ``train_rows`` labelled rows, those with the least hash of doc_id.

Defined results: null and empty texts have no features and the score of the bias. Labels that are null are
not learned from; words of digits alone, and words cut in chunks, are not read; a document labelled twice counts as toxic if one label says so. Without a labelled row of
each class the score is the share of toxic rows (0.0 without labels). Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.linear import fit_logistic, sigmoid
from gazette.llm.shared import refuse, sample_labels, tidy

#: Letters of the character model: a-z, the lower-case letters of Latin-1 and OE; then every other letter as one. 0 is a break.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7) + "œ"
OTHER = len(LETTERS) + 1
V = OTHER + 1
#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou"}
MASKS = "*#%"
#: Channel costs in nats: a sign for its letter, a mask for a vowel, a run of letters, a break at a separator, a sign after the last letter for nothing.
SIGN, MASK, RUN_ONE, RUN_TWO, BREAK, TRAIL = 0.4, 1.6, 0.1, 0.9, 3.0, 0.8
BITS, GRAM = 20, 5
STARTS = (6, 7, 8)
#: Levels of a gram: how often it stands in a text, and for which share of the text's words, at least.
LEVELS = ((1, 0.0), (2, 0.004), (2, 0.01), (2, 0.03))
FEATURES = 4096
LEAST_ROWS = 3

_SIGN = "".join(map(re.escape, SIGNS))
_L = "a-zß-öø-ÿœ"
#: Signs that do not end sentences, and what may stand between letters set apart.
_HARD, GAPS = "0-9@$€£", " ._-/*~|+=^\\"
_GAP = re.escape(GAPS)
#: Letters set apart, a sign before, between or (if it ends no sentence) behind letters, a letter three times, or a word
#: of letters all doubled. A word is tried from its start only. What has no letter at all stays as it is.
SPAN = re.compile(
    rf"(?<![\w{_SIGN}])[{_L}{_SIGN}](?:[{_GAP}]{{1,3}}[{_L}{_SIGN}](?![\w{_SIGN}])|(?<=[{_L}])[*|+]{{1,3}}[{_L}](?![{_L}0-9])){{2,}}"
    rf"|(?<![{_L}{_SIGN}])[{_L}]*+(?:[{_SIGN}]++[{_L}]++)++[{_SIGN}]{{0,4}}"
    rf"|(?<![{_L}{_SIGN}])[{_L}]{{2,}}+[{_HARD}]{{1,4}}(?!\w)"
    rf"|(?<![{_L}])(?=[{_L}]*?([{_L}])\1\1)[{_L}]++"
    rf"|(?<![{_L}])(?:([{_L}])\2){{3,}}(?![{_L}])"
)
_LETTER = re.compile(f"[{_L}]")
_APART = re.compile(rf"[{_L}{_SIGN}](?:[{_GAP}]{{1,3}}[{_L}{_SIGN}]){{2,}}")


def _code_table() -> np.ndarray:
    table = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        if chr(c).isalpha():
            table[c] = OTHER
    for i, x in enumerate(LETTERS):
        table[ord(x)] = i + 1
    return table


_TABLE = _code_table()
_SIGN_POINTS = np.zeros(0x250, bool)
_SIGN_POINTS[[ord(x) for x in SIGNS if ord(x) < 0x250]] = True
_HARD_POINTS = np.zeros(0x250, bool)
_HARD_POINTS[[ord(x) for x in "0123456789@$£"]] = True


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def codes(p: np.ndarray) -> np.ndarray:
    """Symbols of code points; beyond Latin, general punctuation is a break and the rest a letter."""
    near = p < 0x250
    out = _TABLE[np.where(near, p, 0)]
    if not near.all():
        out = np.where(near, out, np.where((p >= 0x2000) & (p < 0x2070), 0, OTHER).astype(np.uint8))
    return out


def _count(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of character trigrams over all documents."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(V**3, np.int64)
        for batch in batches:
            c = codes(points("  ".join([t.lower() for t in batch.column(0).to_pylist() if t]) + "  ")).astype(np.int32)
            if len(c) > 2:
                total += np.bincount((c[:-2] * V + c[1:-1]) * V + c[2:], minlength=V**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    rows = docs.select(text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(V**3)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return counts.reshape(V, V, V)


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with bigrams, single symbols and the uniform distribution."""
    one = counts.sum((0, 1))
    two = counts.sum(0)
    p1 = (one + 1) / (one.sum() + V)
    p2 = (two + 2 * p1) / (two.sum(1, keepdims=True) + 2)
    p3 = (counts + 4 * p2[None]) / (counts.sum(2, keepdims=True) + 4)
    return np.log(0.9 * p3 + 0.08 * p2[None] + 0.02 * p1[None, None]).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """What each place of a lower-cased span offers, with channel costs."""
    places: list[list[tuple[str, float]]] = []
    apart = bool(_APART.fullmatch(span))
    tail = len(span.rstrip("".join(SIGNS)))
    i = 0
    while i < len(span):
        x, j = span[i], i + 1
        if x in GAPS and (apart or x not in SIGNS) and 0 < i < tail:
            while j < len(span) and span[j] in GAPS:
                j += 1
            wide = j - i > 1 and not span[i:j].strip(" ")
            offers = [("", BREAK if wide else 0.0), (" ", 0.0 if wide else BREAK)] if apart else [(" ", 0.0)]
            places.append(offers + ([(y, MASK) for y in SIGNS[x]] if x in MASKS and j - i == 1 else []))
            i = j
            continue
        if x in SIGNS:
            places.append([(y, MASK if x in MASKS else SIGN) for y in SIGNS[x]] + ([("", TRAIL)] if i >= tail else []))
            i = j
            continue
        while j < len(span) and span[j] == x:
            j += 1
        n = j - i
        places.append([(x, 0.0)] if n == 1 else [(x, RUN_TWO), (x + x, RUN_ONE)] if n == 2 else [(x, RUN_ONE), (x + x, RUN_TWO)])
        i = j
    return places


_CODE = {x: i + 1 for i, x in enumerate(LETTERS)}


def decode(span: str, logp: list[float]) -> str:
    """The cheapest reading of a span: Viterbi over the lattice, a state being the last two symbols."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # cost, and the path as (path before, text)
    for place in [*lattice(span), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in best.items():
            for y, extra in place:
                p, q, total = a, b, cost + extra
                for ch in y:
                    c = 0 if ch == " " else _CODE.get(ch, OTHER)
                    total -= logp[(p * V + q) * V + c]
                    p, q = q, c
                if (old := after.get((p, q))) is None or total < old[0]:
                    after[p, q] = (total, (path, y))
        best = after
    path, parts = min(best.values(), key=lambda x: x[0])[1], []
    while path:
        path, y = path
        parts.append(y)
    return "".join(reversed(parts)).rstrip(" ")


def restore(text: str, logp: list[float]) -> str:
    """The lower-cased text with its disguised spans read out."""
    return SPAN.sub(lambda m: decode(m[0], logp) if _LETTER.search(m[0]) else m[0], text)


def _disguised(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Places near which a span may be: a cheap test that no span escapes."""
    letter = c > 0
    sign = _SIGN_POINTS[np.where(p < 0x250, p, 0)] | (p == 0x20AC)
    hit = np.zeros(len(p), bool)
    hit[1:] |= sign[:-1] & letter[1:]
    hit[1:] |= letter[:-1] & (_HARD_POINTS[np.where(p < 0x250, p, 0)] | (p == 0x20AC))[1:]
    hit[2:] |= letter[2:] & (c[2:] == c[1:-1]) & (c[1:-1] == c[:-2])
    double = np.zeros(len(p), bool)
    double[1:] = letter[1:] & (c[1:] == c[:-1])
    hit[4:] |= double[4:] & double[2:-2] & double[:-4]
    some = letter | sign
    alone = some.copy()
    alone[1:] &= ~some[:-1]
    alone[:-1] &= ~some[1:]
    near = alone.copy()
    for gap in (2, 3, 4):
        near[gap:] |= alone[:-gap]
    hit |= near
    return hit


def restored_batch(texts: list[str | None], logp: list[float]) -> list[str]:
    """Restored texts of a batch; only texts with a place that may be disguised are searched for spans."""
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in low])
    p = points("\n".join(low) + "\n")
    hit = np.flatnonzero(_disguised(p, codes(p)))
    for i in np.unique(np.searchsorted(np.cumsum(sizes), hit, "right")).tolist():
        low[i] = restore(low[i], logp)
    return low


def grams(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, cell): each hashed gram of each text on every level that it reaches. wanted: hashes to look at."""
    sizes = np.array([len(t) + 1 for t in texts])
    c = codes(points("\n".join(texts) + "\n")).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
    c = c[keep]
    first = c > 0
    first[1:] &= c[:-1] == 0
    at = np.flatnonzero(first)
    n_words = np.bincount(owner[at], minlength=len(texts))
    found = []

    def add(whose: np.ndarray, h: np.ndarray) -> None:
        h = h ^ (h >> np.uint32(15))
        h = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
        if wanted is not None:
            some = wanted[h]
            whose, h = whose[some], h[some]
        found.append(whose.astype(np.int64) << BITS | h)

    if len(c) >= GRAM:
        n = len(c) - GRAM + 1
        h = np.zeros(n, np.uint32)
        inner = np.ones(n, bool)
        for i in range(GRAM):
            h = h * np.uint32(0x01000193) + c[i : i + n] + np.uint32(1)
            if 0 < i < GRAM - 1:
                inner &= c[i : i + n] > 0  # a break only at either end
        same = inner & (owner[:n] == owner[GRAM - 1 :])
        add(owner[:n][same], h[same])
    h = np.full(len(at), 0x811C9DC5, np.uint32)
    for i in range(max(STARTS)):
        inside = at + i < len(c)
        at, h = at[inside], h[inside]
        letter = c[at + i]
        at, h, letter = at[letter > 0], h[letter > 0], letter[letter > 0]
        h = h * np.uint32(0x01000193) + letter + np.uint32(1)
        if i + 1 in STARTS:
            add(owner[at], h)
    pair, times = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
    whose, h = pair >> BITS, pair & ((1 << BITS) - 1)
    share = times / np.maximum(n_words, 1)[whose]
    on = [(times >= least) & (share >= part) for least, part in LEVELS]
    return np.concatenate([whose[x] for x in on]), np.concatenate([h[x] | k << BITS for k, x in enumerate(on)])


@dataclass
class ToxicityModel:
    logp: np.ndarray
    cells: np.ndarray  # of each level and hash: its feature, or -1
    weights: np.ndarray
    bias: float

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs."""
        owner, cell = grams(texts, (self.cells.reshape(len(LEVELS), -1) >= 0).any(0))
        f = self.cells[cell].astype(np.int64)
        pair = np.unique(owner[f >= 0] * FEATURES + f[f >= 0])
        return pair // FEATURES, pair % FEATURES

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, cols = self.features(texts)
        return sigmoid(np.bincount(rows, self.weights[cols], len(texts)) + self.bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text_col: str = "text", train_rows: int = 20_000) -> ToxicityModel:
    logp = character_model(_count(docs, text_col))
    sample = sample_labels(labels, label, train_rows)
    known = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "y")
    sent = docs.sparkSession.sparkContext.broadcast(logp)

    @tidy
    def associate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.ravel().tolist()
        seen = np.zeros((2, len(LEVELS) << BITS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy()
            texts = restored_batch(batch.column(0).to_pylist(), table)
            owner, cell = grams(texts)
            for k in (0, 1):
                seen[k] += np.bincount(cell[y[owner] == k], minlength=len(LEVELS) << BITS)
                n[k] += (y == k).sum()
        at = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*seen[0][at], n[0]], pa.int64()), pa.array([*seen[1][at], n[1]], pa.int64())], names=["cell", "n0", "n1"])

    rows = known.mapInArrow(associate, "cell int, n0 long, n1 long").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = rows.where((F.col("cell") == -1) | (F.col("n1") >= LEAST_ROWS)).orderBy("cell").toPandas()
    total = rows[rows["cell"] == -1]
    n0, n1 = (float(total["n0"].sum()), float(total["n1"].sum()))
    cells = np.full(len(LEVELS) << BITS, -1, np.int16)
    if n0 == 0 or n1 == 0:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return ToxicityModel(logp, cells, np.zeros(1), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rows = rows[rows["cell"] >= 0]
    a, b = rows["n1"].to_numpy(np.float64), rows["n0"].to_numpy(np.float64)
    rate1, rate0 = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
    gain = (rate1 - rate0) ** 2 / (rate0 * (1 - rate0) / n0 + rate1 * (1 - rate1) / n1)  # squared difference in its own variance
    gain[(a < LEAST_ROWS) | (rate1 < 3 * rate0)] = 0
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    best = best[gain[best] > 9]
    cells[rows["cell"].to_numpy(np.int64)[best]] = np.arange(len(best))
    model = ToxicityModel(logp, cells, np.zeros(FEATURES), 0.0)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value.logp.ravel().tolist()
        for batch in batches:
            r, c = held.value.features(restored_batch(batch.column(0).to_pylist(), table))
            parts = np.split(c, np.searchsorted(r, np.arange(1, batch.num_rows))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.astype("<u2").tobytes() for x in parts], pa.binary())], names=["y", "f"])

    got = known.mapInArrow(lean, "y int, f binary").toPandas()  # at most train_rows rows of their features
    feats = [np.frombuffer(x, "<u2") for x in got["f"]]
    row = np.repeat(np.arange(len(feats)), [len(x) for x in feats])
    model.weights, model.bias = fit_logistic(row, np.concatenate([np.zeros(0, np.int64), *feats]).astype(np.int64), got["y"].to_numpy(np.float64), FEATURES)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity", restored_col: str | None = None, restoring: bool = True) -> DataFrame:
    """Add score_col, and restored_col if named: the lower-cased text with disguised spans read out; restoring=False scores texts as they are."""
    refuse(docs, score_col, restored_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    more = [T.StructField(score_col, T.DoubleType())] + ([T.StructField(restored_col, T.StringType())] if restored_col else [])
    schema = T.StructType([*docs.schema.fields, *more])
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        table = model.logp.ravel().tolist()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            texts = restored_batch(texts, table) if restoring else [(t or "").lower() for t in texts]
            cols = [*batch.columns, pa.array(model.scores(texts), pa.float64())] + ([pa.array(texts, pa.string())] if restored_col else [])
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)
