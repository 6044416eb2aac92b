"""Language identification in two steps (operator 9): the family, then one-versus-one within it.

A text's features are hashed character trigrams of its letters, as square roots of their shares, scaled to
length one. Linear support vector machines tell each family from the others; within a family one machine
for each pair of languages votes, and the language with the largest sum of margins wins.

Fitted on about ``per_language`` documents of each language, ``most_rows`` together, chosen by hash of doc_id. Features are
made where the documents are; the driver gets DIMS small numbers at most for each of these rows, never a text.

Defined results: ``und`` with score 0.0 for a null text or one without a letter; rows with a null lang are
not learned from; with one language that language; without any, ``und``. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.linear import fit_svm, sigmoid
from gazette.llm.shared import held_out, refuse, tidy

#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi", "romance": "ca es fr gl it la oc pt ro", "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv", "uralic": "et fi hu", "celtic": "br cy ga gd", "turkic": "az kk ky tr tt uz", "indic": "bn gu hi mr ne pa si ur", "semitic": "am ar he mt",
    "sinitic": "zh yue", "japonic": "ja", "koreanic": "ko", "austronesian": "id jv ms su tl", "tai": "lo th", "vietic": "km vi", "dravidian": "kn ml ta te", "hellenic": "el", "iranian": "fa ku ps tg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIMS = 2048


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].split("_")[0].lower(), lang)


_LETTER = np.zeros(0x10000, bool)


def _letters() -> np.ndarray:
    if not _LETTER.any():
        _LETTER[:] = [chr(c).isalpha() for c in range(0x10000)]
    return _LETTER


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of DIMS for each text, and whether it has a letter."""
    table = _letters()
    out, some = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        if not t:
            continue
        p = np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = np.where(p < 0x10000, table[np.minimum(p, 0xFFFF)], True)
        if not letter.any():
            continue
        some[i] = True
        p = np.where(letter, p, np.uint32(1))
        mid = letter[1:-1]  # no trigram about a break
        h = p[:-2] * np.uint32(0x9E3779B1) + p[1:-1] * np.uint32(0x85EBCA6B) + p[2:] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        row = np.sqrt(np.bincount((h[mid] >> np.uint32(21)).astype(np.int64), minlength=DIMS))
        out[i] = row / np.linalg.norm(row)
    return out, some


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    outer: np.ndarray | None = None  # a row of weights and bias for each family
    inner: dict[str, tuple[list[tuple[int, int]], np.ndarray]] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x, some = features(texts)
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if not self.families or not len(texts):
            return lang.tolist(), score
        if len(self.families) == 1:
            best, sure = np.zeros(len(x), np.int64), np.ones(len(x))
        else:
            margin = x @ self.outer[:, :-1].T + self.outer[:, -1]
            best = margin.argmax(1)
            top = np.sort(margin, 1)
            sure = sigmoid(2 * (top[:, -1] - top[:, -2]))
        for f, name in enumerate(self.families):
            rows = np.flatnonzero((best == f) & some)
            langs = self.members[name]
            if not len(rows):
                continue
            if len(langs) == 1:
                lang[rows], score[rows] = langs[0], sure[rows]
                continue
            pairs, w = self.inner[name]
            margin = x[rows] @ w[:, :-1].T + w[:, -1]
            votes, sums, least = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
            for k, (a, b) in enumerate(pairs):
                for one, sign in ((a, 1), (b, -1)):
                    m = sign * margin[:, k]
                    votes[:, one] += m > 0
                    sums[:, one] += np.clip(m, -1, 1)
                    least[:, one] = np.minimum(least[:, one], m)
            won = (votes + 1e-3 * sums).argmax(1)
            lang[rows] = np.array(langs, object)[won]
            score[rows] = sure[rows] * sigmoid(4 * least[np.arange(len(rows)), won])
        return lang.tolist(), score


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 1_000, most_rows: int = 16_000) -> LanguageModel:
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return LanguageModel()
    each = min(per_language, max(1, most_rows // len(counts)))
    below = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])[F.col("lang")]
    rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < below * 1_000_003).select("text", "lang")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, some = features(batch.column(0).to_pylist())
            at = [np.flatnonzero(row) for row in x[some]]
            values = [row[i].astype("<f4").tobytes() for row, i in zip(x[some], at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(some, pa.bool_())), pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array(values, pa.binary())], names=["lang", "at", "value"])

    got = rows.mapInArrow(run, "lang string, at binary, value binary").toPandas()  # most_rows rows
    x, lang = np.zeros((len(got), DIMS), np.float32), got["lang"].to_numpy(object)
    for i, (at, value) in enumerate(zip(got["at"], got["value"], strict=True)):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f4")
    model = LanguageModel()
    for one in sorted(set(lang)):
        model.members.setdefault(family(one), []).append(one)
    model.families = sorted(model.members)
    group = np.array([family(z) for z in lang], object)
    if len(model.families) > 1:
        some = model.families[:1] if len(model.families) == 2 else model.families
        outer = [fit_svm(x, np.where(group == f, 1.0, -1.0), c=30) for f in some]
        model.outer = np.stack([*outer, *([-outer[0]] if len(some) == 1 else [])])
    for name, langs in model.members.items():
        if len(langs) > 1:
            pairs = list(combinations(range(len(langs)), 2))
            weights = []
            for a, b in pairs:
                mine = (lang == langs[a]) | (lang == langs[b])
                weights.append(fit_svm(x[mine], np.where(lang[mine] == langs[a], 1.0, -1.0), c=30))
            model.inner[name] = (pairs, np.stack(weights))
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """Add lang_col and score_col (0 to 1)."""
    refuse(docs, lang_col, score_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = held.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
