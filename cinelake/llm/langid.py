"""Hierarchical language identification.

A text is a vector of its letter n-grams (1 to 3 letters with word ends,
hashed). Linear support vector machines first decide between language families,
then one machine per pair of languages of the winning family votes for the
language. The machines are fitted on a bounded sample: at most ``per_lang``
training texts of each language, those with the smallest hashes of the id.
Counting and scoring run over whole texts in the tasks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinelake.llm.common import arrow_map, share, worker_memo

DIM = 1 << 12
PER_LANG = 800
#: Ranges of hashes that are counted to choose the fitting sample (a power of two).
BINS = 1 << 12
#: Characters whose n-grams are counted at once.
_BLOCK = 1 << 18

# Families of common ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "Germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "Romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "Slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "Uralic": ["et", "fi", "hu"],
    "Baltic": ["lt", "lv"],
    "Turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "Indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "Iranian": ["fa", "ku", "ps"],
    "Semitic": ["am", "ar", "he", "mt"],
    "Sinitic": ["zh", "yue"],
}


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram counts; None if the text has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = worker_memo("langid.letters", _letters)[codes]
    if not letter.any():
        return None
    counts = np.zeros(dim, np.int64)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    codes = codes[~((codes == 32) & np.concatenate([[False], codes[:-1] == 32]))]
    shift = np.uint64(64 - int(dim).bit_length() + 1)
    for i in range(0, len(codes), _BLOCK):
        part = codes[i : i + _BLOCK + 2]  # the next two characters belong to n-grams that begin here
        h = np.zeros(len(part), np.uint64)
        for n in range(3):
            h = (h[: len(part) - n] + part[n:] + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(29))
            m = min(_BLOCK, len(h))
            counts += np.bincount(((h[:m] * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64), minlength=dim)
            h = h[: max(0, len(h) - 1)]
    x = np.sqrt(counts)
    return (x / np.linalg.norm(x)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(12):  # the largest curvature
        v = x.T @ (weight * (x @ v))
        top = np.linalg.norm(v)
        v /= top
    step = 1 / (2 * top + penalty)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (penalty * ahead - 2 * (x.T @ (weight * y * slack)))
        ahead, w = new + t / (t + 3) * (new - w), new
    return w


class Model:
    """Families, their pairwise machines, and the machines of the language pairs within each."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, list[str]]) -> None:
        family = {lang: f for f, members in families.items() for lang in members}
        names = np.array([family.get(lang, lang) for lang in langs])
        langs = np.array(langs)
        self.members = {f: sorted(set(langs[names == f].tolist())) for f in sorted(set(names.tolist()))}
        self.pairs: list[tuple[str, str]] = []
        rows = []
        for classes, of in [(sorted(self.members), names), *((m, langs) for m in self.members.values())]:
            for a, b in combinations(classes, 2):
                here = (of == a) | (of == b)
                y = np.where(of[here] == a, 1.0, -1.0).astype(x.dtype)
                weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
                rows.append(_svm(x[here], y, weight))
                self.pairs.append((a, b))
        self.weights = np.array(rows, x.dtype).reshape(len(rows), x.shape[1] + 1)
        self.row = {}
        for i, (a, b) in enumerate(self.pairs):
            self.row[a, b] = i

    def _vote(self, classes: list[str], margins: np.ndarray) -> tuple[str, float]:
        """Winner of the pairwise machines (ties by the sum of margins, then by name) and its least margin."""
        if len(classes) == 1:
            return classes[0], 9.0
        votes, total, least = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0), dict.fromkeys(classes, 9.0)
        for a, b in combinations(classes, 2):
            m = float(margins[self.row[a, b]])
            for c, s in ((a, m), (b, -m)):
                votes[c] += s > 0
                total[c] += s
                least[c] = min(least[c], s)
        best = min(classes, key=lambda c: (-votes[c], -total[c], c))
        return best, least[best]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and a score from 0 to 1 (the logistic of the least margin on the way)."""
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        family, sure = self._vote(sorted(self.members), margins)
        lang, close = self._vote(self.members[family], margins)
        return lang, float(1 / (1 + np.exp(-2 * min(sure, close))))


def fit(docs: DataFrame, per_lang: int = PER_LANG, families: dict[str, list[str]] | None = None, dim: int = DIM) -> Model | None:
    """The model of ``docs (doc_id, text, lang)``; None if no row has both a letter and a language.

    Bound: at most ``per_lang`` different texts of each language reach the
    driver, as sparse n-gram counts. They are those with the smallest hashes of
    id and text: the hashes are counted in ``BINS`` ranges per language, and the
    ranges are taken from the lowest on while the bound holds. Equal rows count
    once; a repeated or null id is no other case.
    """
    lang, text = F.col("lang").cast("string"), F.col("text").cast("string")
    hashed = docs.filter("lang is not null and text is not null").select(lang.alias("lang"), text.alias("text"), F.xxhash64("doc_id", text).alias("_h"))
    one = hashed.select("lang", "_h").distinct().groupBy("lang", F.shiftrightunsigned("_h", 64 - BINS.bit_length() + 1).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("lang").orderBy("_bin"))  # ``BINS`` rows of a language at most
    cut = one.withColumn("_upto", upto).filter(F.col("_upto") <= per_lang).groupBy("lang").agg(F.max("_bin").alias("_last"))
    chosen = hashed.join(F.broadcast(cut), "lang").filter(F.shiftrightunsigned("_h", 64 - BINS.bit_length() + 1) <= F.col("_last"))
    sample = chosen.dropDuplicates(["lang", "_h"]).select("text", "lang")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, at, values = [], [], []
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = features(text, dim) if lang is not None else None
            if x is not None:
                nonzero = np.flatnonzero(x)
                langs.append(lang)
                at.append(nonzero.astype("<u4").tobytes())
                values.append(x[nonzero].astype("<f4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["lang", "at", "x"])

    found = arrow_map(sample, rows, "lang string, at binary, x binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["at"], r["x"]))  # the same model whatever the order of the tasks
    x = np.zeros((len(found), dim), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["x"], "<f4")
    return Model(x, [r["lang"] for r in found], FAMILIES if families is None else families)


def predict(docs: DataFrame, model: Model | None, dim: int = DIM) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs (doc_id, text)``.

    ``und`` with score 0 if the text is null or has no letter, or if there is no
    model. Repeated rows give repeated results; other columns are ignored; an
    empty table gives no rows.
    """
    shared = share(docs.sparkSession, model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, out = shared(), []
        for text in batch.column(1).to_pylist():
            x = features(text, dim) if m is not None else None
            out.append(("und", 0.0) if x is None else m.predict(x))
        langs, scores = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, "doc_id long, lang_pred string, score double")
