"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and
full-width forms become Latin letters, invisible characters go, and digits and
signs that stand for letters inside a word become those letters. What is left
are runs of letters, joined by single spaces.

The lexicon holds whole words and word beginnings with a weight, the lower
confidence bound of the log ratio of their frequency per text in toxic and in
other training texts (an entry that a text repeats counts logarithmically: a
beginning that clean texts hold once may fill toxic ones). Exception phrases (given ones, and word pairs around an entry
that occur in texts labelled 0 only) cancel the entries inside them. A text's
score is a logistic function of its weight per word and of its whole weight,
fitted to the same training texts.

Bound: at most ``sample`` labelled texts are used for fitting, those with the
smallest hashes of the id; scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import cut_lineage, share, slices
from cinelake.session import broadcast_if_small

SAMPLE = 20_000
THRESHOLD = 0.7
#: Toxic texts that hold an entry, and clean texts that hold a harmless pair, at least; the same for every size of table.
FLOOR, SPARE_FLOOR = 2, 3
#: Rows of labels (an id and a bit) that may be broadcast.
SMALL = 2_000_000
PREFIXES = range(4, 10)
#: Least weight of an entry, and standard errors taken off its log ratio.
LEAST, ERRORS = 2.0, 2.0
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown")

# Letters of other scripts that look like Latin letters, and signs that stand for letters.
LOOKALIKES = dict(zip("абвгеёікмнорстухѕјԁһѵαβγεηικνορτυχωϲ", "abbreeikmhopctyxsjdhvabyenikvoptuxwc"))
SIGNS = dict(zip("013457@$!", "oieastasi"))

_UNUSUAL = re.compile("[Ͱ-ԯ­​-‏⁠﻿＀-￯]")
_FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {c: None for c in (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)} | {0xFF41 + i: chr(ord("a") + i) for i in range(26)} | {0xFF10 + i: str(i) for i in range(10)}
_SIGN = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|(?<![\w@$!.])[013457@$](?=[^\W\d_]{2})")
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str | None) -> str:
    """Words of a text after folding, each between single spaces."""
    text = (text or "").lower()
    if _UNUSUAL.search(text):
        text = text.translate(_FOLD)
    text = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m.group()), text)
    return f" {' '.join(_WORD.findall(text))} "


def _entries(line: str) -> Counter:
    """Whole words (between spaces) and beginnings (after a space) of a folded text, with their numbers."""
    out: Counter = Counter()
    for word, n in Counter(line.split()).items():
        out[f" {word} "] += n
        for size in PREFIXES:
            if len(word) >= size:
                out[f" {word[:size]}"] += n
    return out


class Lexicon:
    """Weighted entries and exception phrases with the logistic function of the score."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], logistic: tuple[float, float, float]) -> None:
        self.weights, self.exceptions, self.logistic = weights, exceptions, logistic

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, -1.0))
        if not len(a):
            return None
        a.make_automaton()
        return a

    def weigh(self, automaton: ahocorasick.Automaton | None, text: str | None) -> tuple[float, int, int]:
        """Weight, matched words and words of a text; a word counts once, with its heaviest entry."""
        line = folded(text)
        words = line.count(" ") - 1 if len(line) > 2 else 0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if automaton is not None:
            for end, (n, w) in automaton.iter(line):
                begin = end - n + 1
                if w < 0:
                    spared.append((begin, end))
                elif w > best.get(begin, 0.0):
                    best[begin] = w
        for a, b in spared:
            for at in [x for x in best if a <= x < b]:
                del best[at]
        return sum(best.values()), len(best), words

    def score(self, weight: float, words: int) -> float:
        bias, by_share, by_weight = self.logistic
        z = bias + by_share * np.log1p(20 * weight / (words + 10)) + by_weight * np.log1p(weight)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps of a logistic regression with a small ridge; slopes are not negative."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(3), np.array([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])


def _counts(sample: DataFrame, label: int, of) -> DataFrame:
    """``entry, n, mass`` over the texts of one label: texts that hold it, and the sum of log2(1 + its number in a text).

    ``of`` maps a folded text to a counter of entries.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: Counter = Counter()
        mass: Counter = Counter()
        for batch in slices(batches):
            for line in batch.column(0).to_pylist():
                for entry, n in of(line).items():
                    texts[entry] += 1
                    mass[entry] += round(4096 * np.log2(1 + n))  # whole numbers: the same sums in any order
        yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string()), pa.array(list(texts.values()), pa.int64()), pa.array([mass[e] for e in texts], pa.int64())], ["entry", "n", "mass"])

    counted = sample.filter(F.col("toxic") == label).select("line").mapInArrow(task, "entry string, n long, mass long")
    return counted.groupBy("entry").agg(F.sum("n").alias("n"), (F.sum("mass") / 4096).alias("mass"))


def labelled(docs: DataFrame, labels: DataFrame, train, sample: int = SAMPLE) -> DataFrame:
    """``line, toxic`` (folded text, 0 or 1) of at most ``sample`` labelled texts that ``train`` (a condition on doc_id) admits.

    Those with the smallest hashes of id and text; equal rows count once, and an
    id that many rows share brings no more of them than the bound.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").filter(train).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("_h"))
    chosen = hashed.select("doc_id", "_h").distinct().join(broadcast_if_small(marks, SMALL), "doc_id").orderBy("_h", "doc_id").limit(sample)
    texts = hashed.join(F.broadcast(chosen), ["doc_id", "_h"]).select("text", "toxic", "doc_id", "_h", F.spark_partition_id().alias("_task"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in slices(batches):
            text, toxic, ids, hashes, tasks = (c.to_pylist() for c in batch.columns)
            new = [i for i, key in enumerate(zip(ids, hashes)) if key not in seen and not seen.add(key)]
            lines = pa.array([folded(text[i]) for i in new], pa.string())
            yield pa.RecordBatch.from_arrays([lines, *[c.take(pa.array(new, pa.int64())) for c in batch.columns[1:]]], ["line", "toxic", "doc_id", "_h", "_task"])

    # equal rows of several tasks: the first task's one stays; only ids and hashes are shuffled, no text
    once = cut_lineage(texts.mapInArrow(task, "line string, toxic int, doc_id long, _h long, _task int"))
    first = once.groupBy("doc_id", "_h").agg(F.min("_task").alias("_task"))
    return once.join(F.broadcast(first), ["doc_id", "_h", "_task"]).select("line", "toxic")


def fit(docs: DataFrame, labels: DataFrame, train, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon of the labelled texts; without any label of either kind it is empty and scores 0."""
    lines = labelled(docs, labels, train, sample)  # stored
    size = {r["toxic"]: r["count"] for r in lines.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    fixed = {folded(e).strip() for e in exceptions}
    if not n1 or not n0:
        return Lexicon({}, fixed, (-30.0 if not n1 else 30.0 if not n0 else 0.0, 0.0, 0.0))
    # only entries whose confidence bound could suffice if no clean text held them: the others cannot get a weight
    hope = F.log((F.col("mass") + 0.5) / (n1 + 1)) - float(np.log(0.5 / (n0 + 1))) - ERRORS * F.sqrt(1 / (F.col("n") + 0.5) + 2.0)
    often = {r["entry"]: (r["n"], r["mass"]) for r in _counts(lines, 1, _entries).filter((F.col("n") >= FLOOR) & (hope >= LEAST - 1e-9)).collect()}
    spark = lines.sparkSession
    wanted = spark.sparkContext.broadcast(frozenset(often))
    clean = {r["entry"]: (r["n"], r["mass"]) for r in _counts(lines, 0, lambda line: {e: n for e, n in _entries(line).items() if e in wanted.value}).collect()}
    weights = {}
    for entry, (texts, mass) in often.items():
        other, rest = clean.get(entry, (0, 0.0))
        ratio = np.log((mass + 0.5) / (n1 + 1)) - np.log((rest + 0.5) / (n0 + 1))
        bound = ratio - ERRORS * np.sqrt(1 / (texts + 0.5) + 1 / (other + 0.5))
        if bound >= LEAST:
            weights[entry] = float(bound)
    doubtful = {e for e in weights if clean.get(e, 0)}
    if doubtful:
        finder = Lexicon({e: 1.0 for e in doubtful}, set(), (0.0, 0.0, 0.0))

        held: list[ahocorasick.Automaton] = []

        def pairs(line: str) -> dict[str, int]:
            if not held:
                held.append(finder.automaton())  # once per task
            found, automaton = set(), held[0]
            for end, (n, _) in automaton.iter(line):
                begin = end - n + 1
                past = line.index(" ", begin + 1)
                left = line.rfind(" ", 0, begin) if begin else -1
                right = line.find(" ", past + 1)
                if left >= 0:
                    found.add(line[left + 1 : past])
                if right >= 0:
                    found.add(line[begin + 1 : right])
            return dict.fromkeys(found, 1)

        spare = {r["entry"] for r in _counts(lines, 0, pairs).filter(F.col("n") >= SPARE_FLOOR).collect()}
        spare_bc = spark.sparkContext.broadcast(frozenset(spare))
        guilty = {r["entry"] for r in _counts(lines, 1, lambda line: {p: 1 for p in pairs(line) if p in spare_bc.value}).collect()}
        fixed |= spare - guilty
    lexicon = Lexicon(weights, fixed, (0.0, 0.0, 0.0))
    found = _weights(lines.select(F.lit(0).cast("long").alias("doc_id"), F.col("line").alias("text"), "toxic"), lexicon, "toxic").select("weight", "words", "toxic").collect()
    data = np.array([(r["weight"], r["words"], r["toxic"]) for r in found], float)
    data = data[np.lexsort(data.T)]  # the same sums whatever the order of the tasks
    x = np.column_stack([np.log1p(20 * data[:, 0] / (data[:, 1] + 10)), np.log1p(data[:, 0])])
    return Lexicon(weights, fixed, _logistic(x, data[:, 2]))


def _weights(docs: DataFrame, lexicon: Lexicon, *more: str) -> DataFrame:
    shared = share(docs.sparkSession, lexicon)
    kinds = dict(docs.dtypes)
    extra = "".join(f", {c} {kinds[c]}" for c in more)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        automaton = model.automaton()
        for batch in slices(batches):
            found = [model.weigh(automaton, t) for t in batch.column(1).to_pylist()]
            weight, matched, words = zip(*found) if found else ((), (), ())
            score = [model.score(w, n) for w, _, n in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight, pa.float64()), pa.array(matched, pa.int64()), pa.array(words, pa.int64()), pa.array(score, pa.float64()), *batch.columns[2:]], ["doc_id", "weight", "matched", "words", "score", *more])

    return docs.mapInArrow(task, f"doc_id long, weight double, matched long, words long, score double{extra}")


def scores(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, weight, matched, words, score, predicted`` for every row of ``docs (doc_id, text)``.

    ``predicted`` is 1 from ``threshold`` on. Null, empty and wordless texts have
    weight 0 and the score of a text without any entry. Repeated rows give
    results; the columns ``more`` are passed through and others ignored; an
    empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return _weights(texts, lexicon, *more).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
