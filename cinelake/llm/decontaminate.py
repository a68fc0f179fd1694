"""Benchmark decontamination by winnowing.

Texts become word sequences. Both sides keep the minimum hash of every window
of consecutive word k-grams (winnowing): with windows of ``span - k + 1``
k-grams, any run of ``span`` words that two texts share contains a k-gram that
both sides kept. Document fingerprints are joined with the benchmark's, each
match is extended to the windows of ``span`` words around it, and the words
themselves are compared at the end, so the hits are exact.

The benchmark side is a lookup table of bounded size (``block_bytes`` of item
text), shared with the tasks as a broadcast; a larger benchmark is split into
blocks of items that the documents pass one after the other. Documents are not
shuffled, so neither a hot source nor a passage that many documents share
matters for the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import arrow_map, share, worker_memo

SPAN = 10
GRAM = 5
BLOCK_BYTES = 16 << 20
#: Bytes of text whose words are hashed at once, and match pairs extended at once.
_CHUNK = 1 << 20
_PAIRS = 1 << 17

_FIELDS = "doc_id long, text string, n_words long, spans array<struct<first:long,past:long>>, item_ids array<long>"


def _is_word() -> np.ndarray:
    """Word bytes: digits, letters, and every byte of a character beyond ASCII."""
    word = np.zeros(256, bool)
    word[ord("0") : ord("9") + 1] = word[ord("a") : ord("z") + 1] = word[ord("A") : ord("Z") + 1] = True
    word[128:] = True
    return word


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """Word hashes of a byte buffer, all words at once, by differences of a running polynomial."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20240229)
        self.word = _is_word()
        self.value = rng.integers(1, 1 << 63, 256, np.uint64)
        self.value[ord("A") : ord("Z") + 1] = self.value[ord("a") : ord("z") + 1]
        self.base = 0x9E3779B97F4A7C15
        self.unbase = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.unbase, k, 1 << 64))])

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of ``data``."""
        raw = np.frombuffer(data, np.uint8)
        self._powers(len(raw) + 1)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = self.word[raw]
        turns = np.flatnonzero(np.diff(inside))
        starts, ends = turns[::2], turns[1::2]
        running = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[: len(raw)], out=running[1:])
        return starts, ends, _mix((running[ends] - running[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def _hasher() -> _Hasher:
    return worker_memo("decontaminate.hasher", _Hasher)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    return _mix(out)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of k-grams that are the minimum of a window (all of them, where hashes tie)."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.arange(len(grams)) if len(grams) else np.zeros(0, np.int64)
    low = grams[:n].copy()
    for i in range(1, window):
        np.minimum(low, grams[i : n + i], out=low)
    best = np.zeros(len(grams), np.uint64)  # the largest window minimum over the windows that hold a gram
    for i in range(window):
        np.maximum(best[i : n + i], low, out=best[i : n + i])
    return np.flatnonzero(best == grams)


class Benchmark:
    """Lookup table of one block of items."""

    def __init__(self, items: list[tuple[int, str]], span: int = SPAN, gram: int = GRAM) -> None:
        if not 1 <= gram <= span:
            raise ValueError("a k-gram must fit the span")
        self.span, self.gram, self.window = span, gram, span - gram + 1
        items = [(i, t) for i, t in items if i is not None and t]
        data = b"\0".join(t.encode("utf-8", "replace") for _, t in items)
        starts, ends, self.hashes = _Hasher()(data)
        self.words = [data[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())]
        bounds = np.concatenate([[0], np.cumsum([len(t.encode("utf-8", "replace")) + 1 for _, t in items])]) if items else np.zeros(1, np.int64)
        self.item = np.searchsorted(bounds, starts, "right") - 1
        self.ids = [i for i, _ in items]
        counts = np.bincount(self.item, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        full = np.flatnonzero(counts >= span)
        keep = winnow(grams := _grams(self.hashes, gram), self.window)
        keep = keep[np.isin(self.item[keep], full) & (self.item[keep] == self.item[np.minimum(keep + gram - 1, len(self.item) - 1)])] if len(keep) else keep
        order = np.argsort(grams[keep], kind="stable")
        self.at, self.fps = keep[order], grams[keep][order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({int(c) for c in counts if 0 < c < span}):
            at = self.begin[np.flatnonzero(counts == n)]
            fps = _grams(self.hashes, n)[at]
            order = np.argsort(fps, kind="stable")
            self.short[n] = (at[order], fps[order])

    def _pairs(self, fps: np.ndarray, at: np.ndarray, grams: np.ndarray, spots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Document and benchmark positions whose k-grams agree, in slices."""
        if not len(fps) or not len(spots):
            return
        keys = grams[spots]
        left = np.searchsorted(fps, keys, "left")
        hit = fps[np.minimum(left, len(fps) - 1)] == keys
        spots, left = spots[hit], left[hit]
        n = np.searchsorted(fps, grams[spots], "right") - left
        past = np.cumsum(n)
        i = 0
        while i < len(spots):
            j = max(i + 1, int(np.searchsorted(past, (past[i - 1] if i else 0) + _PAIRS, "right")))
            m, l = n[i:j], left[i:j]
            yield np.repeat(spots[i:j], m), at[np.repeat(l - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            i = j

    def hits(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
        """For each text: words, spans of hit words, ids of the items found."""
        coded = [t.encode("utf-8", "replace") for t in texts]
        data = b"\0".join(coded)
        starts, ends, hashes = _hasher()(data)
        bounds = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])])
        doc = np.searchsorted(bounds, starts, "right") - 1
        begin = np.searchsorted(starts, bounds)
        marks = np.zeros(len(starts) + 1, np.int32)
        found: dict[int, set[int]] = {}

        def mark(p: np.ndarray, q: np.ndarray, n: int) -> None:
            for a, b in set(zip(p.tolist(), q.tolist())):
                if all(data[starts[a + i] : ends[a + i]].lower() == self.words[b + i] for i in range(n)):
                    marks[a] += 1
                    marks[a + n] -= 1
                    found.setdefault(int(doc[a]), set()).add(self.ids[self.item[b]])

        grams = _grams(hashes, self.gram)
        last, top = len(hashes) - 1, len(self.hashes) - 1
        for p, q in self._pairs(self.fps, self.at, grams, winnow(grams, self.window)):
            around = np.arange(1 - self.window, self.span)
            pp, qq = p[:, None] + around, q[:, None] + around
            ok = (pp >= 0) & (pp <= last) & (qq >= 0) & (qq <= top)
            pp, qq = np.clip(pp, 0, last), np.clip(qq, 0, top)
            ok &= (hashes[pp] == self.hashes[qq]) & (doc[pp] == doc[p][:, None]) & (self.item[qq] == self.item[q][:, None])
            for s in range(self.window):
                whole = ok[:, s : s + self.span].all(1)
                mark(p[whole] + around[s], q[whole] + around[s], self.span)
        for n, (at, fps) in self.short.items():
            grams = _grams(hashes, n)
            for p, q in self._pairs(fps, at, grams, np.arange(len(grams))):
                one = doc[p] == doc[p + n - 1]
                mark(p[one], q[one], n)
        hit = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]])
        for k in range(len(texts)):
            a, b = int(begin[k]), int(begin[k + 1])
            if k in found:
                turns = np.flatnonzero(np.diff(np.concatenate([[False], hit[a + 1 : b + 1], [False]]).astype(np.int8)))
                yield b - a, list(zip(turns[::2].tolist(), turns[1::2].tolist())), sorted(found[k])
            else:
                yield b - a, [], []


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, block, keep_text: bool, more: tuple[str, ...]) -> DataFrame:
    """One block of items over all documents; earlier findings in the rows are kept."""
    kinds = dict(docs.dtypes)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts, _, before, items = (c.to_pylist() for c in batch.columns[:5])
        i = 0
        while i < len(ids):
            j, size = i, 0
            while j < len(ids) and (j == i or size < _CHUNK):
                size += 4 * len(texts[j] or "")
                j += 1
            n_words, spans, found = [], [], []
            for k, (n, s, f) in enumerate(block().hits([t or "" for t in texts[i:j]]), i):
                n_words.append(n)
                spans.append([{"first": a, "past": b} for a, b in _joined(s + [(x["first"], x["past"]) for x in before[k] or []])])
                found.append(sorted({*f, *(items[k] or [])}))
            kept = texts[i:j] if keep_text else [None] * (j - i)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))), pa.array(found, pa.list_(pa.int64())), *[c.slice(i, j - i) for c in batch.columns[5:]]], ["doc_id", "text", "n_words", "spans", "item_ids", *more])
            i = j

    return arrow_map(docs, rows, _FIELDS + "".join(f", {c} {kinds[c]}" for c in more))


def overlaps(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, spans, item_ids`` for every row of ``docs (doc_id, text)``.

    ``spans`` are the word ranges (first, past the last) covered by an
    occurrence of any run of ``span`` consecutive words of a benchmark item
    ``(item_id, text)``; an item with fewer words, but not none, counts as one
    run. ``item_ids`` are the items with such a run in the document. Null and
    wordless texts have no words and no hits; items with a null id take no
    part; repeated rows and repeated items change nothing for other rows;
    the columns ``more`` are passed through and others ignored; empty tables
    give no rows, or rows without hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:long,past:long>>)").alias("spans"), F.expr("cast(array() as array<long>)").alias("item_ids"), *more)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        table = Benchmark([tuple(r) for r in part.collect()], span, gram)
        out = _pass(out, share(spark, table), b < blocks - 1, more)
    return out.drop("text")
