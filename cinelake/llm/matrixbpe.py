"""Byte-level BPE over a rank file, merged in padded numpy matrices.

The pieces of many texts are taken together. A piece that is itself a token is
done; the distinct others are sorted into buckets by their length in bytes, and
each bucket becomes a matrix of token ids with one row per piece, padded on the
right. In each round every row merges its leftmost pair of the lowest rank; the
two pairs beside it are looked up again in a hash table of pairs, the columns
behind it move up by one, and rows without a pair leave the matrix.

A piece wider than the widest bucket is a matrix of one row, which merges in
one round all its pairs of the lowest rank that the rounds one by one would
merge next (see ``_merge_wide``), so that its rounds are bounded by the number
of different ranks.

A rank file has no merge list: a pair may merge if its bytes together are a
token, and the rank of that token decides, as in the tiktoken library.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.bpe import shipped
from cinelake.llm.common import arrow_map, worker_memo

#: Widths of the buckets, in bytes.
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024)
#: Cells of one matrix; pieces taken together; pieces kept in a worker's table.
CELLS, TAKE, TABLE = 1 << 17, 1 << 16, 150_000
#: Rank of a pair that does not merge.
NONE = np.int64(1) << 40


class PairTable:
    """Ranks of pairs of token ids: open addressing in two numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int64)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            self.keys[at[free]] = key[todo[free]]  # of several keys for a slot one stays
            won = self.keys[at] == key[todo]
            self.ranks[at[won]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = slot[todo] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it does not merge; ids below zero are padding."""
        key = left << 32 | right
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where((there == key) & (left >= 0) & (right >= 0), self.ranks[slot], NONE)
        todo = np.flatnonzero((there != key) & (there >= 0) & (left >= 0) & (right >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.mask
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out


def pairs_of(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every pair of tokens whose bytes together are a token, with that token's rank."""
    found = [(a, b, r) for token, r in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
    left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
    return left, right, rank


class Classes:
    """Texts as the pattern must see them.

    The Unicode tables of two regular expression libraries can differ. Each
    character is tried once against the library whose ids must be met; one that
    is classed otherwise there is shown to the pattern as a plain character of
    the right class.
    """

    def __init__(self) -> None:
        import tiktoken

        bytes_only = {bytes([i]): i for i in range(256)}
        self.tests = [(regex.compile(p), tiktoken.Encoding(f"class{i}", pat_str=p, mergeable_ranks=bytes_only, special_tokens={}), like) for i, (p, like) in enumerate(((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t")))]
        self.known = set(map(chr, range(128)))
        self.shown: dict[int, str] = {}

    def shadow(self, text: str) -> str:
        if text.isascii():
            return text
        for c in set(text) - self.known:
            self.known.add(c)
            ours = [bool(p.match(c)) for p, _, _ in self.tests]
            theirs = [bool(e.encode_ordinary(c)) for _, e, _ in self.tests]
            if ours != theirs:
                self.shown[ord(c)] = next((like for (_, _, like), is_so in zip(self.tests, theirs) if is_so), "!")
        return text.translate(self.shown) if self.shown else text


class Encoder:
    """Encoder and decoder of one rank file; ``pattern`` splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, widths: tuple[int, ...] = WIDTHS) -> None:
        self.ranks, self.widths = ranks, np.array(widths)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.first = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pairs = PairTable(*pairs_of(ranks))
        self.find = regex.compile(pattern)
        self.classes = Classes()
        self._forget()

    # ---------------------------------------------------------------- merging

    def _merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """The tokens of each row of a padded matrix."""
        out: list[np.ndarray] = [ids[:0, 0]] * len(ids)
        name = np.arange(len(ids))
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(ids):
            at = rank.argmin(1)
            best = rank[np.arange(len(ids)), at]
            done = best == NONE
            if done.any():
                for i, row in zip(name[done], ids[done]):
                    out[i] = row[row >= 0]
                live = ~done
                name, ids, rank, at, best = name[live], ids[live], rank[live], at[live], best[live]
                if not len(ids):
                    break
            rows, width = np.arange(len(ids)), ids.shape[1]
            ids[rows, at] = best
            column = np.arange(width - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            if width == 2:
                for i, row in zip(name, ids):
                    out[i] = row
                break
            rank = np.take_along_axis(rank, column[:-1] + (column[:-1] >= at[:, None]), 1)
            has_next, has_last = at < width - 2, at > 0
            r, a = rows[has_next], at[has_next]
            rank[r, a] = self.pairs.get(ids[r, a], ids[r, a + 1])
            r, a = rows[has_last], at[has_last]
            rank[r, a - 1] = self.pairs.get(ids[r, a - 1], ids[r, a])
        return out

    def _merge_wide(self, ids: np.ndarray) -> np.ndarray:
        """The tokens of one long row.

        A round merges the pairs of the lowest rank from left to right, as the
        single merges would, and stops behind the first merge that makes a pair
        of a still lower rank, because that pair would come next. A merged pair
        makes longer tokens only, so no new pair has the same rank.
        """
        rank = self.pairs.get(ids[:-1], ids[1:])
        while len(rank):
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            run = np.cumsum(np.diff(at, prepend=-2) != 1)  # in a run of overlapping pairs every second one merges
            begin = at[np.searchsorted(run, np.arange(1, run[-1] + 1))]
            at = at[(at - begin[run - 1]) % 2 == 0]
            before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            before[1:][np.diff(at) == 2] = best  # merged just before
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            merged = np.full(len(at), best)
            lower = (self.pairs.get(before, merged) < best) | (self.pairs.get(merged, after) < best)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = best
            ids = np.delete(ids, at + 1)
            rank = np.delete(rank, np.minimum(at + 1, len(rank) - 1)) if at[-1] + 1 < len(rank) else np.delete(rank, np.append(at[:-1] + 1, at[-1]))
            at = at - np.arange(len(at))
            right, left = at[at < len(ids) - 1], at[at > 0]
            rank[right] = self.pairs.get(ids[right], ids[right + 1])
            rank[left - 1] = self.pairs.get(ids[left - 1], ids[left])
        return ids

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece, whatever its length."""
        out = [np.zeros(0, np.int64)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = np.array([whole], np.int64)
            elif piece:
                buckets.setdefault(int(np.searchsorted(self.widths, len(piece))), []).append(i)
        for bucket, names in buckets.items():
            if bucket == len(self.widths):
                for i in names:
                    out[i] = self._merge_wide(self.first[np.frombuffer(pieces[i], np.uint8)])
                continue
            width = int(self.widths[bucket])
            for k in range(0, len(names), max(1, CELLS // width)):
                some = names[k : k + max(1, CELLS // width)]
                size = np.array([len(pieces[i]) for i in some])
                there = np.arange(size.max()) < size[:, None]
                ids = np.full(there.shape, -1, np.int64)
                ids[there] = self.first[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
                for i, row in zip(some, self._merge_rows(ids)):
                    out[i] = row
        return out

    # ---------------------------------------------------------------- texts

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.offset = np.zeros(1 << 16, np.uint32), np.zeros(TABLE + TAKE + 1, np.int64)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has; pieces met before come from the table."""
        at = np.array(list(map(self.index.get, pieces, repeat(-1))), np.int64)
        if (at < 0).any():
            if len(self.index) > TABLE or len(self.flat) > 16 * TABLE:
                self._forget()
                at[:] = -1
            missing = np.flatnonzero(at < 0).tolist()
            new = list(dict.fromkeys([pieces[i] for i in missing]))
            found = self.merge([p.encode() for p in new])
            k, size = len(self.index), np.array([len(x) for x in found])
            past = int(self.offset[k]) + np.cumsum(size)
            while past[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[int(self.offset[k]) : past[-1]] = np.concatenate(found)
            self.offset[k + 1 : k + 1 + len(new)] = past
            self.index.update(zip(new, range(k, k + len(new))))
            at[missing] = list(map(self.index.__getitem__, [pieces[i] for i in missing]))
        begin = self.offset[at]
        n = self.offset[at + 1] - begin
        past = np.cumsum(n)
        return self.flat[np.repeat(begin - (past - n), n) + np.arange(int(past[-1]) if len(past) else 0)], n

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, at most ``TAKE`` at a time."""
        shown = self.classes.shadow(text)
        if len(text) <= TAKE:
            yield self.find.findall(text) if shown is text else [text[m.start() : m.end()] for m in self.find.finditer(shown)]
            return
        found = self.find.finditer(shown)
        while some := [text[m.start() : m.end()] for m in islice(found, TAKE)]:
            yield some

    def stream(self, texts: Iterable[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, some of its ids), in order; the pieces of several texts are merged together."""
        pieces: list[str] = []
        parts: list[tuple[int, int]] = []

        def flush() -> Iterator[tuple[int, list[int]]]:
            ids, n = self._ids(pieces)
            past = np.concatenate([[0], np.cumsum(n)])
            begin = 0
            for i, k in parts:
                yield i, ids[past[begin] : past[begin + k]].tolist()
                begin += k
            pieces.clear()
            parts.clear()

        for i, text in enumerate(texts):
            for some in self._pieces(text):
                if pieces and len(pieces) + len(some) > TAKE:
                    yield from flush()
                pieces += some
                parts.append((i, len(some)))
        yield from flush()

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for i, ids in self.stream(texts):
            out[i] += ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids; unknown ids give nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def encoder(name: str, pattern: str) -> Encoder:
    """The encoder of a file that ``shipped`` has sent; built once per worker process."""
    return worker_memo(f"matrixbpe.{name}", lambda: Encoder(read_ranks(SparkFiles.get(name)), pattern))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row of ``docs (doc_id, text)``: the ids of the whole text.

    Null and empty texts have no ids. A very long text is cut into pieces, and
    merged, some tens of thousands of pieces at a time. Rows with a null or a
    repeated doc_id, and equal rows, each give their own row; other columns are
    ignored; an empty table gives no rows. Pairs of equal rank merge leftmost
    first.
    """
    name = shipped(docs, path)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(name, pattern).encode([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(_texts(docs), rows, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data binary, text`` of ``coded (doc_id, ids)``: the bytes of the ids, and those bytes as text.

    Null and empty ids give empty bytes; ids that are null or unknown give
    nothing; bytes that are not UTF-8 become U+FFFD in the text.
    """
    name = shipped(coded, path)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = encoder(name, pattern)
        data = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in data], pa.string())], ["doc_id", "data", "text"])

    return arrow_map(coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")), rows, "doc_id long, data binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass over the texts.

    The digests are those of the decimal ids joined by commas and of the decoded
    bytes. The same cases as in ``encode``.
    """
    name = shipped(docs, path)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = encoder(name, pattern)
        decimal, token = worker_memo(f"matrixbpe.tables.{name}", lambda: ([f",{i}" for i in range(max(model.bytes_of) + 1)], [model.bytes_of.get(i, b"") for i in range(max(model.bytes_of) + 1)]))
        n = [0] * batch.num_rows
        of_ids, of_bytes = ([hashlib.sha256() for _ in n] for _ in range(2))
        for i, ids in model.stream([t or "" for t in batch.column(1).to_pylist()]):
            of_ids[i].update("".join([decimal[x] for x in ids])[0 if n[i] else 1 :].encode())
            of_bytes[i].update(b"".join([token[x] for x in ids]))
            n[i] += len(ids)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in of_ids], pa.string()), pa.array([h.hexdigest() for h in of_bytes], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(_texts(docs), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
