"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder.

The merge list fixes how far to the right of a byte the text can still change
how the bytes so far are merged (``sufficient_lookahead``). Text is cut into
pieces by the byte-level split pattern; a piece longer than a window is encoded
window by window, and the tokens that end before the lookahead are emitted as
final. A token boundary that is final is crossed by no merge, so the rest of
the piece is encoded on its own: the state is one window, whatever the length
of the piece.

Short pieces repeat, so each worker keeps a table of the pieces it has met
(emptied when it is full; it only saves time).

Decoding is a byte-to-text state machine: token bytes go in, complete
characters come out, and an incomplete or wrong sequence gives U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import arrow_map, worker_memo

# The public byte-level split pattern.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which all Unicode versions in use agree; others are classed by the tokenizer's own splitter.
_ODD = regex.compile("[^\x00-԰‐-‧]")
#: Bytes of a piece that are merged at once; pieces in the table; pieces taken from the text at a time.
DIRECT, TABLE, TAKE = 64, 200_000, 1 << 16


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level tokenizers: a byte is its own Latin-1 character if printable, else 256 and up."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Splitter:
    """The split pattern, with the classes of unusual characters taken from the tokenizer's pre-tokenizer."""

    def __init__(self, pieces_of) -> None:
        self.find = regex.compile(SPLIT)
        self.pieces_of = pieces_of
        self.like: dict[str, str] = {}

    def _class(self, match) -> str:
        c = match.group()
        if c not in self.like:
            if len(self.pieces_of("a" + c)) == 1:
                self.like[c] = "a"
            elif len(self.pieces_of("1" + c)) == 1:
                self.like[c] = "1"
            elif len(self.pieces_of("!" + c)) == 1:
                self.like[c] = "!"
            else:
                self.like[c] = " "
        return self.like[c]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text in order, some at a time."""
        shadow = _ODD.sub(self._class, text)
        if shadow is text or shadow == text:
            if len(text) < TAKE:
                yield self.find.findall(text)
                return
            found = self.find.finditer(text)
            while some := [m.group() for m in islice(found, TAKE)]:
                yield some
        else:
            found = self.find.finditer(shadow)
            while some := [text[m.start() : m.end()] for m in islice(found, TAKE)]:
                yield some


def sufficient_lookahead(merges: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Bytes to the right of a merge that can decide whether it happens.

    ``merges``: (left, right, result) in order of priority. A merge of u and v
    can be prevented by an earlier merge that takes v with what follows it, and
    depends on how v, and that neighbour, came about, which earlier merges
    decide in turn. One pass in order of priority gives each merge the longest
    such chain, in bytes after its own end.
    """
    reach: dict[int, int] = {}  # of the merge that makes a token
    taken: dict[int, int] = {}  # over the merges so far with a token on the left
    most = 0
    for left, right, result in merges:
        here = max(reach.get(right, 0), taken.get(right, 0), reach.get(left, 0) - size[right], 0)
        reach[result] = max(reach.get(result, 0), here)
        taken[left] = max(taken.get(left, 0), size[right] + max(here, reach.get(right, 0)))
        most = max(most, here)
    return most


class Transducer:
    """Encoder and decoder of one merge list."""

    def __init__(self, vocab: dict[str, int], merges: list, added: dict[str, int] | None = None, pieces_of=None, lookahead: int | None = None, direct: int = DIRECT) -> None:
        alphabet = byte_alphabet()
        self.bytes_of = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in vocab.items()}
        self.added = dict(added or {})
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.first = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        triples = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.made = [c for _, _, c in triples]
        self.none = len(triples)
        self.rank: dict[int, int] = {}
        for r, (a, b, _) in enumerate(triples):
            self.rank.setdefault(a << 32 | b, r)
        size = {i: len(b) for i, b in self.bytes_of.items()}
        self.lookahead = sufficient_lookahead(triples, size) + max(size.values(), default=1) if lookahead is None else lookahead
        self.direct = direct
        self.window = max(direct, 4 * self.lookahead)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.splitter = Splitter(pieces_of or (lambda s: regex.findall(SPLIT, s)))
        self._forget()

    def _forget(self) -> None:
        """Start a new table; the last one is still asked before a piece is encoded again."""
        self.old = (self.index, self.flat, self.offset) if hasattr(self, "index") else ({}, None, None)
        self.index: dict[str, int] = {}
        self.flat, self.offset = np.zeros(1 << 16, np.uint32), np.zeros(TABLE + TAKE + 2, np.int64)

    def _ids(self, piece: str) -> list[int] | np.ndarray:
        index, flat, offset = self.old
        if (k := index.get(piece)) is not None:
            return flat[offset[k] : offset[k + 1]]
        return self.encode_piece(piece.encode("utf-8", "replace"))

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Lowest priority number first, leftmost first, by scanning the priorities of the pairs."""
        get, made, none = self.rank.get, self.made, self.none
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list and a queue, for long pieces."""
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)

        def offer(i: int, j: int) -> None:
            if (r := get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(queue, (r, i, ids[i], ids[j]))

        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece longer than a window streams through it."""
        first = self.first
        if len(piece) <= self.direct:
            return self._merge_short([first[b] for b in piece])
        out: list[int] = []
        while len(piece) > self.window:
            ids, end, safe = self._merge_long([first[b] for b in piece[: self.window]]), 0, self.window - self.lookahead
            for t in ids:
                if end + len(self.bytes_of[t]) > safe:
                    break
                out.append(t)
                end += len(self.bytes_of[t])
            piece = piece[end:]
        return out + self._merge_long([first[b] for b in piece])

    def _plain(self, text: str) -> Iterator[np.ndarray]:
        for pieces in self.splitter.pieces(text):
            at = np.array(list(map(self.index.get, pieces, repeat(-1))), np.int64)
            missing = np.flatnonzero(at < 0)
            if len(missing):
                if len(self.index) > TABLE or len(self.flat) > 16 * TABLE:
                    self._forget()
                    missing = np.arange(len(pieces))
                new = dict.fromkeys([pieces[i] for i in missing.tolist()])
                for piece in new:
                    ids, k = self._ids(piece), len(self.index)
                    a = int(self.offset[k])
                    if a + len(ids) > len(self.flat):
                        self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
                    self.flat[a : a + len(ids)] = ids
                    self.offset[k + 1] = a + len(ids)
                    self.index[piece] = k
                at[missing] = list(map(self.index.__getitem__, [pieces[i] for i in missing.tolist()]))
            begin = self.offset[at]
            n = self.offset[at + 1] - begin
            past = np.cumsum(n)
            yield self.flat[np.repeat(begin - (past - n), n) + np.arange(int(past[-1]) if len(past) else 0)]

    def stream(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, some at a time; strings of added tokens become their ids."""
        if not self.special or not any(t in text for t in self.added):
            yield from self._plain(text)
            return
        at = 0
        for m in self.special.finditer(text):
            yield from self._plain(text[at : m.start()])
            yield np.array([self.added[m.group()]], np.uint32)
            at = m.end()
        yield from self._plain(text[at:])

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.stream(text)])

    def decode_stream(self, blocks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of blocks of ids; unfinished characters wait for the next block. Unknown ids give nothing."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield state.decode(b"".join([self.bytes_of.get(i, b"") for i in ids]))
        yield state.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream([ids]))


def load(path: str) -> Transducer:
    """The transducer of a byte-level BPE file of the tokenizers library."""
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
    return Transducer(spec["model"]["vocab"], spec["model"]["merges"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])}, splitter.pre_tokenize_str)


def shipped(docs: DataFrame, path: str) -> str:
    """Send a tokenizer file to the executors; its name there for ``local_copy``."""
    name = path.rsplit("/", 1)[-1]
    docs.sparkSession.sparkContext.addFile(path)
    return name


def transducer(name: str) -> Transducer:
    return worker_memo(f"bpe.{name}", lambda: load(SparkFiles.get(name)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row of ``docs (doc_id, text)``: the ids of the whole text.

    Null and empty texts have no ids. Repeated rows give repeated results,
    other columns are ignored, an empty table gives no rows.
    """
    name = shipped(docs, path)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = transducer(name)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            ids = [model.encode(t or "") for t in part.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``coded (doc_id, ids)``; null and empty ids give an empty text, unknown ids nothing."""
    name = shipped(coded, path)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = transducer(name)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [model.decode([x for x in ids or [] if x is not None]) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")), rows, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass over the texts.

    The digests are those of the decimal ids joined by commas and of the
    decoded text. The same cases as in ``encode``.
    """
    name = shipped(docs, path)

    def digest(model: Transducer, decimal: list[str], text: str) -> tuple[int, str, str]:
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

        def blocks() -> Iterator[list[int]]:
            nonlocal n
            for block in model.stream(text):
                ids = block.tolist()
                if ids:
                    of_ids.update((("," if n else "") + ",".join([decimal[i] for i in ids])).encode())
                    n += len(ids)
                    yield ids

        for out in model.decode_stream(blocks()):
            of_text.update(out.encode("utf-8"))
        return n, of_ids.hexdigest(), of_text.hexdigest()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = transducer(name)
        decimal = worker_memo(f"bpe.decimal.{name}", lambda: [str(i) for i in range(max(model.bytes_of) + 1)])
        found = [digest(model, decimal, t or "") for t in batch.column(1).to_pylist()]
        n, ids, text = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
