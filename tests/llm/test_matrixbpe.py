import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cinelake.llm import matrixbpe
from cinelake.llm.queries import QUERIES
from tests.llm.tools import SF, crowded, documents, edge_rows

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = matrixbpe.read_ranks(PATH)
MODEL = matrixbpe.Encoder(RANKS, PATTERN)
EXACT = tiktoken.Encoding("exact", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def digests(text):
    ids = EXACT.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(EXACT.decode_bytes(ids)).hexdigest()


def plain_bpe(piece, ranks):
    """One merge at a time: the leftmost pair of the lowest rank."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_query_against_the_tiktoken_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op11_matrix_bpe"](spark, SF).collect()}
    assert got == {i: digests(t) for i, t in rows}


def test_odd_rows(spark):
    rows = [*edge_rows(), (20, "<|endoftext|>"), (21, "=" * 5000), (22, "ab" * 4000), (23, "'s 'S I'll  \r\n\n x"), (24, "　x 　\x85 \x1c1²½")]
    rows += [(99, f"hot row {i}") for i in range(60)]
    docs = crowded(documents(spark, rows))
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in matrixbpe.round_trip(docs, PATH, PATTERN).collect()), key=repr)
    assert got == sorted(((i, *digests(t)) for i, t in rows), key=repr)
    coded = matrixbpe.encode(docs, PATH, PATTERN)
    assert sorted(((r["doc_id"], r["ids"]) for r in coded.collect()), key=repr) == sorted(((i, EXACT.encode_ordinary(t or "")) for i, t in rows), key=repr)
    back = matrixbpe.decode(coded, PATH, PATTERN).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert all(bytes(r["data"]).decode() == r["text"] for r in back)
    none = documents(spark, [])
    assert matrixbpe.round_trip(none, PATH, PATTERN).count() == matrixbpe.encode(none, PATH, PATTERN).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [300, None, 10**9, 65]), (3, [])], "doc_id long, ids array<long>")
    assert {r["doc_id"]: bytes(r["data"]) for r in matrixbpe.decode(odd, PATH, PATTERN).collect()} == {1: b"", 2: MODEL.bytes_of[300] + MODEL.bytes_of[65], 3: b""}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert MODEL.encode([text]) == [EXACT.encode_ordinary(text)]
    assert MODEL.decode(MODEL.encode([text])[0]) == text.encode()


def test_every_character_is_split_as_the_library_splits_it():
    rng = random.Random(0)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)}" for c in points[:0x3100] + rng.sample(points, 6000)]
    assert MODEL.encode(texts) == [EXACT.encode_ordinary(t) for t in texts]


def test_long_pieces():
    rng = random.Random(7)
    for alphabet in ("ab", "abcdefghij", "=-", ["the", "ing", "tion", "é", "漢"], "a", "abcdefghijklmnopqrstuvwxyz"):
        for n in (900, 1100, 7000):
            piece = "".join(rng.choice(alphabet) for _ in range(n)).encode()
            assert MODEL.merge([piece])[0].tolist() == EXACT._encode_single_piece(piece)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=6), max_size=25), st.randoms(), st.lists(st.text("abc", min_size=1, max_size=60), min_size=1, max_size=8))
def test_any_rank_list(tokens, rng, texts):
    """Ranks in any order, so that a merge can make a pair of a lower rank; narrow matrices and wide rows alike."""
    more = list(dict.fromkeys(t.encode() for t in tokens))
    rng.shuffle(more)
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(more)}
    pieces = [t.encode() for t in texts]
    want = [plain_bpe(p, ranks) for p in pieces]
    for widths in ((2, 4, 64), (1,)):
        model = matrixbpe.Encoder(ranks, PATTERN, widths)
        assert [x.tolist() for x in model.merge(pieces)] == want


def test_table_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(matrixbpe, "TABLE", 50)
    monkeypatch.setattr(matrixbpe, "TAKE", 40)
    model = matrixbpe.Encoder(RANKS, PATTERN)
    texts = [" ".join(f"w{i * 7 + j}" for j in range(30)) for i in range(40)]
    assert model.encode(texts) == [EXACT.encode_ordinary(t) for t in texts]
    assert len(model.index) <= 50 + 40


@pytest.mark.parametrize("size", [0, 1, 5, 3000])
def test_pair_table(size):
    rng = random.Random(size)
    pairs = {(rng.randrange(99), rng.randrange(10**6)): rng.randrange(10**6) for _ in range(size)}
    table = matrixbpe.PairTable(*matrixbpe.np.array([(a, b, r) for (a, b), r in pairs.items()], matrixbpe.np.int64).reshape(-1, 3).T)
    asked = [*pairs, *((rng.randrange(99), rng.randrange(10**6)) for _ in range(500)), (-1, 5), (5, -1)]
    got = table.get(*matrixbpe.np.array(asked, matrixbpe.np.int64).T).tolist()
    assert got == [pairs.get(p, matrixbpe.NONE) for p in asked]
