import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cinelake.llm import bpe
from cinelake.llm.queries import QUERIES, byte_bpe
from tests.llm.tools import SF, crowded, documents, edge_rows

EXACT = Tokenizer.from_file(byte_bpe())
MODEL = bpe.load(byte_bpe())


def ids_of(text):
    return EXACT.encode(text, add_special_tokens=False).ids


def digests(text):
    ids = ids_of(text or "")
    back = EXACT.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_query_against_the_tokenizers_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op9_bpe"](spark, SF).collect()}
    assert got == {i: digests(t) for i, t in rows}


def test_odd_rows(spark):
    rows = [*edge_rows(), (20, "a<|endoftext|>b <|endoftext|>"), (21, "=" * 5000), (22, "ab" * 4000), (23, "'s 'S I'll  \r\n\n x")]
    docs = crowded(documents(spark, rows))
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, byte_bpe()).collect()), key=repr)
    assert got == sorted(((i, *digests(t)) for i, t in rows), key=repr)
    coded = bpe.encode(docs, byte_bpe())
    assert sorted(((r["doc_id"], r["ids"]) for r in coded.collect()), key=repr) == sorted(((i, ids_of(t or "")) for i, t in rows), key=repr)
    back = bpe.decode(coded, byte_bpe())
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    none = documents(spark, [])
    assert bpe.round_trip(none, byte_bpe()).count() == bpe.encode(none, byte_bpe()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert MODEL.encode(text).tolist() == ids_of(text)
    assert MODEL.decode(MODEL.encode(text).tolist()) == EXACT.decode(ids_of(text), skip_special_tokens=False)


def test_every_character_is_split_as_the_library_splits_it():
    model, rng = bpe.load(byte_bpe()), random.Random(0)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for c in points[:0x3000] + rng.sample(points, 6000):
        text = f"a{chr(c)}b {chr(c)}{chr(c)}1 "
        assert model.encode(text).tolist() == ids_of(text), hex(c)


def test_long_pieces_stream_through_the_window():
    rng = random.Random(7)
    for alphabet in ("ab", "abcdefghij", "=-", ["the", "ing", "tion", "é", "漢"], "a"):
        piece = "".join(rng.choice(alphabet) for _ in range(6000))
        assert MODEL.encode_piece(piece.encode()) == [i for p in [piece] for i in _merged(p)]


def _merged(piece):
    """All at once, without a window."""
    return MODEL._merge_long([MODEL.first[b] for b in piece.encode()])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=25), st.lists(st.integers(0, 3), min_size=60, max_size=200))
def test_lookahead_of_any_merge_list_is_sufficient(picks, letters):
    vocab, merges = {c: i for i, c in enumerate(bpe.byte_alphabet())}, []
    tokens = ["a", "b", "c", "d"]
    for i, j in picks:
        left, right = tokens[i % len(tokens)], tokens[j % len(tokens)]
        if left + right not in vocab and len(left + right) <= 8:
            vocab[left + right] = len(vocab)
            merges.append((left, right))
            tokens.append(left + right)
    model = bpe.Transducer(vocab, merges, direct=1)
    model.window = 2 * model.lookahead
    text = "".join("abcd"[x] for x in letters)
    assert model.encode_piece(text.encode()) == model._merge_long([model.first[b] for b in text.encode()]) == model._merge_short([model.first[b] for b in text.encode()])


def test_decoder_of_broken_sequences():
    one = [MODEL.first[b] for b in "é漢\U0001f600".encode()]
    for ids in (one, one[:-1], one[1:], one[:1], [one[0], one[2]], [*one[2:4], 50256, 999999]):
        known = [i for i in ids if i in MODEL.bytes_of]
        assert MODEL.decode(ids) == EXACT.decode(known, skip_special_tokens=False)
        assert "".join(MODEL.decode_stream([[i] for i in ids])) == MODEL.decode(ids)


def test_table_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 50)
    model = bpe.load(byte_bpe())
    texts = [" ".join(f"w{i * 7 + j}" for j in range(30)) for i in range(40)]
    assert [model.encode(t).tolist() for t in texts] == [ids_of(t) for t in texts]
    assert len(model.index) <= 50 + 100
