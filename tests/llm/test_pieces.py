import hashlib

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from memlake.llm import pieces
from memlake.llm.model_queries import op11_piece_ids, piece_model

MODEL = piece_model()


def variant(**changes) -> bytes:
    """The model with other text rules."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    for name, value in changes.items():
        spec = proto.normalizer_spec if hasattr(proto.normalizer_spec, name) else proto.trainer_spec
        setattr(spec, name, value)
    if changes.get("byte_fallback") is False:
        kept = [p for p in proto.pieces if p.type != proto.SentencePiece.BYTE]
        del proto.pieces[:]
        proto.pieces.extend(kept)
    return proto.SerializeToString()


MODELS = {
    "plain": variant(), "squeezed": variant(remove_extra_whitespaces=True), "bare": variant(add_dummy_prefix=False),
    "unknown": variant(byte_fallback=False),
}
SYMBOLS = st.sampled_from(list("aehinst  .,\n\t0▁") + ["the", " in", "ß", "日本", "\U0001f600", "\x00", "é", "  "])


@pytest.mark.parametrize("kind", MODELS)
@settings(max_examples=150, deadline=None)
@given(words=st.lists(SYMBOLS, max_size=60) | st.text(max_size=40).map(list))
@example(words=[])
@example(words=[" "])
@example(words=["   "])
def test_same_as_the_library(kind, words):
    text = "".join(words).encode("utf-8", "ignore").decode()
    known = pieces.vocabulary(MODELS[kind])
    library = SentencePieceProcessor(model_proto=MODELS[kind])
    ids = library.encode(text, add_eos=True)
    assert known.encode(text, eos=True).tolist() == ids
    assert known.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.integers(0, 400) | st.integers(0, 31_999), max_size=20))
@example(ids=[0xE3 + 3, 0x81 + 3, 300])
@example(ids=[29871, 29871, 2, 29871])
def test_any_ids_decode_as_in_the_library(ids):
    assert pieces.vocabulary(MODELS["plain"]).decode(ids) == SentencePieceProcessor(model_file=MODEL).decode(ids)


@pytest.mark.parametrize("few", [0, 1000])
def test_agenda_takes_the_best_pair_and_the_leftmost_of_equals(monkeypatch, few):
    known = pieces.vocabulary(MODELS["plain"])
    monkeypatch.setattr(pieces, "FEW", few)
    for word in ("▁thethe", "aaaaa", "▁▁▁▁▁▁▁", "▁internationalisation", "▁" + "abracadabra" * 5):
        symbols = list(word)
        while True:
            pairs = [(known.order[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in known.order]
            if not pairs:
                break
            i = min(pairs)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        assert known.merged(word) == symbols


def test_long_texts_and_forgotten_words(rng, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 500)
    monkeypatch.setattr(pieces, "REMEMBERED", 300)
    monkeypatch.setattr(pieces, "FRESH", 2)
    known, library = pieces.Vocabulary(MODELS["plain"]), SentencePieceProcessor(model_file=MODEL)
    for text in (
        " ".join("".join(rng.choices("abcdeäß", k=rng.randint(1, 9))) for _ in range(3000)),
        "x" * 100_000, " " * 3001, ("a" * 499 + "  ") * 20,
    ):
        assert known.encode(text).tolist() == library.encode(text)
        known.check()


@pytest.mark.parametrize("kind", MODELS)
def test_check_finds_a_wrong_word(kind):
    known = pieces.Vocabulary(MODELS[kind])
    known.encode("so the  house stands\nthere ")
    known.check()
    assert not known.known.fresh
    for text in ("all well", "x.well", "y1", "z \n."):
        known.encode(text)
        word = known.known.fresh[-1]
        right, known.known[word] = known.known[word], b"\x05\0\0\0"
        with pytest.raises(RuntimeError):
            known.check()
        known.known[word] = right


def test_models_that_need_other_rules_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary(variant(model_type=1))
    with pytest.raises(ValueError):
        pieces.Vocabulary(variant(precompiled_charsmap=b"x"))


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("pieces", F.lit("clash"))
    rows = pieces.encode(docs, MODEL, eos=True, back=True).collect()
    library = SentencePieceProcessor(model_file=MODEL)
    assert len(rows) == docs.count()
    for row in rows:
        assert list(row["pieces"]["ids"]) == library.encode(row["text"] or "", add_eos=True)
        assert row["pieces"]["decoded"] == (row["text"] or "")
    assert pieces.encode(no_docs, MODEL).count() == 0
    back = pieces.encode(odd_docs, MODEL, check="texts")
    back = back.select("text", pieces.decode(F.col("pieces")["ids"], MODEL).alias("b"), F.col("pieces")["decoded"].alias("c"))
    assert all(r["b"] == (r["text"] or "") and r["c"] is None for r in back.collect())
    lists = spark.createDataFrame([([1, None, 99_999, 306],), (None,), ([],)], "ids array<int>")
    assert {r["t"] for r in lists.select(pieces.decode(F.col("ids"), MODEL).alias("t")).collect()} == {
        library.decode([306]), None, ""}


def test_query(spark, sf_dir):
    library = SentencePieceProcessor(model_file=MODEL)
    found = {r["doc_id"]: r for r in op11_piece_ids(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc in docs:
        ids = library.encode(doc["text"] or "", add_eos=True)
        row = found[doc["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert row["decoded_sha256"] == sha(library.decode(ids))
