import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    r = random.Random(3)
    signs, parts = "abcdeéthion  \n.,ing▁AB01\x00", ["the", "ing", "tion", " ", "er", "a", "an", "in", "ation", "s", "ss", "l", "ll", ".", "..", "🙂"]
    out = ["", "  ", " a", "Hello  world\n\tfoo ▁bar 　é é \x00 x", "a" * 200, "<s> </s> <unk> <0x41>", "日本語 한글 🙂🙂", " " * 40 + "y", "1234567 === ---- ####"]
    out += ["".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    return out + ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(1500)]


def test_ids_are_the_librarys_and_decode_to_the_text(library):
    own = pieces.Pieces(PATH)
    own.REMEMBERED = 50
    for text, data in zip(texts(), own.encode(texts()), strict=True):
        ids = np.frombuffer(data, "<u4").astype(int)
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == text.replace("▁", " ")


def test_whole_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library.encode(r.text or "") for r in docs.collect()}
    encoded = pieces.encode(docs, PATH)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == want
    assert {r.doc_id: r.text for r in pieces.decode(encoded, PATH).collect()} == {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: (r.n_ids, r.round_trip) for r in pieces.digests(docs, PATH).collect()} == {i: (len(x), True) for i, x in want.items()}


def test_edge_cases(spark, edge_docs, library):
    docs = edge_docs([None, "", "same", "same", "w" * 5000, "x y" * 3000])
    rows = pieces.encode(docs.union(docs), PATH).collect()
    assert len(rows) == 12
    assert all(list(r.ids) == library.encode({0: "", 1: "", 4: "w" * 5000, 5: "x y" * 3000}.get(r.doc_id, "same")) for r in rows)
    assert pieces.encode(docs.limit(0), PATH).count() == 0 and pieces.decode(rows and pieces.encode(docs, PATH).limit(0), PATH).count() == 0
