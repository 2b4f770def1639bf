import random
import string
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.word_ids import WordIds, encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer):
    odd = [
        "", " \n", "don't stop's I'LL", "x\x1fy a\x85b 　c　d", "É́ ñ n̊ ǅ İstanbul ΑΣ ὈΔΥΣΣΕΎΣ", "<|endoftext|> <|startoftext|>", "\x00 \x1c\x1dq",
        "a.b c,, d. e, 12.5 3rd, ...", " x​y 한글 日本語。 🙂 á ́a", "ß. Straße, ŉ ﬁ. ª º x²,", "'s 's's ''s \"'s it'sx a'b 'll'", "ǅ. İ. ſ, K",
    ]
    r = random.Random(1)
    signs = "aBé'st.,1² \n ́ſK-_ñ"
    odd += ["".join(r.choice(signs) for _ in range(r.randint(1, 30))) for _ in range(2000)]
    for remembered in (3, 100_000):
        ids, ends = WordIds(PATH, remembered).encode(pa.array([*odd, None]))
        for text, a, b in zip(odd, ends, ends[1:]):
            assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_marks_in_a_text_are_one_id(tokenizer):
    texts = ["a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>. x<|endoftext|", "<|endoftext|><|endoftext|>\n<|endoftext|>,", "Straße<|endoftext|>"]
    ids, ends = WordIds(PATH).encode(pa.array(texts))
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert 49407 in want[0] and want[1].count(49407) == 3 and 49406 in want[0]


def test_letters_are_encoded_once_whatever_case_and_signs(tokenizer):
    texts = ["Été! été, ÉTÉ... tea### TEA$$$ Tea", "tea, (tea) ΤΕΑ. tea's !? ÿ×", None]
    known = WordIds(PATH)
    ids, ends = known.encode(pa.array(texts))
    for text, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
    assert set(known.ids) == {"été", "tea", "ÿ×", "!", ",", "...", "###", "$$$", "", "(tea)", "ΤΕΑ", ".", "ΤΕΑ.", "tea's", "!?"}


def test_every_letter_and_sign_up_to_two_bytes(tokenizer):
    letters = [chr(i) for i in range(0x21, 0x800) if i not in range(0x7F, 0xA1)]
    texts = [f"{x} a{x} {x}a a{x}b a{x}! {x}. {x}'" for x in letters]
    texts += ["!" + x + y for x in string.punctuation for y in "aÀ1"] + ["Àb" + x + y for x in string.punctuation for y in string.punctuation]
    ids, ends = WordIds(PATH).encode(pa.array(texts))
    for text, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_worker_forgets_a_tasks_words_but_not_the_tokenizer(tokenizer):
    texts = [" ".join(f"wörd{i}" for i in range(3000)), None, "one more"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])
    known = WordIds(PATH)
    for task in range(2):
        made = packing._cut(iter([batch, batch]), known, task, 64, False)
        first = next(made)
        assert known.ids  # met in this task
        rows = [first, *made]
        assert known.ids == {}
        want = [len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1 for text in texts]
        lengths = pa.Table.from_batches(rows).group_by("doc_id").aggregate([("length", "sum")]).sort_by("doc_id")
        assert lengths["length_sum"].to_pylist() == [2 * n for n in want]
    assert encoder(PATH) is encoder(PATH)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_uses_each_piece_once(counts):
    plan = packing.fill_windows(counts, 64)
    used = {}
    for times, window in plan:
        assert sum(length * n for length, n in window.items()) <= 64
        for length, n in window.items():
            used[length] = used.get(length, 0) + times * n
    assert used == counts


def test_first_window_is_as_full_as_can_be():
    r = random.Random(2)
    for _ in range(30):
        counts = {r.randint(1, 40): r.randint(1, 3) for _ in range(5)}
        room = 60 - max(counts)
        rest = [x for x, n in counts.items() for _ in range(n)]
        rest.remove(max(counts))
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums if s + x <= room}
        _, window = packing.fill_windows(counts, 60)[0]
        assert sum(x * n for x, n in window.items()) == max(counts) + max(sums)


def check(docs, tokenizer, packed, capacity):
    rows = packed.collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1])
        for r in parts:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in parts) == len(ids)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1])
        assert sum(r.length for r in parts) <= capacity
    total = sum(r.length for r in rows)
    return total / (capacity * len(by_sequence))


def test_whole_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    assert check(docs, tokenizer, packing.pack(docs, PATH), 2048) > 0.98


def test_edge_cases_and_sequences(spark, tokenizer, edge_docs):
    docs = edge_docs([None, "", "a", "word " * 70, "same text here", "same text here"])
    packed = packing.pack(docs, PATH, capacity=16, with_ids=True)
    check(docs, tokenizer, packed, 16)
    put = packing.sequences(packed, 16)
    tokens = {r.sequence_id: r.tokens for r in put.collect()}
    assert all(len(r.ids) in (16, r.tokens) and (len(r.ids) == 16 or r.tokens & (r.tokens - 1) == 0) for r in put.collect())
    assert sum(tokens.values()) == packed.agg(F.sum("length")).first()[0]
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = packing.pack(docs.union(docs).withColumn("doc_id", F.lit(None).cast("long")), PATH)
    assert twice.where("doc_id is null").count() == 12
