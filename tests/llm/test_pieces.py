"""The prefix table against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from fairlead.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, ids string, decoded int, n_tokens string"


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_random_texts_and_ids_as_in_the_library():
    model, mine, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PrefixTable(PATH), random.Random(1)
    letters = list("  \n\t▁▁abcdefghijklmnopqrstuvwxyzABC0123456789.,'-<>é²日本ЖяЁ𠮷̀ ﻿\0") + rng.sample(mine.pieces, 2000)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(25)))
        ids = model.encode(text)
        assert mine.encode(text) == raw(ids), text
        assert mine.decode(raw(ids)) == model.decode(ids), text
    odd = [0, 1, 2, 259, 260, 28705]
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(262), rng.randrange(len(mine.pieces)), rng.choice(odd)]) for _ in range(rng.randrange(9))]
        assert mine.decode(raw(ids)) == model.decode(ids), ids


def test_pairs_by_their_merge_histories_as_by_merging():
    mine, rng = pieces.PrefixTable(PATH), random.Random(2)
    plain = [p for p in mine.ids if p not in mine.odd]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(plain)
        assert mine._left_alone(a, b) == (mine.merged(a + b)[0] == [a, b]), (a, b)


def test_documents(spark):
    texts = ["", None, " lead  two\n\nx", "日本𠮷", "ab" * 40_000, "many words " * 9000, "same", "same"]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(None, "no id", "x", 1, "y")]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoded = pieces.encode_documents(spark.createDataFrame(rows, DOCS), PATH, keep=["doc_id"])
    got = {r.doc_id: r for r in pieces.decode_ids(encoded, PATH).collect()}
    for i, text, *_ in rows:
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        assert bytes(got[i].ids) == raw(ids) and got[i].n_tokens == len(ids) and got[i].decoded == model.decode(ids)
    assert pieces.decode_ids(encoded.limit(0), PATH).count() == 0


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = model.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in pieces.op11_piece_codec(spark, sf).collect()} == want
