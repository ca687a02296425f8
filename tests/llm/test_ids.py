"""Ids above 2**53 beside null ids, doc_ids with several texts, and added tokens' strings."""

import zlib

import numpy as np

from fairlead.llm import bitplanes, htmltext, jaccard, linededup, quality, toxicity

IDS = [(1 << 60) + 1, (1 << 60) + 3, None]


def together(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_ids_stay_exact_beside_nulls(spark):
    d = together(spark, [(i, f"text of {i} stands here", 5) for i in IDS], "doc_id long, text string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, label int")
    pages = together(spark, [(i, "http://h/", "<p>x</p>") for i in IDS], "page_id long, url string, html string")
    ids = lambda df, name="doc_id": sorted((r[name] for r in df.collect()), key=str)
    want = sorted(IDS, key=str)
    assert ids(bitplanes.token_files(d)) == ids(quality.score_quality(d, none)) == want
    assert ids(toxicity.score_toxicity(d, none)) == ids(linededup.dedup_lines(d)) == want
    joined = jaccard.jaccard_components(d)
    assert ids(joined) == ids(joined, "component_id") == want
    assert ids(htmltext.extract_main_text(pages), "page_id") == want


def test_one_doc_id_with_several_texts(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, words(0, 40)), (1, words(100, 140)), (3, words(100, 141)), (3, words(100, 141)), (4, words(0, 41)), (5, words(100, 140).upper())]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.first) for r in jaccard.jaccard_components(together(spark, rows, "doc_id long, text string"), 4, 85, 100).collect())
    assert got == [(1, 37, 1, True), (1, 37, 1, True), (3, 38, 1, False), (3, 38, 1, False), (4, 38, 1, False), (5, 37, 1, False)]


def test_added_tokens_and_a_long_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "plain words here " * 60_000, "a  b"]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in bitplanes.token_files(together(spark, list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_parsing_is_linear(spark):
    nested = "<div>" * 20_000 + "text" + "</div>" * 20_000
    assert htmltext._cut(nested, "div.a>div") == "text"
    assert len(htmltext._cut('<a href="' * 110_000, None)) == 990_000
    wrapped = '<body><div class="has-sidebar"><form><article><h1>T</h1><p>body text</p></article><div class=sidebar>menu</div></form></div></body>'
    assert htmltext._cut(wrapped, None) == "T\nbody text"
