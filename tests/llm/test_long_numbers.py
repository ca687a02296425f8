"""Permutations of digit strings beyond what a double holds."""

from pyspark.sql import functions as F

from fairlead.llm import pseudonyms


def test_eighteen_digits_are_permuted(spark):
    low = 10**9
    numbers = [f"{a * low + b:018d}" for a in (0, 1, low - 2, low - 1) for b in (0, 1, 2, low - 2, low - 1)]
    d = spark.createDataFrame([(n,) for n in numbers], "n string")
    got = [r.p for r in d.select(pseudonyms.permute_digits(F.col("n"), "k", "t").alias("p")).collect()]
    assert len(set(got)) == len(numbers) and all(len(p) == 18 and p.isdigit() for p in got)


def test_cards_after_and_between_dots_and_dashes(spark):
    texts = ["card no.4111111111111111", "card:-4111111111111111", "visa 4111.1111.1111.1111 ok", "(4111-1111-1111-1111)", "3.4111111111111111", "12.5 13.7 14.2 15.1 16.3 17.9 18.2", "+4111111111111111", "10.1.2.3 and 4111.1111.1111.1112"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(rows).collect()}
    digits = lambda x: "".join(c for c in x if c.isdigit())
    fresh = {digits(v["pseudonym"]) for i in range(4) for v in got[i].found}
    assert len(fresh) == 1 and "4111111111111111" not in fresh  # one card, however it is written
    shape = lambda x: "".join("9" if c.isdigit() else c for c in x)
    assert all(shape(got[i].text) == shape(texts[i]) for i in range(4))
    assert got[4].text == texts[4] and got[5].text == texts[5]
    assert [v["kind"] for v in got[7].found] == ["ip"] and got[7].text.endswith("4111.1111.1111.1112")
