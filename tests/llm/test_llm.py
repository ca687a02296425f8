"""Operators for training corpora against brute force, on small tables and on the smallest driver tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.llm import bitplanes, components, decontamination, htmltext, jaccard, linededup, mixing, pseudonyms, quality, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, extra string"
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def docs(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id here", "x")]
    return spark.createDataFrame(rows, DOCS)


def word(i):
    return "w" + "".join(chr(97 + int(c)) for c in str(i))


# --- 1 -----------------------------------------------------------------------------------------------------------------
def top_brute(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None]
    out = {}
    for q, v in ok:
        if q % 50 == 0:
            best = sorted({(-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q})[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def test_topk_on_ties_nulls_and_few_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(500, None), (550, [float("nan")] * 4), (600, [1.0, None, 1.0, 1.0]), (None, [1.0] * 4), (650, [0.0] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", topk.quantised())
    got = defaultdict(list)
    for r in topk.PivotIndex(d, 5, pivots=6, annuli=4).top_k(d.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert dict(got) == top_brute(fine, 5)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>").withColumn("v", topk.quantised())
    assert [tuple(r) for r in topk.PivotIndex(few, 5).top_k(few.where("vec_id = 0")).collect()] == [(0, 1, 1, 4 * 65536)]
    assert topk.PivotIndex(few.limit(0), 5).top_k(few).count() == 0


# --- 2 -----------------------------------------------------------------------------------------------------------------
def test_extraction(spark):
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home page</a></nav><div class="wrap"><div class="post-body"><h1>A &amp; B</h1><p>One   two<br>three</p><div class="ad-slot">buy</div><p>four <b>five</b></div><div id="comments"><p>first reader says a lot of things here</p></div></div><footer>end</footer></body></html>'
    d = spark.createDataFrame([(1, "http://h/a", page), (2, None, None), (3, "http://h/b", ""), (4, "x", "<p>open <i>text"), (5, "http://h/c", page.replace("One", "Uno"))], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract_main_text(d).collect()}
    assert got[1][0] == "A & B\nOne two three\nfour five" and got[5][0] == "A & B\nUno two three\nfour five"
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[4] == ("open text", 9)
    assert htmltext.extract_main_text(d.limit(0)).count() == 0


def test_extraction_votes_by_host(spark):
    usual = "<body><div class='main{}'>" + "<p>the article says something of note here</p>" * 6 + "</div><div class='list'>{}</div></body>"
    odd = usual.format(7, "<p>some other long list of words that outweighs it all</p>" * 9)
    rows = [(i, "http://h/", usual.format(i, "")) for i in range(5)] + [(9, "http://h/", odd)]
    got = {r.page_id: r.text for r in htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == got[0]  # alone, the page's heaviest container would be the list


# --- 3 -----------------------------------------------------------------------------------------------------------------
def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["", None, "Hello  world", " lead 'tis\n\n x", "año 日本 a²b\tc", "one two " * 3000, "don't can't\r\n"]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = docs(spark, texts)
    path = f"{bitplanes.work_folder(spark)}/test-tokens"
    for mode in ("bit", "byte"):
        bitplanes.write_token_files(d, path + mode, public_tokenizers.path("byte_bpe_50k.json"), block_ids=64, mode=mode)
        start, want = 0, []
        for i, t in [(None, "no id here"), *enumerate(texts)]:
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, bitplanes.read_documents(spark, path + mode).collect()), key=str) == sorted(want, key=str)
        assert bitplanes.chunk_index(spark, path + mode).agg(F.sum("n_ids")).first()[0] == start
        assert bitplanes.read_ids(spark, path + mode).agg(F.sum(F.size("ids"))).first()[0] == start
    assert bitplanes.token_files(d.limit(0)).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (7, 2), (1000, 50257), (5, 1 << 31), (3, 0)):
        ids = rng.integers(0, top + 1, n).astype(np.uint32)
        for mode in ("bit", "byte"):
            assert (bitplanes.restore_ids(n, mode, *bitplanes.shuffle_planes(ids, mode)) == ids).all()


# --- 4 and 7 -----------------------------------------------------------------------------------------------------------
def test_quality_separates_held_out_labels(spark):
    r = quality.op4_quality_votes(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    m = r.agg(F.count("*"), F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.avg(F.when(F.col("held_out"), (F.col("predicted") == F.col("quality")).cast("double")))).first()
    assert m[0] == 399 and m[1] > 0.95 and m[2] > 0.93


def test_quality_cases(spark):
    d = docs(spark, ["", None, "plain words here.", "A!! B!! C!!"])
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.score_quality(d, none).collect()} == {0.5}
    some = spark.createDataFrame([(2, 1), (3, 0), (99, 1)], "doc_id long, label int")
    out = quality.score_quality(d, some)
    assert out.columns == ["doc_id", "text", "extra", "score"] and out.count() == 5
    got = {r.doc_id: r.score for r in out.collect()}
    assert got[0] == got[1] == 0.5 and got[2] > 0.5 > got[3]
    assert quality.score_quality(d.limit(0), some).count() == 0


def test_toxicity(spark):
    bad = [f"Fine words here. You are a zorg{x} friend. Bye." for x in ("ling", "ish", "ful", "ous", "ity", "ness")]
    good = ["Fine words here. You are a friend. Bye.", "Other words stand there. Nothing else."] * 6
    d = docs(spark, [*bad, *good, "Calm start. Then zorglest things!", "", None, "Über İstanbul. zorgling"])
    labels = spark.createDataFrame([(i, 1) for i in range(6)] + [(i, 0) for i in range(6, 18)], "doc_id long, label int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, labels).collect()}
    assert all(got[i].score > 0.7 for i in range(6)) and all(got[i].score < 0.3 for i in range(6, 18))
    assert got[18].score > 0.5 and got[19].score == got[20].score == 0 and got[19].n_sentences == 0
    spot = got[0].offending[0]
    assert bad[0][spot["first"] : spot["past"]].strip() == "You are a zorgling friend"
    assert {r.score for r in toxicity.score_toxicity(d, labels.where("label = 0")).collect()} == {0.0}


# --- 5 -----------------------------------------------------------------------------------------------------------------
def test_raking_meets_its_margins():
    rng = np.random.default_rng(5)
    codes = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    mass = rng.integers(1, 100, len(codes)).astype(float)
    targets = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25]), np.array([0.7, np.nan])]
    x = mixing.rake(mass, codes, targets)
    for code, t in zip(codes.T, targets[:2]):
        assert np.allclose(np.bincount(code, x) / mass.sum(), t, atol=1e-6)
    own = mass[codes[:, 2] == 1].sum() / mass.sum()
    assert np.isclose(x[codes[:, 2] == 1].sum() / mass.sum(), own, atol=1e-6)
    f = mixing.calibrate(mass, x / mass, 0.5)
    assert np.isclose((mass * np.minimum(1, f * x / mass)).sum(), 0.5 * mass.sum())


def test_mixing_cases(spark):
    rows = [(i, "a b c " * (i % 5 + 1), ["en", "de", None][i % 3], f"s{i % 2}", "t") for i in range(300)] + [(None, None, "en", "s0", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    out = mixing.mix(d, {"source": {"s0": 0.8, "s1": 0.2, "s9": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"t": 1.0}}, 0.4)
    assert out.count() == 301
    m = out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("mix_weight")).alias("m")).collect()
    total = sum(r.m for r in m)
    assert {r.source: round(r.m / total, 4) for r in m} == {"s0": 0.8, "s1": 0.2}
    again = mixing.mix(d, {"source": {"s0": 0.8, "s1": 0.2, "s9": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"t": 1.0}}, 0.4)
    assert sorted(r.doc_id for r in out.where("mix_kept and doc_id is not null").collect()) == sorted(r.doc_id for r in again.where("mix_kept and doc_id is not null").collect())
    assert mixing.mix(d.limit(0)).count() == 0


# --- 6 -----------------------------------------------------------------------------------------------------------------
def luhn(x):
    ds = [int(c) for c in x if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 // 10 + d * 2 % 10 for i, d in enumerate(ds)) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    t = "call +1 (743) 555-3824, +1 743-555-3824; card 4111 1111 1111 1111 bad 4111111111111112; ip 227.5.221.1; 2024-02-29 31.04.2024 29/02/2024; 123-45-6789 000-12-3456; Ab.c9@mail9.example.com"
    d = docs(spark, [t, None, "", "none", "x" * 50_000 + " 227.5.221.1"])
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(d).collect()}
    assert got[1].text is None and got[2].text == "" and got[3].text == "none" and len(got[4].text) >= 50_007
    new = got[0].text
    assert re.sub(r"\d", "9", new).startswith("call +9 (999) 999-9999, +9 999-999-9999; card 9999 9999 9999 9999 bad 9999999999999999; ip")
    assert "4111111111111112" in new and "31.04.2024" in new and "000-12-3456" in new and "@mail9.example.com" in new
    f = {v["value"]: v["pseudonym"] for v in got[0].found}
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(f["+1 (743) 555-3824"]) == digits(f["+1 743-555-3824"]) and luhn(f["4111 1111 1111 1111"]) and len(f) == 8
    iso, other = f["2024-02-29"], f["29/02/2024"]
    assert iso == f"{other[6:]}-{other[3:5]}-{other[:2]}"
    assert got[4].found[0]["pseudonym"] == f["227.5.221.1"] != "227.5.221.1"


def test_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [
        f"pay {card} now", f"{card} 123", "4111111111111111 12/27", "2 4111111111111111", f"12345 67890 {card} 12 27", f"{card} 5500-0000-0000-0004", f"{card} 123-45-6789", f"{card} 2024-02-29", f"{card} 10.1.2.3", f"{card} 12@mail.example.com", f"7 8 {card} 29/02/2024 9",
        "bad 4111111111111112 4111111111111113", "order 1234567 1234567 12", f"{card}- thanks", "1 2 3 4 5 6 7 8 9 10 11 12 13 " * 40,
    ]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs(spark, texts)).collect()}
    digits = lambda x: re.sub(r"\D", "", x)
    new = got[0].found[0]["pseudonym"]
    assert new != card and luhn(new)
    for i in range(14):
        assert i == 8 or re.sub(r"[0-9a-z]", "9", got[i].text) == re.sub(r"[0-9a-z]", "9", texts[i])
        if card in texts[i] or digits(card) in texts[i]:
            assert digits(card) not in digits(got[i].text) and digits(new) in digits(got[i].text), texts[i]
            assert digits(new) in [digits(v["pseudonym"]) for v in got[i].found if v["kind"] == "card"]
    kinds = lambda i: [v["kind"] for v in got[i].found]
    assert got[1].text == f"{new} 123" and got[2].text.endswith(" 12/27") and got[3].text.startswith("2 ") and got[4].text.startswith("12345 67890 ") and got[4].text.endswith(" 12 27")
    assert kinds(5) == ["card", "card"] and kinds(6) == ["card", "ssn"] and kinds(7) == kinds(10) == ["card", "date"] and kinds(8) == ["card", "ip"] and kinds(9) == ["card", "email"]
    assert got[11].text == texts[11] and kinds(11) == []


def test_feistel_is_a_permutation(spark):
    d = spark.range(1000).select(pseudonyms.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"), pseudonyms.date_pseudonym(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"), "k").alias("d"))
    assert d.select("p").distinct().count() == 1000 and d.select("d").distinct().count() == 1000


# --- 8 -----------------------------------------------------------------------------------------------------------------
def test_line_chunks(spark):
    shared = "\n".join(f"this is the shared line number {i} of the notice" for i in range(40))
    own = ["\n".join(f"own line {word(j)} of {i} stands here alone" for j in range(30)) for i in range(4)]
    texts = [own[0] + "\n" + shared, "intro\n" + shared + "\n" + own[1], own[2], "", None, own[3] + "\n" + own[3]]
    out = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[2].text == texts[2] and out[3].text == "" and out[4].text == ""
    assert own[1][100:900] in out[1].text and out[1].text.count("shared line") <= 12 and out[1].chars_removed > 0.6 * len(shared)
    assert out[5].n_removed > 0 and out[5].text.startswith(own[3][:500])
    assert len(out) == 7
    assert linededup.dedup_lines(docs(spark, texts).limit(0)).count() == 0


def runs_left(texts, out, least=20):
    """Lines of later occurrences of repeated runs of two lines that came out, by brute force over all pairs of lines."""
    first, later = {}, defaultdict(set)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        for j, pair in enumerate(zip(lines, lines[1:])):
            seen = first.setdefault(pair, (i, j))
            if seen != (i, j) and not (seen[0] == i and j <= seen[1] + 1) and len("\n".join(pair).encode()) >= least and all(x.strip() for x in pair):
                later[i] |= {j, j + 1}
    want = {i: "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in later[i]) for i, t in enumerate(texts)}
    return {i for i in want if want[i] != out[i].text}


def test_line_chunks_remove_every_run_of_lines(spark):
    own = iter(f"own line {word(j)} stands here alone" for j in range(10_000))
    notices = {n: [f"notice of {n} lines, its line {word(k)} of many words" for k in range(n)] for n in range(2, 9)}
    alone = "a line that is repeated on its own"
    texts = ["\n".join(x for n, run in notices.items() for x in [next(own), *run, next(own)])]
    texts += ["\n".join([*[next(own) for _ in range(lead)], *run, *[next(own) for _ in range(tail)], alone, next(own)]) for run in notices.values() for lead, tail in ((0, 1), (1, 0), (3, 2), (5, 5))]
    texts += ["\n".join([next(own), *["the same line again and again"] * 9, next(own)]), "\n".join([next(own), *["the same line again and again"] * 5])]
    out = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert runs_left(texts, out) == set()
    assert out[0].text == texts[0] and "notice" not in "".join(out[i].text for i in range(1, len(texts)))
    assert sum(alone in out[i].text for i in range(len(texts))) == 28 and out[29].text.count("the same") == 2 and "the same" not in out[30].text


def test_line_chunks_of_short_and_blank_lines(spark):
    short = "\n".join(["ab cd", "ef", "a rather long line of the run", "x", "y"])
    spaced = "first part of the notice\n\n \nsecond part of the notice"
    texts = [f"one\n{short}\ntwo\n{spaced}", f"three\n{short}\nfour", f"five\n\n{spaced}\n\nsix", "seven\nq\nr", "eight\nq\nr", "nine\n\nfirst part of the notice\n\nten"]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert out[0] == texts[0] and out[1] == "three\nfour" and out[2] == "five\n\n\nsix" and [out[i] for i in (3, 4, 5)] == texts[3:]


# --- 9 -----------------------------------------------------------------------------------------------------------------
def components_brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, n, num):
    rng = np.random.default_rng(n)
    base = [[word(x) for x in rng.integers(0, 400, 120)] for _ in range(4)]
    texts = []
    for b in base:
        for edits in (0, 0, 1, 2, 3, 4, 5, 6, 8):
            t = list(b)
            for at in rng.integers(0, len(t), edits):
                t[at] = word(rng.integers(1000, 9999))
            texts.append(" ".join(t))
    chain = base[0]
    for _ in range(6):  # each near the one before, the ends far apart
        chain = chain[4:] + [word(x) for x in rng.integers(400, 800, 4)]
        texts.append(" ".join(chain))
    texts += ["", None, "two words", "Two  WORDS", "a b c d", "x " * 500, "x " * 700]
    want = components_brute(list(enumerate(texts)), n, num, 100)
    out = jaccard.jaccard_components(docs(spark, texts), n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
    assert [r.component_id for r in out if r.doc_id is None] == [None]


def test_jaccard_on_empty_and_repeated_rows(spark):
    d = docs(spark, ["a b c d e f"])
    assert jaccard.jaccard_components(d.limit(0)).count() == 0
    twice = d.unionByName(d)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.jaccard_components(twice).collect()) == [("0", "0")] * 2 + [("None", "None")] * 2


def test_components(spark):
    links = spark.createDataFrame([(9, 5), (5, 7), (1, 2), (3, 3), (2, 8), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in components.smallest_reachable(links).collect()} == {5: 5, 7: 5, 9: 5, 1: 1, 2: 1, 8: 1}
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components.smallest_reachable(path).collect()} == {0}


# --- 10 ----------------------------------------------------------------------------------------------------------------
def test_decontamination(spark, monkeypatch):
    long = " ".join(word(i) for i in range(30))
    items = spark.createDataFrame([(1, long), (2, "Short item, Here!"), (3, None), (4, "..."), (None, "x y"), (5, "the the the"), (10, long)], "item_id long, text string")
    texts = ["so " + long.upper() + " end", long[40:130], "short ITEM here and " + "pad " * 60, "short item", "the the the the", "", None, "Ünï " + " ".join(word(i) for i in range(9, 22))]
    out = {r.doc_id: r for r in decontamination.hits(docs(spark, texts), items).collect()}
    win = defaultdict(set)
    for i, t in ((1, long), (2, "Short item, Here!"), (5, "the the the"), (10, long)):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
        for k in range(max(1, len(w) - 12)):
            win[tuple(w[k : k + 13])].add(i)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        hit, found = set(), set()
        for p, ids in win.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        r = out[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)), i
    assert out[None].n_hit == 0 and len(out) == 9
    shared = [(5, "short item, here", "x"), (5, "clean", "x"), (None, "short ITEM here", "x"), (None, "clean", "x"), (None, "short ITEM here", "x"), (7, "clean", "x")]
    judged = decontamination.hits(spark.createDataFrame(shared, DOCS), items)
    assert sorted(((r.doc_id, r.n_hit, r.contaminated) for r in judged.collect()), key=str) == sorted([(5, 3, True), (5, 0, False), (None, 3, True), (None, 3, True), (None, 0, False), (7, 0, False)], key=str)
    clash = spark.createDataFrame(shared, DOCS).withColumns({"key": F.lit("k"), "words": F.lit(1), "n_hit": F.lit("n"), "document_key": F.lit(0)})
    assert clash.count() == 6 and decontamination.hits(clash, items).where("contaminated").count() == 3
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)  # the same by shuffle joins
    assert {r.doc_id: r for r in decontamination.hits(docs(spark, texts), items).collect()} == out
    monkeypatch.undo()
    assert decontamination.hits(docs(spark, texts).limit(0), items).count() == 0
    assert decontamination.hits(docs(spark, texts), items.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = decontamination.PositionalIndex(docs(spark, ["alpha beta gamma", "alpha x beta gamma", "gamma alpha"]), items)
    assert index.phrase_matches().count() == 1
    assert index.proximity_matches(1).select("key").distinct().count() == 2


# --- pipeline ----------------------------------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{SF}/documents.parquet")
    stage, kept = table, []
    for name, run in p.STAGES[:-1]:
        stage = run(spark, stage, SF)
        assert stage.columns == table.columns, name
        stage = p.durable(stage, "test")
        kept.append({r.doc_id: r.text for r in stage.collect()})
    near = components_brute(list(kept[0].items()), 5, 80, 100)
    assert set(kept[1]) == {i for i, (_, c) in near.items() if c == i}
    assert set(kept[3]) <= set(kept[2]) <= set(kept[1])
    final = p.STAGES[-1][1](spark, stage, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in final] == sorted(kept[3])
    starts = np.cumsum([0, *[r.n_tokens for r in final]])
    assert [r.start for r in final] == list(starts[:-1])
