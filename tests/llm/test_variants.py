"""Spelling variants against plain counting and all pairs by deletion."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barwright.llm import variants
from barwright.llm.common import as_text, read


def plain_words(rows, divisor):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % divisor == 0:
                p = h % len(w)
                w = w[:p] + w[p + 1 :]
            out[w] += 1
    return out


def plain(rows, divisor=31, least_chars=7, least_n=2, ratio=10):
    words = {w: n for w, n in plain_words(rows, divisor).items() if len(w) >= least_chars and n >= least_n}
    alike, near = defaultdict(list), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            alike[i, rest].append(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in alike.values():
        for w in group:
            near[w] |= {x for x in group if x != w}
    form = {w: f for w in words if (f := min(near[w], key=lambda x: (-words[x], x), default=None)) and words[f] >= ratio * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return out


def test_whole_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    got = [tuple(r) for r in variants.variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs.select("doc_id", "text").collect())


def test_dense_words_long_chains_and_ties(spark):
    """All words of few letters lie near each other; counts grow tenfold along a chain; equal counts tie."""
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice("abÀé") for _ in range(r.randrange(4, 8))) for _ in range(300))) for i in range(12)]
    word, chain = "chainword", []
    for k in range(5):
        chain += [word] * 2 * 10**k
        word = word[:k] + "xyzuv"[k] + word[k + 1 :]
    rows += [(100 + i, " ".join(chain[i::7])) for i in range(7)] + [(200, "tieword tieword tieworda tiewordb " * 20 + "tiewordc tiewordc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(x) for x in variants.variants(docs, least_chars=4, divisor=10**9).collect()}
    assert got == plain(rows, 10**9, 4)
    assert {x[5] for x in got if x[0] == "chainword"} == {"xyzuvword"[:4] + "nword"}


def test_words_of_slices():
    r = random.Random(1)
    for _ in range(400):
        texts = ["".join(r.choice(["Ab", "straße", "é", "x" * 60, "CDe", " ", "’", "日", "-", "word", "×"]) for _ in range(r.randrange(8))) for _ in range(r.randrange(5))]
        ids = [r.choice([None, r.randrange(10**12)]) for _ in texts]
        whole = as_text(pa.array(["before ", *texts], pa.string()).slice(1))
        got = variants.words_of(whole, ids, variants.Checksums(), 3, 4)
        assert got == Counter({w: n for w, n in plain_words(zip(ids, texts, strict=True), 3).items() if len(w) >= 4})


def test_pivots_are_the_cheapest_disjoint_grams():
    r = random.Random(2)
    for _ in range(3000):
        word = "".join(r.choice("abcd") for _ in range(r.randrange(4, 10)))
        order = {g: i for i, g in enumerate(r.sample([a + b for a in "abcd" for b in "abcd"], 16))}
        prefix = variants.prefix_of(word, order)
        pivots = variants.pivots_of(prefix)
        assert abs(pivots[0][1] - pivots[1][1]) >= 2 and set(pivots) <= set(prefix)
        assert sum(o for o, _ in pivots) == min(a[0] + b[0] for a in prefix for b in prefix if abs(a[1] - b[1]) >= 2)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert {tuple(r) for r in variants.variants(odd, least_chars=4).collect()} == plain(rows, 31, 4)
    assert variants.variants(none).collect() == []
    assert variants.variants(odd.withColumn("word", F.lit("x")).withColumn("other_n", F.lit(1))).count() == len(plain(rows))
    with pytest.raises(ValueError):
        variants.variants(odd, least_chars=3)


def test_no_side_goes_through_the_driver(spark):
    """Keys are several times the words, whose files are small: they are merged."""
    words = spark.createDataFrame([(w, 2) for w in ("standard", "standart", "garments", "garment", "tomorrow", "tomorow")], "word string, n long")
    found = variants.near_words(words)
    assert {(r.word, r.other) for r in found.collect()} >= {("standard", "standart"), ("garment", "garments"), ("tomorow", "tomorrow")}
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
