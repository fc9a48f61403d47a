"""The text operators against plain versions, on the small tables and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barwright.llm import bpe, chat, decontaminate, linedup, neardup, packing, quality, suffixes, units, warc
from barwright.llm.common import read, string_hashes, word_hashes
from tests.llm.conftest import LONG, ODD


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1: quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_quality_counts(spark, odd, sf_dir):
    for docs in (odd, read(spark, sf_dir, "documents")):
        found = quality.judge(docs, quality.Chain()).toPandas()
        want = collections.Counter((r.doc_id, *plain_counts(r.text or "")) for r in docs.select("doc_id", "text").collect())
        got = collections.Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found.itertuples())
        assert got == want
        assert ((found.n_words < 50) | (100 * found.n_repeat_words > 50 * found.n_words)).equals(found.base_failed)
        assert not (found.kept & found.base_failed).any()


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    chain = quality.Chain(np.zeros(1), rng.normal(size=(2, 2)))
    doc = np.repeat(np.arange(6), [1, 2, 5, 3, 7, 4])
    score = rng.normal(size=len(doc))
    label = quality.viterbi(score, doc, chain)

    def total(y, s):
        return sum(s[i] for i in range(len(y)) if y[i]) + sum(chain.step[y[i], y[i + 1]] for i in range(len(y) - 1))

    marginal, _ = quality.expected(score, doc, chain)
    for d in range(6):
        s = score[doc == d]
        every = {y: total(y, s) for y in np.ndindex(*[2] * len(s))}
        assert tuple(label[doc == d]) == max(every, key=every.get)
        z = np.logaddexp.reduce(list(every.values()))
        for i in range(len(s)):
            assert np.isclose(marginal[doc == d][i], sum(np.exp(v - z) for y, v in every.items() if y[i]))


def test_quality_learns(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    found = quality.judge(docs, quality.train(docs, labels, most=800)).toPandas().set_index("doc_id")
    q = labels.toPandas().groupby("doc_id").quality.max()
    found = found.join(q, how="inner")
    judged = found[~found.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.05


def test_quality_labels_lines(spark):
    """Held-out lines: blocks of clean and of junk lines, as their own documents have them, in one text."""
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    chain = quality.train(docs, labels, most=800)
    assert quality.train(docs.repartition(7), labels.repartition(3), most=800).emit.tolist() == chain.emit.tolist()
    used = {r.doc_id for r in labels.where("quality IS NOT NULL").groupBy("doc_id").count().selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").limit(800).collect()}
    rng, kind, shared = random.Random(31), {0: [], 1: []}, collections.Counter()
    for r in docs.join(labels.groupBy("doc_id").agg({"quality": "max"}), "doc_id").collect():
        lines = {x for x in (r.text or "").split("\n") if len(x) > 20}
        shared.update(lines)
        if r.doc_id not in used:
            kind[r["max(quality)"]] += sorted(lines)
    odd_share = lambda x: max(sum(c in "#*$%&|<>!" for c in x) / len(x) * 10, sum(c.isupper() for c in x) / len(x))
    source = {0: [x for x in kind[0] if odd_share(x) > 0.5], 1: [x for x in kind[1] if shared[x] < 5]}
    right = n = mixed = 0
    for k in range(200):
        labels_, lines = [], []
        for b in range(4):
            m = rng.randint(1, 5)
            labels_ += [(b + k) % 2] * m
            lines += [rng.choice(source[(b + k) % 2]) for _ in range(m)]
        found = quality.verdict(pa.array(["\n".join(lines)], pa.large_string()), chain, 0.5)["label"]
        right += (found == np.array(labels_)).sum()
        mixed += 0 < found.sum() < len(found)
        n += len(lines)
    assert right > 0.93 * n and mixed > 180


def test_quality_empty(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.kept_documents(none, labels).count() == 0
    assert quality.train(none, labels).emit.tolist() == quality.PRIOR


# 2: near duplicates


def plain_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=30), st.integers(0, 30)), min_size=1, max_size=8))
def test_alignment(cases):
    pairs = [(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b, _ in cases]
    for (a, b, limit), d in zip(cases, (neardup.distance(*p, c[2]) for p, c in zip(pairs, cases, strict=True)), strict=True):
        true = plain_distance(a, b)
        assert d == (true if true <= limit else -1)


def edited(words, share, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"new{rng.random()}"
    return out


def test_near_duplicates_are_found(spark):
    rng = random.Random(5)
    texts, group = [], []
    for g in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 400))]
        passage = [f"p{i}" for i in range(60)]
        if g % 4 == 0:
            base[10:10] = passage  # many texts share a passage without being copies
        for share in (0, 0, 0.03, 0.08):
            texts.append(" ".join(edited(base, share, rng)))
            group.append(g)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = neardup.classes(docs).toPandas().set_index("doc_id").sort_index()
    hashed = [np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:4] for w in t.split()), "<u4") for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    d = [neardup.distance(hashed[i], hashed[j], int(0.2 * max(len(hashed[i]), len(hashed[j])))) for i, j in pairs]
    linked = [p for p, x in zip(pairs, d, strict=True) if x >= 0]
    assert all(group[i] == group[j] for i, j in linked)
    missed = [p for p in linked if found.class_id[p[0]] != found.class_id[p[1]]]
    assert len(missed) <= 0.01 * len(linked)
    for c, members in found.groupby("class_id").groups.items():
        assert {group[m] for m in members} == {group[c]} and c == min(members)
    kept = neardup.keep_one(docs).toPandas()
    assert sorted(kept.doc_id) == sorted(found.class_id.unique())


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.86: at most 1 % are missed."""
    rng, texts = random.Random(17), []
    for g in range(600):
        base = [f"g{g}w{i}" for i in range(200)]
        texts += [" ".join(base), " ".join(edited(base, (0.2, 0.18, 0.16, 0.14)[g % 4], rng))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert all(c in (i, i // 2 * 2) for i, c in got.items())
    assert sum(got[2 * g + 1] != 2 * g for g in range(600)) <= 6


def test_near_duplicates_of_few_words(spark):
    """All pairs of short texts: a word changed, added or gone, and two of ten or more."""
    rng, texts, linked = random.Random(19), [], 0
    for n in range(4, 15):
        for kind in ("change", "add", "drop"):
            base = [f"t{len(texts)}w{i}" for i in range(n)]
            other = list(base)
            for at in rng.sample(range(n), max(1, n // 5)):
                other[at] = {"change": f"x{at}", "add": f"{other[at]} x{at}", "drop": ""}[kind]
            other = " ".join(" ".join(other).split())
            longer = max(n, len(other.split()))
            same = max(1, n // 5) <= 0.2 * longer + 1e-9
            texts.append((" ".join(base), other, same))
            linked += same
    docs = spark.createDataFrame([(2 * i + k, t[k]) for i, t in enumerate(texts) for k in (0, 1)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert linked > 25 and [got[2 * i + 1] == 2 * i for i in range(len(texts))] == [t[2] for t in texts]


def test_near_duplicates_behind_a_passage(spark):
    """Texts that share most of their words with all others, and texts that one long text holds, still meet their copies."""
    rng = random.Random(11)
    passage, held, texts = [f"p{i}" for i in range(140)], [], []
    for g in range(60):
        base = passage + [f"g{g}w{i}" for i in range(50)]
        texts += [" ".join(base), " ".join(edited(base, 0.02, rng))]
    for g in range(20):
        part = [f"h{g}w{i}" for i in range(60)]
        held += part
        texts += [" ".join(edited(part, 0.04, rng)), " ".join(edited(part, 0.04, rng))]
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), " ".join(held))], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts) + 1)}


def test_near_duplicates_with_repeated_and_null_ids(spark):
    """A class is its texts, whatever ids they have: unrelated texts of the same id stay, and near copies without ids go."""
    rng = random.Random(23)
    bases = [[f"g{g}w{i}" for i in range(60)] for g in range(12)]
    docs = [(7 if g < 8 else None, " ".join(edited(b, share, rng))) for g, b in enumerate(bases) for share in (0, 0.03, 0.05)]
    kept = neardup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(min(w.split("w")[0] for w in r.text.split()) for r in kept) == sorted(f"g{g}" for g in range(12))


def test_near_duplicates_odd(spark, odd, none):
    found = neardup.classes(odd).toPandas()
    assert len(found) == len(ODD)
    of = {(None if pd.isna(r.doc_id) else int(r.doc_id)): r.class_id for r in found.itertuples()}
    assert of[8] == of[9] == 8 and of[6] == 6 and pd.isna(of[None])
    empty = found[found.class_id == 1]
    assert len(empty) == 3  # null, empty and blank texts are copies
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, ""), (4, "ein Wort"), (5, "x" * 5000), (6, LONG), (7, ODD[7][1]), (0, ODD[8][1]), (8, ODD[9][1]), (2, "same id, other text")])
    assert neardup.classes(none).count() == 0 and neardup.keep_one(none).count() == 0


def test_keep_one_leaves_columns_alone(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8), (3, "d e f", 9, 9)], "doc_id long, text string, _bw_hash int, _BW0 int")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(rows(kept)) == [(1, "a b c", 5, 6), (3, "d e f", 9, 9)]


@pytest.mark.parametrize(("low", "high"), [(12, 31), (32, 60), (60, 200), (200, 600)])
def test_near_duplicates_recall(spark, low, high):
    """Substitutions, insertions and deletions at random, 5 to 20 % of the words: 0.9 of the linked pairs at least, at every share."""
    rng, texts, want = random.Random(low), [], {}
    for g in range(160):
        base = [f"g{g}w{i}" for i in range(rng.randint(low, high))]
        share = (0.05, 0.1, 0.15, 0.2)[g % 4]
        other = list(base)
        for at in rng.sample(range(len(base)), int(share * len(base))):
            other[at] = rng.choice([f"x{rng.random()}", f"{other[at]} x{rng.random()}", ""])
        texts += [" ".join(base), " ".join(" ".join(other).split())]
        words = [np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint32) for t in texts[-2:]]
        if neardup.similarity(*words) >= 0:
            want.setdefault(share, []).append(2 * g)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(c in (i, i // 2 * 2) for i, c in got.items())
    for share, pairs in want.items():
        assert sum(got[p + 1] == p for p in pairs) >= 0.9 * len(pairs), share


def test_near_duplicates_of_a_dense_group(spark):
    """Pairs among many texts that are a little too far from each other, and so share all keys with texts that they fail against."""
    rng, texts = random.Random(31), []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(100)]
        for _ in range(50):
            one = edited(base, 0.15, rng)
            texts += [" ".join(one), " ".join(edited(one, 0.2, rng))]
    hashed = [np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in t.split()], np.uint32) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i // 100 * 100, i):
            if neardup.similarity(hashed[i], hashed[j]) >= 0:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {i: top(i) for i in range(len(texts))}


def test_short_near_duplicates_of_a_dense_group(spark):
    """Texts of 10 words that share 8 with many others, of which each is near one alone."""
    kept, texts = [f"k{i}" for i in range(8)], []
    for g in range(20):
        places = random.Random(g).sample(range(9), 2)
        one = list(kept)
        for at in sorted(places, reverse=True):
            one.insert(at, f"g{g}x{at}")
        texts += [" ".join(one), " ".join(f"{w}y" if w == f"g{g}x{places[0]}" else w for w in one)]
    hashed = [np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in t.split()], np.uint32) for t in texts]
    near = {i: [j for j in range(len(texts)) if neardup.similarity(hashed[i], hashed[j]) >= 0] for i in range(len(texts))}
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == got[j] for i in near for j in near[i])


def test_common_keys_meet_by_words(spark, monkeypatch):
    """Where a key is too common to be held against itself, classes are the same."""
    rng, texts = random.Random(37), []
    for g in range(60):
        base = [f"p{i}" for i in range(60)] + [f"g{g}w{i}" for i in range(40)]
        texts += [" ".join(base), " ".join(edited(base, 0.2, rng))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "COMMON", 8)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {i: i // 2 * 2 for i in range(len(texts))}


@settings(max_examples=200, deadline=None)
@given(st.integers(12, 90), st.integers(0, 10**6), st.sampled_from([1, 3]))
def test_linked_texts_share_rare_kmers(n, seed, k):
    """Whatever up to 20 % of the longer text's words do, so many of the rarest k-mers of both agree as pairs are asked for."""
    rng = random.Random(seed)
    a = [rng.randrange(30) for _ in range(n)]
    b = list(a)
    for _ in range(n // 5):
        at = rng.randrange(len(b))
        b[at : at + 1] = rng.choice([[], [rng.randrange(30)], [b[at], rng.randrange(30)]])
    pair = [np.array(x, np.uint32) for x in (a, b)]
    if neardup.similarity(*pair) < 0 or min(len(a), len(b)) < 12:
        return
    found = [neardup.kmers(x.astype(np.uint64), k) for x in pair]
    size = {int(x): rng.randrange(3) for x in np.concatenate(found)}
    rare = []
    for f, m in zip(found, (len(a), len(b)), strict=True):
        rare.append(set(sorted(f.tolist(), key=lambda x: (size[x], x))[: len(f) - neardup.shared_least(m, k) + neardup.shared_rare(m, k)]))
    assert len(rare[0] & rare[1]) >= neardup.shared_rare(min(len(a), len(b)), k) >= 4


def test_near_duplicates_against_all_pairs(spark):
    """The classes of a whole table are those of all linked pairs, found by aligning every pair that a bound on the distance leaves."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in (r.text or "").split()], np.uint32) for r in docs.collect()}
    ids = sorted(texts, key=lambda d: (len(texts[d]), d))
    bags = np.stack([np.bincount(texts[d] % 128, minlength=128) for d in ids])
    root = {d: d for d in ids}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        apart = bags[i + 1 :] - bags[i]
        far = np.maximum(np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1))
        for j in np.flatnonzero(far <= 0.2 * np.array([len(texts[d]) for d in ids[i + 1 :]]) + 1e-9):
            if neardup.similarity(texts[a], texts[ids[i + 1 + j]]) >= 0:
                x, y = sorted((top(a), top(ids[i + 1 + j])))
                root[y] = x
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {d: top(d) for d in ids}


def test_near_copies_are_not_aligned_with_all_their_leaders(spark, monkeypatch):
    """In a dense group a text is aligned until its class is known, and the exact step takes no keys that one class alone has."""
    rng, aligned, rows = np.random.default_rng(5), [], {}
    base = rng.integers(0, 10**6, 80)
    texts = [" ".join(f"w{w}" for w in np.where(rng.random(80) < 0.06, rng.integers(0, 10**6, 80), base)) for _ in range(300)]
    held, written = neardup._aligned, neardup.Scratch.table
    monkeypatch.setattr(neardup, "_aligned", lambda pairs, *more: aligned.append(pairs.count()) or held(pairs, *more))

    def table(self, df, name):
        made = written(self, df, name)
        rows[name] = rows.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(neardup.Scratch, "table", table)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(300), 0)
    assert sum(aligned) < 3 * len(texts) and rows["repeated"] == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = dict(rows(neardup.components(spark.createDataFrame(edges, "a string, b string"))))
    inside = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == inside and all(got[x] == root(x) for x in inside)


# 3: decontamination


def plain_local(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(2, 6), min_size=1, max_size=15), st.lists(st.integers(2, 6), min_size=1, max_size=25)), min_size=1, max_size=6))
def test_smith_waterman(cases):
    score, _ = decontaminate.smith_waterman([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in cases])
    assert score.tolist() == [plain_local(a, b) for a, b in cases]


def test_leaks_against_all_alignments(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 50)))) for i in range(12)]
    docs, planted = [], set()
    for d in range(120):
        body = [word() for _ in range(rng.randint(20, 200))]
        if d % 3 == 0:
            i = rng.randrange(12)
            body[5:5] = edited(items[i][1].split(), 0.1 if d % 2 else 0, rng)
            planted.add((d, i))
        docs.append((d, " ".join(body).replace(" v1", ", V1")))
    found = {(r[0], r[1]) for r in rows(decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))}
    clean = lambda t: [w.lower().strip(decontaminate.PUNCTUATION) for w in t.split()]
    want = {(d, i) for d, t in docs for i, x in items if plain_local(clean(x), clean(t)) >= 0.6 * 2 * len(clean(x))}
    assert planted <= want and found == want


@pytest.mark.parametrize("copies", [1, 2, 3, 8])
def test_leaks_dont_hang_on_the_number_of_copies(spark, copies):
    """28 of an item's 40 words: its other seeds stand in no document, so that those of the copies are the common ones."""
    item = [f"w{i}" for i in range(40)]
    docs = [(k, " ".join([f"a{k}"] * 9 + item[:28] + [f"b{k}"] * 9)) for k in range(copies)]
    found = rows(decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")))
    assert {(r[0], r[1], round(r[2], 6)) for r in found} == {(k, 7, 0.7) for k in range(copies)}


def test_leaks_say_where_the_passage_begins(spark):
    item = [f"w{i}" for i in range(10)]
    docs = [(1, " ".join([f"a{i}" for i in range(6)] + item[:5] + ["x", "y"] + item[5:] + ["b"] * 4)), (2, " ".join(["c"] * 3 + item[1:9] + ["d"] * 30)), (3, " ".join(item))]
    for kind in ("smallint", "int", "bigint", "string", "decimal(9,0)", "date"):
        items = spark.createDataFrame([(" ".join(item),)], "text string").selectExpr("CAST(NULL AS DATE) item_id" if kind == "date" else f"CAST(7 AS {kind}) item_id", "text")
        found = {(r.doc_id, r.start_word, r.end_word) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
        assert found == {(1, 6, 18), (2, 3, 11), (3, 0, 10)}


def test_leaks_of_a_phrase_of_many_items(spark, monkeypatch):
    """A text that meets more items than are held at once takes them in parts."""
    monkeypatch.setattr(decontaminate, "MEETINGS", 40)
    block = decontaminate.Items.of(list(range(30)), [" ".join(["one", "common", "phrase", "here", *(f"i{i}w{k}" for k in range(6))]) for i in range(30)])
    text = " ".join(["one common phrase here"] * 5 + ["one", "common", "phrase", "here", *(f"i{9}w{k}" for k in range(6))])
    found = decontaminate.matches(block, block.prefilter(), pa.array([text, "none", text], pa.large_string()))
    assert list(zip(found["text"], found["item"], found["start"], found["end"], strict=True)) == [(0, 9, 20, 30), (2, 9, 20, 30)]


def test_leaks_by_rarity_are_those_of_all_seeds(spark, sf_dir):
    """Passages of one text by the rarest seed first: the same matches and places as all in their order; and over a table, those of all alignments."""
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(60)}" for _ in range(rng.randint(8, 25)))) for i in range(15)]
    texts = [" ".join(" ".join(edited(items[rng.randrange(15)][1].split(), rng.choice([0, 0.1, 0.3]), rng)) + f" x{k} y{k} " * rng.randint(0, 9) for k in range(6)) for _ in range(40)]
    texts.append((items[3][1] + " gap" * 60 + " ") * 3)
    block = decontaminate.Items.of([i for i, _ in items], [t for _, t in items])
    few, array = block.prefilter(), pa.array(texts, pa.large_string())
    held = decontaminate.held_seeds(block, few, array)
    assert held.max() > 1 and (decontaminate.counted(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), block) == held).all()
    said = [decontaminate.matches(block, few, array, h) for h in (None, held, -held)]
    of = lambda m: sorted(zip(*(m[c].tolist() for c in ("text", "item", "score", "start", "end")), strict=True))
    assert len(of(said[0])) > 40 and of(said[0]) == of(said[1]) == of(said[2])
    assert [x[3:] for x in of(said[1]) if x[:2] == (40, 3)] == [(0, len(items[3][1].split()))]

    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    split = lambda t: decontaminate.plain_words(pa.array([t], pa.large_string()))[0]
    own, tests = {r.doc_id: split(r.text or "") for r in docs.collect()}, {r.item_id: split(r.text) for r in benchmark.collect()}
    pairs = [(d, i) for d, w in own.items() for i, x in tests.items() if decontaminate.reach(x, w) >= decontaminate.SCORE]
    score, _ = decontaminate.smith_waterman([(tests[i], own[d]) for d, i in pairs])
    assert found == {p for p, s in zip(pairs, score.tolist(), strict=True) if s >= decontaminate.SCORE * 2 * len(tests[p[1]])} and found


def test_leaks_odd(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "ein Wort"), (4, "tie tie tie tie")], "item_id long, text string")
    assert {(r[0], r[1]) for r in rows(decontaminate.leaks(odd, items))} == {(4, 3), (8, 4), (9, 4)}
    assert decontaminate.clean_documents(odd, items).count() == len(ODD) - 3
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).count() == 0


# 4: fixity


def test_audit(spark):
    rng = random.Random(4)
    a = [(i, f"record {i} " + "z" * rng.randrange(50)) for i in range(-3, 700) if i % 13]
    b = [(i, x.replace("record", "rec0rd") if i % 101 == 5 else x) for i, x in a if i % 150 != 7] + [(1300, "more"), (20, "twice")]
    found = {r.record_id: (r.status, r.offset, r.length) for r in warc.audit(*(spark.createDataFrame(x, "record_id long, record string") for x in (a, b))).collect()}
    at, want = 0, {1300: ("extra", -1, -1)}
    there = collections.defaultdict(list)
    for i, x in b:
        there[i].append(x)
    for i, x in a:
        if there[i] != [x]:
            want[i] = ("corrupt" if there[i] else "missing", at, len(x))
        at += len(x)
    assert found == want
    same = spark.createDataFrame(a, "record_id long, record string")
    assert warc.audit(same, same).count() == 0 and warc.audit(same.limit(0), same.limit(0)).count() == 0


def test_audit_odd(spark):
    """Ids of 64 bits, of both signs, null ids, null bodies, long records and columns of other names."""
    ids = [-(1 << 63), -(1 << 62) - 1, 5, (1 << 62) + 1, (1 << 62) + 63, (1 << 62) + 64, None]
    pages = spark.createDataFrame([(i, None if i == 5 else "u", "z" * 300_000 if i == 5 else None, 1, 2) for i in ids], "page_id long, url string, html string, place int, digest int")
    good = warc.serialised(pages)
    assert good.count() == 6 and warc.audit(good, good).count() == 0
    bad = good.where("record_id != 5").withColumn("record", F.when(F.col("record_id") == (1 << 62) + 63, "changed").otherwise(F.col("record")))
    assert {(r.record_id, r.status) for r in warc.audit(good, bad).collect()} == {(5, "missing"), ((1 << 62) + 63, "corrupt")}
    assert {(r.record_id, r.status) for r in warc.audit(good.limit(0), good).collect()} == {(i, "extra") for i in ids if i is not None}


# 5 and 10: tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["<|endoftext|>", "'s", "'ll", " ", "  ", "\n", "_", "½", "՘", "the", " ing"])), max_size=12))
def test_bpe_equals_the_library(library, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ids = library.encode(text, add_special_tokens=False).ids
    for kind in (bpe.ByteBPE, bpe.LibraryBPE):
        coder = bpe.loaded(bpe.default_path(), kind)
        assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.just(""), st.lists(st.sampled_from(["a", "foo bar", "x", " ", "  ", "\n", "\t", "'s", "9", "!", "é", "<|endoftext|>"]), max_size=6).map("".join)), max_size=6))
def test_bpe_of_texts_side_by_side(library, texts):
    """Texts of one slice, in any order: ends in white space before empty, null and indented ones."""
    from barwright.llm.common import as_text

    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (bpe.ByteBPE, bpe.LibraryBPE):
        coder = bpe.loaded(bpe.default_path(), kind)
        packed = coder.encode_many(as_text(pa.array(texts, pa.string())))
        assert [np.frombuffer(x, "<u4").tolist() for x in packed] == want
        assert coder.decode_many(packed) == [library.decode(i, skip_special_tokens=False) for i in want]


@pytest.mark.parametrize("texts", [["foo bar\n", None], ["foo bar\n", " baz"], ["x a\n", "\nb c"], ["hello there\n", "\tz y"]])
def test_bpe_rows_that_end_in_white_space(spark, library, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in bpe.encode_documents(docs).orderBy("doc_id").collect()] == want
    assert [r.n_tokens - 1 for r in packing.token_files(docs).orderBy("doc_id").collect()] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_decode_equals_the_library(library, ids):
    assert bpe.loaded(bpe.default_path()).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, odd, none, library):
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(odd).collect())
    want = collections.Counter()
    for i, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.encode_documents(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 2**20), max_size=60), st.integers(1, 9))
def test_packing_round_trip(width, values, block):
    import io

    ids = np.array([v % (1 << width) for v in values], np.uint32)
    out = io.BytesIO()
    writer = packing.Writer(out, width, block)
    cuts = sorted({0, len(ids) // 3, len(ids) // 2})
    for k, part in enumerate(np.split(ids, cuts)):
        writer.add(k, part)
    writer.close()
    reader = packing.Reader(out.getvalue())
    assert reader.ids(0, len(ids)).tolist() == ids.tolist()
    for a in range(0, len(ids), 7):
        assert reader.ids(a, min(a + 5, len(ids))).tolist() == ids[a : a + 5].tolist()
    assert np.concatenate([reader.document(k) for k in range(len(cuts) + 1)]).tolist() == ids.tolist()


@pytest.mark.parametrize("shard_ids", [packing.SHARD_IDS, 50])
def test_token_files(spark, odd, none, library, shard_ids):
    """With a small limit the documents stand in many shards."""
    got = sorted(rows(packing.token_files(odd, with_ids=True, shard_ids=shard_ids)), key=lambda r: r[1])
    hashed = odd.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect()
    at, want = 0, []
    for i, text, _ in hashed:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    assert got == want
    assert packing.token_files(none).count() == 0


def test_token_files_of_another_width(spark, sf_dir, library):
    """Fields of 17 bits are cut across bytes, on disk and back."""
    docs = read(spark, sf_dir, "documents")
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    got = {r.doc_id: r.ids for r in packing.token_files(docs, end_id=None, with_ids=True, shard_ids=40_000, width=17).collect()}
    assert got == want


# 6: suffixes


@settings(max_examples=80, deadline=None)
@given(st.text("ab", min_size=60, max_size=200), st.integers(17, 45))
def test_deep_shallow(text, width):
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(0, len(data) - width + 1)
    order, common = suffixes.deep_shallow(data, starts, width, shallow=16)
    parts = [text[s : s + width] for s in starts]
    assert [parts[i] for i in order] == sorted(parts)
    for a, b, c in zip(order, order[1:], common[1:], strict=False):
        same = next((k for k in range(width) if parts[a][k] != parts[b][k]), width)
        assert c == (same if same >= 16 else 0)


def plain_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[k : k + 200] for r in raw for k in range(len(r) - 199))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), sha(np.frombuffer(r, np.uint8)[~gone].tobytes())))
    return out


@pytest.mark.parametrize("hot", [2, 2000])
def test_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(330))
    texts = [None, "", "short", "ab" * 400, passage, passage[:199]]
    for k in range(40):
        body = "".join(rng.choice("ijklmnop ü") for _ in range(rng.randint(0, 500)))
        texts.append(body[:50] + passage[: rng.randint(150, 330)] + body[50:] + (passage if k % 9 == 0 else ""))
    texts += [texts[10], texts[11]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(rows(suffixes.remove_repeats(docs)))
    assert [r[1:] for r in got] == plain_repeats(texts)


def test_repeats_odd(spark, odd, none):
    got = collections.Counter(r[1:] for r in rows(suffixes.remove_repeats(odd)))
    assert got == collections.Counter(plain_repeats([t for _, t in ODD]))
    assert suffixes.remove_repeats(none).count() == 0


# 7: units


def plain_units(text, unit):
    """Start and end of each unit, by characters alone."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    if unit == "paragraph":
        blocks = []
        for a, b in out:
            if not text[a:b].strip(" \t"):
                blocks.append(None)
            elif blocks and blocks[-1]:
                blocks[-1] = (blocks[-1][0], b)
            else:
                blocks.append((a, b))
        out = [x for x in blocks if x]
    if unit == "sentence":
        cut = []
        for a, b in out:
            for k in range(a, b):
                if text[k] in ".!?" and (k + 1 == b or text[k + 1] in " \t\v\f\r"):
                    cut.append((a, k + 1))
                    a = k + 1
            cut.append((a, b))
        out = cut
    if unit != "line":
        out = [(a + len(text[a:b]) - len(text[a:b].lstrip(" \t\n\v\f\r")), b) for a, b in out]
    return [(a, b) for a, b in out if text[a:b].strip(" \t\n\v\f\r")]


@pytest.mark.parametrize("unit", ["paragraph", "line", "sentence"])
def test_units(spark, sf_dir, unit):
    docs = read(spark, sf_dir, "documents")
    got = {r.doc_id: (r.n_units, r.n_removed, r.removed_chars, [tuple(x) for x in r.spans], r.kept_sha256) for r in units.remove_units(docs, unit).collect()}
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        text, spans = r.text or "", []
        for a, b in plain_units(text, unit):
            key = " ".join(re.sub("[ \t\v\f\r\n]+", " ", text[a:b].lower()).strip(" ").split(" "))
            if key.count(" ") >= units.LEAST_WORDS - 1:
                if key in seen:
                    spans.append((a, b))
                seen.add(key)
        kept = "".join(c for k, c in enumerate(text) if not any(a <= k < b for a, b in spans))
        want[r.doc_id] = (len(plain_units(text, unit)), len(spans), sum(b - a for a, b in spans), spans, sha(kept))
    assert got == want


def test_units_odd(spark, odd, none):
    got = {(r.doc_id, r.n_removed) for r in units.remove_units(odd, "line", least_words=5).collect()}
    assert (8, 0) in got and (9, 1) in got and (6, 0) in got and len(got) == len({i for i, _ in ODD})
    assert units.remove_units(none).count() == 0


# 8: chat


def test_chat_parts(spark):
    parts = "array<struct<type: string, text: string, ref: string, units: bigint>>"
    said = [
        (1, 0, "user", [("text", "see </turn> & <image:9>", None, None), ("image", None, "a.png", 2), ("document", None, "b.pdf", None)]),
        (1, 1, "assistant", [("text", "ok &lt;", None, None), ("audio", None, "c.wav", 4), ("text", "!", None, None)]),
        (2, 0, "a>b", None), (2, None, None, [("video", None, "d", 1), ("text", None, None, None)]), (None, 0, "assistant", [("text", "x", None, None)]),
    ]
    f = chat.format_conversations(spark.createDataFrame(said, f"conv_id long, turn long, role string, parts {parts}"))
    got = {r.conv_id: r for r in chat.read_back(f).collect()}
    one = got[1]
    assert one.formatted == "<turn:user>see &lt;/turn> &amp; &lt;image:9><image:1><document:2></turn>\n<turn:assistant>ok &amp;lt;<audio:3>!</turn>\n"
    assert [tuple(a) for a in one.attachments] == [(1, "image", "a.png", 512), (2, "document", "b.pdf", 512), (3, "audio", "c.wav", 100)]
    assert one.attached_tokens == 1124 and one.n_unknown == 0 and one.loss_text == "ok &lt;<audio:3>!"
    assert [tuple(t) for t in got[2].turns] == [("", ""), ("a>b", "")] and got[2].n_unknown == 1
    assert got[None].loss_text == "x"


def test_chat_reads_back(spark):
    texts = [r"\### Assistant: </turn> ok", None, "", "&lt;&amp;<turn:user>\n</turn>\n", "a\n\nb ", "<", "&", "é\U0001f600" * 50]
    said = [(c, t, "assistant" if t % 2 else "user", texts[(c + t) % len(texts)]) for c in range(8) for t in range(5)]
    rows_ = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(rows_.select("conv_id", "turn", "role", chat.text_parts(rows_["text"]).alias("parts"))).collect()}
    for c in range(8):
        own = [(r, t or "") for k, _, r, t in said if k == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (5, sha("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_chat_odd(spark):
    """Ties, repeated rows, null turns and roles, a very long text, an empty table, columns with names used inside."""
    said = [(1, 1, "user", "same"), (1, 1, "user", "same"), (1, 1, "assistant", "same"), (2, None, None, LONG), (2, 3, "assistant", LONG), (None, 1, "assistant", None)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(3)
    extra = {c: F.lit("x") for c in ("p", "t", "number", "first", "opened", "files", "plain", "pieces", "body", "loss", "formatted", "turns", "n_turns")}
    got = {r.conv_id: r for r in chat.digests(df.withColumns({"parts": chat.text_parts(df["text"]), **extra})).collect()}
    want = {1: [("assistant", "same"), ("user", "same"), ("user", "same")], 2: [("", LONG), ("assistant", LONG)], None: [("assistant", "")]}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert chat.digests(df.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


# 9: lines


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    prints, counts = keys * np.uint64(3), (np.arange(len(keys)) + 2).astype(np.uint32)
    made = linedup.PerfectHash.load(linedup.PerfectHash.build(keys, prints, counts).dump())
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    assert made.count(keys, prints).tolist() == counts.tolist()
    other = np.arange(50, dtype=np.uint64) * np.uint64(77777) + np.uint64(5)
    other = other[~np.isin(other, keys)]
    assert set(made.count(other, other * np.uint64(5) + np.uint64(1)).tolist()) <= {1}


@pytest.mark.parametrize(("shard", "kept"), [(12, 0), (40, 1 << 20), (500_000, 96 << 20)])
def test_lines(spark, shard, kept, monkeypatch):
    """One shard and many, kept in memory or none of them."""
    monkeypatch.setattr(linedup, "SHARD_KEYS", shard)
    monkeypatch.setattr(linedup, "KEPT_BYTES", kept)
    assert linedup.probed_bytes(9) == (linedup.PROBED_BYTES if not kept else linedup.SLICE_BYTES)
    rng = random.Random(8)
    pool = [f"  Line {i}\t" if i % 3 else f"line {i}" for i in range(700)] + ["", " ", "ÄB", "äb", "\x0b"]
    texts = [None, "", "\n\n"] + ["\n".join(rng.choice(pool[: 20 if rng.random() < 0.5 else 705]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    n = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    for r in linedup.line_report(docs).collect():
        own = (texts[r.doc_id] or "").split("\n")
        kept = [x for x in own if not key(x) or n[key(x)] < 10]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(own), len(own) - len(kept), sha("\n".join(kept)))


def test_lines_odd(spark, odd, none):
    got = linedup.drop_common_lines(odd, least_docs=2)
    assert got.columns == odd.columns and got.count() == len(ODD)
    kept = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == collections.Counter((i, "" if t in (LONG, ODD[9][1]) else t) for i, t in ODD)
    assert linedup.line_report(none).count() == 0


def test_string_hashes():
    """Of any lengths and slices: the same for equal strings, apart for others."""
    words = sorted({"", "a", "\x00", "\x00\x00", "é", "x" * 63, "x" * 64, "x" * 65, "x" * 5000, *(chr(97 + i % 26) * (i // 26) for i in range(26 * 80))})
    h = string_hashes(pa.array(words))
    assert len(set(h.tolist())) == len(words) and not len(string_hashes(pa.array([], pa.string())))
    for a, n in ((7, 50), (1900, 100), (0, 1)):
        assert (string_hashes(pa.array(words).slice(a, n)) == h[a : a + n]).all()


def test_word_hashes():
    h, o = word_hashes(pa.array(["a b\x0bc", "", " a ", "b c"], pa.large_string()))
    assert o.tolist() == [0, 3, 3, 4, 5] and h[0] == h[3] and len(set(h.tolist())) == 4
