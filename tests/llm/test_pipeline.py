"""Each stage of the pipeline against a plain version, on the rows that its predecessor kept."""

import collections
import hashlib

import numpy as np

import corpus_pipeline
from barwright.llm import bpe, decontaminate, neardup, quality
from barwright.llm.common import read, table


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    docs, stages = read(spark, sf_dir, "documents"), dict(corpus_pipeline.STAGES)
    columns = docs.columns

    kept = table(stages["quality rules"](spark, docs, sf_dir), "t1")
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, quality.train(docs, read(spark, sf_dir, "labels"))).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {d for d, k in verdict.items() if k}

    lines = table(stages["line dedup"](spark, kept, sf_dir), "t2")
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    before = {r.doc_id: r.text for r in kept.collect()}
    n = collections.Counter(k for t in before.values() for k in {key(x) for x in t.split("\n")})
    want = {d: "\n".join(x for x in t.split("\n") if not key(x) or n[key(x)] < 10) for d, t in before.items()}
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == columns and {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())

    one = table(stages["near-dedup"](spark, lines, sf_dir), "t3")
    words = {d: np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:4] for w in t.split()), "<u4") for d, t in want.items()}
    ids = sorted(words)
    pairs = [(a, b) for a in ids for b in ids if a < b]
    far = [neardup.distance(words[a], words[b], int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)) for a, b in pairs]
    root = {d: d for d in ids}
    for (a, b), x in zip(pairs, far, strict=True):
        if x >= 0:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == [d for d in ids if root[d] == d]

    clean = table(stages["benchmark decontamination"](spark, one, sf_dir), "t4")
    leaked = {r.doc_id for r in decontaminate.leaks(one, read(spark, sf_dir, "benchmark")).collect()}
    items = [r.text for r in read(spark, sf_dir, "benchmark").collect()]
    verbatim = {r.doc_id for r in one.collect() if any(x in r.text for x in items)}
    assert verbatim <= leaked
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaked

    coded = {r.doc_id: r.ids_sha256 for r in stages["BPE encoding"](spark, clean, sf_dir).collect()}
    text = {r.doc_id: r.text for r in clean.collect()}
    assert coded == {d: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for d, t in text.items()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()} == coded


def test_odd_rows(spark, odd, sf_dir):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names, stage by stage and one after the other."""
    from tokenizers import Tokenizer

    words = [f"Wort{i} und noch {i} andere Wörter." for i in range(60)]
    good = [(20, " ".join(words)), (20, " ".join(words)), (21, " ".join(words[:-1])), (None, "\n".join(words[::-1])), (22, "\n".join(w + " kurz" for w in words))]
    docs = odd.unionByName(odd.limit(0).unionByName(spark.createDataFrame(good, "doc_id long, text string"), allowMissingColumns=True))
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() <= count, name
        assert {c: t for c, t in out.dtypes} == {c: t for c, t in docs.dtypes}
    kept = table(corpus_pipeline.quality_rules(spark, docs, sf_dir), "odd")
    assert {r.doc_id for r in kept.collect()} <= {6, 20, 21, 22, None} and kept.where("text IS NULL OR text = ''").count() == 0
    one = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert sum(r.doc_id in (20, 21) for r in one) == 1 and sum(r.doc_id == 6 for r in one) == 1 and sum(r.doc_id is None for r in one) == 2
    library = Tokenizer.from_file(bpe.default_path())
    want = collections.Counter((r.doc_id, hashlib.sha256(np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    assert collections.Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.bpe_encoding(spark, docs, sf_dir).collect()) == want


def test_empty(spark, tmp_path):
    """Stages of an empty table give an empty table."""
    docs = read(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, "/root/testdata/sf0.001"), "none")
        assert docs.count() == 0
