"""Quality rules: lines labelled content or boilerplate by a linear-chain CRF (operator 1).

Each line has a few features; a conditional random field with two labels scores the lines of a text as a chain, Viterbi
decoding finds the best labelling, and the share of a text's characters in content lines decides whether it is kept.

The field is trained on lines of labelled documents. Only documents have labels, so those of lines are derived: they begin
with their document's label (quality 1: content). To the documents as they are, whose labels would hardly ever change from
line to line, come pairs of a good and a bad document cut at a random line and put together crosswise. Then labels and
weights take turns (expectation and maximisation under constraints): a line takes the label that the field finds likelier
by its shape and its neighbours, but of a good document at least GOOD_SHARE of the characters stay content, of a bad one
at most BAD_SHARE. So bad documents come to have content lines, and good ones boilerplate. The training rows are bounded:
`TRAIN_DOCS` labelled documents, those of least hash, and `TRAIN_LINES` lines of each; decoding reads every line of every
text. Without documents of both labels the weights of `PRIOR` are used. Of rows that share a doc_id that of the least text
hash is trained on, so that the weights hang on the tables alone.

Null and empty texts have no words, fail the base rules and aren't kept. Rows stay one to one, repeated ones too. Of a
very long text every line is labelled. An empty table gives no rows. Other columns have no say, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_text, runs, slices

#: Labelled documents and lines of each that the field is trained on.
TRAIN_DOCS, TRAIN_LINES = 2_000, 200
#: Shares of characters in content lines that a document's label allows in training, and turns of labels and weights.
GOOD_SHARE, BAD_SHARE, TURNS = 0.8, 0.4, 2
#: The least share of characters in content lines.
CONTENT_SHARE = 0.5
#: A text of fewer words, or with more words per hundred in repeated windows of three, fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
FEATURES = ["one", "symbols_2", "symbols_5", "symbols_10", "upper_30", "upper_70", "digits_30", "exclaims_5", "short_20", "short_60", "ends_sentence", "long_words", "repeated"]
#: Weights for want of training rows: a content line is one of few symbols, capitals, digits and exclamation marks.
PRIOR = [1.5, -1.0, -1.0, -2.0, -1.0, -2.5, -1.5, -2.0, -0.5, 0.0, 0.5, -0.5, -1.5]

CLASSES = np.zeros((5, 256), bool)
CLASSES[0, [ord(c) for c in SYMBOLS]] = True
CLASSES[1, ord("A") : ord("Z") + 1] = True
CLASSES[2, ord("0") : ord("9") + 1] = True
CLASSES[3, ord("!")] = True
CLASSES[4, [ord(c) for c in SPACES]] = True


@dataclass
class Chain:
    """Weights of content against boilerplate for each feature, and of each pair of labels in sequence."""

    emit: np.ndarray = field(default_factory=lambda: np.array(PRIOR))
    step: np.ndarray = field(default_factory=lambda: np.array([[0.7, -0.7], [-0.7, 0.7]]))


def counted(data: np.ndarray, offsets: np.ndarray, which: int) -> np.ndarray:
    """How many bytes of a class each run between two offsets holds."""
    sums = np.concatenate(([0], np.cumsum(CLASSES[which][data], dtype=np.int64)))
    return np.diff(sums[offsets])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of large strings, and their offsets."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def repeats_in(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the same key stands more than once in the same document."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.lexsort((key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.zeros(len(key), bool)
    out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return out


def lines_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The lines of all texts: document, code, whether it has a word, and the features."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    doc = runs(lists.offsets.to_numpy())
    data, at = bytes_of(flat)
    n_bytes = np.maximum(np.diff(at), 1)
    symbols, upper, digits, exclaims, spaces = (counted(data, at, k) for k in range(5))
    chars = pc.utf8_length(flat).to_numpy().astype(np.int64)
    worded = np.diff(at) > spaces
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = np.maximum(spaces + 1, 1)
    tail = pc.match_substring_regex(flat, r"[.!?][ \t\n\v\f\r]*$").to_numpy(zero_copy_only=False)
    x = np.stack(
        [
            np.ones(len(flat)), symbols > 0.02 * n_bytes, symbols > 0.05 * n_bytes, symbols > 0.1 * n_bytes, upper > 0.3 * n_bytes, upper > 0.7 * (n_bytes - spaces - exclaims), digits > 0.3 * n_bytes,
            exclaims > 0.05 * n_bytes, chars < 20, chars < 60, tail, chars > 15 * words, repeats_in(doc, code),
        ], 1,
    ).astype(np.float64)
    return {"doc": doc, "code": code, "worded": worded, "chars": chars, "x": x, "flat": flat}


def base_counts(texts: pa.Array, lines: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(texts)
    data, at = bytes_of(texts)
    spaces, symbols = counted(data, at, 4), counted(data, at, 0)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    doc = runs(lists.offsets.to_numpy())[full]
    coded = flat.dictionary_encode()
    code, v = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[full], len(coded.dictionary) + 1
    pairs = code[:-2] * v + code[1:-1] if len(code) > 2 else np.zeros(0, np.int64)
    if v >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    found = np.zeros(len(code) + 2, bool)
    if len(pairs):
        inside = doc[2:] == doc[:-2]
        again = np.zeros(len(pairs), bool)
        again[inside] = repeats_in(doc[:-2][inside], (pairs * v + code[2:])[inside])
        for k in range(3):
            found[k : k + len(again)] |= again
    worded = lines["worded"]
    one = np.unique(lines["doc"][worded] * (1 + lines["code"].max(initial=0)) + lines["code"][worded]) // (1 + lines["code"].max(initial=0))
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": pc.utf8_length(texts).to_numpy().astype(np.int64) - spaces,
        "n_symbols": symbols,
        "n_dup_lines": np.bincount(lines["doc"][worded], minlength=n) - np.bincount(one, minlength=n),
        "n_repeat_words": np.bincount(doc[found[: len(doc)]], minlength=n),
    }


def turns(doc: np.ndarray) -> list[np.ndarray]:
    """The flat indices of the first, second, ... line of every text; `doc` ascends."""
    if not len(doc):
        return []
    first = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1))
    length = np.diff(np.concatenate((first, [len(doc)])))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    return [first[: np.searchsorted(-length, -t, side="left")] + t for t in range(length[0])]


def viterbi(score: np.ndarray, doc: np.ndarray, chain: Chain) -> np.ndarray:
    """The best labels (1: content) of the lines, all texts a step at a time. `score` is for content against boilerplate."""
    emit = np.stack([np.zeros(len(score)), score], 1)
    best, came, label = emit.copy(), np.zeros((len(score), 2), np.int8), np.zeros(len(score), np.int8)
    steps = turns(doc)
    for at in steps[1:]:
        reach = best[at - 1][:, :, None] + chain.step[None]  # from, to
        came[at] = reach.argmax(1)
        best[at] = reach.max(1) + emit[at]
    ends = np.concatenate((np.flatnonzero(np.diff(doc)), [len(doc) - 1])) if len(doc) else np.zeros(0, int)
    label[ends] = best[ends].argmax(1)
    for at in reversed(steps[1:]):
        label[at - 1] = came[at, label[at]]
    return label


def expected(score: np.ndarray, doc: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward: the probability of content of each line, and the expected count of each pair of labels."""
    emit = np.stack([np.zeros(len(score)), score], 1)
    ahead, behind, steps = emit.copy(), np.zeros_like(emit), turns(doc)
    for at in steps[1:]:
        ahead[at] = np.logaddexp(ahead[at - 1][:, 0, None] + chain.step[0], ahead[at - 1][:, 1, None] + chain.step[1]) + emit[at]
    pairs = np.zeros((2, 2))
    for at in reversed(steps[1:]):
        onward = (behind[at] + emit[at])[:, None, :] + chain.step[None]  # from, to
        behind[at - 1] = np.logaddexp(onward[..., 0], onward[..., 1])
    for at in steps[1:]:
        both = ahead[at - 1][:, :, None] + (behind[at] + emit[at])[:, None, :] + chain.step[None]
        both -= both.max((1, 2), keepdims=True)
        p = np.exp(both)
        pairs += (p / p.sum((1, 2), keepdims=True)).sum(0)
    total = ahead + behind
    return 1 / (1 + np.exp(total[:, 0] - total[:, 1])), pairs


def fit(x: np.ndarray, y: np.ndarray, doc: np.ndarray, rounds: int = 200, rate: float = 0.3, decay: float = 1e-3, begin: Chain | None = None) -> Chain:
    """Maximum likelihood with a Gaussian prior, by gradient steps of adapted length (Adam)."""
    chain, moment, square = begin or Chain(np.zeros(x.shape[1]), np.zeros((2, 2))), 0.0, 0.0
    follows = np.flatnonzero(np.diff(doc) == 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[follows], y[follows + 1]), 1)
    w = np.concatenate((chain.emit, chain.step.ravel()))
    for k in range(1, rounds + 1):
        chain = Chain(w[: x.shape[1]], w[x.shape[1] :].reshape(2, 2))
        p, pairs = expected(x @ chain.emit, doc, chain)
        slope = np.concatenate((x.T @ (y - p), (seen - pairs).ravel())) / len(y) - decay * w
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = w + rate * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Chain(w[: x.shape[1]], w[x.shape[1] :].reshape(2, 2))


def constrained(p: np.ndarray, chars: np.ndarray, doc: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The likelier label of each line, within the shares of characters that its document's label allows."""
    order = np.lexsort((np.where(good, -p, p), doc))  # of a good document the surest content first, of a bad one the surest boilerplate
    before = np.cumsum(chars[order])
    first = np.searchsorted(doc[order], doc[order])
    before = before - chars[order] - np.where(first > 0, before[first - 1], 0)
    whole = np.bincount(doc, weights=chars)[doc[order]]
    forced = np.zeros(len(p), bool)
    forced[order] = before < np.where(good[order], GOOD_SHARE, 1 - BAD_SHARE) * whole
    return np.where(forced, good, p > 0.5).astype(np.int64)


def spliced(doc: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines in order and the chain of each: the documents, and each good one with a bad one, cut and put together crosswise."""
    rng = np.random.default_rng(11)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    end = np.append(first[1:], len(doc))
    goods, bads = np.flatnonzero(good[first]), np.flatnonzero(~good[first])
    order, chain = [np.arange(len(doc))], [doc]
    for k, (a, b) in enumerate(zip(goods, np.resize(bads, len(goods)), strict=True)):
        i, j = rng.integers(first[a], end[a] + 1), rng.integers(first[b], end[b] + 1)
        for side, part in enumerate((np.r_[first[a] : i, j : end[b]], np.r_[first[b] : j, i : end[a]])):
            order.append(part)
            chain.append(np.full(len(part), len(first) + 2 * k + side))
    return np.concatenate(order), np.concatenate(chain)


def fit_lines(x: np.ndarray, good: np.ndarray, doc: np.ndarray, chars: np.ndarray) -> Chain:
    """The chain fitted on lines whose documents alone are labelled: `good` has of each line its document's label."""
    order, place = spliced(doc, good)
    chain = fit(x[order], good[order].astype(np.int64), place, 150)
    for _ in range(TURNS):
        p, _ = expected(x @ chain.emit, doc, chain)
        chain = fit(x[order], constrained(p, chars, doc, good)[order], place, 60, begin=chain)
    return chain


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, lines_each: int = TRAIN_LINES) -> Chain:
    """Fits the chain on at most `most` labelled documents and `lines_each` lines of each (both bound what the driver gets)."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    )
    quality = {r.doc_id: int(r.quality > 0) for r in picked}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = lines_of(as_text(batch.column("text")))
            place = np.arange(len(lines["doc"])) - np.searchsorted(lines["doc"], lines["doc"])
            kept = np.flatnonzero((place < lines_each) & lines["worded"])
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lines["doc"][kept]], pa.int64()), pa.array(place[kept], pa.int64()), pa.array(lines["chars"][kept], pa.int64()), pa.array(list(lines["x"][kept]), pa.list_(pa.float64()))],
                ["doc_id", "place", "chars", "x"],
            )

    wanted = docs.where(F.col("doc_id").isin(list(quality))).select(F.col("doc_id").cast("long"), "text")
    wanted = wanted.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = wanted.mapInArrow(rows, "doc_id long, place long, chars long, x array<double>").toPandas().sort_values(["doc_id", "place"])
    good = got.doc_id.map(quality).to_numpy(np.int64) > 0
    if len(set(good)) < 2:
        return Chain()
    return fit_lines(np.stack(got.x.to_list()), good, got.doc_id.factorize()[0], got.chars.to_numpy())


def verdict(texts: pa.Array, chain: Chain, share: float) -> dict[str, np.ndarray]:
    """The base counts, base_failed, kept, content_share and n_content_lines of each text; doc and label of each line."""
    lines = lines_of(texts)
    out, n = base_counts(texts, lines), len(texts)
    label = viterbi(lines["x"] @ chain.emit, lines["doc"], chain)
    content = np.bincount(lines["doc"], weights=label * lines["chars"], minlength=n)
    whole = np.bincount(lines["doc"], weights=lines["chars"], minlength=n)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    out["content_share"] = np.divide(content, whole, out=np.zeros(n), where=whole > 0)
    out["kept"] = ~out["base_failed"] & (out["content_share"] >= share)
    out["n_content_lines"] = np.bincount(lines["doc"][label == 1], minlength=n)
    return out | {"doc": lines["doc"], "label": label}


def judge(docs: DataFrame, chain: Chain, share: float = CONTENT_SHARE, with_lines: bool = False) -> DataFrame:
    """The verdict on each row: doc_id, the base counts, base_failed, kept, content_share and n_content_lines.

    with_lines: also the text, and an array with the label (1: content) of each of its lines.
    """
    emit, step = chain.emit.tolist(), chain.step.tolist()
    kinds = dict.fromkeys(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], "long") | {"base_failed": "boolean", "kept": "boolean", "content_share": "double", "n_content_lines": "long"}
    schema = "doc_id long, " + ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", text string, lines array<tinyint>" * with_lines

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(np.array(emit), np.array(step))
        for batch in slices(batches):
            found = verdict(as_text(batch.column("text")), own, share)
            out = {"doc_id": batch.column("doc_id")} | {k: pa.array(found[k]) for k in kinds}
            if with_lines:
                cuts = np.flatnonzero(np.diff(found["doc"])) + 1
                out |= {"text": batch.column("text"), "lines": pa.array(np.split(found["label"], cuts), pa.list_(pa.int8()))}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def kept_documents(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs, all columns, whose text the rules keep. The verdict is on the text alone."""
    chain = train(docs, labels)
    emit, step = chain.emit.tolist(), chain.step.tolist()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(np.array(emit), np.array(step))
        for batch in slices(batches):
            yield batch.filter(pa.array(verdict(as_text(batch.column("text")), own, share)["kept"]))

    return docs.mapInArrow(rows, docs.schema)
