"""Hard negatives from an inverted multi-index (operator 11).

Vectors are cut into two halves. Two codebooks, one for each half-space and trained on a bounded sample (SAMPLE rows, by
hash of the id), give each row a pair of codewords: its cell. Every row is indexed, and the radius of a codeword is the
largest distance of any row's half from it. For an anchor, a codeword's half-score bound is its inner product with the
anchor's half plus that half's length times the radius; a cell's bound is the sum of two. The multi-sequence heap visits the
cells from the greatest bound down. A search asks for the first few rows whose scores lie in windows; it ends for an anchor
when each window is certified: the bound of the next cell lies below the window, or below the last of enough rows
found. First the positives are searched (rows of the anchor's label, one open window), then the negatives (other
labels, a window for each positive). All of it is exact.

Work is dealt in blocks: a cell's rows by hash to blocks of some BLOCK rows, the anchors that ask for the cell to blocks of
as many, and a pair of blocks is one product of matrices, so that no task holds a cell or all anchors. A round visits four
times the rows of the round before; anchors that are certified leave. Rounds are written to the shared folder.

Scores are exact whole numbers however large the components are: products that a double can't hold are made in 64-bit
arithmetic, and one by one where even sums of that might wrap. A positive's score that no long holds is an error, as a
component beyond LARGEST is.

Null ids, labels and vectors and vectors with a null or non-finite component take no part; short
vectors are filled up with zeros; rows that share an id count once, as that of least label, then least vector. Ties in
score go to the smaller id. An empty table gives no rows. Columns beyond those named aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows that train the codebooks; most codewords of a half; rows of a block; a component's bound, so that bounds of scores are finite.
SAMPLE, MOST_WORDS, BLOCK, LARGEST = 4096, 64, 2048, 1e100
#: Rows that an anchor's first round visits at least, and the share of all rows; how much more each later round visits.
FIRST_ROWS, FIRST_SHARE, MORE = 4096, 64, 4
NONE = -(1 << 63) + 1
#: A score of this size stands for all from there on; those below are exact.
WIDEST = (1 << 63) - 2


def trained(half: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """A codebook by k-means from evenly spread rows of a sample, which stands in an order of its own."""
    centres = half[np.linspace(0, len(half) - 1, words).astype(int)].astype(float)
    for _ in range(rounds):
        near = nearest(half, centres)[0]
        count = np.bincount(near, minlength=words)
        total = np.zeros_like(centres)
        np.add.at(total, near, half)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row, and its distance."""
    near = np.argmin((centres**2).sum(1) - 2 * half @ centres.T, axis=1)
    return near, np.sqrt(((half - centres[near]) ** 2).sum(1))


class MultiIndex:
    """Two codebooks, their radii, and the rows and radii of each cell."""

    def __init__(self, books: list[np.ndarray]):
        self.books, self.words = books, len(books[0])
        self.cut = books[0].shape[1]
        self.rows = np.zeros((self.words, self.words), np.int64)
        self.cell_radii = np.zeros((2, self.words, self.words))
        self.radii = np.zeros((2, self.words))

    def halves(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, : self.cut], vectors[:, self.cut :]]

    def count(self, cells: list) -> None:
        """From rows of cell, count and radii."""
        for r in cells:
            i, j = divmod(r.cell, self.words)
            self.rows[i, j] = r.n
            self.cell_radii[:, i, j] = r.radius_a, r.radius_b
        self.radii = np.stack([self.cell_radii[0].max(1), self.cell_radii[1].max(0)])

    def cells(self, vector: np.ndarray) -> Iterator[tuple[float, int, float, float]]:
        """The cells that have rows, by the multi-sequence heap: a bound of this and all later ones, the cell, and the greatest and least score of its own rows."""
        halves = [vector[: self.cut], vector[self.cut :]]
        inner = [b @ h for b, h in zip(self.books, halves, strict=True)]
        length = [float(np.sqrt((h * h).sum())) for h in halves]
        # Room for what floating-point sums lose, in proportion to what is summed.
        norms = [np.sqrt((b * b).sum(1)) for b in self.books]
        room = [1e-9 * n * (c + r) for n, c, r in zip(length, norms, self.radii, strict=True)]
        bound = [x + n * r + e for x, n, r, e in zip(inner, length, self.radii, room, strict=True)]
        order = [np.argsort(-b, kind="stable") for b in bound]
        a, b = (x[o].tolist() for x, o in zip(bound, order, strict=True))
        queue, pushed = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}
        while queue:
            total, i, j = heappop(queue)
            for at in ((i + 1, j), (i, j + 1)):
                if at[0] < self.words and at[1] < self.words and at not in pushed:
                    pushed.add(at)
                    heappush(queue, (-(a[at[0]] + b[at[1]]), *at))
            u, v = int(order[0][i]), int(order[1][j])
            if self.rows[u, v]:
                middle, spread = inner[0][u] + inner[1][v], length[0] * self.cell_radii[0, u, v] + length[1] * self.cell_radii[1, u, v] + 1e-9 * (length[0] * (norms[0][u] + self.cell_radii[0, u, v]) + length[1] * (norms[1][v] + self.cell_radii[1, u, v]))
                yield raised(-total), u * self.words + v, raised(middle + spread), -raised(spread - middle)


def raised(bound: float) -> float:
    """A bound with room for the rounding of the last sum."""
    return bound + 1e-9 * abs(bound) + 1e-3


def wrapped(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2 ** 64."""
    low = np.fmod(np.abs(vectors), 2.0**64).astype(np.uint64)
    return np.where(vectors < 0, ~low + np.uint64(1), low)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of rows of whole numbers, exact below WIDEST; greater ones are WIDEST, with their sign."""
    near = a @ b.T
    size = np.abs(a).max(1, initial=0)[:, None] * np.abs(b).max(1, initial=0)[None, :] * max(1, a.shape[1])
    if size.max(initial=0) < 2.0**53:
        return near.astype(np.int64)
    out = (wrapped(a) @ wrapped(b).T).view(np.int64)
    lost = size * a.shape[1] * 2.0**-50  # of the sum in floating point
    beyond = np.abs(near) - lost >= WIDEST
    out[beyond] = np.where(near[beyond] < 0, -WIDEST, WIDEST)
    for i, j in np.argwhere(~beyond & (np.abs(near) + lost >= WIDEST)):
        exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True))
        out[i, j] = max(-WIDEST, min(WIDEST, exact))
    return out


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def ready(rows: DataFrame) -> DataFrame:
    """The rows that take part, one an id, vectors of one length: id, label, anchor, vector (array<int>)."""
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.when(F.abs(x) < 2.0**52, x.cast("long").cast("double")).when(F.abs(x) < LARGEST, x).otherwise(F.raise_error(F.lit("a component is too large: no score with it fits a long")))
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), "anchor", F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fit)
    rows = rows.select("id", "label", "anchor", F.transform("vector", whole).alias("vector"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("x")).select("id", "x.label", "x.anchor", "x.vector")


def build(rows: DataFrame, scratch: Scratch, words: int | None = None) -> tuple[MultiIndex, DataFrame]:
    """The index of some rows, and the rows with cell and block."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    vectors = vectors_of(sample.column("vector"))
    words = min(words or max(1, round(n**0.25)), MOST_WORDS, len(vectors))
    index = MultiIndex([vectors[:, : vectors.shape[1] // 2], vectors[:, vectors.shape[1] // 2 :]])
    index = MultiIndex([trained(h, words) for h in index.books])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (a, ra), (b, rb) = (nearest(h, book) for h, book in zip(index.halves(vectors_of(batch.column("vector"))), index.books, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((a * words + b).astype(np.int32)), pa.array(ra), pa.array(rb)], [*batch.schema.names, "cell", "radius_a", "radius_b"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    placed_rows = scratch.table(rows.mapInArrow(placed, f"{kinds}, cell int, radius_a double, radius_b double"), "placed")
    index.count(placed_rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius_a").alias("radius_a"), F.max("radius_b").alias("radius_b")).collect())  # MOST_WORDS squared rows at most
    return index, placed_rows


def blocks_of(index: MultiIndex) -> F.Column:
    """How many blocks the rows of a cell are dealt to."""
    counts = np.maximum(1, -(-index.rows.ravel() // BLOCK))
    return F.element_at(F.array(*[F.lit(int(x)) for x in counts]), F.col("cell") + 1)


def search(index: MultiIndex, placed: DataFrame, anchors: DataFrame, same_label: bool, first: int, scratch: Scratch, keep: tuple[DataFrame, ...] = ()) -> DataFrame:
    """For each anchor and window the first rows by score, then id: anchor_id, window, rank, id, score.

    anchors: anchor_id, label, vector, lows and highs (array<long>, the windows' ends). Rows of the anchor's own label, or all others.
    Of the scratch tables those in `keep` stay.
    """
    n_anchors, n_rows = anchors.count(), int(index.rows.sum())
    parts = max(1, -(-n_anchors // BLOCK))
    state = anchors.select("anchor_id", "label", "vector", "lows", "highs", F.lit(0).alias("seen"))
    best = anchors.sparkSession.createDataFrame([], "anchor_id long, window int, id long, score long")
    rows_now = max(FIRST_ROWS, n_rows // FIRST_SHARE)
    kinds = f"anchor_id long, label long, vector {dict(anchors.dtypes)['vector']}, lows array<long>, highs array<long>, seen int, cell int, bound double"

    def visits(most: int):
        """For each anchor a row for each cell to visit, and one with cell -1: how many cells have been seen, and the bound of the rest (null: none is left)."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, seen, cells, bounds = [], [], [], []
                if not batch.num_rows:
                    continue
                for k, (vector, low, high, before) in enumerate(zip(vectors_of(batch.column("vector")), *(batch.column(c).to_pylist() for c in ("lows", "highs", "seen")), strict=True)):
                    open_windows = [(a, b) for a, b in zip(low, high, strict=True) if a <= b]
                    least, greatest = min((a for a, _ in open_windows), default=0), max((b for _, b in open_windows), default=NONE)
                    rest, rows, passed = None, 0, 0
                    for n, (bound, cell, top, bottom) in enumerate(index.cells(vector)):
                        if n < before:
                            continue
                        if bound < least or rows >= most or not open_windows:
                            rest = bound
                            break
                        passed += 1
                        if top >= least and bottom <= greatest:
                            rows += int(index.rows.ravel()[cell])
                            at.append(k)
                            seen.append(0)
                            cells.append(cell)
                            bounds.append(None)
                    at.append(k)
                    seen.append(before + passed)
                    cells.append(-1)
                    bounds.append(rest)
                take = pa.array(at, pa.int64())
                arrays = [batch.column(c).take(take) for c in ("anchor_id", "label", "vector", "lows", "highs")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(seen, pa.int32()), pa.array(cells, pa.int32()), pa.array(bounds, pa.float64())], ["anchor_id", "label", "vector", "lows", "highs", "seen", "cell", "bound"])

        return of

    def scored(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The first rows in each window of each anchor, of one block of anchors and one block of rows."""
        out = {"anchor_id": [], "window": [], "id": [], "score": []}
        if asked.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            ids, names = rows.column("id").to_numpy(), asked.column("anchor_id").to_numpy()
            scores = products(vectors_of(asked.column("vector")), vectors_of(rows.column("vector")))
            fit = asked.column("label").to_numpy()[:, None] == rows.column("label").to_numpy()[None, :]
            fit = fit & (names[:, None] != ids[None, :]) if same_label else ~fit
            lows, highs = (np.array(asked.column(c).to_pylist(), np.int64) for c in ("lows", "highs"))
            # One number orders rows by score and then by place, which is by id.
            small = np.abs(scores).max() < WIDEST // len(ids)
            places = scores if small else np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
            ordered, few = places * len(ids) + np.arange(len(ids))[::-1], min(first, len(ids))
            for w in range(lows.shape[1]):
                inside = fit & (scores >= lows[:, w, None]) & (scores <= highs[:, w, None])
                some = np.flatnonzero(inside.any(1))
                if len(some):
                    top = np.partition(np.where(inside[some], ordered[some], NONE), len(ids) - few, axis=1)[:, len(ids) - few :]
                    i, j = np.nonzero(top != NONE)
                    at = len(ids) - 1 - top[i, j] % len(ids)
                    for c, v in zip(out, (names[some[i]], np.full(len(i), w), ids[at], scores[some[i], at]), strict=True):
                        out[c].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({c: pa.array(np.concatenate(v) if v else [], t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    in_order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    while True:
        made = scratch.table(state.mapInArrow(visits(rows_now), kinds), "visits")
        blocks = blocks_of(index)  # keys of both sides have the same types, or equal ones would be dealt to different tasks
        asked = made.where("cell >= 0").select("anchor_id", "label", "vector", "lows", "highs", "cell", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        dealt = placed.select("id", "label", "vector", "cell", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        key = ("cell", "block", "part")
        found = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(scored, "anchor_id long, window int, id long, score long")
        best = scratch.table(best.unionByName(found).withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= first).drop("rank"), "best")
        # What each window still needs: nothing below the last of enough rows; a window is closed where no later cell reaches it.
        after = made.where("cell < 0").join(_lasts(best, first), "anchor_id", "left")
        needs = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.element_at("last", w), low)))
        lows = F.transform(needs, lambda need: F.when(F.col("bound").isNull() | (F.col("bound") < need), F.lit(-NONE)).otherwise(need))
        after = after.select("anchor_id", "label", "vector", lows.alias("lows"), "highs", "seen")
        state = scratch.table(after.where(F.exists(F.arrays_zip("lows", "highs"), lambda x: x["lows"] <= x["highs"])), "state")
        scratch.drop_all_but(placed, best, state, *keep)
        if state.isEmpty():
            return best.withColumn("rank", F.row_number().over(in_order))
        rows_now *= MORE


def _lasts(best: DataFrame, first: int) -> DataFrame:
    """The score of the last of enough rows by window, for the windows that have enough: anchor_id, last (map)."""
    full = best.groupBy("anchor_id", "window").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") >= first)
    return full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "last"))).alias("last"))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, words: int | None = None) -> DataFrame:
    """Of each anchor and positive the first negatives: see RESULT.

    rows: id, label, vector (array of whole numbers), anchor (boolean). A negative's score is between low and high percent of the positive's.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    part = ready(rows)
    every = scratch.table(part, "rows")
    most, largest = every.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).head()
    if most is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    zeros = F.array_repeat(F.lit(0.0), F.lit(most) - F.size("vector"))
    kind = "array<int>" if (largest or 0) < 1 << 31 else "array<double>"
    index, placed = build(every.withColumn("vector", F.concat("vector", zeros).cast(kind)), scratch, words)
    anchors = placed.where("anchor").select(F.col("id").alias("anchor_id"), "label", "vector")
    wide = F.array(F.lit(NONE))
    near = search(index, placed, anchors.select("*", wide.alias("lows"), F.array(F.lit(-NONE - 1)).alias("highs")), True, positives, scratch)
    held = F.when(F.abs("score") < WIDEST, F.col("score")).otherwise(F.raise_error(F.lit("a positive's score doesn't fit a long")).cast("long"))
    near = scratch.table(near.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), held.alias("positive_score")), "positives")
    # A window for each positive, in order; low * p <= 100 * n <= high * p in whole numbers, hundreds and rest apart.
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    p = lambda f: F.transform("p", lambda x: f(x["positive_score"]))
    hundreds = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))  # noqa: E731  rounded down
    hundredths = lambda k, x: k * hundreds(x) + hundreds(k * F.pmod(x, F.lit(100)))  # noqa: E731  of k * x
    up, down = (lambda x: -hundredths(low, -x)), (lambda x: hundredths(high, x))
    windows = windows.select("anchor_id", p(up).alias("lows"), p(down).alias("highs"))
    lengthened = lambda c, fill: F.concat(c, F.array_repeat(F.lit(fill), F.lit(positives) - F.size(c)))
    windows = windows.select("anchor_id", lengthened("lows", -NONE).alias("lows"), lengthened("highs", NONE).alias("highs"))
    found = search(index, placed, anchors.join(windows, "anchor_id"), False, negatives, scratch, (near,))
    found = found.select("anchor_id", (F.col("window") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(found, ["anchor_id", "place"]).select(*(x.split()[0] for x in RESULT.split(", ")))
