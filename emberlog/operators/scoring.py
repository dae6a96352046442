"""Scorers: reconstruction error of windows, isolation forest, kernel novelty, distance in PCA space.

Models are fitted by Spark on all rows; what a model holds does not grow with the data, and rows are
scored in Arrow batches where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.rulebook import WINDOW_LENGTH, WINDOW_STRIDE
from ..workspace import Workspace
from .bind import bind
from .indexing import percentile_values
from .windows import KEY_ROWS, PLACE, sequence_windows

# Sizes of the ensemble's models.
MODEL_SIZES = (16, 24, 32)
# Share of the variance that a reconstruction may keep, and what counts as none at all.
KEPT_VARIANCE, NO_VARIANCE = 0.999, 1e-9
# Directions that one pass over the rows works on, blocks kept before they are condensed, the residual
# (as a share of the largest variance) at which a direction counts as found, and the most passes.
BLOCK, BLOCKS, RESIDUAL, PASSES = 64, 8, 1e-10, 300
# Root mean square error that the kernel's estimate may have in a row; its frequencies are counted from it.
KERNEL_ERROR = 0.02
# Rows whose features a task holds at a time.
SLICE = 1024
# Hashes of a row's key: two of so many hexadecimal digits; mixed with factors below a prime they fit in 63 bits.
HASH_DIGITS, SPAN = 7, (1 << 31) - 1


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def vector_stats(df: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population variance per dimension, and the number of rows; no rows have no dimensions."""
    vector = array_to_vector(F.col(features).cast("array<double>"))
    # A group, unlike the whole table, is not there without rows, of which the summary would fail.
    row = df.groupBy(F.lit("all")).agg(Summarizer.metrics("mean", "variance", "count").summary(vector).alias("s")).select("s.*").first()
    if row is None:
        return np.zeros(0), np.zeros(0), 0
    n = row["count"]
    return np.array(row["mean"]), np.array(row["variance"]) * (n - 1) / max(n, 1), n


def covariance_times(df: DataFrame, features: str, mean: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """The covariance of the rows times a block of columns, in one pass and without the covariance itself.

    Every task sums (x - mean) (x - mean)' block over its rows; the sums meet by dimension.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(block.shape)
        for batch in batches:
            x = _matrix(batch["x"]) - mean if len(batch) else np.zeros((0, len(mean)))
            total += x.T @ (x @ block)
        yield pd.DataFrame({"at": np.arange(len(total)), "part": list(total)})

    parts = (df.select(F.col(features).cast("array<double>").alias("x")).mapInPandas(partial, "at long, part array<double>")
             .groupBy("at").agg(Summarizer.metrics("sum").summary(array_to_vector("part")).alias("s")).select("at", "s.sum"))
    out = np.zeros(block.shape)
    for row in parts.collect():
        out[row["at"]] = row["sum"]
    return out / max(n, 1)


def leading_directions(df: DataFrame, features: str, mean: np.ndarray, n: int, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k directions of most variance and their variances, largest first.

    Rows of at most ``BLOCK`` dimensions take one pass, since the block is then the whole space. Wider ones
    take block power steps: what a block of directions is mapped to widens the space in which the best
    directions are sought, until the residuals of the k best vanish. The driver holds at most
    ``BLOCKS`` blocks, d x (BLOCKS * block) numbers, never d x d.
    """
    d = len(mean)
    width = min(d, max(BLOCK, 2 * k))
    basis = np.eye(d) if width == d else np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    image = covariance_times(df, features, mean, basis, n)
    for _ in range(PASSES):
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        left = image - basis * values
        if basis.shape[1] == d or np.linalg.norm(left[:, :k], axis=0).max() <= RESIDUAL * max(values[0], 0.0):
            break
        if basis.shape[1] + width > BLOCKS * width:
            # The rows' images turn with the basis, so condensing needs no pass.
            basis, image = basis[:, :2 * width], image[:, :2 * width]
        new = left[:, :width] / np.maximum(np.linalg.norm(left[:, :width], axis=0), np.finfo(float).tiny)
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
            new, size = np.linalg.qr(new)
            new = new[:, np.abs(np.diag(size)) > 1e-8][:, :d - basis.shape[1]]
        if not new.shape[1]:
            break
        basis, image = np.hstack([basis, new]), np.hstack([image, covariance_times(df, features, mean, new, n)])
    found = basis[:, :k]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return found * np.where(signs == 0, 1.0, signs), np.maximum(values[:k], 0.0)


@dataclass
class Reconstruction:
    """A linear encoder: the mean and the k directions that keep most of the variance."""

    mean: np.ndarray
    directions: np.ndarray
    floor: float = 0.0

    @classmethod
    def fit(cls, df: DataFrame, features: str, k: int, kept: float | None = None) -> "Reconstruction":
        """At most ``k`` directions; given ``kept``, fewer than hold that share of the variance.

        With as many directions as the rows span, every error would be rounding noise. Errors below
        ``floor``, a billionth of the variance, count as none.
        """
        mean, variance, n = vector_stats(df, features)
        total = float(np.nansum(variance))
        floor = NO_VARIANCE * total / max(len(mean), 1)
        k = min(k, len(mean))
        if k == 0 or total <= 0:
            return cls(mean, np.zeros((len(mean), 0)), floor)
        found, values = leading_directions(df, features, mean, n, min(k + 1, len(mean)))
        if kept is not None:
            k = min(k, int((np.cumsum(values / total) < kept).sum()))
        return cls(mean, found[:, :k], floor)

    def truncated(self, k: int, largest: int | None = None) -> "Reconstruction":
        """The smaller model: directions are ordered by the variance they keep.

        If fewer directions than ``largest`` were kept, ``k`` is the same share of those.
        """
        return Reconstruction(self.mean, self.directions[:, :self._size(k, largest)], self.floor)

    def _size(self, k: int, largest: int | None) -> int:
        have = self.directions.shape[1]
        return -(-k * have // largest) if largest is not None and have < largest else min(k, have)

    def errors(self, features: Column, sizes: Sequence[int], largest: int | None = None) -> Column:
        """The errors of the smaller models of some sizes, in their order: squared projections add up."""
        mean, directions, floor = self.mean, self.directions, self.floor
        kept = [self._size(k, largest) for k in sizes]

        @F.pandas_udf("array<double>")
        def all_mse(column: pd.Series) -> pd.Series:
            x = _matrix(column) - mean
            found = np.concatenate([np.zeros((len(x), 1)), np.cumsum((x @ directions) ** 2, axis=1)], axis=1)
            left = ((x ** 2).sum(axis=1)[:, None] - found[:, kept]) / max(len(mean), 1)
            return pd.Series(list(np.where(left <= floor, 0.0, left)))

        return all_mse(features)

    def error(self, features: Column) -> Column:
        """Mean squared error of encoding and decoding a row."""
        mean, directions, floor = self.mean, self.directions, self.floor

        @F.pandas_udf("double")
        def mse(column: pd.Series) -> pd.Series:
            x = _matrix(column) - mean
            left = ((x ** 2).sum(axis=1) - ((x @ directions) ** 2).sum(axis=1)) / max(len(mean), 1)
            return pd.Series(np.where(left <= floor, 0.0, left))

        return mse(features)

    def norm(self, features: Column) -> Column:
        """Length of the encoded row."""
        mean, directions = self.mean, self.directions

        @F.pandas_udf("double")
        def length(column: pd.Series) -> pd.Series:
            return pd.Series(np.linalg.norm((_matrix(column) - mean) @ directions, axis=1))

        return length(features)


def _places(rows: DataFrame) -> tuple[list[str], str | None]:
    """Columns of rows that were placed per key, and the one that numbers them all."""
    helpers = [c for c in (PLACE, KEY_ROWS) if c in rows.columns]
    return helpers, PLACE if PLACE in helpers else None


def flat_windows(rows: DataFrame, n: int | Column, features: str, seq_len: int = WINDOW_LENGTH,
                 stride: int = WINDOW_STRIDE) -> DataFrame:
    """(win_id, window): the features of a window's rows in order, as one array. A group is one window."""
    helpers, place = _places(rows)
    windows = sequence_windows(rows.select("idx", *helpers, F.col(features).cast("array<double>").alias("x")), n, seq_len, stride,
                               place=place)
    return (windows.groupBy("win_id").agg(F.sort_array(F.collect_list(F.struct("offset", "x"))).alias("rows"))
            .select("win_id", F.flatten("rows.x").alias("window")))


def single_errors(rows: DataFrame, n: int | Column, features: str, model: Reconstruction, **window) -> DataFrame:
    """(win_id, err): mean error of the window's rows, each on its own."""
    helpers, place = _places(rows)
    scored = rows.select("idx", *helpers, model.error(F.col(features)).alias("err"))
    return sequence_windows(scored, n, place=place, **window).groupBy("win_id").agg(F.avg("err").alias("err"))


def sequential_errors(windows: DataFrame, model: Reconstruction) -> DataFrame:
    """(win_id, err): error of each window as one object."""
    return windows.select("win_id", model.error(F.col("window")).alias("err"))


def staged_windows(rows: DataFrame, n: int | Column, features: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Rows (idx, x) and their flat windows, both staged, since every scorer reads them."""
    rows = ws.stage(rows.select("idx", *_places(rows)[0], F.col(features).cast("array<double>").alias("x")), "vectors")
    return rows, ws.stage(flat_windows(rows, n, "x"), "flat_windows")


def fit_models(rows: DataFrame, windows: DataFrame, sizes: Sequence[int] = MODEL_SIZES) -> dict[str, Reconstruction]:
    """One fit per mode: a model with fewer directions is a part of the largest."""
    return {"single_log": Reconstruction.fit(rows, "x", max(sizes), KEPT_VARIANCE),
            "sequential": Reconstruction.fit(windows, "window", max(sizes), KEPT_VARIANCE)}


def ensemble_errors(rows: DataFrame, n: int | Column, features: str, ws: Workspace, sizes: Sequence[int] = MODEL_SIZES,
                    models: dict[str, Reconstruction] | None = None) -> DataFrame:
    """(win_id, model_id, mode, err) for models of several sizes in both modes, fitted here unless given."""
    rows, windows = staged_windows(rows, n, features, ws)
    models = models or fit_models(rows, windows, sizes)
    helpers, place = _places(rows)
    largest, single, whole = max(sizes), models["single_log"], models["sequential"]
    scored = rows.select("idx", *helpers, single.errors(F.col("x"), sizes, largest).alias("errs"))
    means = F.array(*[F.avg(F.get("errs", F.lit(i))) for i in range(len(sizes))]).alias("errs")
    by_mode = {"single_log": sequence_windows(scored, n, place=place).groupBy("win_id").agg(means),
               "sequential": windows.select("win_id", whole.errors(F.col("window"), sizes, largest).alias("errs"))}
    named = lambda errs, mode: errs.select("win_id", F.lit(mode).alias("mode"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("model_id"), F.get("errs", F.lit(i)).alias("err")) for i, k in enumerate(sizes)])))
    return (named(by_mode["single_log"], "single_log").unionByName(named(by_mode["sequential"], "sequential"))
            .select("win_id", "model_id", "mode", "err"))


def custom_errors(windows: DataFrame, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(win_id, err) from a user's model: a function from a batch of flat windows to errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"win_id": batch["win_id"], "err": score(_matrix(batch["window"]))})

    return windows.select("win_id", "window").mapInPandas(run, "win_id long, err double")


def _labelled(scored: DataFrame, limit: float | None, below: bool) -> DataFrame:
    outlier = F.lit(False) if limit is None else (F.col("score") < limit if below else F.col("score") > limit)
    return scored.withColumn("prediction", F.when(outlier, -1).otherwise(1))


# ---- isolation forest ---------------------------------------------------------------------------

def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, mean))


def hashed(text: str) -> int:
    """The first 48 bits of a text's MD5, which any engine can form."""
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def tree_draws(trees: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(tree, a, b, c): a row with hashes h1, h2 is drawn by tree at (a h1 + b h2 + c) modulo ``SPAN``."""
    return [(t, *(1 + hashed(f"{seed}:{t}:{part}") % (SPAN - 1) for part in "abc")) for t in range(trees)]


def _grow(points: np.ndarray, name: str, limit: int) -> dict[str, np.ndarray]:
    """One tree, level by level: node i has the children 2 i + 1 and 2 i + 2.

    A node's hash picks one of the features that differ among its points, and the place of the cut between
    the least and the largest value. Nodes of one point, of equal points or at the limit are leaves; their path is
    their depth and the mean path among their points.
    """
    nodes: dict[int, tuple[int, float, float]] = {}
    level = {0: points}
    for depth in range(limit + 1):
        below = {}
        for at, x in level.items():
            low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(0), np.zeros(0))
            open_features = np.flatnonzero(high > low)
            if depth == limit or not len(open_features):
                nodes[at] = (-1, 0.0, depth + float(_average_path(len(x))))
                continue
            f = int(open_features[hashed(f"{name}:{at}:f") % len(open_features)])
            cut = float(low[f] + (high[f] - low[f]) * (hashed(f"{name}:{at}:c") / 2.0 ** 48))
            nodes[at] = (f, cut, 0.0)
            left = x[:, f] <= cut
            below[2 * at + 1], below[2 * at + 2] = x[left], x[~left]
        level = below
    at = np.array(sorted(nodes))
    table = np.array([nodes[i] for i in at])
    return {"node": at, "feature": table[:, 0].astype(int), "cut": table[:, 1], "path": table[:, 2]}


def _walkable(tree) -> dict[str, np.ndarray]:
    """A grown tree with the places of the children instead of their numbers."""
    node, feature = np.array(tree["node"]), np.array(tree["feature"])
    left = np.where(feature >= 0, np.searchsorted(node, 2 * node + 1), 0)
    return {"feature": feature, "cut": np.array(tree["cut"]), "path": np.array(tree["path"]), "left": left,
            "right": np.where(feature >= 0, np.searchsorted(node, 2 * node + 2), 0)}


def grow_forest(df: DataFrame, key: str, features: str, n: int, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(tree, node, feature, cut, path), one row per tree with its nodes as arrays.

    Every tree draws its points from all rows: the MD5 of the key, mixed by the tree's numbers, keeps some four times
    as many rows as the tree needs, and the lowest (then the least keys) are grown in one bounded group per tree.
    A null key counts as the empty text.
    """
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(features).cast("array<double>").alias("x"))
    limit = SPAN if n <= 4 * sample else int(np.ceil(SPAN * (4.0 * sample / n)))
    digit = lambda at: F.conv(F.substring("md5", at, HASH_DIGITS), 16, 10).cast("long")
    made = bind(rows, {"md5": F.md5(F.col("key").cast("binary"))}).select("key", "x", digit(1).alias("h1"), digit(1 + HASH_DIGITS).alias("h2"))
    draws = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(draw, "tabc")]) for draw in tree_draws(trees, seed)])
    place = lambda d: F.pmod(d["a"] * F.col("h1") + d["b"] * F.col("h2") + d["c"], F.lit(SPAN))
    drawn = F.filter(F.transform(draws, lambda d: F.struct(d["t"].alias("tree"), place(d).alias("at"))), lambda d: d["at"] < limit)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        points = _matrix(group.assign(values=group["x"].map(tuple)).sort_values(["at", "key", "values"])["x"].head(sample))
        grown = _grow(points, f"{seed}:{tree}", int(np.ceil(np.log2(max(len(points), 2)))))
        return pd.DataFrame({"tree": [tree], **{k: [v.tolist()] for k, v in grown.items()}})

    schema = "tree long, node array<long>, feature array<long>, cut array<double>, path array<double>"
    return made.select("key", "x", F.inline(drawn)).groupBy("tree").applyInPandas(grow, schema)


def isolation_forest(df: DataFrame, key: str, features: str, ws: Workspace, trees: int = 100, sample: int = 256,
                     contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """(key, score, prediction): low scores are easy to isolate; the lowest share is -1.

    The forest is data of bounded size (``trees`` trees of at most ``sample`` points), the same whichever engine grows it.
    """
    n = df.count()
    grown = grow_forest(df, key, features, n, trees, sample, seed).collect()
    forest = df.sparkSession.sparkContext.broadcast([_walkable(r) for r in sorted(grown, key=lambda r: r.tree)])
    norm = float(_average_path(min(sample, n))) or 1.0

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        x = _matrix(column)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for tree in forest.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                feature = tree["feature"][at]
                inner = feature >= 0
                if not inner.any():
                    break
                goes_left = x[rows, np.maximum(feature, 0)] <= tree["cut"][at]
                at = np.where(inner, np.where(goes_left, tree["left"][at], tree["right"][at]), at)
            total += tree["path"][at]
        return pd.Series(-np.power(2.0, -(total / len(forest.value)) / norm))

    scored = ws.stage(df.select(key, score(F.col(features)).alias("score")), "forest_scores")
    limit = percentile_values(scored, "score", [contamination], ws)
    return _labelled(scored, limit[0] if limit else None, below=True)


# ---- kernel novelty and PCA distance ------------------------------------------------------------

def kernel_frequencies(d: int, error: float = KERNEL_ERROR, seed: int = 42) -> np.ndarray:
    """One row per frequency of a Gaussian kernel of width one over d dimensions.

    A frequency's estimate of a similarity is a cosine whose variance is at most 1/2, and so is that of a mean of
    similarities. 1 / (2 error^2) independent ones hence miss the mean by ``error`` at most (root mean square). They are drawn
    in blocks of d that are orthogonal to one another and as long as normal vectors are, which spreads them more evenly.
    """
    rng = np.random.default_rng(seed)
    wanted = int(np.ceil(1.0 / (2.0 * error ** 2)))
    if not d:
        return np.zeros((wanted, 0))
    blocks = [np.linalg.qr(rng.normal(size=(d, d)))[0] * np.sqrt(rng.chisquare(d, size=(d, 1))) for _ in range(-(-wanted // d))]
    return np.vstack(blocks)[:wanted]


def rbf_novelty(df: DataFrame, key: str, features: str, ws: Workspace, share: float = 0.05, seed: int = 42,
                error: float = KERNEL_ERROR) -> DataFrame:
    """(key, score, prediction): mean RBF similarity to all rows; the least similar share is -1.

    The kernel is a product of Fourier features (cosines and sines of ``kernel_frequencies``), so the mean similarity to all
    rows is the product with the rows' mean feature vector: one pass for the mean, one for the scores. Rows
    are mapped in slices of a batch, so that a task holds ``SLICE`` rows' features at most.
    """
    mean, variance, n = vector_stats(df, features)
    # One over the number of dimensions times the variance of all entries.
    spread = float(variance.mean() + mean.var()) if len(mean) else 0.0
    gamma = 1.0 / (max(len(mean), 1) * spread) if spread else 1.0
    frequencies = df.sparkSession.sparkContext.broadcast(kernel_frequencies(len(mean), error, seed).T * np.sqrt(2.0 * gamma))

    def waves(column: pd.Series) -> Iterator[np.ndarray]:
        for at in range(0, len(column), SLICE):
            angles = _matrix(column.iloc[at:at + SLICE]) @ frequencies.value
            yield np.hstack([np.cos(angles), np.sin(angles)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * frequencies.value.shape[1])
        for batch in batches:
            total += sum(part.sum(axis=0) for part in waves(batch["x"]))
        yield pd.DataFrame({"total": [total]})

    sums = df.select(F.col(features).cast("array<double>").alias("x")).mapInPandas(partial, "total array<double>")
    row = sums.groupBy(F.lit("all")).agg(Summarizer.metrics("sum").summary(array_to_vector("total")).alias("s")).select("s.sum").first()
    centre = (np.array(row["sum"]) if row else 0.0) / (max(n, 1) * frequencies.value.shape[1])

    @F.pandas_udf("double")
    def similarity(column: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0), *[part @ centre for part in waves(column)]]))

    scored = ws.stage(df.select(key, similarity(F.col(features)).alias("score")), "kernel_scores")
    limit = percentile_values(scored, "score", [share], ws)
    return _labelled(scored, limit[0] if limit else None, below=True)


def pca_norm(df: DataFrame, key: str, features: str, ws: Workspace, k: int = 2, percentile: float = 95) -> DataFrame:
    """(key, score, prediction): distance from the centre in k principal directions; above the percentile is -1."""
    model = Reconstruction.fit(df, features, k)
    scored = ws.stage(df.select(key, model.norm(F.col(features)).alias("score")), "pca_scores")
    limit = percentile_values(scored, "score", [percentile / 100], ws)
    return _labelled(scored, limit[0] if limit else None, below=False)
