"""Train once, score many: what a run learns, kept in one folder."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import detect as dt, scoring as sc
from ..operators.features import Preprocessor, chrono_split
from ..operators.windows import KEY_ROWS, Placed, place_rows, sequence_windows
from ..workspace import Workspace

Scorer = Callable[[np.ndarray], np.ndarray]


def _placed(rows: DataFrame, ws: Workspace, key: str | None = None) -> Placed:
    """Parsed rows with their 0-based position in the order of ``line_id``, which may have gaps."""
    numbered = ws.stage(rows.withColumn("_line", F.col("line_id").cast("long")), "parsed", measure=True)
    return place_rows(numbered, ["_line"], ws, key)


def _validation(errors: DataFrame, vectors: DataFrame, placed: Placed) -> DataFrame:
    """The errors of windows that begin in the validation part, of each key if there is one."""
    if placed.key is None:
        split = chrono_split(errors.withColumn("idx", F.col("win_id") * sc.WINDOW_STRIDE), placed.n)
        return split.filter("split = 'validation'")
    starts = sequence_windows(vectors.select("idx", *placed.helpers), placed.n, place=placed.place).filter(F.col("offset") == 0)
    return errors.join(chrono_split(starts, placed.n).filter("split = 'validation'").select("win_id"), "win_id")


def model_weights(errors: DataFrame, validation: DataFrame, sizes: Sequence[int]) -> dict[str, dict[int, float]]:
    """Per mode the models' weights by 1/loss on the validation windows; equal ones if there are none."""
    rows = validation.groupBy("mode", "model_id").agg(F.avg("err").alias("loss"))
    out = {}
    for mode in dt.MODES:
        found = {r.model_id: r.w for r in dt.ensemble_weights(rows.filter(F.col("mode") == mode)).collect()}
        out[mode] = found or {k: 1.0 for k in sizes}
    return out


def weighted_errors(errors: DataFrame, weights: dict[str, dict[int, float]], ws: Workspace) -> DataFrame:
    """(win_id, sequential_error, single_error): the weighted mean of the models, one aggregate for both modes."""
    table = errors.sparkSession.createDataFrame(
        [(mode, int(k), float(w)) for mode, of in weights.items() for k, w in of.items()] or [("", 0, 0.0)],
        "mode string, model_id int, w double")
    joined = errors.join(F.broadcast(table), ["mode", "model_id"])
    mean = lambda mode: (F.sum(F.when(F.col("mode") == mode, F.col("w") * F.col("err")))
                         / F.sum(F.when(F.col("mode") == mode, F.col("w"))))
    return ws.stage(joined.groupBy("win_id").agg(mean("sequential").alias("sequential_error"),
                                                 mean("single_log").alias("single_error")), "window_errors")


@dataclass
class Trained:
    """Features, models and their weights per mode, and severity thresholds.

    All of it is of fixed size: it does not grow with the logs it was learned from.
    """

    preprocessor: Preprocessor
    models: dict[str, sc.Reconstruction]
    weights: dict[str, dict[int, float]]
    severity: dt.SeverityModel
    sizes: tuple[int, ...] = sc.MODEL_SIZES

    @classmethod
    def fit(cls, structured: DataFrame, ws: Workspace, sizes: Sequence[int] = sc.MODEL_SIZES, key: str | None = None) -> Trained:
        """Learn from a parsed table: features and models from its first 70 %, weights from the next 15 %.

        With ``key`` these are shares of each key's rows.
        """
        return cls.fit_placed(_placed(structured, ws, key), ws, sizes)[0]

    @classmethod
    def fit_placed(cls, placed: Placed, ws: Workspace, sizes: Sequence[int] = sc.MODEL_SIZES,
                   preprocessor: Preprocessor | None = None) -> tuple[Trained, DataFrame]:
        """What is learned from rows in order, and the errors of all their windows."""
        if preprocessor is None:
            preprocessor = Preprocessor.fit(chrono_split(placed.rows, placed.n).filter("split = 'train'").drop("split"), ws)
        vectors = ws.stage(cls._vectors(placed, preprocessor, ws), "all_vectors")
        known = F.floor(0.7 * placed.n).cast("long") if placed.key else int(0.7 * placed.n)
        part = vectors.filter(F.col("idx") < known)
        if placed.key:
            part = part.withColumn(KEY_ROWS, known)
        part, windows = sc.staged_windows(part, F.col(KEY_ROWS) if placed.key else known, "x", ws)
        if windows.isEmpty():
            # Too few rows for a window in the first part.
            part, windows = sc.staged_windows(vectors, placed.n, "x", ws)
        models = sc.fit_models(part, windows, sizes)
        errors = ws.stage(sc.ensemble_errors(vectors, placed.n, "x", ws, sizes, models), "model_errors")
        weights = model_weights(errors, _validation(errors, vectors, placed), sizes)
        errors = weighted_errors(errors, weights, ws)
        both = errors.select(F.explode(F.array("sequential_error", "single_error")).alias("error"))
        return cls(preprocessor, models, weights, dt.SeverityModel.fit(both, "error", ws), tuple(sizes)), errors

    @staticmethod
    def _vectors(placed: Placed, preprocessor: Preprocessor, ws: Workspace) -> DataFrame:
        return preprocessor.transform(placed.rows, ws).select("idx", *placed.helpers, vector_to_array("features").alias("x"))

    def errors(self, placed: Placed, ws: Workspace, scorer: Scorer | None = None) -> DataFrame:
        """(win_id, sequential_error, single_error) of the windows of rows in order."""
        vectors = self._vectors(placed, self.preprocessor, ws)
        errors = weighted_errors(sc.ensemble_errors(vectors, placed.n, "x", ws, self.sizes, self.models), self.weights, ws)
        if scorer is not None:
            _, windows = sc.staged_windows(vectors, placed.n, "x", ws)
            own = sc.custom_errors(windows, scorer).withColumnRenamed("err", "sequential_error")
            errors = ws.stage(errors.drop("sequential_error").join(own, "win_id"), "window_errors")
        return errors

    def score(self, structured: DataFrame, ws: Workspace, mode: str = "both", scorer: Scorer | None = None,
              key: str | None = None) -> dt.Detection:
        """Detect in a parsed table. ``scorer`` replaces the models of sequences: flat windows to errors."""
        placed = _placed(structured, ws, key)
        return dt.detect_windows(placed.rows, placed.n, self.errors(placed, ws, scorer), ws, mode, self.severity, key=key)

    def save(self, spark: SparkSession, folder: str) -> None:
        self.preprocessor.save(spark, f"{folder}/preprocessor")
        models = {m: {"mean": r.mean.tolist(), "directions": r.directions.tolist(), "floor": r.floor} for m, r in self.models.items()}
        held = {"models": models, "weights": self.weights, "severity": asdict(self.severity), "sizes": list(self.sizes)}
        spark.createDataFrame([(json.dumps(held),)], "fitted string").coalesce(1).write.mode("overwrite").text(f"{folder}/scorers")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Trained:
        held = json.loads(spark.read.text(f"{folder}/scorers").first()[0])
        models = {m: sc.Reconstruction(np.array(r["mean"]), np.array(r["directions"]).reshape(len(r["mean"]), -1), r["floor"])
                  for m, r in held["models"].items()}
        weights = {m: {int(k): w for k, w in of.items()} for m, of in held["weights"].items()}
        severity = held["severity"]
        return cls(Preprocessor.load(spark, f"{folder}/preprocessor"), models, weights,
                   dt.SeverityModel(severity["thresholds"], tuple(severity["percentiles"]), severity["stats"]), tuple(held["sizes"]))
