"""The whole batch run: raw lines to labelled anomalies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import detect as dt, scoring as sc
from ..operators.features import Preprocessor
from ..operators.parsing import parse_preset
from ..operators.templates import Mined, mine
from ..operators.windows import Placed, place_rows
from ..sources.text import SPLIT, number_lines
from ..workspace import Workspace
from .presets import PRESETS, Preset
from .trained import Trained


@dataclass
class Run:
    structured: DataFrame
    events: Mined
    preprocessor: Preprocessor
    detection: dt.Detection
    trained: Trained


def structure(lines: DataFrame, preset: Preset, ws: Workspace) -> tuple[DataFrame, Mined]:
    """Raw lines (of ``read_logs``) to numbered rows with their event; staged, since all else reads it."""
    parsed = number_lines(parse_preset(lines, preset, keep=SPLIT), ws).drop(*SPLIT)
    events = mine(parsed, preset, ws)
    return ws.stage(events.events(parsed), "structured"), events


def analyze_logs(lines: DataFrame, preset: Preset | str, ws: Workspace, mode: str = "both",
                 preprocessor: Preprocessor | None = None, model: dt.SeverityModel | None = None,
                 sizes: Sequence[int] = sc.MODEL_SIZES, key: str | None = None) -> Run:
    """Parse, mine, build features, train, score windows in both modes, flag and label.

    Features and scorers learn from the first 70 % of the lines, the models' weights from the next
    15 %. A saved preprocessor and severity model may be given. With ``key`` (a column of the layout)
    each of its values has lines, windows and shares of its own, and no window mixes them.
    """
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    rows, events = structure(lines, preset, ws)
    if key is None:
        # Lines are numbered already.
        n = rows.count()
        placed = Placed(rows.withColumn("idx", F.col("line_id") - 1), n, n)
    else:
        placed = place_rows(rows, ["line_id"], ws, key)
    trained, errors = Trained.fit_placed(placed, ws, sizes, preprocessor)
    found = dt.detect_windows(placed.rows, placed.n, errors, ws, mode, model or trained.severity, key=key)
    return Run(rows, events, trained.preprocessor, found, trained)
