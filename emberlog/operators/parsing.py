"""Lines to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import capture, compile_format, regex, snake, strip
from ..plans.presets import PRESETS, Preset
from .bind import bind


def parse_logs(df: DataFrame, log_format: str, line: str = "value", keep: Sequence[str] = (),
               rejects: bool = False) -> DataFrame:
    """Each header of the format as a column; lines that do not fit are dropped.

    ``rejects=True`` gives those lines instead. A header inside an optional part is null where the
    part is absent.
    """
    pattern, headers = compile_format(log_format)
    pattern, plain = regex(pattern), regex(compile_format(log_format, atomic=False)[0])
    broken = lambda text: F.contains(text, F.lit("\n"))
    hit = lambda text: F.when(broken(text), F.rlike(text, F.lit(plain))).otherwise(F.rlike(text, F.lit(pattern)))
    fits = lambda text: F.coalesce(hit(text), F.lit(False))
    if rejects:
        return df.filter(~fits(strip(F.col(line))))
    numbers = sorted({n for pair in headers.values() for n in pair if n})
    slot = {n: i for i, n in enumerate(numbers)}
    text = F.col("_line")
    lines = bind(df.select(*keep, F.col(line).alias("_raw")), {"_line": strip(F.col("_raw"))})
    captured = F.when(broken(text), capture(text, plain, numbers)).otherwise(capture(text, pattern, numbers))
    parts = lines.filter(fits(text)).select(*keep, captured.alias("_parts"))
    columns = []
    for header, (number, around) in headers.items():
        value = F.get("_parts", F.lit(slot[number]))
        if around:
            value = F.when(F.get("_parts", F.lit(slot[around])) != "", value)
        columns.append(value.alias(snake(header)))
    return parts.select(*keep, *columns)


def parse_preset(df: DataFrame, preset: Preset | str, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    return parse_logs(df, preset.log_format, line, keep)
