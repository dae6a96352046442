"""Column expressions over raw text. Everything here stays in built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..plans.presets import Preset

# Unicode classes and only "\n" as line end, as the usual scripting regex engines have it.
DIALECT = "(?dU)"
_MARK = "\u0001"


def regex(pattern: str, ignore_case: bool = False) -> str:
    return ("(?diU)" if ignore_case else DIALECT) + pattern


def strip(col: Column) -> Column:
    return F.regexp_replace(col, regex(r"^\s+|\s+$"), "")


def _parentheses(part: str):
    """(character, what follows) for each parenthesis that is neither escaped nor in brackets."""
    bare = re.sub(r"\\.|\[[^\]]*\]", lambda m: " " * len(m.group()), part)
    return [(m.group(), bare[m.end():m.end() + 1]) for m in re.finditer(r"[()]", bare)]


def compile_format(log_format: str, atomic: bool = True) -> tuple[str, dict[str, tuple[int, int | None]]]:
    """Turn ``<Month> <Date> <Content>`` into an anchored pattern.

    Also gives each header's group number and the number of the optional group around it, if any.
    Parentheses written by the user take group numbers too.

    A header between spaces ends at the first space if the line fits at all: the header after the
    spaces can take up whatever it would have held. ``atomic`` says so in the pattern, or lines that
    do not fit would be tried in a number of ways that grows with a power of their words. It holds for
    text without line breaks.
    """
    pattern, headers, open_groups, optional, count = "^", {}, [], set(), 0
    parts = re.findall(r"<[^<>]+>|[^<]+|<", log_format)
    for i, part in enumerate(parts):
        header = re.fullmatch(r"<([^<>]+)>", part)
        if header:
            count += 1
            headers[header.group(1)] = (count, open_groups[-1] if open_groups else None)
            spaced = i + 2 < len(parts) and not parts[i + 1].strip(" ") and parts[i + 2].startswith("<")
            pattern += r"(?>(.*?)(?=\s))" if atomic and spaced and not open_groups else "(.*?)"
            continue
        for mark, following in _parentheses(part):
            if mark == "(":
                count += following != "?"
                open_groups.append(count if following != "?" else None)
            else:
                closed = open_groups.pop()
                if following in ("?", "*"):
                    optional.add(closed)
        pattern += re.sub(" +", lambda _: r"\s+", part)
    around = {h: (n, o if o in optional else None) for h, (n, o) in headers.items()}
    return pattern + "$", around


def snake(name: str) -> str:
    """``EventTemplate`` → ``event_template``; ``PID`` → ``pid``."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def capture(col: Column, pattern: str, numbers: Sequence[int | None]) -> Column:
    """All wanted groups as one array, with a single run of the pattern per row.

    The groups are joined by a control character and split again; a line that itself holds that
    character takes the slower way of one extraction per group. A group that took no part, or whose
    number is None, is ``''``.
    """
    joined = _MARK.join(f"${n}" if n else "" for n in numbers)
    fast = F.split(F.regexp_replace(col, pattern, joined), _MARK, -1)
    slow = F.array(*[F.regexp_extract(col, pattern, n) if n else F.lit("") for n in numbers])
    return F.when(F.contains(col, F.lit(_MARK)), slow).otherwise(fast)


def mask(col: Column, masks: Sequence[str]) -> Column:
    """Replace whatever each pattern hits by ``<*>``, in order."""
    for pattern in masks:
        col = F.regexp_replace(col, regex(pattern), "<*>")
    return col


def delete(col: Column, deletions: Sequence[str]) -> Column:
    for pattern in deletions:
        if pattern:
            col = F.regexp_replace(col, regex(pattern), "")
    return col


def space_out(col: Column, separators: Sequence[str]) -> Column:
    """Add a space after each separator, so that it ends its word."""
    for mark in separators:
        col = F.replace(col, F.lit(mark), F.lit(mark + " "))
    return col


def single_spaced(col: Column) -> Column:
    """Space after commas, and no runs of spaces: the text whose words are counted."""
    return F.regexp_replace(F.replace(col, F.lit(","), F.lit(", ")), " +", " ")


def normalized(col: Column, preset: Preset) -> Column:
    """Content as the miner sees it: masked, cleared, separators spaced out, single spaced."""
    return single_spaced(space_out(delete(mask(col, preset.masks), preset.deletions), preset.separators))


def words(col: Column) -> Column:
    """Split on single spaces; leading and trailing spaces give empty words."""
    return F.split(col, " ", -1)


def is_parameter(word: Column) -> Column:
    """A word that holds a mask, or of which at least three tenths are digits."""
    digits = F.length(F.regexp_replace(word, r"\P{Nd}", ""))
    return F.contains(word, F.lit("<*>")) | ((digits > 0) & (digits / F.length(word) >= 0.3))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(regex(r"\S+")))


def has(col: Column, pattern: str) -> Column:
    """1 if the pattern hits, regardless of case; 0 if not or if the text is missing."""
    return F.coalesce(F.rlike(col, F.lit(regex(pattern, ignore_case=True))), F.lit(False)).cast("int")


def rule_text(template: Column, content: Column) -> Column:
    """The text that the rules look at: patterns may hit across the seam."""
    blank = F.lit("")
    return F.lower(F.concat(F.coalesce(template, blank), F.lit(" "), F.coalesce(content, blank)))
