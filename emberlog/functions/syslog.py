"""Expressions over collected payloads: a JSON envelope or a raw syslog line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from ..plans.rulebook import AUTH_LINE, KERNEL_LINE, NOISE_PROGRAM, NOISE_WORDS, SYSLOG_LINE
from .text import capture, regex, strip

FIELDS = ("timestamp", "hostname", "process", "program", "pid", "uptime", "message")

ENVELOPE = T.StructType([
    T.StructField("message", T.StringType()),
    T.StructField("log", T.StructType([T.StructField("file", T.StructType([T.StructField("path", T.StringType())]))])),
    T.StructField("host", T.StructType([T.StructField("hostname", T.StringType())])),
    T.StructField("@timestamp", T.StringType()),
])

# Which group of a layout holds which field.
_LAYOUTS = (
    (AUTH_LINE, {"timestamp": 1, "hostname": 2, "process": 3, "pid": 5, "message": 6}),
    (SYSLOG_LINE, {"timestamp": 1, "hostname": 2, "program": 3, "pid": 4, "message": 5}),
    (KERNEL_LINE, {"timestamp": 1, "hostname": 2, "uptime": 3, "message": 4}),
)


def which_layout(line: Column) -> Column:
    """Number of the first layout that fits the start of the line; null if none does."""
    chain = None
    for i, (pattern, _) in enumerate(_LAYOUTS):
        hit = F.rlike(line, F.lit(regex("^" + pattern)))
        chain = F.when(hit, i) if chain is None else chain.when(hit, i)
    return chain


def syslog_fields(line: Column, layout: Column) -> Column:
    """Array in the order of FIELDS for a line whose layout is known; ``''`` where the layout lacks one."""
    chain = None
    for i, (pattern, groups) in enumerate(_LAYOUTS):
        fields = capture(line, regex("^" + pattern + r"(?s:.*)$"), [groups.get(f) for f in FIELDS])
        chain = F.when(layout == i, fields) if chain is None else chain.when(layout == i, fields)
    return chain


def is_json_object(payload: Column) -> Column:
    """Whether the payload is one complete JSON object; bare scalars and arrays count as raw text."""
    braces = F.startswith(F.ltrim(payload), F.lit("{")) & F.endswith(F.rtrim(payload), F.lit("}"))
    return F.coalesce(braces & F.try_parse_json(payload).isNotNull(), F.lit(False))


def envelope(payload: Column) -> Column:
    """Struct of message, path, hostname and timestamp, with defaults for what is absent."""
    body = F.from_json(payload, ENVELOPE)
    unknown = F.lit("unknown")
    return F.struct(F.coalesce(body["message"], F.lit("")).alias("message"),
                    F.coalesce(body["log"]["file"]["path"], unknown).alias("path"),
                    F.coalesce(body["host"]["hostname"], unknown).alias("hostname"),
                    F.coalesce(body["@timestamp"], unknown).alias("timestamp"))


def is_noise(message: Column, words: Sequence[str] = NOISE_WORDS) -> Column:
    text, hit = F.lower(message), F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def from_noise_program(parsed: Column, program: str = NOISE_PROGRAM) -> Column:
    by = lambda f: F.coalesce(parsed[f] == program, F.lit(False))
    return by("program") | by("process")


def format_syslog(parsed: Column) -> Column:
    """``timestamp hostname program[pid]: message``."""
    unknown = F.lit("unknown")
    program = F.coalesce(F.nullif(parsed["program"], F.lit("")), parsed["process"], unknown)
    pid = F.when(F.coalesce(parsed["pid"], F.lit("")) != "", F.concat(F.lit("["), parsed["pid"], F.lit("]")))
    return F.concat(F.coalesce(parsed["timestamp"], unknown), F.lit(" "), F.coalesce(parsed["hostname"], unknown),
                    F.lit(" "), program, F.coalesce(pid, F.lit("")), F.lit(": "),
                    F.coalesce(parsed["message"], F.lit("")))


def short_line(body: Column) -> Column:
    return F.concat(body["timestamp"], F.lit(" "), body["hostname"], F.lit(" "), body["path"], F.lit(": "),
                    strip(body["message"]))
