"""Event template mining as joins and aggregates over words.

Equal normalized lines ("shapes") are folded together first; all later steps work on shapes and
their counts. A shape is named by its first line, so no step depends on the order of arrival.
Word frequencies are joined back through a bounded broadcast for frequent words and a shuffle for
the rest. Variable positions are found without moving the words: a 64-bit set of word hashes proves
that a position holds enough distinct words, and only undecided positions are counted exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_parameter, normalized, words
from ..plans.presets import PRESETS, Preset
from ..workspace import Workspace, sized_like
from .bind import once
from .indexing import index_rows
from .lookup import lookup_join

GROUP = ["n_tokens", "root_freq", "root_count"]
MASK = "<*>"


# ---- words and their frequencies -------------------------------------------------------------

def explode_tokens(df: DataFrame, preset: Preset, content: str = "content", key: str = "line_id") -> DataFrame:
    """(key, pos, word): every word of the normalized content with its 0-based position."""
    return df.select(key, F.posexplode(words(normalized(F.col(content), preset))).alias("pos", "word"))


def length_groups(df: DataFrame, preset: Preset, content: str = "content") -> DataFrame:
    """Lines per number of words."""
    size = F.size(words(normalized(F.col(content), preset)))
    return df.groupBy(size.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_lines"))


def line_shapes(df: DataFrame, preset: Preset, ws: Workspace, content: str = "content",
                key: str = "line_id") -> DataFrame:
    """Distinct normalized lines: text, first line, number of lines."""
    shape = normalized(F.col(content), preset).alias("norm")
    return ws.stage(df.groupBy(shape).agg(F.min(key).alias("sid"), F.count(F.lit(1)).alias("n")), "shapes")


def positional_token_freq(shapes: DataFrame) -> DataFrame:
    """(pos, word, freq): in how many lines the word stands at the position."""
    return (shapes.select("n", F.posexplode(words(F.col("norm"))).alias("pos", "word"))
            .groupBy("pos", "word").agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("rows")))


def join_token_freq(shapes: DataFrame, ws: Workspace) -> DataFrame:
    """(sid, n, pos, word, freq): each word of each shape with its frequency.

    Words seen once are left out of the look-up table: they are most of a vocabulary.
    """
    repeated = ws.stage(positional_token_freq(shapes).filter("freq > 1"), "token_freq", measure=True)
    # Whole lines are dealt by their key before they are taken apart: their words then meet again
    # without another shuffle, unless the look-up itself needs one.
    tokens = shapes.repartition("sid").select("sid", "n", F.posexplode(words(F.col("norm"))).alias("pos", "word"))
    return (lookup_join(tokens, repeated, ["pos", "word"], "left", weight="rows")
            .select("sid", "n", "pos", "word", F.coalesce("freq", F.lit(1)).alias("freq")))


def _combinations(freqs: Column) -> Column:
    """For each distinct frequency of a line: how many words share it, and where it first occurs.

    Frequencies are sorted with their positions, so each is a run: linear but for the sort.
    """

    def runs(placed: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda i: (i == 0) | (
            F.get(placed, i)["freq"] != F.get(placed, F.greatest(i - 1, F.lit(0)))["freq"]))
        return once(begins, lambda at: F.transform(at, lambda i, j: F.struct(
            (F.coalesce(F.get(at, j + 1), F.size(placed)) - i).alias("n"),
            (-(F.get(placed, i)["pos"] + 1)).alias("earliest"), F.get(placed, i)["freq"].alias("freq"))))

    placed = F.array_sort(F.transform(freqs, lambda f, i: F.struct(f.alias("freq"), i.alias("pos"))))
    return F.when(F.size(freqs) > 0, once(placed, runs))


def annotated_shapes(shapes: DataFrame, ws: Workspace) -> DataFrame:
    """One row per shape: its words, their frequencies, which are parameters, and its root.

    The root is the frequency shared by most words of the line; ties go to the earliest position.
    """
    tokens = join_token_freq(shapes, ws).withColumn("param", is_parameter(F.col("word")))
    rows = (tokens.groupBy("sid", "n")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "word", "freq", "param"))).alias("t"))
            .select("sid", "n", F.size("t").alias("n_tokens"), F.col("t.word").alias("words"),
                    F.col("t.freq").alias("freqs"), F.col("t.param").alias("params")))
    root = F.array_max(_combinations(F.col("freqs")))
    rows = rows.withColumn("root", root)
    return ws.stage(rows.select("sid", "n", "n_tokens", "words", "freqs", "params",
                                F.col("root.freq").alias("root_freq"),
                                F.col("root.n").cast("int").alias("root_count")), "annotated")


def frequency_combinations(annotated: DataFrame) -> DataFrame:
    """(sid, n, freq, n_words): how many words of a shape share each frequency."""
    return (annotated.select("sid", "n", F.explode(_combinations(F.col("freqs"))).alias("c"))
            .select("sid", "n", F.col("c.freq").alias("freq"), F.col("c.n").alias("n_words")))


# ---- groups and their variable words ----------------------------------------------------------

def root_groups(annotated: DataFrame, *more: Column) -> DataFrame:
    """Groups of equal length and root, with their first line, lines and shapes."""
    return annotated.groupBy(*GROUP).agg(F.min("sid").alias("first_line"), F.sum("n").alias("n_lines"),
                                         F.count(F.lit(1)).alias("rows"), *more)


def _candidates(annotated: DataFrame, ws: Workspace) -> DataFrame:
    """Groups with the positions at which their first line's frequency differs from the root's."""
    positions = F.sequence(F.lit(0), F.col("n_tokens") - 1)
    differs = F.filter(positions, lambda i: F.get("freqs", i) != F.col("root_freq"))
    return ws.stage(root_groups(annotated, F.min_by("freqs", "sid").alias("freqs"))
                    .select(*GROUP, "first_line", "n_lines", "rows", differs.alias("candidates")), "groups", measure=True)


def child_variables(annotated: DataFrame, groups: DataFrame, threshold: int, ws: Workspace) -> DataFrame:
    """(group, pos, literal): candidate positions that hold at least ``threshold`` distinct words.

    ``literal`` tells whether some of these words are no parameters by themselves.
    """
    at = F.transform("candidates", lambda i: F.struct(
        i.alias("pos"), F.get("words", i).alias("word"), F.get("params", i).alias("param")))
    tokens = (lookup_join(annotated.select(*GROUP, "words", "params"),
                          sized_like(groups.select(*GROUP, "rows", "candidates"), groups), GROUP, weight="rows")
              .select(*GROUP, F.explode(at).alias("t")).select(*GROUP, "t.*"))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(word), 64) as int))")
    seen = ws.stage(tokens.groupBy(*GROUP, "pos").agg(
        F.bit_count(F.bit_or(bit)).alias("at_least"), F.count(F.lit(1)).alias("rows"),
        F.max(~F.col("param")).alias("literal")), "seen", measure=True)
    proven = seen.filter(F.col("at_least") >= threshold).select(*GROUP, "pos", "literal")
    undecided = seen.filter((F.col("at_least") < threshold) & (F.col("rows") >= threshold))
    counted = (lookup_join(tokens.drop("param"), sized_like(undecided.select(*GROUP, "pos", "rows", "literal"), seen),
                           [*GROUP, "pos"], weight="rows")
               .select(*GROUP, "pos", "word", "literal").distinct()
               .groupBy(*GROUP, "pos", "literal").agg(F.count(F.lit(1)).alias("n_words"))
               .filter(F.col("n_words") >= threshold).select(*GROUP, "pos", "literal"))
    return proven.unionByName(counted)


def variable_groups(annotated: DataFrame, threshold: int, ws: Workspace) -> DataFrame:
    """Groups with their variable positions as an array; ``literal`` if these hold words that are no parameters."""
    groups = _candidates(annotated, ws)
    positions = (child_variables(annotated, groups, threshold, ws)
                 .groupBy(*GROUP).agg(F.sort_array(F.collect_list("pos")).alias("variable"), F.max("literal").alias("literal")))
    return ws.stage(groups.join(positions, GROUP, "left")
                    .withColumn("variable", F.coalesce("variable", F.array().cast("array<int>")))
                    .withColumn("literal", F.coalesce("literal", F.lit(False))), "variable_groups", measure=True)


def _grouped_tokens(annotated: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
    """Words of all shapes with their group and whether they stand at a variable position."""
    token = F.transform("words", lambda w, i: F.struct(
        i.alias("pos"), w.alias("word"), F.get("params", i).alias("param"),
        F.array_contains("variable", i).alias("at_variable")))
    return (lookup_join(annotated, sized_like(groups.select(*GROUP, "rows", "variable"), groups), GROUP, weight="rows")
            .select(*columns, *GROUP, F.explode(token).alias("t")).select(*columns, *GROUP, "t.*"))


def variable_words(annotated: DataFrame, groups: DataFrame, ws: Workspace) -> DataFrame:
    """(sid, n, pos, word): words that are in their group's variable set, at any position.

    At a variable position every word is in the set. Elsewhere the word is looked up among the
    (group, word) pairs that occur on both sides; these are found by one pre-aggregated shuffle.
    """
    tokens = _grouped_tokens(annotated, groups, "sid", "n")
    crossing = ws.stage(_crossing(tokens), "crossing_words", measure=True)
    inside = tokens.filter("at_variable").select("sid", "n", "pos", "word")
    elsewhere = lookup_join(tokens.filter("not at_variable"), crossing, [*GROUP, "word"], weight="rows")
    return inside.unionByName(elsewhere.select("sid", "n", "pos", "word"))


def _crossing(tokens: DataFrame) -> DataFrame:
    return (tokens.groupBy(*GROUP, "word")
            .agg(F.max("at_variable").alias("inside"), F.max(~F.col("at_variable")).alias("outside"),
                 F.count(F.lit(1)).alias("rows"))
            .filter("inside and outside").select(*GROUP, "word", "rows"))


# ---- templates --------------------------------------------------------------------------------

@dataclass
class Mined:
    """Results of mining: the event of each shape, and the catalogue of events."""

    shapes: DataFrame
    catalogue: DataFrame
    preset: Preset

    def events(self, df: DataFrame, content: str = "content") -> DataFrame:
        """Add event_id and event_template to the lines that were mined."""
        keyed = df.withColumn("norm", normalized(F.col(content), self.preset))
        # A line without content has no event, and stays.
        return lookup_join(keyed, self.shapes, ["norm"], "left", weight="n").drop("norm", "n")


def shape_templates(df: DataFrame, preset: Preset, ws: Workspace, content: str = "content",
                    key: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """Shapes with their draft template, and the catalogue of final templates per group and draft.

    A draft masks parameters and variable positions. Words that are variable elsewhere in their group
    are masked in the catalogue, which is far smaller than the shapes.
    """
    annotated = annotated_shapes(line_shapes(df, preset, ws, content, key), ws)
    groups = variable_groups(annotated, preset.threshold, ws)
    masked = F.transform("words", lambda w, i: F.when(
        F.get("params", i) | F.array_contains("variable", i), MASK).otherwise(w))
    positions = sized_like(groups.select(*GROUP, "rows", "variable"), groups)
    drafts = ws.stage(lookup_join(annotated, positions, GROUP, weight="rows")
                      .select("sid", "n", *GROUP, F.array_join("words", " ").alias("norm"),
                              F.array_join(masked, " ").alias("draft")), "drafts", measure=True)
    catalogue = (drafts.groupBy(*GROUP, "draft")
                 .agg(F.min("sid").alias("first_line"), F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("rows")))
    literal = groups.filter("literal")
    if literal.isEmpty():
        catalogue = catalogue.withColumn("template", F.col("draft"))
    else:
        crossing = _crossing(_grouped_tokens(annotated, sized_like(literal, groups)).filter("not param"))
        word = catalogue.select(*GROUP, "first_line", F.posexplode(words(F.col("draft"))).alias("pos", "word"))
        final = (word.join(crossing.select(*GROUP, "word", F.lit(MASK).alias("mask")), [*GROUP, "word"], "left")
                 .groupBy("first_line").agg(F.sort_array(F.collect_list(F.struct(
                     "pos", F.coalesce("mask", "word").alias("word")))).alias("t"))
                 .select("first_line", F.array_join("t.word", " ").alias("template")))
        catalogue = catalogue.join(final, "first_line")
    # Order of first appearance: by length, then by group, then by line.
    lengths = groups.groupBy("n_tokens").agg(F.min("first_line").alias("length_first"))
    firsts = groups.select(*GROUP, F.col("first_line").alias("group_first"))
    return drafts, ws.stage(catalogue.join(lengths, "n_tokens").join(firsts, GROUP), "catalogue", measure=True)


def assign_event_ids(catalogue: DataFrame, ws: Workspace) -> DataFrame:
    """(event_id, event_template, occurrences): ``E0``, ``E1`` … in order of first appearance."""
    order = ["length_first", "group_first", "first_line"]
    events = (catalogue.groupBy("template")
              .agg(F.min(F.struct(*order)).alias("at"), F.sum("n_lines").alias("occurrences"))
              .select("template", "occurrences", "at.*"))
    return (index_rows(sized_like(events, catalogue), order, ws, "number")
            .select(F.concat(F.lit("E"), F.col("number").cast("string")).alias("event_id"),
                    F.col("template").alias("event_template"), "occurrences"))


def hashed_event_ids(catalogue: DataFrame) -> DataFrame:
    """Ids that need no order and stay equal between runs: a hash of the template."""
    return (catalogue.groupBy("template").agg(F.sum("n_lines").alias("occurrences"))
            .select(F.concat(F.lit("E"), F.hex(F.xxhash64("template"))).alias("event_id"),
                    F.col("template").alias("event_template"), "occurrences"))


def mine(df: DataFrame, preset: Preset | str, ws: Workspace, content: str = "content", key: str = "line_id",
         hashed_ids: bool = False) -> Mined:
    """Mine the templates of ``df``; ``.events(df)`` then labels its lines."""
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    drafts, catalogue = shape_templates(df, preset, ws, content, key)
    events = sized_like(hashed_event_ids(catalogue) if hashed_ids else assign_event_ids(catalogue, ws), catalogue)
    named = lookup_join(catalogue.select(*GROUP, "draft", "rows", F.col("template").alias("event_template")),
                        sized_like(events.select("event_id", "event_template"), events), ["event_template"])
    shapes = lookup_join(drafts.select("norm", "n", *GROUP, "draft"), sized_like(named, catalogue), [*GROUP, "draft"],
                         weight="rows").select("norm", "n", "event_id", "event_template")
    return Mined(ws.stage(shapes, "mined_shapes", measure=True), events, preset)


def parse_accuracy(truth: DataFrame, parsed: DataFrame, key: str = "line_id") -> DataFrame:
    """Pairwise F1 and grouping accuracy of parsed event ids against labelled ones.

    Pairs are counted as n(n-1)/2 per group and never formed. A line counts as right if the lines of
    its parsed event are exactly the lines of one labelled event.
    """
    both = (truth.select(key, F.col("event_id").alias("truth_id"))
            .join(parsed.select(key, F.col("event_id").alias("parsed_id")), key)
            .groupBy("truth_id", "parsed_id").agg(F.count(F.lit(1)).cast("double").alias("n")))
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    by_truth = both.groupBy("truth_id").agg(F.sum("n").alias("n_truth"))
    by_parsed = both.groupBy("parsed_id").agg(F.sum("n").alias("n_parsed"))
    cells = both.join(by_truth, "truth_id").join(by_parsed, "parsed_id")
    share = cells.withColumn("w_truth", F.col("n") / F.col("n_truth")).withColumn("w_parsed", F.col("n") / F.col("n_parsed"))
    half = lambda n: n * (n - 1) / 2
    exact = (F.col("n") == F.col("n_truth")) & (F.col("n") == F.col("n_parsed"))
    return (share.agg(pairs(F.col("n")).alias("hits"),
                      F.sum(half(F.col("n_truth")) * F.col("w_truth")).alias("truth_pairs"),
                      F.sum(half(F.col("n_parsed")) * F.col("w_parsed")).alias("parsed_pairs"),
                      (F.sum(F.when(exact, F.col("n")).otherwise(0.0)) / F.sum("n")).alias("accuracy"))
            .withColumn("precision", F.coalesce(F.try_divide("hits", "parsed_pairs"), F.lit(1.0)))
            .withColumn("recall", F.coalesce(F.try_divide("hits", "truth_pairs"), F.lit(1.0)))
            .select("precision", "recall",
                    F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                            F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"),
                    "accuracy"))
