"""Features of parsed logs: fitted on one table, applied to others."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import has, regex, word_count
from ..plans.rulebook import CONTENT_FLAGS, STOP_WORDS
from ..workspace import Workspace
from .bind import bind
from .indexing import index_rows
from .lookup import lookup_join
from .quality import passes_gate

TEMPORAL_COLUMNS = ("line_id", "time", "date", "pid", "month")
NUMERIC = ("content_length", "content_word_count", *CONTENT_FLAGS)
INFREQUENT = "infrequent"


def drop_temporal(df: DataFrame) -> DataFrame:
    """Without columns that would tie a model to a time or a process."""
    return df.drop(*TEMPORAL_COLUMNS)


def content_features(df: DataFrame) -> DataFrame:
    content = F.col("content")
    return df.withColumns({"content_length": F.length(content), "content_word_count": word_count(content),
                           **{name: has(content, pattern) for name, pattern in CONTENT_FLAGS.items()}})


# ---- template words -----------------------------------------------------------------------------

def template_grams(template: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of three or more letters without stop words, and pairs of neighbours among them."""
    found = F.regexp_extract_all(F.lower(template), F.lit(regex(r"\b[a-zA-Z]{3,}\b")), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*stop_words))
    pairs = F.transform(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))),
                        lambda w, i: F.concat(F.get(kept, i), F.lit(" "), w))
    return F.concat(kept, pairs)


@dataclass
class Tfidf:
    """A vocabulary in alphabetical order with the inverse document frequency of each term."""

    terms: list[str]
    idf: list[float]

    @classmethod
    def fit(cls, df: DataFrame, template: str = "event_template", size: int = 50, min_df: int = 3,
            max_df: float = 0.7) -> "Tfidf":
        """Rows with equal templates are counted first, so the terms are formed once per template."""
        docs = df.groupBy(F.col(template).alias("t")).agg(F.count(F.lit(1)).alias("rows"))
        n = df.count()
        stats = term_stats(docs).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
        top = stats.orderBy(F.desc("tf"), "term").limit(size)
        rows = top.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf")).orderBy("term").collect()
        return cls([r.term for r in rows], [r.idf for r in rows])

    def weights(self, grams: Column) -> Column:
        """Term count times idf, in the order of ``terms``."""
        terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("idf")) for t, w in zip(self.terms, self.idf)])
        return F.transform(terms, lambda t: (F.size(grams) - F.size(F.array_remove(grams, t["term"]))) * t["idf"])

    def transform(self, df: DataFrame, ws: Workspace, template: str = "event_template", out: str = "tfidf") -> DataFrame:
        """Add the array of weights, of unit length, or zeros if no term occurs.

        Weights are worked out once per distinct template and looked up by the rows.
        """
        if not self.terms:
            return df.withColumn(out, F.array().cast("array<double>"))
        docs = df.groupBy(template).agg(F.count(F.lit(1)).alias("_rows"))
        docs = bind(docs, {"_grams": template_grams(F.col(template))})
        docs = bind(docs, {"_w": self.weights(F.col("_grams"))})
        docs = bind(docs, {"_norm": F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, x: a + x * x))})
        unit = F.transform("_w", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0))
        weighted = ws.stage(docs.select(template, "_rows", unit.alias(out)), "tfidf", measure=True)
        joined = lookup_join(df, weighted, [template], "left", weight="_rows").drop("_rows")
        # A row without a template has no term.
        return joined.withColumn(out, F.coalesce(out, F.array_repeat(F.lit(0.0), len(self.terms))))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, tf, df) over templates ``t`` that occur in ``rows`` rows each."""
    grams = docs.select("t", "rows", F.explode(template_grams(F.col("t"))).alias("term"))
    per_doc = grams.groupBy("t", "rows", "term").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum(F.col("n") * F.col("rows")).alias("tf"), F.sum("rows").alias("df"))


# ---- categories and numbers ---------------------------------------------------------------------

def fit_categories(df: DataFrame, column: str, size: int = 50) -> tuple[list[str], bool]:
    """Kept categories in order, and whether the rest shares one infrequent bucket.

    Of more than ``size`` categories the most common size - 1 are kept; among equals the later in order.
    """
    counts = df.groupBy(F.col(column).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.desc("c")).limit(size + 1).collect()
    if len(top) <= size:
        return sorted(r.c for r in top if r.c is not None), False
    return sorted(r.c for r in top[: size - 1] if r.c is not None), True


def known_categories(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("c")).distinct()


def bucket(column: Column, kept: Sequence[str], infrequent: bool) -> Column:
    """The category itself, the infrequent bucket, or null if neither (unseen)."""
    value = column.cast("string")
    chain = F.when(value.isin(*kept), value) if kept else F.when(F.lit(False), value)
    return chain.otherwise(F.lit(INFREQUENT)) if infrequent else chain


def one_hot(column: Column, kept: Sequence[str], infrequent: bool) -> Column:
    """Array of 0/1 per kept category, then one for the infrequent bucket; all zero if unseen."""
    names = [*kept, INFREQUENT] if infrequent else list(kept)
    at = bucket(column, kept, infrequent)
    return F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce((n == at).cast("double"), F.lit(0.0)))


def label_encode(df: DataFrame, column: str, ws: Workspace, out: str | None = None) -> DataFrame:
    """Alphabetical integer codes. The distinct values are numbered apart from the rows."""
    out = out or f"{column}_code"
    values = df.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    codes = ws.stage(index_rows(values.filter(F.col(column).isNotNull()), [column], ws, out), "codes", measure=True)
    return lookup_join(df, codes, [column], "left", weight="_rows").drop("_rows")


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, from one aggregate."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = column_stats(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c][0])) for c in columns})


def scaled(column: Column, mean: float | None, std: float | None) -> Column:
    """Distance from the mean in population deviations; 0 for a constant column."""
    return F.lit(0.0) if not std else (column - mean) / std


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = column_stats(df, columns)
    return df.withColumns({c: scaled(F.col(c), *stats[c]) for c in columns})


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def chrono_split(df: DataFrame, n: int | Column, train: float = 0.7, validation: float = 0.15, idx: str = "idx") -> DataFrame:
    """Add ``split`` by position: first train, next validation, the rest test; sizes are truncated."""
    part = lambda share: int(share * n) if isinstance(n, int) else F.floor(F.lit(share) * n)
    first = part(train)
    second = first + part(validation)
    return df.withColumn("split", F.when(F.col(idx) < first, "train").when(F.col(idx) < second, "validation").otherwise("test"))


@dataclass
class Preprocessor:
    """Everything learned from training logs: vocabulary, categories, means and deviations."""

    tfidf: Tfidf | None = None
    categories: dict[str, tuple[list[str], bool]] = field(default_factory=dict)
    numeric: dict[str, tuple[float, float]] = field(default_factory=dict)
    scale: list[tuple[float, float]] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, ws: Workspace, max_templates: int = 1000) -> "Preprocessor":
        columns = [c for c in ("level", "component", "event_id") if c in df.columns]
        use_template = "event_template" in df.columns and passes_gate(df, "event_template", max_templates)
        self = cls(Tfidf.fit(df) if use_template else None)
        size = 50 if use_template else 100
        self.categories = {c: fit_categories(df, c, size) for c in columns}
        self.numeric = column_stats(content_features(df), NUMERIC)
        wide = self._raw(df, ws).select(array_to_vector("_raw").alias("v"))
        stats = wide.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*").first()
        shrink = (stats["count"] - 1) / stats["count"] if stats["count"] else 0.0
        self.scale = [(float(m), math.sqrt(v * shrink)) for m, v in zip(stats["mean"], stats["variance"])]
        return self

    def _raw(self, df: DataFrame, ws: Workspace) -> DataFrame:
        """``_raw``: template weights, then categories, then numbers, as one array."""
        rows = content_features(df)
        parts = []
        if self.tfidf is not None:
            rows = self.tfidf.transform(rows, ws)
            parts.append(F.col("tfidf"))
        parts += [one_hot(F.col(c), kept, rest) for c, (kept, rest) in self.categories.items()]
        parts.append(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(mean)) for c, (mean, _) in self.numeric.items()]))
        return rows.withColumn("_raw", F.concat(*parts))

    def transform(self, df: DataFrame, ws: Workspace) -> DataFrame:
        """Add ``features``: the scaled vector. Unseen categories are zeros, missing numbers the mean."""
        means = F.array(*[F.lit(m) for m, _ in self.scale])
        stds = F.array(*[F.lit(s or 0.0) for _, s in self.scale])
        unit = F.transform("_raw", lambda x, i: F.when(F.get(stds, i) > 0, (x - F.get(means, i)) / F.get(stds, i)).otherwise(0.0))
        keep = df.columns
        return self._raw(df, ws).select(*keep, array_to_vector(unit).alias("features"))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "fitted string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preprocessor":
        data = json.loads(spark.read.text(path).first()[0])
        pairs = lambda d: {k: tuple(v) for k, v in d.items()}
        return cls(Tfidf(**data["tfidf"]) if data["tfidf"] else None, pairs(data["categories"]), pairs(data["numeric"]),
                   [tuple(p) for p in data["scale"]])
