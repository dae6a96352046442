"""Document fingerprints by winnowing.

A text is its words; a k-gram is K words in a row. The hash of a k-gram is a polynomial over GF(2)
in the words' 56-bit codes, c1*x^4 + c2*x^3 + ... + c5, which rolls: the next one is the present one
without its first term, times x, plus the next code. Of every W neighbouring k-grams the one with
the least hash is kept, the rightmost of equals, with its position. So two texts that share
K + W - 1 words in a row share a kept k-gram, and its positions say where.

Everything is built-in expressions on the words of one row; minima over W = 8 neighbours take three
rounds of pairwise minima (over 2, 4 and 8), so the work is linear in the text.

Defined cases: a null text is the empty text; a text without words has the empty fingerprint; one
of fewer than K words has one k-gram of all its words, one of fewer than W k-grams one minimum;
two empty fingerprints are alike (1.0), an empty and another are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bound, let, texts, words

K, W = 5, 8
CODE_DIGITS = 14
# Rows that one range of neighbouring documents holds, and the most ranges.
RANGE_ROWS, MAX_RANGES = 1_000, 100_000


def _code(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, CODE_DIGITS), 16, 10).cast("long")


def _hashes(w: Column) -> Column:
    """Hashes of all k-grams of a list of words."""

    def of(codes: Column) -> Column:
        n = F.size(codes)

        def gram(first: Column) -> Column:
            value = F.get(codes, first + (K - 1))
            for back in range(1, K):
                value = value.bitwiseXOR(F.shiftleft(F.get(codes, first + (K - 1 - back)), back))
            return value

        short = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.shiftleft(h, 1).bitwiseXOR(c))
        long = F.transform(F.sequence(F.lit(0), n - K), gram)
        return F.when(n >= K, long).when(n > 0, F.array(short)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(w, _code), of)


def _winnowed(h: Column) -> Column:
    """Positions of the kept k-grams: the rightmost least of each window."""
    n = F.size(h)

    def lower(at: Column, step: int) -> Column:
        """Of each place and the one ``step`` further the one with the lower hash."""
        def pick(i: Column, j: Column) -> Column:
            return let(F.get(at, j + step), lambda k: F.when(F.get(h, k) <= F.get(h, i), k).otherwise(i))
        return F.transform(F.slice(at, 1, F.greatest(F.size(at) - step, F.lit(0))), pick)

    places = F.sequence(F.lit(0), n - 1)
    best = let(let(places, lambda a: lower(a, 1)), lambda b: let(lower(b, 2), lambda c: lower(c, 4)))
    least = lambda: F.reduce(places, F.lit(0), lambda k, i: F.when(F.get(h, i) <= F.get(h, k), i).otherwise(k))
    return (F.when(n >= W, F.array_distinct(best)).when(n > 0, F.array(least()))
            .otherwise(F.array().cast("array<int>")))


def fingerprint(text: Column) -> Column:
    """Struct of ``hashes`` (with repeats, by position) and ``positions``."""
    kept = lambda h: let(_winnowed(h), lambda at: F.struct(
        F.transform(at, lambda i: F.get(h, i)).alias("hashes"), at.alias("positions")))
    return let(words(text), lambda w: let(_hashes(w), kept))


def as_string(print_: Column) -> Column:
    """Hexadecimal hash and position of each kept k-gram: ``hash@position``, joined by spaces."""
    return F.array_join(F.zip_with(print_["hashes"], print_["positions"],
                                   lambda h, i: F.concat(F.hex(h), F.lit("@"), i.cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two lists of hashes."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(either, F.lit(0)))


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with the number of their range, in descending order of documents.

    Cut points are documents' ids, so that ranges hold about as many rows each. The first document
    of a range is repeated at the end of the range before it, the very first one at the end of the
    last: then each document finds the next one in its own range. One shuffle of the texts; no
    range grows with the table.
    """
    first = docs.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).first()
    ranges = max(1, min(MAX_RANGES, -(-first.n // RANGE_ROWS)))
    cuts = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        got = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 20 * ranges)).first()[0] or []
        cuts = sorted({*got} - {first.top}, reverse=True)
    low = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    # Two levels keep the search short: blocks of cuts, then the cuts of one block.
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    above = lambda values: F.size(F.filter(F.array(*[F.lit(c) for c in values]), lambda c: c >= low)) if values else F.lit(0)
    block = above([b[-1] for b in blocks])
    within = F.size(F.filter(F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), F.col("_block")), lambda c: c >= low)) if blocks else F.lit(-1)
    placed = (docs.withColumn("_block", block)
              .withColumn("_range", F.least(F.col("_block") * step + F.greatest(within, F.lit(0)), F.lit(len(cuts)))))
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("again"))
    head = F.get(F.array(*map(F.lit, cuts)), F.col("_range") - 1) if cuts else F.lit(None).cast("long")
    before = F.struct((F.col("_range") - 1).alias("range"), F.lit(True).alias("again"))
    last = F.struct(F.lit(len(cuts)).alias("range"), F.lit(True).alias("again"))
    top = F.col("doc_id").eqNullSafe(F.lit(first.top).cast("long"))
    copies = F.array_compact(F.array(own, F.when(head == F.col("doc_id"), before), F.when(top, last)))
    return placed.select("doc_id", "text", F.inline(copies))


def query(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited form ends in the beginning of the next document. Documents of equal ids are ordered
    by text; a single document is its own next one; no documents give no rows.
    """
    order = Window.partitionBy("range").orderBy("again", F.col("doc_id").desc_nulls_last(), "text")
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("_next"), F.lit(1), part))
    rows = (beside_next(texts(docs)).withColumn("_next", F.lead("text").over(order))
            .select("doc_id", "range", "again", "text", F.when(~F.col("again"), edited).alias("edited")))
    rows = bound(rows, fingerprint(F.col("text")), "own")
    rows = bound(rows, F.when(~F.col("again"), fingerprint(F.col("edited"))), "other")
    rows = rows.withColumn("_next", F.lead("own.hashes").over(order)).filter(~F.col("again"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"), as_string(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own.hashes"), F.col("other.hashes")).alias("near_edited"),
        likeness(F.col("own.hashes"), F.col("_next")).alias("near_next"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT rid, doc_id, t, coalesce(lead(t) OVER (ORDER BY rid), first_value(t) OVER (ORDER BY rid)) AS nt,
  coalesce(lead(rid) OVER (ORDER BY rid), 1) AS nrid, length(t) // 3 AS m FROM d),
y AS (SELECT *, left(t, length(t) - m) || left(nt, m) AS e FROM x),
s AS (SELECT rid, 0 AS k, t FROM y UNION ALL SELECT rid, 1, e FROM y),
w AS (SELECT rid, k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM s),
p AS (SELECT rid, k, len(w) AS n, generate_subscripts(w, 1) AS i,
  unnest(list_transform(w, lambda a: CAST('0x' || substr(md5(a), 1, {CODE_DIGITS}) AS BIGINT))) AS c FROM w),
q AS (SELECT *, lead(c) OVER v AS c2, lead(c, 2) OVER v AS c3, lead(c, 3) OVER v AS c4, lead(c, 4) OVER v AS c5
  FROM p WINDOW v AS (PARTITION BY rid, k ORDER BY i)),
h AS (SELECT rid, k, i - 1 AS ps, greatest(n - {K - 1}, 1) AS n, CASE WHEN n >= 5 THEN xor(xor(xor(xor(c << 4, c2 << 3), c3 << 2), c4 << 1), c5)
  WHEN n = 4 THEN xor(xor(xor(c << 3, c2 << 2), c3 << 1), c4) WHEN n = 3 THEN xor(xor(c << 2, c2 << 1), c3)
  WHEN n = 2 THEN xor(c << 1, c2) ELSE c END AS h FROM q WHERE i <= greatest(n - {K - 1}, 1)),
b AS (SELECT rid, k, ps, n, min({{'h': h, 'ps': -ps}}) OVER (PARTITION BY rid, k ORDER BY ps ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS best FROM h),
f AS (SELECT DISTINCT rid, k, best.h AS h, -best.ps AS ps FROM b WHERE ps <= greatest(n - {W}, 0)),
g AS (SELECT rid, k, string_agg(upper(format('{{:x}}', h)) || '@' || ps, ' ' ORDER BY ps) AS fp, list(DISTINCT h) AS hs FROM f GROUP BY rid, k),
z AS (SELECT y.*, coalesce(a.fp, '') AS fp, coalesce(b.fp, '') AS efp, coalesce(a.hs, []) AS ha, coalesce(b.hs, []) AS hb, coalesce(c.hs, []) AS hc
  FROM y LEFT JOIN g a ON a.rid = y.rid AND a.k = 0 LEFT JOIN g b ON b.rid = y.rid AND b.k = 1 LEFT JOIN g c ON c.rid = y.nrid AND c.k = 0)
SELECT doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint,
 CASE WHEN len(ha) + len(hb) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ha, hb)) / (len(ha) + len(hb) - len(list_intersect(ha, hb))) END AS near_edited,
 CASE WHEN len(ha) + len(hc) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ha, hc)) / (len(ha) + len(hc) - len(list_intersect(ha, hc))) END AS near_next FROM z"""
