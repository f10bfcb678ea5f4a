"""Mix sources to target weights by hash-threshold histograms.

Every row gets a fixed 60-bit hash. For each source a histogram of sizes over the
hash's leading bits shows the bucket in which the source's budget runs out; only
that bucket's rows are looked at again, by the next bits, until one hash value is
left. The result is a threshold for each source, and taking the mix is a filter:
nothing is sorted, and a larger budget always takes a superset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, local, n_words, passing, table, written

#: Bits of the hash, and bits that a histogram resolves at a time.
HASH_BITS, LEVEL_BITS = 60, 12


@dataclass(frozen=True)
class Share:
    """What the mix wants of one source: ``source`` may be None."""

    source: str | None
    size: int
    target: float


def cycle_weights(sources: list[str | None], weights: tuple[float, ...] = (5, 2, 1)) -> dict:
    """Weights by code point order of the sources, null last, repeating."""
    order = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: weights[i % len(weights)] for i, s in enumerate(order)}


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> list[Share]:
    """Targets that share ``share`` of all sizes by weight.

    A target stops at ``most`` times its source's size; what it leaves is shared out
    among the others by weight, until none is above. An empty source gets 0.
    """
    caps = {s: most * n for s, n in sizes.items()}
    total, capped, rest, level = share * sum(sizes.values()), 0.0, sum(weights[s] for s in sizes), 0.0
    full = set()
    for s in sorted(sizes, key=lambda s: caps[s] / weights[s]):  # those that fill up first come first
        level = (total - capped) / rest
        if weights[s] * level <= caps[s]:
            break
        full.add(s)
        capped, rest = capped + caps[s], rest - weights[s]
    return [Share(s, n, caps[s] if s in full else weights[s] * level) for s, n in sizes.items()]


def row_hash(key: Column) -> Column:
    """The leading 60 bits of the key's md5, the same in every run and engine."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def thresholds(rows: DataFrame, budgets: dict[str, float], sizes: dict[str, int]) -> dict[str, int]:
    """For each key the hash below which the sizes come nearest to its budget.

    ``rows`` has columns key, hash, size. One row for each source and level reaches
    the driver. The first histogram reads all rows, each later one only the rows of
    the boundary buckets of the one before.
    """
    spark = rows.sparkSession
    limit = 1 << HASH_BITS
    found = {k: limit for k, b in budgets.items() if b >= sizes[k]}
    found |= {k: 0 for k, b in budgets.items() if b <= 0 and k not in found}
    # key -> (first hash of its open range, size of all rows before the range)
    open_ = {k: (0, 0) for k in budgets if k not in found}
    inside = rows
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        if not open_:
            break
        bounds = local(spark, [(k, at, before, budgets[k]) for k, (at, before) in open_.items()], "bkey string, at long, before long, budget double")
        width = 1 << (shift + LEVEL_BITS)
        inside = inside.join(bounds, F.col("key") == F.col("bkey")).where((F.col("hash") >= F.col("at")) & (F.col("hash") < F.col("at") + F.lit(width))) if width < limit else inside.join(bounds, F.col("key") == F.col("bkey"))
        inside = inside.select("key", "hash", "size", "at", "before", "budget")
        if width < limit:
            inside = written(inside, "mix-boundary")
        bins = inside.groupBy("key", "before", "budget", F.shiftright(F.col("hash"), shift).alias("bin")).agg(F.sum("size").alias("size"))
        # At most 2^LEVEL_BITS bins of a key meet here, however many rows it has.
        bins = bins.groupBy("key", "before", "budget").agg(F.array_sort(F.collect_list(F.struct("bin", "size"))).alias("bins"))
        step = F.aggregate(
            "bins",
            F.struct(F.col("before").alias("sum"), F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("size")),
            lambda a, x: F.when((a.bin >= 0), a).when(
                a["sum"] + x["size"] > F.col("budget"),
                F.struct(a["sum"].alias("sum"), x["bin"].alias("bin"), x["size"].alias("size")),
            ).otherwise(F.struct((a["sum"] + x["size"]).alias("sum"), a["bin"].alias("bin"), a["size"].alias("size"))),
        )
        for r in bins.select("key", step.alias("cut")).collect():
            k, cut = r["key"], r["cut"]
            if shift:
                open_[k] = (cut["bin"] << shift, cut["sum"])
            else:  # one hash value is left: take it if that is nearer
                more = budgets[k] - cut["sum"] >= cut["sum"] + cut["size"] - budgets[k]
                found[k] = cut["bin"] + int(more)
        inside = inside.select("key", "hash", "size")
    return found


def source_key(source: Column) -> Column:
    """A key that tells a null source from every other."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _rows(docs: DataFrame, size: Column | None) -> DataFrame:
    size = n_words(F.col("text")) if size is None else size
    rows = docs.select(
        "doc_id",
        "source",
        source_key(F.col("source")).alias("key"),
        row_hash(F.col("doc_id")).alias("hash"),
        size.cast("long").alias("size"),
    )
    return written(rows, "mix-rows")


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """For each source: pkey, source_size, target, and the copies base and cut make of a row."""
    totals = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    shares = targets(totals, cycle_weights(list(totals), weights), share, most) if totals else []
    key = {s.source: "n" if s.source is None else "s" + s.source for s in shares}
    base = {key[s.source]: int(s.target // s.size) if s.size else 0 for s in shares}
    sizes = {key[s.source]: s.size for s in shares}
    budgets = {key[s.source]: s.target - base[key[s.source]] * s.size for s in shares}
    cuts = thresholds(rows.select("key", "hash", "size"), budgets, sizes) if shares else {}
    return local(
        rows.sparkSession,
        [(key[s.source], s.size, s.target, base[key[s.source]], cuts[key[s.source]]) for s in shares],
        "pkey string, source_size long, target double, base int, cut long",
    )


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document: 0, 1 or more. A source whose
    target is above its size gives every document ``floor(target / size)`` times and
    those below its threshold once more. Rows of one doc_id are taken alike, also
    where the table repeats them; null texts have size 0 and null sources form a
    source of their own, last in order. An empty table gives an empty result. Only
    the columns doc_id, text and source are read, whatever others there are.

    The totals and thresholds of the sources, one row each, pass through the driver.
    """
    rows = _rows(docs, size)
    copies = (F.col("base") + (F.col("hash") < F.col("cut")).cast("int")).alias("copies")
    out = rows.join(
        _plan(rows, weights, share, most),
        F.col("key") == F.col("pkey"),
    ).select("doc_id", "source", "size", "source_size", "target", copies)
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with all their columns.

    Rows of one doc_id are taken alike, also repeated ones; null and empty texts have size
    0 and weigh nothing, null sources are a source of their own, an empty table stays empty.
    Columns of any name may stand beside.
    """
    with passing(docs.sparkSession):
        plan = _plan(_rows(docs, size), weights, share, most)
    copies = plan["base"] + (row_hash(docs["doc_id"]) < plan["cut"]).cast("int")
    taken = docs.join(plan, source_key(docs["source"]) == plan["pkey"]).where(copies > 0)
    extra = fresh(docs, "copy")
    return taken.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), copies)).alias(extra)).drop(extra)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; null texts have size 0, null sources are the last source."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
                WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, 2.0 * source_size / weight AS ratio FROM w),
p AS (SELECT *, CAST((SELECT 1.5 * sum(source_size) FROM s) AS DOUBLE) AS total,
             coalesce(sum(2 * source_size) OVER o, 0) AS capped, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS rest
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total - capped) / rest AS level FROM p WHERE ratio >= (total - capped) / rest ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN weight * level > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * level AS DOUBLE) END AS target
      FROM w, l),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS base FROM t),
h AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.base + CASE WHEN b.target - b.base * b.source_size > 0
            AND (c.before + c.size <= b.target - b.base * b.source_size
                 OR (c.before <= b.target - b.base * b.source_size
                     AND b.target - b.base * b.source_size - c.before >= c.before + c.size - (b.target - b.base * b.source_size)))
            THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
       JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
