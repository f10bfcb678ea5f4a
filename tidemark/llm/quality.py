"""Quality rules: word and line statistics, and line frequency across a host's documents.

Everything is built-in column functions. A first pass over the texts writes the hashes of
each row's normalised lines. Lines that many distinct documents of a host share are found
by counting hashes; a document most of whose words stand in such lines is rejected as
depleted, and those that are kept lose such lines. As long as such lines are few enough to
be broadcast, a second pass over the texts does all that where a text stands; else verdicts
meet their documents in a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, small, table, written
from .mixing import source_key

#: Words of the windows whose repeats are counted.
WINDOW = 8

#: A line is removed if more distinct documents of its host have it.
MAX_DOCS = 50

#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.3


def window_hashes(words: Column) -> Column:
    """A hash of each 8 consecutive words: pairs, pairs of pairs, and pairs of those."""
    out, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < WINDOW:
        out = _paired(out, width)
        width *= 2
    return F.when(F.size(words) >= WINDOW, out).otherwise(F.array().cast("array<bigint>"))


def _paired(hashes: Column, apart: int) -> Column:
    def both(a: Column) -> Column:
        n = F.greatest(F.size(a) - apart, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + apart), n), lambda x, y: F.xxhash64(x, y))

    # Inside a lambda the array is bound once, not computed anew for each use.
    return F.element_at(F.transform(F.array(hashes), both), 1)


def repeated_words(hashes: Column) -> Column:
    """Words that lie in windows whose hash occurs twice or more."""
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        return F.filter(
            s,
            lambda x,
            i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
        )

    at = F.array_sort(F.transform(F.element_at(F.transform(F.array(order), twice), 1), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        at,
        start,
        lambda a,
        p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def even_lines(text: Column) -> Column:
    """The lines in lower case with white space made even."""
    even = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))
    return F.transform(F.split(even, "\n", -1), lambda x: F.trim(x))


def line_hashes(text: Column) -> Column:
    """Hash and words of each line with a word, as even_lines has them."""
    lines = F.filter(even_lines(text), lambda x: x != "")
    return F.transform(
        lines,
        lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")),
    )


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """One row for each row of docs: its doc_id, host key, text hash, base statistics, lines, and columns named in ``more``."""
    rows = docs.select("doc_id", source_key(F.col("source")).alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
    rows = rows.select(
        "*",
        F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"),
    )
    rows = rows.select(
        "*",
        window_hashes(F.col("words")).alias("windows"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("real"),
    )
    n = F.size("words").cast("long")
    repeat = repeated_words(F.col("windows"))
    rows = rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        n.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("real") - F.size(F.array_distinct("real"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        line_hashes(F.col("text")).alias("lines"),
        *more,
    )
    return rows.select("*", ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, h of lines that more than max_docs distinct texts of the host have.

    A first count over all rows bounds the distinct ones from above; only lines above
    the limit there are counted by distinct text. Copies of a text count once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = F.array_distinct(F.transform(line_hashes(text), lambda x: x["h"]))
    rows = docs.select(source_key(F.col("source")).alias("host"), F.xxhash64(text).alias("text_hash"), hashes.alias("hashes"))
    rows = written(rows, "quality-lines", compression="lz4_raw")
    each = rows.select("host", "text_hash", F.explode("hashes").alias("h"))
    many = written(each.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).select("host", "h"), "lines-many")
    few = each.join(small(many), ["host", "h"]).groupBy("host", "h", "text_hash").agg(F.count("*").alias("n"))
    return few.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("host", "h")


#: A host's frequent lines are dealt into so many lists by hash, one of which is searched for a line.
LISTS = 256


def _listed(common: DataFrame) -> DataFrame:
    """One row for each host: its frequent lines in LISTS lists."""
    at = F.pmod("h", F.lit(LISTS)).cast("int").alias("at")
    parts = common.groupBy("host", at).agg(F.collect_list("h").alias("h")).groupBy("host").agg(F.collect_list(F.struct("at", "h")).alias("parts"))
    one = lambda i: F.get(F.filter("parts", lambda x: x["at"] == i), 0)["h"]
    return parts.select("host", F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), one).alias("lists"))


def _with_lost(docs: DataFrame, common: DataFrame, *more: str) -> DataFrame:
    """statistics() with ``lost``, words in frequent lines, and ``frequent``, their hashes, null without any."""
    none = F.lit(0).cast("long")
    if common.count() <= BROADCAST_ROWS:
        rows = statistics(docs, *more).join(F.broadcast(_listed(common)), "host", "left")
        known = lambda x: F.array_contains(F.get(F.col("lists"), F.pmod(x["h"], F.lit(LISTS)).cast("int")), x["h"])
        rows = rows.select("*", F.when(F.col("lists").isNotNull(), F.filter("lines", known)).alias("hits"))
        lost = F.aggregate("hits", none, lambda a, x: a + x["w"])
        frequent = F.when(F.size("hits") > 0, F.array_distinct(F.col("hits")["h"]))
        return rows.select("*", F.coalesce(lost, none).alias("lost"), frequent.alias("frequent")).drop("lines", "lists", "hits")
    rows = written(statistics(docs, *more).select(F.monotonically_increasing_id().alias("row"), "*"), "quality-rows", compression="zstd")
    each = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.w")
    lost = each.join(common, ["host", "h"]).groupBy("row").agg(F.sum("w").alias("lost"), F.collect_set("h").alias("frequent"))
    rows = rows.drop("lines").join(lost, "row", "left")
    return rows.withColumn("lost", F.coalesce("lost", none)).drop("row")


def judged(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, host, text_hash, statistics, words_left, kept,
    and frequent: hashes of its lines above the limit, null without any; and columns in ``more``.

    Null and empty texts have no words and fail. Null sources are a host of their own.
    Repeated rows give repeated rows with equal verdicts; an empty table gives none.
    Whatever other columns there are, only doc_id, text, source and those in ``more`` are read.
    """
    common = written(frequent_lines(docs, max_docs), "lines-common")
    rows = _with_lost(docs, common, *more).withColumn("words_left", F.col("n_words") - F.col("lost"))
    fine = ~F.col("base_failed") & (F.col("words_left") >= F.lit(min_left) * F.col("n_words"))
    return rows.withColumn("kept", fine).drop("lost")


def without(text: Column, frequent: Column) -> Column:
    """The text without the lines whose hash is in ``frequent``; the others stay as they are."""
    pairs = F.zip_with(F.split(text, "\n", -1), even_lines(text), lambda raw, even: F.struct(raw.alias("raw"), F.xxhash64(even).alias("h")))
    return F.array_join(F.transform(F.filter(pairs, lambda x: ~F.array_contains(frequent, x["h"])), lambda x: x["raw"]), "\n")


def kept(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, without their host's frequent lines.

    A text without such a line stays as it is; n_chars follows the text where the column
    exists. Null and empty texts have no words and go; repeated rows stay repeated, and
    columns of any name may stand beside.
    """
    names = docs.columns
    whole = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("document"))
    # As one condition, which the optimizer neither splits nor moves to where it would compute statistics anew for each use.
    out = judged(whole, **limits, more=("document",)).where(F.element_at(F.transform(F.array("kept"), lambda x: x), 1))
    old = {c: F.col("document")[f"c{i}"] for i, c in enumerate(names)}
    gone = F.col("frequent")
    # Bound once: the text is rebuilt where a line goes.
    out = out.select("document", F.when(gone.isNotNull(), without(old["text"], gone)).alias("new"))
    now = {"text": F.coalesce("new", old["text"])}
    if "n_chars" in names:
        now["n_chars"] = F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType), old["n_chars"])
    return out.select(*(now.get(c, old[c]).alias(c) for c in names))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of each document."""
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "words_left",
    )


OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
g AS (SELECT r, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM d WHERE len(words) >= {WINDOW}),
x AS (SELECT g.r, g.i, hash(array_to_string(list_slice(d.words, g.i, g.i + {WINDOW - 1}), ' ')) AS h FROM g JOIN d USING (r)),
y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM x) WHERE n > 1),
z AS (SELECT r, sum(least({WINDOW}, i - coalesce(last, i - {WINDOW}))) AS n_repeat_words
      FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last FROM y) GROUP BY r),
l AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
q AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY r),
e AS (SELECT r, source, text, trim(lower(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'))) AS line FROM l),
f AS (SELECT source, line FROM e WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT text) > {MAX_DOCS}),
o AS (SELECT e.r, sum(len(string_split(e.line, ' '))) AS lost FROM e JOIN f
      ON e.source IS NOT DISTINCT FROM f.source AND e.line = f.line GROUP BY e.r),
s AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(words) - coalesce(lost, 0) AS BIGINT) AS words_left
  FROM d LEFT JOIN z USING (r) LEFT JOIN q USING (r) LEFT JOIN o USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_left >= {MIN_LEFT} * n_words AS kept
FROM s
"""
