"""Personal data: base patterns, generated candidates, and boosted trees that choose among them.

All of it is column functions. A kind's base pattern finds its spans in whole texts;
wider generators propose further spans, which may overlap; trees over format and
context give each a calibrated probability, and those above their kind's threshold
join the base spans. The trees are fitted on the driver, on a fixed number of invented
examples whose features the same expressions compute.

Patterns match without backtracking over what they have taken, so a long run of
letters or digits costs no more than its length.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import boost
from .common import BROADCAST_ROWS, fresh, passing, table, written

KINDS = ("email", "ip", "card", "phone")

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

#: The base patterns. A match starts where a run starts, or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_AT, _DOT = r"(?:\x20?[\[(]at[\])]\x20?|\x20at\x20|\x20?@\x20?)", r"(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)"

#: What else may be personal data, per kind: patterns whose spans may overlap, also those of one kind.
GENERATORS = {
    "email": [
        rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++",
        rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_LABEL}++{_DOT}[A-Za-z]{{2,6}}+(?![A-Za-z0-9])",
    ],
    "ip": [rf"(?<![0-9.]){_OCTET}(?:(?:[\[(]\.[\])]|\x20\.\x20|\x20dot\x20|\.){_OCTET}){{3}}(?![0-9])"],
    "card": [
        r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]{0,2}+[0-9]){12,18}+(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])[0-9]{4}([\x20._/-]{1,2}+)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])",
    ],
    "phone": [
        r"(?<![0-9A-Za-z])(?:\+|\()?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,14}+(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    ],
}

#: Characters of context on either side of a candidate.
CONTEXT = 24

#: Words before a candidate that speak for its kind.
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|address|reach|mailto)[^A-Za-z0-9]*+(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip\b|ipv4|host|server|gateway|address|addr)[^A-Za-z0-9]*+(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|payment)[^A-Za-z0-9]*+(?:\w+\W+)?$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|dial|whatsapp|sms)[^A-Za-z0-9]*+(?:\w+\W+)?$",
}

#: Features of a candidate; the one that depends on its kind.
FEATURES, CUE = 17, 12

#: Invented examples that each kind's trees are fitted on.
EXAMPLES = 1500

_BLOCK = 256


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before, in blocks so that long arrays stay cheap."""

    def sums(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, zero, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def blocked(x: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")),
            lambda b: sums(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))),
        )
        return F.element_at(F.transform(F.array(blocks), joined), 1)

    def joined(b: Column) -> Column:
        return F.flatten(F.zip_with(b, sums(F.transform(b, lambda s: s["at"]))["out"], lambda s, off: F.transform(s["out"], lambda v: v + off)))

    return F.element_at(F.transform(F.array(lengths), lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(blocked(x))), 1)


def spans(text: Column, pattern: str, possible: Column | None = None) -> Column:
    """array<struct<start, end, m, before, after>> of a pattern's matches, in code points.

    Matches and the text between them come from one pattern, so their lengths add up to
    the places. ``possible`` tells the rows in which the pattern can match at all.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")

    def placed(m: Column) -> Column:
        def between(gaps: Column) -> Column:
            lengths = F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
            firsts = F.transform(lengths, lambda x: x)

            def build(starts: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    at = F.get(starts, i) + F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)
                    before, after = F.get(gaps, i), F.coalesce(F.get(gaps, i + 1), F.lit(""))
                    return F.struct(
                        at.alias("start"),
                        (at + F.length(x)).alias("end"),
                        x.alias("m"),
                        F.substring(before, -CONTEXT, CONTEXT).alias("before"),
                        F.substring(after, 1, CONTEXT).alias("after"),
                    )

                return F.transform(m, one)

            return F.element_at(F.transform(F.array(_starts(firsts)), build), 1)

        return F.when(F.size(m) == 0, none).otherwise(F.element_at(F.transform(F.array(F.split(text, pattern, -1)), between), 1))

    out = F.element_at(F.transform(F.array(found), placed), 1)
    return out if possible is None else F.when(possible, out).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether a number's digits pass the Luhn check."""
    digits = F.reverse(_digits(m))

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a base match keeps its kind's rule."""
    n = F.length(_digits(m))
    return {
        "email": F.lit(True),
        "ip": m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": F.when(n.between(13, 19), luhn(m)).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def possible(kind: str, text: Column) -> Column:
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")


def base_spans(kind: str, text: Column) -> Column:
    return F.filter(spans(text, BASE[kind], possible(kind, text)), lambda s: valid(kind, s["m"]))


def features(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    count = lambda pattern, of=m: F.regexp_count(of, F.lit(pattern)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    digits = _digits(m)
    return [
        F.length(m).cast("double"),
        F.length(digits).cast("double"),
        count("[0-9]++"),
        count(r"[\x20()./_-]"),
        count(r"\."),
        flag(m.startswith("+")),
        flag(m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")),
        flag(m.rlike(r"^[0-9]{4}([\x20._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$")),
        flag(F.when(F.length(digits).between(13, 19), luhn(m))),
        flag(m.rlike(r"[\[(](?:at|dot|\.)[\])]")),
        flag(m.rlike(r"\x20at\x20.*\x20dot\x20")),
        flag(m.rlike(r"\.[A-Za-z]{2,6}$|dot[\])]?\x20?[A-Za-z]{2,6}$")),
        flag(before.rlike(CUES[kind])),
        flag(before.rlike(r"[A-Za-z0-9+=\"'/_-]$")),
        flag(after.rlike(r"^[A-Za-z0-9\"'/_=-]")),
        flag(m.rlike(r"^(?:19|20)[0-9]{2}[./-]")),
        flag(m.contains("@")),
    ]


def _examples(kind: str) -> list[tuple[str, str, str, int]]:
    """Invented candidates with context and label, the same in every run."""
    rng = random.Random(f"{kind} examples")
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cue = {
        "email": ["email: ", "contact me ", "write to ", "e-mail "],
        "ip": ["ip ", "host ", "server ", "IP: "],
        "card": ["card ", "visa: ", "credit card no ", "paid by card "],
        "phone": ["call ", "tel. ", "phone: ", "fax "],
    }[kind]

    def checked(n: int) -> str:
        d = num(n - 1)
        s = sum(v if i % 2 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d))))
        return d + str(-s % 10)

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def positive() -> tuple[str, bool]:
        """A candidate, and whether it needs a cue."""
        if kind == "email":
            at, dot = rng.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", "."), ("(at)", ".")])
            return f"{word()}{rng.choice(['', '.' + word(), num(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}", False
        if kind == "ip":
            return rng.choice(["[.]", "(.)", " dot "]).join(str(rng.randint(0, 255)) for _ in range(4)), False
        if kind == "card":
            return grouped(checked(16), rng.choice([".", "_", "/", "  "])), rng.random() < 0.5
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{num(2)} {num(3)} {num(4)}", a + b + c]), True

    def negative() -> tuple[str, bool]:
        """A candidate, and whether a cue may stand before it."""
        if kind == "email":
            return rng.choice([f"{word()} at {word()}.{word()}", f"{word()} at {word()}.{num(1)}", f"{word()} at {num(1)}.{num(1)}"]), True
        if kind == "ip":
            return rng.choice([" . ".join(num(1) for _ in range(4)), ".".join(["0" * rng.randint(1, 3) + num(1) for _ in range(4)])]), False
        if kind == "card":
            d = num(rng.randint(13, 19))
            return rng.choice([d, grouped(d, "."), grouped(d, "_"), grouped(d, "  ")]), rng.random() < 0.2
        return rng.choice([
            num(rng.randint(7, 15)),
            f"20{num(2)}-{num(2)}-{num(2)}",
            f"{num(2)}/{num(2)}/20{num(2)}",
            f"{num(3)} {num(3)} {num(3)}",
            f"{num(4)} {num(4)}",
            f"{num(1)}.{num(6)}",
            f"{num(4)}-{num(4)}-{num(4)}",
            f"{num(3)}-{num(3)}-{num(4)}",
            f"{num(3)} {num(3)} {num(4)}",
        ]), False

    out = []
    for i in range(EXAMPLES):
        label = i % 2
        m, cued = positive() if label else negative()
        strong = label and (not cued) and rng.random() < 0.6
        before = f"{word()} {word()} " + (rng.choice(cue) if (cued and label) or (cued and rng.random() < 0.1) or (label and not strong and rng.random() < 0.5) else "")
        after = rng.choice([" ", ". ", ", ", " " + word()])
        if not label and rng.random() < 0.3:
            before, after = before.strip() + rng.choice(["=", "/", '"', "_", "-"]), rng.choice(["_", "/", '"', "-", "x"])
        out.append((m, before[-CONTEXT:], after, label))
    return out


_models: dict[str, boost.Model] = {}


def models(spark: SparkSession) -> dict[str, boost.Model]:
    """Each kind's trees; fitted once in a driver, the same in every run."""
    for kind in KINDS:
        if kind not in _models:
            rows = spark.createDataFrame(_examples(kind), "m string, before string, after string, label int")
            got = rows.select("label", F.array(*features(kind, F.col("m"), F.col("before"), F.col("after"))).alias("x")).collect()
            _models[kind] = boost.fit(np.array([r["x"] for r in got]), np.array([r["label"] for r in got]))
    return _models


@lru_cache(maxsize=1)
def _wide() -> dict[str, str]:
    """What a text needs for a kind's generator to be tried."""
    near = r"[0-9][^A-Za-z]{0,24}[0-9]"
    return {"email": r"@|\bat\b|[\[(]at[\])]", "ip": rf"{near}|[0-9]\x20dot\x20[0-9]", "card": near, "phone": near}


def detected(docs: DataFrame, key: list[str]) -> DataFrame:
    """One row for each row of docs: key columns, base and added array<struct<kind, start, end>>.

    Whole texts are searched, null and empty ones have no spans. Added spans touch no
    base span, nor each other: of two that overlap the likelier stays, then the earlier,
    then the first kind by name. Repeated rows give repeated rows, an empty table none.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *key, text.alias("text"))
    place = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    wide = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), *(s[c].alias(c) for c in ("start", "end", "m", "before", "after")))
    has = {k: F.col("text").rlike(p) for k, p in _wide().items()}
    rows = rows.select(
        "row",
        *key,
        F.concat(*(F.transform(base_spans(k, F.col("text")), place(k)) for k in KINDS)).alias("base"),
        F.concat(*(F.transform(spans(F.col("text"), p, has[k]), wide(k)) for k in KINDS for p in GENERATORS[k])).alias("wide"),
    )
    rows = written(rows, "pii-rows", compression="zstd")
    each = rows.where(F.size("wide") > 0).select("row", F.explode("wide").alias("c")).select("row", "c.*")
    score = F.lit(0.0)
    for kind, model in models(spark).items():
        p = model.column([F.col(f"x{i}") for i in range(FEATURES)])
        score = F.when(F.col("kind") == kind, F.when(p >= model.threshold, p)).otherwise(score)
    numbers = []
    by_kind = {k: features(k, F.col("m"), F.col("before"), F.col("after")) for k in KINDS}
    for i in range(FEATURES):
        x = by_kind["phone"][i]
        if i == CUE:
            x = F.when(F.col("kind") == "email", by_kind["email"][i]).when(F.col("kind") == "ip", by_kind["ip"][i]).when(F.col("kind") == "card", by_kind["card"][i]).otherwise(x)
        numbers.append(x.alias(f"x{i}"))
    # Written once more, so that the optimizer doesn't reason about the trees in what follows.
    scored = written(
        each.select("row", "kind", "start", "end", *numbers).select("row", "kind", "start", "end", score.alias("p")),
        "pii-scored",
    ).where(F.col("p") > 0)
    base = rows.where(F.size("wide") > 0).select("row", F.explode("base").alias("c")).select("row", "c.*", F.lit(BASE_P).alias("p"))
    added = _apart(scored.unionByName(base)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.join(added, "row", "left").select(*key, "base", F.coalesce("added", empty).alias("added"))


#: Stands for the probability of a base span, above all others.
BASE_P = 2.0


def _apart(found: DataFrame) -> DataFrame:
    """Of a row's spans (row, kind, start, end, p) those that stay beside its base spans.

    In order of probability, then start, then kind, a span stays if it overlaps no base
    span and none that stayed before it. Only spans of a chain of overlaps are put
    together for that, which are few even in a very long text.
    """
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    till = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("start") < F.max("end").over(before), 0).otherwise(1)
    chains = found.distinct().withColumn("new", new).withColumn("chain", F.sum("new").over(till))
    each = F.struct((-F.col("p")).alias("p"), "start", "kind", "end")
    lists = chains.groupBy("row", "chain").agg(F.array_sort(F.collect_list(each)).alias("all"))
    alone = F.filter("all", lambda s: s["p"] > -BASE_P)
    none = F.filter("all", lambda s: s["p"] == -BASE_P)

    def step(kept: Column, s: Column) -> Column:
        free = ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(free, F.concat(kept, F.array(s))).otherwise(kept)

    kept = F.filter(F.aggregate(alone, none, step), lambda s: s["p"] > -BASE_P)
    return lists.select("row", F.explode(kept).alias("s")).select("row", "s.kind", "s.start", "s.end")


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _said(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _in_order(found: Column) -> Column:
    """Spans by kind as listed, then start."""
    return F.concat(*(F.array_sort(F.filter(found, _of(k))) for k in KINDS))


#: Characters of the pieces that a text is cut into before spans are cut out of it.
PIECE = 4096


def _rebuilt(text: Column, found: Column) -> Column:
    """The text with each of its spans (ascending, apart) replaced by its kind in brackets.

    What stands between spans is cut from pieces of the text: time follows its length.
    """
    size = F.length(text)
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / PIECE), F.lit(0)).cast("int")),
        lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)),
    )

    def build(parts: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
            inside = F.substring(F.get(parts, first), a % PIECE + 1, b - a)
            middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            return F.when(b <= a, F.lit("")).when(first == last, inside).otherwise(F.concat(
                F.substring(F.get(parts, first), a % PIECE + 1, F.lit(PIECE)),
                middle,
                F.substring(F.get(parts, last), F.lit(1), (b - 1) % PIECE + 1),
            ))

        def one(s: Column, i: Column) -> Column:
            return F.concat(cut(F.coalesce(F.get(found, i - 1)["end"], F.lit(0)), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))

        return F.concat(F.array_join(F.transform(found, one), ""), cut(F.element_at(found, -1)["end"], size))

    return F.element_at(F.transform(F.array(pieces), build), 1)


def merged(found: DataFrame) -> DataFrame:
    """Of spans (id, hash, start, end, kind) one row for each id and hash: ``spans`` in order, those that touch or overlap as one, of the first's kind."""
    order = Window.partitionBy("id", "hash").orderBy("start", "end", "kind")
    before, till = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)
    each = found.distinct().withColumn("new", new).withColumn("part", F.sum("new").over(till))
    each = each.groupBy("id", "hash", "part").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"),
    )
    return each.groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets.

    Spans that touch or overlap become one, named after the first. A text without
    personal data, and a null one, stays as it is; n_chars follows the text where the
    column exists. All columns stay, in their order, whatever their names; repeated rows
    stay repeated, and an empty table stays empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with passing(docs.sparkSession) as keep:
        found = detected(docs.select("doc_id", "text", F.xxhash64(text).alias("text_hash")), ["doc_id", "text_hash"])
        each = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.explode(F.concat("base", "added")).alias("s"))
        keep.append(written(merged(each.select("id", "hash", "s.start", "s.end", "s.kind")), "pii-found"))
    found = keep[0]
    own, key, cut, new = (fresh(docs, c) for c in ("row_key", "found_key", "found_spans", "new_text"))
    broadcast = (found.agg(F.sum(1 + F.size("spans"))).first()[0] or 0) <= BROADCAST_ROWS
    found = found.select(F.struct("id", "hash").alias(key), F.col("spans").alias(cut))
    rows = docs.withColumn(own, F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash")))
    out = rows.join(F.broadcast(found) if broadcast else found, F.col(own) == F.col(key), "left")
    whole = F.col(cut).isNull()
    out = out.withColumn(new, F.when(whole, F.col("text")).otherwise(_rebuilt(F.col("text"), F.col(cut))))
    changed = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and all spans of each document; a null text has none."""
    out = detected(table(spark, sf_dir, "documents"), ["doc_id"])
    n = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(
        "doc_id",
        *n,
        F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _said(_in_order(F.concat("base", "added"))).alias("spans"),
    )
