"""Secret scans (operator 2), in DataFrame functions only.

Base rules find assigned values, access keys and long hex runs. On top of them two
character Markov models, one of random strings and one of ordinary identifiers, are
compared: a run of ``[A-Za-z0-9+/_=-]`` of 16 or more characters that overlaps no base span
becomes a ``random`` span if its log-likelihood ratio reaches the threshold.

Both models are bigram tables over that alphabet with additive smoothing, fitted on
labelled samples of a documented bound: random are the base spans' values in the first
``SAMPLE_DOCS`` documents by hash and ``SAMPLE_STRINGS`` digests in hex and base64; ordinary
are the other words of those documents, singly, in capitals, and joined as snake_case and camelCase, and SAMPLE_STRINGS numbers. The
driver sees the two tables alone, at most 2 x 67 x 67 counts.

Positions are code points, end exclusive. A null text is empty: no spans. Repeated rows
give repeated rows, an empty table none (the models then come from digests alone). Long
texts are scanned whole. Other columns are kept by :func:`redact`, whatever their names, and
by :func:`spans` but for ``base``, ``all_spans`` and names that begin with ``_``, which it uses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_documents, partitions, text_of

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?=[AaPpSsTt])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLE_DOCS, SAMPLE_STRINGS = 512, 4096
#: Nats by which random must win: odds of some thousands to one.
THRESHOLD = 9.0
#: Added to every count of a character pair.
SMOOTH = 0.25
#: Log ratios are held as whole thousandths.
UNIT = 1000


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often they are used: the
    optimiser doesn't copy expressions past a generator."""
    held = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.withColumn("_once", held).withColumns({k: F.col(f"_once.{k}") for k in columns}).drop("_once")


def _starts(text: Column, pattern: str, found: Column) -> Column:
    """Where each of ``found``, all matches of ``pattern``, begins."""
    gaps = F.split(text, pattern, -1)
    step = F.arrays_zip(gaps.alias("g"), found.alias("m"))

    def add(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["g"])
        return F.struct(
            (at + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(at))).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(step, zero, add, lambda acc: acc["out"])


NONE = "array<struct<start:int,rank:int,end:int,value:string>>"


def _matches(df: DataFrame, name: str, pattern: str, group: int, can: Column) -> DataFrame:
    """Adds ``name``: (start, end, value) of all matches of ``pattern`` in ``_text``; there
    are none where ``can``, a cheaper condition, doesn't hold."""
    text = F.col("_text")
    all_of = lambda g: F.when(can, F.regexp_extract_all(text, F.lit(pattern), F.lit(g))).otherwise(F.array().cast("array<string>"))
    df = once(df, _m=all_of(0))
    df = once(df, _s=F.when(F.size("_m") > 0, _starts(text, pattern, F.col("_m"))).otherwise(F.array().cast("array<int>")), _v=all_of(group) if group else F.col("_m"))
    each = F.arrays_zip("_s", "_m", "_v")
    span = lambda x: F.struct(x["_s"].alias("start"), (x["_s"] + F.length(x["_m"])).alias("end"), x["_v"].alias("value"))
    return once(df, **{name: F.transform(each, span)}).drop("_m", "_s", "_v")


def _ranked(found: Column, rank: int, least: int) -> Column:
    long = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.transform(long, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], x["value"]))


def with_base(df: DataFrame) -> DataFrame:
    """Adds ``base`` to rows with ``_text``: base spans by start, then kind."""
    parts, text = [], F.col("_text")
    rules = (
        (ASSIGN, 2, 8, (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & F.rlike(text, F.lit(ASSIGN))),
        (ACCESS, 0, 16, F.contains(text, F.lit("AKIA"))),
        (HEX, 0, 32, F.rlike(text, F.lit("[0-9a-f]{32}"))),
    )
    for rank, (pattern, group, least, can) in enumerate(rules):
        df = _matches(df, f"_{rank}", pattern, group, can)
        parts.append(_ranked(F.col(f"_{rank}"), rank, least))
    return once(df, base=F.sort_array(F.concat(*parts))).drop("_0", "_1", "_2")


def _codes(word: Column) -> Column:
    """Each character's place in the alphabet, from 1."""
    return F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(docs: DataFrame) -> list[int]:
    """The table of log ratios (random against ordinary) of all character pairs, in UNITs."""
    spark, n = docs.sparkSession, len(ALPHABET)
    text = text_of(docs)
    # the least hashes, of which only likely ones reach the task that sorts them
    share = min(1.0, 8 * SAMPLE_DOCS / max(1, docs.count()))
    sample = docs.select(text.alias("text")).withColumn("h", F.xxhash64("text")).where(F.col("h") <= int(-(2**63) + share * (2**64 - 2**12)))
    sample = sample.orderBy("h", "text").limit(SAMPLE_DOCS).select("text")
    sample = with_base(sample.repartition(partitions(spark)).withColumnRenamed("text", "_text")).select(F.col("_text").alias("text"), F.col("base").alias("spans"))
    hits = sample.select(F.explode("spans.value").alias("w")).withColumn("random", F.lit(1))
    digests = spark.range(SAMPLE_STRINGS).select(
        F.explode(F.array(F.sha2(F.col("id").cast("string"), 256), F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "id"), 256))))).alias("w"), F.lit(1).alias("random")
    )
    words = once(sample, _w=F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0)))
    words = once(words, ws=F.filter(F.array_distinct("_w"), lambda w: ~F.exists("spans", lambda s: F.contains(s["value"], w))))
    joined = F.transform("ws", lambda w, i: F.concat(w, F.lit("_"), F.coalesce(F.get("ws", i + 1), F.lit(""))))
    camel = F.transform("ws", lambda w, i: F.concat(w, F.initcap(F.coalesce(F.get("ws", i + 1), F.lit("")))))
    ordinary = words.select(F.explode(F.concat("ws", joined, camel, F.transform("ws", lambda w: F.upper(w)))).alias("w")).withColumn("random", F.lit(0))
    numbers = spark.range(SAMPLE_STRINGS).select(F.abs(F.xxhash64("id")).cast("string").alias("w"), F.lit(0).alias("random"))
    codes = hits.unionByName(digests).unionByName(ordinary).unionByName(numbers).select("random", _codes(F.col("w")).alias("c"))
    pairs = codes.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("c") - 1, F.lit(1))), lambda i: F.struct(F.get("c", i - 1).alias("a"), F.get("c", i).alias("b")))).alias("p"))
    rows = pairs.where("p.a > 0 and p.b > 0").groupBy("random", "p.a", "p.b").count().collect()
    counts = [[[SMOOTH] * n for _ in range(n)] for _ in range(2)]
    for r in rows:
        counts[r["random"]][r["a"] - 1][r["b"] - 1] += r["count"]
    out = []
    for a in range(n):
        low, high = sum(counts[0][a]), sum(counts[1][a])
        out += [round(UNIT * (math.log(counts[1][a][b] / high) - math.log(counts[0][a][b] / low))) for b in range(n)]
    return out


def _ratio(word: Column, model: list[int]) -> Column:
    import numpy as np

    weights, n = F.lit(np.array(model, dtype=np.int32)), len(ALPHABET)

    def add(acc: Column, c: Column) -> Column:
        return F.struct(
            (acc["sum"] + F.when(acc["last"] == 0, F.lit(0)).otherwise(F.get(weights, (acc["last"] - 1) * n + c - 1))).alias("sum"), c.alias("last")
        )

    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    return F.aggregate(F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c)), zero, add, lambda a: a["sum"])


def _blanked(text: Column, found: str) -> Column:
    """``text`` with spaces in place of spans, which are sorted and may overlap."""

    def cut(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["at"], s["end"])
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(end.alias("at"), F.concat(acc["out"], gap, F.repeat(F.lit(" "), end - F.greatest(acc["at"], s["start"]))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(found, zero, cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def spans(docs: DataFrame, model: list[int]) -> DataFrame:
    """``docs`` with ``base`` and ``all_spans``: arrays of (start, rank, end, value), the
    rank a place in KINDS, or 3 for ``random``."""
    df = with_base(docs.withColumn("_text", text_of(docs)))
    least = round(THRESHOLD * UNIT)
    # base spans are blanked, so the parts of a run beside them are runs of their own
    df = once(df, _whole=F.col("_text"), _text=F.when(F.size("base") > 0, _blanked(F.col("_text"), "base")).otherwise(F.col("_text")))
    df = once(df, _words=F.array_distinct(F.regexp_extract_all("_text", F.lit(RUN), F.lit(0))))
    df = once(df, _words=F.filter("_words", lambda w: _ratio(w, model) >= least))
    df = _matches(df, "_runs", RUN, 0, F.size("_words") > 0)  # places are wanted in few texts
    df = once(df, _runs=F.filter("_runs", lambda x: F.array_contains("_words", x["value"])), _text=F.col("_whole"))
    random = F.transform("_runs", lambda x: F.struct(x["start"], F.lit(3).alias("rank"), x["end"], x["value"]))
    return once(df, all_spans=F.sort_array(F.concat("base", random))).drop("_runs", "_words", "_whole")


def redact(docs: DataFrame, model: list[int], mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span's text replaced by ``mark`` (touching or overlapping spans by
    one) and ``n_chars`` brought up to date; the columns stay the same."""
    found = spans(docs.select(F.struct("*").alias("doc"), docs["text"]), model)
    text = F.col("_text")

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] > acc["at"], F.concat(acc["out"], gap, F.lit(mark))).when((acc["out"] == "") & (acc["at"] == 0), F.lit(mark)).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("all_spans", zero, cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    some = F.size("all_spans") > 0
    columns = {c: F.col("doc")[c] for c in docs.columns} | {"text": F.when(some, clean).otherwise(F.col("doc.text"))}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(some, F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def _listed(spans_: Column, kinds: tuple[str, ...]) -> Column:
    names = F.lit(list(kinds))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_rank(k: int) -> Column:
    return F.filter("base", lambda s: s["rank"] == k)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every document."""
    docs = dealt_documents(spark, sf_dir).select("doc_id", "text")
    found = spans(docs, train(docs))
    counts = [F.size(_of_rank(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base"), KINDS), 256).alias("base_sha256"), _listed(F.col("all_spans"), (*KINDS, "random")).alias("spans"))
