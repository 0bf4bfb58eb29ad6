"""Quality rules under weak supervision (operator 10).

Each rule votes good, bad or abstains on a document; how accurate the rules are is
estimated without labels by expectation-maximisation over the votes of all documents (two
classes, each rule's votes independent within a class), and a document is kept if its
posterior probability of being good is at least KEEP. Two things tell the classes apart: a
prior of TRUST imagined documents a class, whatever the size of the corpus, and that a
document which no rule votes against counts as good throughout, so that a corpus without
junk isn't split. What EM needs of the corpus is how often each pattern of votes occurs, at
most 3**len(RULES) counts, however many documents.

Two hard rules come first: fewer than 50 words, or over half of the words in repeated
3-word windows, fail. A null text has no words and fails. A null ``doc_id`` is kept as it
is; repeated documents are judged alike, and an empty table gives no rows. Other columns,
whatever their names, are ignored by :func:`op10_quality` and kept by :func:`keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import Scratch, dealt_documents, release, small_batches

KEEP, ROUNDS = 0.5, 100
SYMBOL, UPPER, ALPHA, BANG = (np.zeros(256, bool) for _ in range(4))
SYMBOL[list(b"#*$%&|<>")] = True
UPPER[65:91] = True
ALPHA[65:91] = ALPHA[97:123] = True
BANG[list(b"!")] = True
#: What a word of prose doesn't end in.
ODD = np.zeros(256, bool)
ODD[list(b"#*$%&|<>!=_~^@/\\+{}")] = True
#: Each rule: a measure, and the votes good up to one bound and bad from another on.
RULES = (
    ("symbols_per_word", 0.05, 0.2),
    ("repeated_words", 0.2, 0.4),
    ("upper_share", 0.15, 0.4),
    ("dup_line_share", 0.1, 0.4),
    ("bangs_per_word", 0.05, 0.2),
    ("same_as_last", 0.05, 0.15),
    ("word_length_off", 4.0, 10.0),
    ("odd_word_share", 0.1, 0.35),
)
#: How bad and good documents are taken to get the votes bad, abstain, good before any is
#: seen, and how many documents of each class that is worth.
PRIOR = np.array([[0.25, 0.1, 0.65], [0.005, 0.05, 0.945]])
TRUST = 20
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUT = [T.StructField(f, T.LongType()) for f in FEATURES] + [T.StructField("votes", T.IntegerType())]


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """FEATURES and the vote pattern of each row."""
    starts, ends, begins = vec.words(data, offsets)
    n_words = np.diff(begins)
    inner = ~vec.SPACE[data]
    chars = vec.per_row(inner & ((data & 0xC0) != 0x80), offsets)
    symbols = vec.per_row(SYMBOL[data], offsets)
    hashes = vec.word_hashes(data, starts, ends)
    lines, dups = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    raw = data.tobytes()
    for r in range(len(n_words)):
        own = [x for x in raw[offsets[r] : offsets[r + 1]].split(b"\n") if x and not x.isspace()]
        lines[r], dups[r] = len(own), len(own) - len(set(own))
    runs, run_begins = vec.shingles(hashes, begins, 3)
    row = np.repeat(np.arange(len(n_words), dtype=np.uint64), np.diff(run_begins))
    key = vec.mix(runs + row * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    place = at - run_begins[row[at].astype(np.int64)] + begins[row[at].astype(np.int64)]
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[place + i] = True
    repeats = vec.per_row(covered, begins)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[begins[:-1][n_words > 0]] = False
    w = np.maximum(n_words, 1)
    values = (
        symbols / w,
        repeats / w,
        vec.per_row(UPPER[data], offsets) / np.maximum(vec.per_row(ALPHA[data], offsets), 1),
        dups / np.maximum(lines, 1),
        vec.per_row(BANG[data], offsets) / w,
        vec.per_row(again, begins) / w,
        np.abs(chars / w - 6),
        vec.per_row(ODD[data[np.maximum(ends - 1, 0)]], begins) / w,
    )
    votes = np.zeros(len(n_words), np.int32)
    for k, (x, (_, good, bad)) in enumerate(zip(values, RULES)):
        vote = np.where(x <= good, 2, np.where(x >= bad, 0, 1))
        votes += (3**k * np.where(n_words > 0, vote, 1)).astype(np.int32)
    return n_words, chars, symbols, dups, repeats, votes


def features(docs: DataFrame, own: list[str]) -> DataFrame:
    """FEATURES and ``votes`` of every document, with its columns ``own`` in a struct ``doc``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("doc"), docs["text"].cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc"], *OUT])

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in vec.small_blocks(batch.column(1)):
                found = measure(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x) for x in found)], names=schema.names)
        release()

    return rows.mapInArrow(run, schema)


def fit(patterns: list[tuple[int, int]], trust: float = TRUST) -> np.ndarray:
    """The posterior probability of good for every vote pattern, from (pattern, count)."""
    size = 3 ** len(RULES)
    digits = (np.arange(size)[:, None] // 3 ** np.arange(len(RULES))) % 3  # 0 bad, 1 abstain, 2 good
    counts = np.zeros(size)
    for p, n in patterns:
        counts[p] += n
    counts[(digits == 1).all(1)] = 0  # texts without a word fail anyway
    against = (digits == 0).sum(1)
    good = 0.2**against  # at first rules are trusted
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        log = np.log(prior)[:, None] + np.zeros((2, size))
        for k in range(len(RULES)):
            votes = np.stack([weight[:, digits[:, k] == v].sum(1) for v in range(3)], 1) + trust * PRIOR
            log += np.log(votes / votes.sum(1, keepdims=True))[:, digits[:, k]]
        good = np.where(against == 0, 1.0, 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60))))
    return good


def verdicts(found: DataFrame, posterior: np.ndarray) -> DataFrame:
    """Adds ``base_failed, quality`` and ``kept``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = F.get(F.lit(np.round(posterior, 6)), F.col("votes"))
    return found.withColumn("base_failed", failed).withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def _counts(found: DataFrame) -> list[tuple[int, int]]:
    return [(r[0], r[1]) for r in found.groupBy("votes").count().collect()]  # at most 3**len(RULES)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they have."""
    posterior = fit(_counts(features(docs, ["n_chars"] if "n_chars" in docs.columns else ["text"])))
    return verdicts(features(docs, docs.columns), posterior).where("kept").select("doc.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every document."""
    found = Scratch(spark, "op10").keep(features(dealt_documents(spark, sf_dir), ["doc_id"]), "features")
    out = verdicts(found, fit(_counts(found)))
    return out.select("doc.doc_id", *FEATURES, "base_failed", "kept", "quality")
