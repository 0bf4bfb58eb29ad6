"""Document fingerprints by winnowing (operator 3).

Rolling hashes of all runs of K code points; of each window of WINDOW successive hashes
the least is chosen, of equal ones the rightmost, and kept with its position. Two texts
that share a passage of ``K + WINDOW - 1`` = 28 code points therefore share a fingerprint
hash. A text of fewer windows than one gives the least of what it has; one shorter than K is
hashed whole; an empty text has an empty fingerprint.

A fingerprint is written in five bytes a place: how far it is from the place before, and the
hash (:func:`places` reads it). The likeness of two texts is the Jaccard of the sets of hashes
of their fingerprints, 1 for two empty ones, so equal fingerprints have a likeness of 1.

:func:`with_next` hands every document the text that follows it in descending ``doc_id``
order, without a task that sees all rows: ids alone set range bounds, each range is
sorted in a task, and the first row of a range also goes to the range before it.
A null text is empty, a null ``doc_id`` sorts last; equal ids go by the text's hash.
Repeated rows follow each other. An empty table gives no rows. Other columns are ignored.
A very long text is held by its task, with some arrays of eight bytes a code point.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .common import partitions, small_batches, table, text_of

#: WINDOW is at most 255: a place is within a window of the one before.
K, WINDOW = 12, 17
U = np.uint64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all runs of k code points (of the whole, if it is shorter)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32)
    k = min(k, n)
    base = 0x9E3779B97F4A7C15
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum((points.astype(U) + U(1)) * vec._table(base, n)[:n], out=sums[1:])
    rolled = (sums[k:] - sums[:-k]) * vec._table(pow(base, -1, 2**64), n)[: n - k + 1]
    return (vec.mix(rolled + U(k)) >> U(32)).astype(np.uint32)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's fingerprint."""
    hashes = gram_hashes(points, k)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint32), hashes
    w = min(window, n)
    # the rightmost least: hash, then how far from the end, as one number
    least = (hashes.astype(U) << U(32)) | (U(n) - np.arange(n, dtype=U))
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if w > span:
        least = np.minimum(least[: n - w + 1], least[w - span :])
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (U(n) - (chosen & U(0xFFFFFFFF))).astype(np.uint32), (chosen >> U(32)).astype(np.uint32)


PLACE = np.dtype([("gap", "u1"), ("hash", ">u4")])


def written(positions: np.ndarray, hashes: np.ndarray) -> bytes:
    """Five bytes for each place: how far from the one before (the first: from the start), hash."""
    out = np.empty(len(positions), PLACE)
    out["gap"], out["hash"] = np.diff(positions.astype(np.int64), prepend=0), hashes
    return out.tobytes()


def places(fingerprint: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a written fingerprint."""
    read = np.frombuffer(fingerprint, PLACE)
    return np.cumsum(read["gap"], dtype=np.int64), read["hash"].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``doc_id, text, part, extra``: dealt and sorted so that each row's next one follows it
    in its task; rows with ``extra`` are there for the row before them only."""
    spark = docs.sparkSession
    parts = parts or partitions(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    shares = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, max(10000, 20 * parts))).first()[0] if parts > 1 else None
    bounds = sorted(set(bounds or []))  # at most parts
    held = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    # ranges in descending order, a null id last
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(F.lit(len(bounds)) - F.size(F.filter(held, lambda b: b <= F.col("doc_id"))))
    rows = rows.withColumn("part", part.cast("int"))
    order = F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "tie")
    heads = rows.groupBy("part").agg(F.max(order).alias("h")).select("part", "h.doc_id", "h.tie").collect()  # at most parts + 1
    heads = sorted(heads, key=lambda r: r["part"])
    before = {heads[i]["part"]: heads[i - 1]["part"] for i in range(len(heads))}
    if not heads:
        return rows.select("doc_id", "text", "part", F.lit(False).alias("extra"))
    # by part: its first row, and the part before it
    first, at = {h["part"]: h for h in heads}, range(heads[-1]["part"] + 1)
    own = lambda k: F.get(F.lit([first[p][k] if p in first else None for p in at]).cast("array<bigint>"), F.col("part"))
    leads = F.col("doc_id").eqNullSafe(own("doc_id")) & (F.col("tie") == own("tie"))
    also = F.get(F.lit([before.get(p) for p in at]).cast("array<int>"), F.col("part"))
    here = F.struct(F.col("part"), F.lit(False).alias("extra"))
    sent = F.explode(F.when(leads, F.array(here, F.struct(also.alias("part"), F.lit(True).alias("extra")))).otherwise(F.array(here)))
    rows = rows.select("doc_id", "text", "tie", sent.alias("to")).select("doc_id", "text", "tie", "to.part", "to.extra")
    dealt = rows.repartition(len(heads), "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return dealt.select("doc_id", "text", "part", "extra")


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the
    beginning of the next document), and how alike they and the next one's are."""

    def run(batches):
        last = None  # doc_id, text, part, fingerprint
        out: list[tuple] = []

        def read(text: str):
            positions, hashes = winnow(code_points(text))
            return written(positions, hashes), np.unique(hashes)

        def judged(own, text: str, fingerprint) -> tuple:
            doc_id, mine, _, (kept, unique) = own
            n = len(mine)
            edited = mine[: n - n // 3] + text[: n // 3]
            e_kept, e_unique = read(edited)
            return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), kept, e_kept, likeness(unique, e_unique), likeness(unique, fingerprint[1])

        for batch in batches:
            for doc_id, text, part, extra in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if last is None and extra:
                    continue
                fingerprint = read(text)
                if last is not None:
                    out.append(judged(last, text, fingerprint))
                last = None if extra else (doc_id, text, part, fingerprint)
                if len(out) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], names=NAMES)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], names=NAMES)

    small_batches(docs.sparkSession)
    return with_next(docs).mapInArrow(run, FIELDS)


NAMES = [x.split()[0] for x in FIELDS.split(", ")]
KINDS = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}[x.split()[1]] for x in FIELDS.split(", ")]


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints, in base 64."""
    out = compare(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")})
