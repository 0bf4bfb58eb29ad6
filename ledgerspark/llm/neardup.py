"""MinHash near-dedup over weighted shingles (operator 8).

A text's shingles are its runs of five words (all its words, if fewer), weighted
``1 + ln(count)``. Its ProbMinHash signature of ``M`` registers: every shingle is a Poisson
process whose rate is its weight; an arrival goes to a random register, which keeps its
earliest one, and a text's processes stop once no later arrival can lower a register. Two
registers agree with the probability Jaccard of the weights. A text with repeated shingles
has a second signature of equal weights, whose registers agree with the probability Jaccard
of the sets; without repeats the two are the same. Signatures are cut into bands of ROWS
registers; texts that share a band of either are candidates, and a candidate pair is a link
if the Jaccard of the two shingle sets, computed from the texts, is THRESHOLD or more
(and LIKELY of their registers of equal weights agree, which spares texts that are hardly
alike the look). So both steps before the verification go by the measure it verifies.

A band's first text (by key) is its pivot and is verified against the others of the band;
links make classes (distributed connected components), so a group of copies costs about a
pair each and is then one class. What is left are bands whose texts are of several classes.
They are dealt in blocks of about BLOCK texts; the blocks of a band meet in tasks, two by
two, but for those of its largest class, which need not meet each other. One product of
their shingle incidences gives the exact Jaccard of each text with each other one; a task
hands on only links that join classes, fewer than it has texts. So texts of different
classes that share a band are all compared, and no list of pairs is made. What is lost are
pairs that share no band, ``(1 - s**ROWS)**BANDS`` at similarity s (3e-4 at 0.8), or that
LIKELY turns down (2e-11 at 0.8).

Equal texts are one class from the start and are hashed once; a null text is empty, and
all empty texts are one class. A class's id is its smallest ``doc_id`` (nulls last).
Repeated rows stay, an empty table gives no rows, other columns are ignored by
:func:`classes` and kept by :func:`first_of_each`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import vec
from .common import Scratch, dealt_documents, hinted, release, small_batches, text_of
from .graph import components

K, M, ROWS, THRESHOLD = 5, 238, 7, 0.8
#: Share of equal registers (of equal weights) below which a candidate pair isn't verified:
#: at a set similarity of THRESHOLD less than exp(-M * KL(LIKELY, THRESHOLD)) = 2e-11 fall
#: below it; all bands miss (1 - THRESHOLD**ROWS)**BANDS = 3e-4.
LIKELY = 0.6
#: Texts of a band that are worked on together.
BLOCK = 128
U = np.uint64


def text_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (row, hash, count), sorted by row and hash."""
    starts, ends, begins = vec.words(data, offsets)
    hashes = vec.word_hashes(data, starts, ends)
    runs, at = vec.shingles(hashes, begins, K)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    short = np.flatnonzero((np.diff(begins) < K) & (np.diff(begins) > 0))
    if len(short):
        whole = np.zeros(len(short), U)
        for n, r in enumerate(short):
            for h in hashes[begins[r] : begins[r + 1]]:
                whole[n : n + 1] = vec.mix(whole[n : n + 1] * U(0x9FB21C651E98DF25) + h)
        runs, rows = np.concatenate([runs, whole]), np.concatenate([rows, short])
    order = np.lexsort((runs, rows))
    runs, rows = runs[order], rows[order]
    if not len(runs):
        return rows, runs, np.zeros(0, np.int64)
    new = np.concatenate([[True], (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1])])
    first = np.flatnonzero(new)
    return rows[first], runs[first], np.diff(np.concatenate([first, [len(runs)]]))


def signatures(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The ProbMinHash registers (the shingle that came first) of n rows."""
    least = np.full(n * M, np.inf)
    who = np.zeros(n * M, U)
    live = np.arange(len(hashes))
    time = np.zeros(len(hashes))
    state = vec.mix(hashes + U(0x632BE59BD9B4E019))
    last = np.full(n, np.inf)
    while len(live):
        state = vec.mix(state + U(0x9E3779B97F4A7C15))
        gap = -np.log(((state >> U(11)).astype(np.float64) + 0.5) / 2.0**53)
        time = time + gap / weights[live]
        ok = time < last[rows[live]]
        live, state, time = live[ok], state[ok], time[ok]
        if not len(live):
            break
        place = rows[live] * M + (vec.mix(state ^ U(0xA0761D6478BD642F)) % U(M)).astype(np.int64)
        order = np.lexsort((time, place))
        p = place[order]
        lead = order[np.concatenate([[True], p[1:] != p[:-1]])]
        lead = lead[time[lead] < least[place[lead]]]
        least[place[lead]] = time[lead]
        who[place[lead]] = hashes[live[lead]]
        last = least.reshape(n, M).max(1)
    return who.reshape(n, M)


BANDS = M // ROWS


def text_key(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, key, bands, sketch`` of every row; a text without words has no bands. The
    sketch is a byte of each register of equal weights."""
    small_batches(docs.sparkSession)
    rows_in = docs.select(docs["doc_id"], text_of(docs).alias("text")).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    schema = T.StructType([rows_in.schema["doc_id"], rows_in.schema["key"], T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def banded(who: np.ndarray) -> np.ndarray:
        bands = np.repeat(salt[None, :], len(who), 0)
        for k in range(ROWS):
            bands = vec.mix(bands * U(0x9FB21C651E98DF25) + who[:, k::ROWS])
        return bands

    salt = (np.arange(BANDS, dtype=U) + U(1)) * U(0xD1B54A32D192ED03)

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in vec.small_blocks(batch.column(2)):
                n = j - i
                rows, hashes, counts = text_shingles(data, offsets)
                who = signatures(rows, hashes, np.ones(len(rows)), n)
                some = np.bincount(rows, minlength=n) > 0
                # of texts that repeat a shingle also the weighted bands that differ
                again = np.bincount(rows[counts > 1], minlength=n) > 0
                mine = again[rows]
                own = (np.cumsum(again) - 1)[rows[mine]]
                bands, keep = np.zeros((n, 2 * BANDS), U), np.zeros((n, 2 * BANDS), bool)
                bands[:, :BANDS], keep[:, :BANDS] = banded(who), some[:, None]
                bands[again, BANDS:] = banded(signatures(own, hashes[mine], 1 + np.log(counts[mine]), int(again.sum())))
                keep[again, BANDS:] = bands[again, BANDS:] != bands[again, :BANDS]
                ends = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[keep].view(np.int64)))
                small = pa.array([x.tobytes() for x in (vec.mix(who) >> U(56)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), listed, small], names=schema.names)
        release()

    return rows_in.mapInArrow(run, schema)


def verified(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``u, v`` of those rows of ``u, v, u_text, v_text`` whose shingle sets are alike."""
    schema = T.StructType([pairs.schema["u"], pairs.schema["v"]])

    def run(batches):
        for batch in batches:
            n, i = batch.num_rows, 0
            a, b = (batch.column(c).cast(pa.large_binary()) for c in (2, 3))
            size = np.cumsum([len(x.as_py()) + len(y.as_py()) for x, y in zip(a, b)])
            while i < n:
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + vec.BLOCK, "right")))
                both = pa.concat_arrays([a.slice(i, j - i), b.slice(i, j - i)])
                ((_, _, data, offsets),) = vec.text_blocks(both, 1 << 62)
                rows, hashes, _ = text_shingles(data, offsets)
                sizes = np.bincount(rows, minlength=2 * (j - i))
                keyed = np.lexsort((hashes, rows % (j - i)))
                r, h = rows[keyed] % (j - i), hashes[keyed]
                same = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
                shared = np.bincount(r[1:][same], minlength=j - i)
                union = sizes[: j - i] + sizes[j - i :] - shared
                good = np.flatnonzero((union > 0) & (shared >= threshold * union))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(good)) for c in (0, 1)], names=schema.names)
                i = j
        release()

    return pairs.select("u", "v", "u_text", "v_text").mapInArrow(run, schema)


def likely(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Those of ``u, v`` with LIKELY equal registers or more."""
    schema = T.StructType([pairs.schema["u"], pairs.schema["v"]])
    both = pairs.join(sketch.select(F.col("key").alias("u"), F.col("sketch").alias("a")), "u").join(sketch.select(F.col("key").alias("v"), F.col("sketch").alias("b")), "v")

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, M) for c in (2, 3))
            good = pa.array(np.flatnonzero((a == b).sum(1) >= LIKELY * M))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(good) for c in (0, 1)], names=schema.names)

    return both.select("u", "v", "a", "b").mapInArrow(run, schema)


def _with_texts(pairs: DataFrame, rows: int, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Texts for ``u, v``; a pivot in many pairs is a skewed key of plain joins, which
    adaptive execution splits."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    text = docs.select(text_of(docs).alias("text")).select(text_key(F.col("text")).alias("key"), "text")
    few = scratch.keep(text.join(hinted(wanted, 2 * rows), "key", "left_semi").dropDuplicates(["key"]), "few")
    own = pairs.join(few.select(F.col("key").alias("u"), F.col("text").alias("u_text")), "u")
    return own.join(few.select(F.col("key").alias("v"), F.col("text").alias("v_text")), "v")


def _links_within(owner: np.ndarray, shingle: np.ndarray, sizes: np.ndarray, group: list) -> list[tuple[int, int]]:
    """Pairs with a similarity of THRESHOLD that join the groups of some texts, a tree of them."""
    n = len(sizes)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
    column = np.cumsum(new) - 1
    times = np.bincount(column)
    keep = times[column] > 1
    _, column = np.unique(column[keep], return_inverse=True)
    owner, shared = owner[keep], np.zeros((n, n), np.float32)
    at = 0
    while at < len(column):  # some thousand shingles at a time
        end = np.searchsorted(column, column[at] + 4096)
        x = np.zeros((int(column[end - 1] - column[at]) + 1, n), np.float32)
        x[column[at:end] - column[at], owner[at:end]] = 1
        shared += x.T @ x
        at = end
    alike = shared >= THRESHOLD * (sizes[:, None] + sizes[None, :] - shared)
    root = {c: c for c in group}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(alike, 1))):
        if (a := find(group[i])) != (b := find(group[j])):
            root[a] = b
            out.append((int(i), int(j)))
    return out


def dealt(members: DataFrame) -> DataFrame:
    """``band, inner, lo, hi, u, c``: to which blocks' meetings the texts of each band go, so
    that each two texts of different classes meet, if in a band.

    A band's largest class is cut into blocks, and so are the others together. Every block of
    the others meets every other such one (``inner``) and every block of the largest class;
    blocks of the largest class don't meet each other. One stray text beside a class of n
    goes to n / BLOCK meetings, and each of the n to one."""
    by_class = members.groupBy("band", "c").agg(F.count("*").alias("n"))
    sizes = by_class.groupBy("band").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("band", F.col("most.c").alias("main"), blocks(F.col("most.n")).alias("mains"), blocks(F.col("n") - F.col("most.n")).alias("others"))
    rows = members.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("u"), F.when(F.col("c") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    meeting = lambda inner, lo, hi: F.struct(F.lit(inner).alias("inner"), lo.alias("lo"), hi.alias("hi"))
    own = F.col("own")
    of_main = F.transform(every(F.col("others")), lambda k: meeting(False, own, k))
    of_other = F.concat(
        F.transform(every(F.col("mains")), lambda k: meeting(False, k, own)),
        F.transform(every(F.col("others")), lambda k: meeting(True, F.least(k, own), F.greatest(k, own))),
    )
    return rows.select("band", "u", "c", F.inline(F.when(F.col("c") == F.col("main"), of_main).otherwise(of_other)))


def block_links(left: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, v``: links between texts of different classes ``c`` in the same band."""
    members = left.select("band", "u", "c")
    wanted = scratch.keep(members.select(F.col("u").alias("key")).distinct(), "wanted")
    text = docs.select(text_of(docs).alias("text")).select(text_key(F.col("text")).alias("key"), "text")
    few = text.join(hinted(wanted, wanted.count()), "key", "left_semi")
    held = T.StructType([few.schema["key"], T.StructField("shingles", T.BinaryType())])

    def cut(batches):
        for batch in batches:
            for i, j, data, offsets in vec.text_blocks(batch.column(1)):
                rows, hashes, _ = text_shingles(data, offsets)
                begins = np.searchsorted(rows, np.arange(j - i + 1))
                lists = [hashes[begins[r] : begins[r + 1]].tobytes() for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lists, pa.binary())], names=held.names)
        release()

    few = scratch.keep(few.select("key", "text").mapInArrow(cut, held).dropDuplicates(["key"]), "shingles")
    rows = dealt(members).join(few.withColumnRenamed("key", "u"), "u")
    schema = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])

    def run(group: pa.Table) -> pa.Table:
        keys, classes_, lists = (group.column(k).to_pylist() for k in ("u", "c", "shingles"))
        sizes = np.array([len(x) // 8 for x in lists], np.int64)
        found = _links_within(np.repeat(np.arange(len(keys)), sizes), np.frombuffer(b"".join(lists), U), sizes, classes_)
        return pa.table([pa.array([keys[e[k]] for e in found], pa.binary()) for k in (0, 1)], names=["u", "v"])

    rows = rows.select("band", "inner", "lo", "hi", "u", "c", "shingles")
    return rows.groupBy("band", "inner", "lo", "hi").applyInArrow(run, schema)  # two blocks a group


def link(rows: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``node, component`` of the text keys that have a link; None if there is none."""
    texts = scratch.keep(rows.select("key", "bands", "sketch").dropDuplicates(["key"]), "texts")
    bands = scratch.keep(texts.select(F.explode("bands").alias("band"), F.col("key").alias("u")), "bands")
    shared = bands.groupBy("band").agg(F.min("u").alias("v"), F.max("u").alias("hi")).where("v < hi").select("band", "v")
    shared = scratch.keep(shared, "shared")
    rest = scratch.keep(bands.join(hinted(shared, shared.count()), "band").where("u > v").select("band", "u", "v"), "rest")
    scratch.drop(bands)
    close = scratch.keep(likely(rest.select("u", "v").distinct(), texts), "close")
    if not (n := close.count()):
        edges = groups = None
        classed = rest.select("band", "u", F.col("u").alias("c"))
    else:
        edges = scratch.keep(verified(_with_texts(close, n, docs, scratch)), "links")
        groups = scratch.keep(components(edges, scratch), "groups")
        own, few = groups.select(F.col("node").alias("u"), F.col("component").alias("c")), groups.count()
        classed = rest.join(hinted(own, few), "u", "left").select("band", "u", F.coalesce("c", "u").alias("c"))
    # bands of three texts or more that are of several classes
    classed = scratch.keep(classed, "classed")
    several = classed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"))
    several = scratch.keep(several.where("lo < hi and n > 1").select("band"), "several")
    if not (n := several.count()):
        return groups
    left = scratch.keep(classed.join(hinted(several, n), "band").select("band", "u", "c"), "left")
    more = scratch.keep(block_links(left, docs, scratch), "more")
    edges = more if edges is None else edges.unionByName(more)
    return scratch.keep(components(edges, scratch), "groups")


def text_classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key`` of every row, and ``key, class_id, class_key`` of every text."""
    rows = scratch.keep(sketches(docs), "rows")
    groups = link(rows, docs, scratch)
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("least"))
    if groups is None:
        named = texts.select("key", F.col("least").alias("class_id"), F.col("key").alias("class_key"))
        return rows.select("doc_id", "key"), scratch.keep(named, "named")
    classed = texts.join(groups.select(F.col("node").alias("key"), F.col("component").alias("class_key")), "key", "left")
    classed = scratch.keep(classed.withColumn("class_key", F.coalesce("class_key", "key")), "classed")
    names = scratch.keep(classed.groupBy("class_key").agg(F.min("least").alias("class_id")), "names")
    return rows.select("doc_id", "key"), scratch.keep(classed.join(names, "class_key").select("key", "class_id", "class_key"), "named")


def classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, class_id, class_key`` of every row."""
    rows, named = text_classes(docs, scratch)
    return rows.join(named, "key").select("doc_id", "class_id", F.lower(F.hex("class_key")).alias("class_key"))


def first_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of each class: of its smallest ``doc_id`` (of equal ones the smallest key),
    with the columns that ``docs`` has."""
    rows, named = text_classes(docs, scratch)
    first = rows.join(named, "key").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x"))
    first = scratch.keep(first.select(F.col("x.doc_id").alias("_id"), F.col("x.key").alias("_key")), "first")
    held = docs.select(F.struct("*").alias("doc"), docs["doc_id"].alias("own_id"), text_key(text_of(docs)).alias("own_key"))
    match = F.col("own_key").eqNullSafe(F.col("_key")) & F.col("own_id").eqNullSafe(F.col("_id"))
    kept = held.join(first, match, "left_semi")
    one = F.row_number().over(W.partitionBy("own_key", "own_id").orderBy(F.lit(0)))  # of repeated rows any
    return kept.withColumn("n", one).where("n = 1").select("doc.*")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(dealt_documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark, "op8"))
