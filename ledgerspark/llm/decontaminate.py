"""Benchmark decontamination by winnowing (operator 13).

A text's words are its runs of letters, digits and characters beyond ASCII, A-Z in lower case.
Of each SPAN - GRAM + 1 successive runs of GRAM words the one of least hash is kept, of equal
ones the rightmost: a text's anchors. Two texts that share SPAN words in a row share a whole
such window, so both keep the same anchor of it: no shared span of SPAN words goes unseen. An
item of fewer words, but not none, is one window of its own; its only anchor is all of it, and
texts are looked through for runs of as many words.

Anchors of documents and items are joined by hash. Each carries the hashes of the words around
it, as far as a span with it can reach; a match is extended to both sides word by word, and
counts if it comes to a whole window. Words inside such spans are hit.

A bitmap of SLOTS bits of the items' anchors spares the join nearly all of the documents' (a
full one would spare it none, and change nothing). A document's anchors leave its task in rows
of MOST, its hit words are united 64 at a time, and items are joined to their anchors only
after equal anchors have been verified once. Words are equal if their 64-bit hashes are.

Null texts have no words. A null ``doc_id`` is kept, a null ``item_id`` is the empty string;
rows with one ``item_id`` are one item. Repeated documents are judged alike, an empty table of
either kind gives no hits, other columns are ignored. A very long text is held by the task that
reads it, with some arrays of eight bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import Scratch, dealt_documents, hinted, release, small_batches, table

SPAN, GRAM = 10, 5
SLOTS, MOST, LISTS = 1 << 27, 4096, 256
U = np.uint64
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
ANCHOR = T.StructType([T.StructField("gram", T.LongType()), T.StructField("need", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("around", T.BinaryType())])


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and at which word each row begins."""
    starts, ends, begins = vec.runs(WORD[data], offsets)
    return vec.word_hashes(vec.LOWER[data], starts, ends), begins


def winnowed(grams: np.ndarray, begins: np.ndarray, window: int) -> np.ndarray:
    """Which grams are the least, of equal ones the rightmost, of a window within a row."""
    n = len(grams)
    kept = np.zeros(n, bool)
    if n < window:
        return kept
    best = np.arange(n - window + 1)
    for j in range(1, window):
        best = np.where(grams[j : n - window + 1 + j] <= grams[best], np.arange(j, n - window + 1 + j), best)
    counts = np.diff(begins)
    whole = np.arange(n) + window <= np.repeat(begins[1:], counts)
    kept[best[whole[: len(best)]]] = True
    return kept


def anchors(hashes: np.ndarray, begins: np.ndarray, span: int, gram: int, short: list[int], bits: np.ndarray | None, whole: bool = False):
    """``row, gram, need, place`` of all anchors, sorted by row and place: those of ``span`` words,
    and, for each length in ``short``, all runs of that length (``whole``: of rows of just that
    length). Those whose bit isn't set are left out."""
    found = []
    for need in [span, *short]:
        size = gram if need == span else need
        runs, at = vec.shingles(hashes, begins, size)
        row = np.repeat(np.arange(len(begins) - 1), np.diff(at))
        keep = winnowed(runs, at, span - gram + 1) if need == span else np.ones(len(runs), bool)
        if whole and need != span:
            keep &= (np.diff(begins) == need)[row]
        key = vec.mix(runs + U(need * 0xD6E8FEB86659FD93 % 2**64))
        if bits is not None:
            slot = key & U(SLOTS - 1)
            keep &= (bits[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8) & 1).astype(bool)
        one = np.flatnonzero(keep)
        row = row[one]
        place = one - at[row]
        found.append((row, key[one], np.full(len(one), need, np.int32), place))
    row, key, needs, place = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, row))
    return row[order], key[order], needs[order], place[order]


def surroundings(hashes: np.ndarray, begins: np.ndarray, row: np.ndarray, place: np.ndarray, span: int, gram: int, gap: int) -> np.ndarray:
    """The words around each anchor, a row of hashes each; ``gap`` stands in for those beyond a
    text's ends."""
    around = (begins[row] + place)[:, None] + np.arange(gram - span, span)[None, :]
    inside = (around >= begins[row][:, None]) & (around < begins[row + 1][:, None])
    return np.where(inside, hashes[np.clip(around, 0, len(hashes) - 1)], U(gap)) if len(hashes) else np.zeros(around.shape, U)


def _listed(hashes: np.ndarray, begins: np.ndarray, found: tuple, span: int, gram: int, gap: int):
    """Anchors as lists of MOST at most, some LISTS lists at a time: (row of each list, which of
    its row's it is, lists)."""
    row, key, needs, place = found
    first = np.searchsorted(row, np.arange(len(begins)))
    counts = np.maximum(1, -(-np.diff(first) // MOST))
    owner = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = np.append(first[owner] + MOST * inner, len(row))
    for i in range(0, len(owner), LISTS):
        j = min(i + LISTS, len(owner))
        some = slice(ends[i], ends[j])
        around = np.ascontiguousarray(surroundings(hashes, begins, row[some], place[some], span, gram, gap))
        bytes_ = (8 * around.shape[1] * np.arange(len(around) + 1)).astype(np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(around), [None, pa.py_buffer(bytes_), pa.py_buffer(around)])
        fields = [pa.array(key[some].view(np.int64)), pa.array(needs[some]), pa.array(place[some].astype(np.int32)), raw]
        lists = pa.ListArray.from_arrays(pa.array((ends[i : j + 1] - ends[i]).astype(np.int32)), pa.StructArray.from_arrays(fields, names=ANCHOR.names))
        yield owner[i:j], inner[i:j], lists


def item_anchors(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``item, gram, need, around`` of every item's windows."""
    rows_in = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item"), items["text"].cast("string").alias("text"))
    schema = T.StructType([rows_in.schema["item"], T.StructField("anchors", T.ArrayType(ANCHOR))])

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in vec.small_blocks(batch.column(1)):
                hashes, begins = hashed_words(data, offsets)
                found = anchors(hashes, begins, span, gram, list(range(1, span)), None, whole=True)
                for owner, _, lists in _listed(hashes, begins, found, span, gram, 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(owner)), lists], names=schema.names)

    return rows_in.mapInArrow(run, schema).select("item", F.inline("anchors")).select("item", "gram", "need", "around")


def bitmap(grams: DataFrame) -> np.ndarray:
    """SLOTS bits, those of ``gram`` set; comes in rows of 4 KB, SLOTS / 8 bytes in all."""
    slot, bits = F.pmod("gram", F.lit(SLOTS)), np.zeros((SLOTS >> 15, 4096), np.uint8)
    rows = grams.groupBy(F.shiftright(slot, 15).alias("at")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(1 << 15))).alias("bits"))
    for row in rows.toLocalIterator():
        bits[row["at"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def doc_anchors(docs: DataFrame, bits, short: list[int], span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``row, part, doc_id, n_words, some, anchors``: of every document one row, numbered by its
    task, and more for the anchors beyond MOST; ``some``: whether there are any."""
    small_batches(docs.sparkSession)
    rows_in = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    head = T.StructType([T.StructField("row", T.LongType()), T.StructField("part", T.IntegerType()), rows_in.schema["doc_id"]])
    schema = T.StructType([*head.fields, T.StructField("n_words", T.LongType()), T.StructField("some", T.BooleanType()), T.StructField("anchors", T.ArrayType(ANCHOR))])

    def run(batches):
        from pyspark import TaskContext

        base, held = TaskContext.get().partitionId() << 33, bits.value
        for batch in batches:
            for i, j, data, offsets in vec.small_blocks(batch.column(1)):
                hashes, begins = hashed_words(data, offsets)
                found = anchors(hashes, begins, span, gram, short, held)
                for owner, inner, lists in _listed(hashes, begins, found, span, gram, 0):
                    ids = batch.column(0).slice(i, j - i).take(pa.array(owner))
                    columns = [pa.array(base + owner), pa.array(inner.astype(np.int32)), ids, pa.array(np.diff(begins)[owner]), pa.compute.greater(pa.compute.list_value_length(lists), 0), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                base += j - i
        release()

    return rows_in.mapInArrow(run, schema)


def extended(pairs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``row, low, high, gram, around``: of rows of ``row, place, need, gram, mine, around`` those
    whose words agree over a whole window, and the words of the document from ``low`` to before
    ``high`` that do."""
    reach = span - gram
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("around", T.BinaryType())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, theirs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U).reshape(batch.num_rows, -1) for c in ("mine", "around"))
            same, need = mine == theirs, batch.column("need").to_numpy()
            size = np.where(need == span, gram, need)
            left = np.cumprod(same[:, :reach][:, ::-1], 1).sum(1)
            # from the anchor's first word on, to the right
            right = np.cumprod(same[:, reach:], 1).sum(1)
            left, right = np.where(need == span, left, 0), np.where(need == span, right, np.minimum(right, need))
            good = np.flatnonzero((right >= size) & (left + right >= need))
            place, part = batch.column("place").to_numpy()[good], batch.take(pa.array(good))
            low, high = (pa.array(x.astype(np.int32)) for x in (place - left[good], place + right[good]))
            yield pa.RecordBatch.from_arrays([part.column("row"), low, high, part.column("gram"), part.column("around")], names=schema.names)

    return pairs.select("row", "place", "need", "gram", "mine", "around").mapInArrow(run, schema)


def hit_words(hits: DataFrame) -> DataFrame:
    """``row, n_hit``: how many words stand in the spans ``low, high``, by masks of 64."""
    blocks = hits.select("row", "low", "high", F.explode(F.sequence(F.expr("low div 64"), F.expr("(high - 1) div 64"))).alias("block"))
    mask = F.expr("shiftleft(-1L, int(greatest(low - 64 * block, 0))) & shiftrightunsigned(-1L, int(63 - least(high - 1 - 64 * block, 63)))")
    united = blocks.groupBy("row", "block").agg(F.bit_or(mask).alias("mask"))
    return united.groupBy("row").agg(F.sum(F.bit_count("mask")).cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items`` (their ids, sorted as strings) of every document."""
    own = scratch.keep(item_anchors(items, span, gram).distinct(), "items")
    short = sorted(r[0] for r in own.where(F.col("need") < span).select("need").distinct().collect())  # under span of them
    held = docs.sparkSession.sparkContext.broadcast(bitmap(own))
    scanned = scratch.keep(doc_anchors(docs, held, short, span, gram), "scanned")
    looked = scratch.keep(own.select("gram", "need", "around").distinct(), "looked")
    mine = scanned.where("some").select("row", F.inline("anchors")).withColumnRenamed("around", "mine")
    width = 8 * (2 * span - gram) + 24
    hits = scratch.keep(extended(mine.join(hinted(looked, looked.count(), width), ["gram", "need"]), span, gram), "hits")
    named = own.select("gram", "around", "item").distinct()
    told = hits.select("row", "gram", "around").distinct().join(hinted(named, own.count(), width + 16), ["gram", "around"])
    told = told.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))  # a document's, at most all items
    first = scanned.where("part = 0").select("row", "doc_id", "n_words", "some")
    dirty = first.where("some").join(hit_words(hits), "row", "left").join(told, "row", "left")
    none = F.array().cast("array<string>")
    clean = first.where("not some").withColumns({"n_hit": F.lit(0).cast("long"), "items": none})
    both = dirty.select(*clean.columns).unionByName(clean)
    items_ = F.coalesce("items", none)
    return both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items."""
    docs, items = dealt_documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = contamination(docs, items, Scratch(spark, "op13"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
places AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM windows))
),
hits AS (SELECT r, i, m, item FROM places JOIN windows USING (m, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
