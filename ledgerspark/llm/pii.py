"""Information-theoretic sanitisation of personal data (operator 6).

Patterns find e-mail addresses, IP addresses, payment cards and telephone numbers: the
protected entities, by their normalised values. Corpus co-occurrence then says what other
terms give one away: of an entity c that it stands near, a term t leaves the uncertainty
``-log2 p(c | t)``, where ``p(c | t)`` is the share of all documents with t in which it stands
within NEAR words of c. A term, in any document, is a ``term`` span if for some c no more than
``-log2(share)`` bits are left, by the lower bound of that share (Wilson's, for Z, over different
texts). The bar is on ``p(c | t)`` itself, so it is the same for any size of the corpus: with
SHARE 0.5 and Z 1.2816 a word of one text tells nothing, of two texts only if c is near in both.
:func:`sanitize` generalises base spans to their kind and removes terms.

Terms are words in lower case (A-Z) without the punctuation after them, known by 64-bit
hashes; they are counted over all documents, summed in the tasks before the shuffle. An entity
makes pairs with 2 * NEAR terms at most each time it stands somewhere, so pairs grow with the
spans, whatever the page; those of an entity of too few texts to be told go before they are
shuffled. A second look at all documents reads their terms; a bitmap of SLOTS bits spares those
that disclose nothing the join, which decides by the hashes (n told words set at most n bits:
a million fill 0.7 % of it).

Positions are code points, end exclusive. A null text is empty: no spans. Repeated rows
count as documents but not as different texts, and are judged alike. An empty table gives
no rows. Other columns are ignored by :func:`find`, kept by :func:`sanitize`. A very long text
is held by its task, with some arrays of eight bytes a byte.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import Scratch, dealt_documents, hinted, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Z: of the normal distribution, one-sided 90 %.
SHARE, Z, NEAR = 0.5, 1.2816, 32
FLUSH = 3_000_000
SLOTS = 1 << 27
U = np.uint64
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, SIGN, STOP = (np.zeros(256, bool) for _ in range(3))
DIGIT[48:58] = True
STOP[list(b".,;:!?)\"'")] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """As if the whole pattern was searched from left to right, but from each @ on, so a
    long run without one takes no time."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str, digits: int) -> list[tuple[int, int, int, str]]:
    """(start, rank in KINDS, end, normalised value), sorted; ``digits`` is how many ASCII
    digits the text has."""
    out = []
    if "@" in text:
        out += [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    if digits >= 4 and "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end(), m[0]))
    if digits >= 14:
        for m in CARD.finditer(text):
            value = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(value) <= 19 and luhn(value):
                out.append((m.start(), 2, m.end(), value))
    if digits >= 10 and "+" in text:
        for m in PHONE.finditer(text):
            value = "".join(c for c in m[0] if "0" <= c <= "9")
            if 10 <= len(value) <= 15:
                out.append((m.start(), 3, m.end(), value))
    return sorted(out)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType())]))
TERM = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all terms, their first and end byte, and where rows begin."""
    starts, ends, begins = vec.words(data, offsets)
    for _ in range(3):
        ends = np.where((ends - starts > 1) & STOP[data[ends - 1]], ends - 1, ends) if len(ends) else ends
    return vec.word_hashes(vec.LOWER[data], starts, ends), starts, ends, begins


def _free(data: np.ndarray, offsets: np.ndarray, raw: bytes):
    """Of a block of texts: base spans by row (those that have any), and hashes, rows, starts
    and ends of all terms that touch none of them."""
    digits = vec.per_row(DIGIT[data], offsets).tolist()
    hashes, starts, ends, begins = _terms(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    a, b = (place[x] - place[offsets[row]] for x in (starts, ends))
    free, base = np.ones(len(a), bool), {}
    for r in range(len(offsets) - 1):
        mine = raw[offsets[r] : offsets[r + 1]]
        if (digits[r] >= 4 or b"@" in mine) and (spans := base_spans(mine.decode(), digits[r])):
            base[r], own = spans, slice(begins[r], begins[r + 1])
            for s, _, e, _ in spans:  # terms are in order: those that touch it are a run
                i, j = np.searchsorted(b[own], s, "right"), np.searchsorted(a[own], e, "left")
                free[own][i:j] = False
    return base, hashes[free].view(np.int64), row[free], a[free], b[free]


PAIR = pa.list_(pa.struct([("entity", pa.int64()), ("word", pa.int64())]))


def scan(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """``text_key, entities, pairs`` of documents that have base spans: hashes of their values,
    and each with the hashes of the terms within ``near`` of it, but those that touch a span."""
    small_batches(docs.sparkSession)

    def run(batches):
        import xxhash

        signed = lambda x: xxhash.xxh64_intdigest(x) - 2**63
        for batch in batches:
            for _, _, data, offsets in vec.text_blocks(batch.column(0)):
                raw = data.tobytes()
                base, hashes, row, first, _ = _free(data, offsets, raw)
                at, out = np.searchsorted(row, np.arange(len(offsets))), []
                for r, spans in base.items():
                    own, places = hashes[at[r] : at[r + 1]], first[at[r] : at[r + 1]]
                    entities, pairs = set(), set()
                    for start, k, _, value in spans:
                        entities.add(entity := signed(f"{k}:{value}"))
                        i = int(np.searchsorted(places, start))
                        pairs.update((entity, w) for w in own[max(0, i - near) : i + near].tolist())
                    pairs = [{"entity": e, "word": w} for e, w in pairs]
                    out.append((signed(raw[offsets[r] : offsets[r + 1]]), sorted(entities), pairs))
                if out:
                    kinds = (pa.int64(), pa.list_(pa.int64()), PAIR)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["text_key", "entities", "pairs"])

    schema = "text_key long, entities array<long>, pairs array<struct<entity: long, word: long>>"
    return docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def spot(docs: DataFrame, own: list[str], bitmap) -> DataFrame:
    """``key, doc`` (a struct of the columns ``own``), ``base, terms``: of every document the
    base spans and those terms whose bit is set, with their places."""
    small_batches(docs.sparkSession)
    rows_in = docs.select(F.struct(*[docs[c] for c in own]).alias("doc"), docs["text"].cast("string").alias("text"))
    schema = T.StructType([rows_in.schema["doc"], T.StructField("base", SPAN), T.StructField("terms", TERM)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        bits, kinds = bitmap.value, [to_arrow_type(f.dataType) for f in schema.fields[1:]]
        for batch in batches:
            for i, j, data, offsets in vec.text_blocks(batch.column(1)):
                base, hashes, row, a, b = _free(data, offsets, data.tobytes())
                slot = hashes & (SLOTS - 1)
                some = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                at = np.searchsorted(row[some], np.arange(j - i + 1)).astype(np.int32)
                listed = pa.StructArray.from_arrays([pa.array(hashes[some]), *(pa.array(x[some].astype(np.int32)) for x in (a, b))], names=["word", "start", "end"])
                spans = pa.array([[dict(start=s, rank=k, end=e) for s, k, e, _ in base.get(r, ())] for r in range(j - i)], kinds[0])
                terms = pa.ListArray.from_arrays(pa.array(at), listed).cast(kinds[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), spans, terms], names=schema.names)

    return rows_in.mapInArrow(run, schema).withColumn("key", F.monotonically_increasing_id())


def count_terms(docs: DataFrame) -> DataFrame:
    """``word, n``: how many documents hold each term."""

    def run(batches):
        held, size = [], 0

        def flush():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(words), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000])], names=["word", "n"])

        for batch in batches:
            for _, _, data, offsets in vec.text_blocks(batch.column(0)):
                hashes, _, _, begins = _terms(data, offsets)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                if len(hashes):
                    hashes = hashes[np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])]
                held.append(hashes)
                size += len(hashes)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lower_bound(share: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share of n."""
    z2 = F.lit(z * z)
    return (share + z2 / (2 * n) - z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def least_texts(share: float = SHARE, z: float = Z) -> int:
    """In how many different texts a term and an entity must stand together at least."""
    if not 0 < share < 1:
        raise ValueError("the share is to be between 0 and 1")
    return max(1, math.ceil(z * z * share / (1 - share) - 1e-9))


def disclosing(docs: DataFrame, found: DataFrame, scratch: Scratch, share: float = SHARE, z: float = Z) -> DataFrame:
    """``entity, word`` of the pairs that leave at most ``-log2(share)`` bits, from :func:`scan`'s rows."""
    least = least_texts(share, z)
    texts = found.select("text_key", F.explode("entities").alias("entity")).groupBy("entity", "text_key").count()
    often = texts.groupBy("entity").agg(F.count("*").alias("texts")).where(F.col("texts") >= least).select("entity")
    often = scratch.keep(often, "often")
    pairs = found.select("text_key", F.inline("pairs")).join(hinted(often, often.count(), 16), "entity", "left_semi")
    both = pairs.groupBy("entity", "word", "text_key").agg(F.count("*").alias("times"))
    known = both.groupBy("entity", "word").agg(F.count("*").alias("texts"), F.sum("times").alias("n_both")).where(F.col("texts") >= least)
    known = scratch.keep(known, "known")
    if known.isEmpty():
        return known.select("entity", "word")
    words = scratch.keep(known.select("word").distinct(), "words")
    counts = count_terms(docs).join(hinted(words, words.count(), 16), "word", "left_semi")
    part = F.col("n_both") / F.col("n")
    # of n documents with t those with c are n_both; their different texts count as trials
    low = lower_bound(part, F.col("texts") / part, z)
    return known.join(counts, "word").where(low >= share - 1e-12).select("entity", "word")


def find(docs: DataFrame, own: list[str], scratch: Scratch, share: float = SHARE, z: float = Z, near: int = NEAR) -> DataFrame:
    """``doc, base, spans``: base spans, and all spans with rank 4 for terms that disclose."""
    found = scratch.keep(scan(docs, near), "found")
    told = scratch.keep(disclosing(docs, found, scratch, share, z).select("word").distinct(), "told")
    # SLOTS / 8 bytes, in rows of 4096 at most
    slot, bits = F.pmod("word", F.lit(SLOTS)), np.zeros((SLOTS >> 15, 4096), np.uint8)
    for row in told.groupBy(F.shiftright(slot, 15).alias("at")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(1 << 15))).alias("bits")).toLocalIterator():
        bits[row["at"]] = np.frombuffer(row["bits"], np.uint8)
    spotted = scratch.keep(spot(docs, own, docs.sparkSession.sparkContext.broadcast(bits.ravel())), "spotted")
    terms = spotted.select("key", F.inline("terms")).join(hinted(told, told.count()), "word")
    extra = terms.groupBy("key").agg(F.collect_list(F.struct("start", F.lit(4).alias("rank"), "end")).alias("extra"))  # of one document's terms
    out = spotted.drop("terms").join(extra, "key", "left")
    return out.select("doc", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "extra"))).alias("spans"))


def sanitize(docs: DataFrame, scratch: Scratch, share: float = SHARE, z: float = Z, near: int = NEAR) -> DataFrame:
    """``docs`` with base spans generalised to ``[EMAIL]`` and so on and disclosing terms
    removed; ``n_chars``, if there, is brought up to date."""
    found = find(docs, docs.columns, scratch, share, z, near)
    marks = F.lit([f"[{k.upper()}]" for k in KINDS] + ["[REMOVED]"])

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("doc.text"), acc["at"] + 1, s["start"] - acc["at"])
        part = F.concat(acc["out"], gap, F.get(marks, s["rank"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], part).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", zero, cut, lambda a: F.concat(a["out"], F.substring(F.col("doc.text"), a["at"] + 1, F.length("doc.text"))))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("doc.text"))
    out = found.select(text.alias("_text"), "doc")
    columns = {c: F.col(f"doc.{c}") for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.length("_text").cast(docs.schema["n_chars"].dataType), F.col("doc.n_chars"))
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def _listed(spans: str, kinds: tuple[str, ...]) -> Column:
    names = F.lit(list(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_rank(k: int) -> Column:
    return F.filter("base", lambda s: s["rank"] == k)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All personal data of every document."""
    found = find(dealt_documents(spark, sf_dir), ["doc_id"], Scratch(spark, "op6"))  # SHARE, Z and NEAR
    counts = [F.size(_of_rank(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc.doc_id", *counts, F.sha2(_listed("base", KINDS), 256).alias("base_sha256"), _listed("spans", (*KINDS, "term")).alias("spans"), F.size("base").cast("long").alias("n_base"))
