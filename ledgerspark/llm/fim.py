"""Fill-in-middle transformation by a parallel automaton scan (operator 12).

A text's units are its lines, ``[^\\n]*\\n|[^\\n]+``. One automaton of eight states reads a
text's bytes: whether a line begins here, and how much of one of the marks ``<P>``, ``<S>``,
``<M>`` stands before (nothing, ``<``, ``<P``, or a whole one somewhere, which it never
forgets). A chunk of text, wherever it lies, gives the automaton's transition function (the
state it ends in, for each state it may be entered in) and how many lines begin in it, again
by entry state. These pairs compose associatively, so chunks are read independently and a
scan over them gives each one's entry state and how many lines began before: what is needed
to select the chunk and the place where line k begins.

:func:`transform` does so on three levels with one function, :func:`prefixes`: symbols in
chunks of CHUNK bytes, chunks in a piece, and, for texts of more than ``piece`` bytes, pieces
dealt over all tasks. A text's pieces' functions (at most 2 GB / ``piece`` of them) compose in
one task; the pieces that hold a cut are looked at again.

The prefix ends after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` of a text's n lines,
the middle after the larger; h1 to h4 are the first four 8-digit groups of the hex SHA-256 of
``seed:doc_id``. A text that is empty or holds a mark is left ``plain``; others are written
``<P>`` prefix ``<S>`` suffix ``<M>`` middle (``psm``) or ``<S>`` suffix ``<P>`` prefix ``<M>``
middle (``spm``). :func:`restored` gets the text back from either.

A null text is empty; a null ``doc_id`` is hashed as no digits and kept. Repeated rows are
treated alike, an empty table gives no rows, other columns are ignored. A very long text is
held whole only by the tasks that read and write its row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import Scratch, dealt_documents, partitions, release, small_batches, text_of

SEED, PERCENT_FIM, PERCENT_SPM = 7, 100, 50
#: Bytes of text whose symbols are scanned together, and of a text from which on its pieces
#: are dealt over tasks. Neither changes a result.
CHUNK, PIECE = 4096, 1 << 20
OTHER, NEWLINE, OPEN, LETTER, CLOSE = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[ord("\n")], KIND[ord("<")], KIND[ord(">")] = NEWLINE, OPEN, CLOSE
KIND[list(b"PSM")] = LETTER
#: States are ``4 * inside a line + mark``, marks nothing, ``<``, ``<P``, found.
STATES, FOUND = 8, 3


def _step(kind: int, state: int) -> int:
    mark = state % 4
    if mark != FOUND:
        mark = {OPEN: 1, LETTER: 2 * (mark == 1), CLOSE: FOUND * (mark == 2)}.get(kind, 0)
    return 4 * (kind != NEWLINE) + mark


TO = np.array([[_step(k, s) for s in range(STATES)] for k in range(5)], np.uint8)
#: A byte begins a line if it is read in one of the first four states.
STARTS = np.array([[int(s < 4) for s in range(STATES)]] * 5, np.int64)


def prefixes(to: np.ndarray, starts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of transition functions and line counts: each row composed with all before it
    in its segment (``begins``: where segments begin). Doubling steps, so a segment of m rows
    takes log m of them."""
    to, starts, n = to.copy(), starts.copy(), len(to)
    sizes = np.diff(np.append(begins, n))
    place = np.arange(n) - np.repeat(begins, sizes)
    step = 1
    while (at := np.flatnonzero(place >= step)).size:
        before, own = to[at - step], to[at]
        counts = starts[at - step] + np.take_along_axis(starts[at], before.astype(np.intp), 1)
        to[at] = np.take_along_axis(own, before.astype(np.intp), 1)
        starts[at] = counts
        step *= 2
    return to, starts


class Scan:
    """The scan of a block of texts: ``to, starts``: each text's function and counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets, sizes = offsets, np.diff(offsets)
        counts = -(-sizes // CHUNK)
        self.owner = np.repeat(np.arange(len(sizes)), counts)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # of each text's chunks
        inner = np.arange(len(self.owner)) - self.first[self.owner]
        self.begins = offsets[self.owner] + CHUNK * inner
        self.places, self.symbols = self._symbols(data)
        self.own = np.searchsorted(self.places, self.begins)  # the first symbol of each chunk
        self.inner = prefixes(TO[self.symbols], STARTS[self.symbols], self.own)
        last = np.append(self.own[1:], len(self.places)) - 1
        full = counts > 0
        self.chunks = prefixes(self.inner[0][last], self.inner[1][last], self.first[:-1][full])
        self.to = np.tile(np.arange(STATES, dtype=np.uint8), (len(sizes), 1))
        self.starts = np.zeros((len(sizes), STATES), np.int64)
        self.to[full], self.starts[full] = (x[self.first[1:][full] - 1] for x in self.chunks)

    def _symbols(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes that matter stand, and their kinds: letters and ``>`` count only
        after what they complete, and of successive other bytes the first does for all, as
        reading one more of them changes nothing. A chunk's first byte always stands."""
        kind = KIND[data]
        first = np.zeros(len(kind), bool)
        first[self.begins] = True
        loose = np.zeros(len(kind), bool)
        for what, needs in ((LETTER, OPEN), (CLOSE, LETTER)):
            loose[1:] = (kind[1:] == what) & (kind[:-1] != needs)
            kind[loose & ~first] = OTHER
        keep = kind != OTHER
        keep[1:] |= kind[:-1] != OTHER
        places = np.flatnonzero(keep | first)
        return places, kind[places]

    def entered(self, state: np.ndarray | int = 0) -> np.ndarray:
        """Where lines begin, if each text is entered in ``state`` (one, or one a text)."""
        state = np.broadcast_to(np.asarray(state), (len(self.offsets) - 1,))[self.owner]
        entry = state.copy()
        later = np.flatnonzero(np.arange(len(self.owner)) > self.first[self.owner])
        entry[later] = self.chunks[0][later - 1, state[later]]
        chunk = np.repeat(np.arange(len(self.own)), np.diff(np.append(self.own, len(self.places))))
        before = entry[chunk]
        rest = np.ones(len(chunk), bool)
        rest[self.own] = False
        rest = np.flatnonzero(rest)
        before[rest] = self.inner[0][rest - 1, before[rest]]
        return self.places[before < 4]


def chosen(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """After how many of n lines the prefix and the middle end."""
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


CUTS = (("n", pa.int64()), ("found", pa.bool_()), ("first_cut", pa.int64()), ("second_cut", pa.int64()))


def _whole(schema: T.StructType):
    """Texts of up to a piece: lines, marks and cuts (in code points) in one go."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in vec.small_blocks(batch.column(1)):
                scan, rows = Scan(data, offsets), batch.slice(i, j - i)
                n = scan.starts[:, 0]
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                at = np.append(scan.entered(), 0)
                base = np.concatenate([[0], np.cumsum(n)[:-1]])
                cuts = []
                for k in chosen(n, *(rows.column(c).to_numpy() for c in (2, 3))):
                    place = np.where(k < n, at[np.minimum(base + k, len(at) - 1)], offsets[1:])
                    cuts.append(points[place] - points[offsets[:-1]])
                found = [pa.array(x, t) for x, (_, t) in zip((n, scan.to[:, 0] % 4 == FOUND, *cuts), CUTS)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *found], names=schema.names)
        release()

    return run


def _read(batches):
    """Each piece's function and counts."""
    for batch in batches:
        for i, j, data, offsets in vec.small_blocks(batch.column("bytes")):
            scan, rows = Scan(data, offsets), batch.slice(i, j - i)
            chars = vec.per_row((data & 0xC0) != 0x80, offsets)
            to = pa.array([x.tobytes() for x in scan.to], pa.binary())
            starts = pa.array(scan.starts.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("key", "h1", "h2", "piece")), to, starts, pa.array(chars)], names=_names(READ))


READ = "key string, h1 long, h2 long, piece int, to binary, starts array<long>, chars long"
RESOLVED = "key string, piece int, entry int, wanted array<struct<cut: int, ordinal: long>>, before long, n long, found boolean, total long"
WANTED = pa.list_(pa.struct([("cut", pa.int32()), ("ordinal", pa.int64())]))
KINDS = (pa.string(), pa.int32(), pa.int32(), WANTED, pa.int64(), pa.int64(), pa.bool_(), pa.int64())


def _names(ddl: str) -> list[str]:
    return [re.split(" ", x)[0] for x in re.split(r", (?![^<]*>)", ddl)]


def _resolve(group: pa.Table) -> pa.Table:
    """Of one text's pieces: the state each is entered in, the code points before it, and which
    cut is the ``ordinal``-th line start in it."""
    group = group.sort_by("piece")
    to = np.frombuffer(b"".join(group["to"].to_pylist()), np.uint8).reshape(-1, STATES)
    to, starts = prefixes(to, np.array(group["starts"].to_pylist(), np.int64), np.array([0]))
    entry, lines = np.append(0, to[:-1, 0]), np.append(0, starts[:, 0])
    chars = np.append(0, np.cumsum(group["chars"].to_numpy()))
    n, h1, h2 = lines[-1], group["h1"][0].as_py(), group["h2"][0].as_py()
    wanted: list[list[dict]] = [[] for _ in entry]
    for cut, k in enumerate(int(x[0]) for x in chosen(np.array([n]), np.array([h1]), np.array([h2]))):
        if k < n:
            j = int(np.searchsorted(lines, k, "right")) - 1
            wanted[j].append({"cut": cut, "ordinal": int(k - lines[j])})
    m = len(entry)
    columns = (group["key"].to_pylist(), group["piece"].to_pylist(), entry.tolist(), wanted, chars[:-1].tolist(), [int(n)] * m, [bool(to[-1, 0] % 4 == FOUND)] * m, [int(chars[-1])] * m)
    return pa.table([pa.array(c, k) for c, k in zip(columns, KINDS)], names=_names(RESOLVED))


def _select(batches):
    """Where the wanted lines begin, in code points of the text."""
    for batch in batches:
        for i, j, data, offsets in vec.small_blocks(batch.column("bytes")):
            rows = batch.slice(i, j - i)
            at = Scan(data, offsets).entered(rows.column("entry").to_numpy())
            base, out = np.searchsorted(at, offsets[:-1]), []
            for r, (key, wanted, before) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("key", "wanted", "before")))):
                for w in wanted:
                    place = at[base[r] + w["ordinal"]]
                    out.append((key, w["cut"], before + int(np.count_nonzero((data[offsets[r] : place] & 0xC0) != 0x80))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64()))], names=["key", "cut", "at"])


def _giants(rows: DataFrame, piece: int, scratch: Scratch) -> DataFrame:
    """``doc_id, text, n, found, first_cut, second_cut`` of texts that are read in pieces."""
    keyed = rows.withColumn("key", F.concat_ws(":", F.sha2("text", 256), F.col("doc_id").cast("string")))
    octets = F.encode("text", "utf-8")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / piece).cast("int")), lambda k: F.substring(octets, k * piece + 1, F.lit(piece)))
    pieces = keyed.select("key", "h1", "h2", F.posexplode(cut).alias("piece", "bytes"))
    pieces = scratch.keep(pieces.repartition(partitions(rows.sparkSession), "key", "piece"), "pieces")
    read = pieces.mapInArrow(_read, READ).dropDuplicates(["key", "piece"])  # of repeated rows one
    resolved = scratch.keep(read.groupBy("key").applyInArrow(_resolve, RESOLVED), "resolved")  # a row a piece of one text
    wanted = resolved.where(F.size("wanted") > 0).select("key", "piece", "entry", "wanted", "before")
    found = pieces.join(wanted, ["key", "piece"]).select("key", "entry", "wanted", "before", "bytes").mapInArrow(_select, "key string, cut int, at long")
    cuts = found.groupBy("key").agg(*(F.max(F.when(F.col("cut") == k, F.col("at"))).alias(f"c{k}") for k in (0, 1)))
    whole = resolved.where("piece = 0").select("key", "n", "found", "total").join(cuts, "key", "left")
    whole = whole.select("key", "n", "found", F.coalesce("c0", "total").alias("first_cut"), F.coalesce("c1", "total").alias("second_cut"))
    return keyed.join(whole, "key").select("doc_id", "text", *(name for name, _ in CUTS))


def transform(docs: DataFrame, scratch: Scratch, seed: int = SEED, percent_fim: int = PERCENT_FIM, percent_spm: int = PERCENT_SPM, piece: int = PIECE) -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars, output`` of every document."""
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"), h(0).alias("h1"), h(1).alias("h2"))
    schema = T.StructType([*rows.schema.fields[:2], *(T.StructField(n, T.BooleanType() if n == "found" else T.LongType()) for n, _ in CUTS)])
    whole = rows.where(F.octet_length("text") <= piece).mapInArrow(_whole(schema), schema)
    cut = whole.unionByName(_giants(rows.where(F.octet_length("text") > piece), piece, scratch))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    plain = (F.col("text") == "") | F.col("found") | (h(2) % 100 >= percent_fim)
    form = F.when(plain, "plain").when(h(3) % 100 < percent_spm, "spm").otherwise("psm")
    a, b = F.col("first_cut").cast("int"), F.col("second_cut").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    psm = F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle)
    spm = F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return cut.withColumn("form", form).select(
        "doc_id", "text", "n", "form", chars(F.col("first_cut")).alias("prefix_chars"), chars(F.col("second_cut") - F.col("first_cut")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output of this form was made from."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output, "<[PSM]>", -1)  # no text in these forms holds a mark
    own = lambda *order: F.concat(*(F.get(parts, k) for k in order))
    return F.when(form == "psm", own(1, 3, 2)).when(form == "spm", own(2, 3, 1)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with digests in place of their texts."""
    out = transform(dealt_documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark, "op12"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s
  FROM documents
), placed AS (
  SELECT *, len(lines) AS n, ('0x' || substr(s, 1, 8))::BIGINT % (len(lines) + 1) AS a, ('0x' || substr(s, 9, 8))::BIGINT % (len(lines) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(s, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || substr(s, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(lines[1:least(a, b)], '') AS prefix, array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(lines[greatest(a, b) + 1:], '') AS suffix
  FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
