"""Byte-level BPE encoding and decoding (operator 7), in DuckDB within each task.

A text is split by the tokenizer's pattern. Words that a task hasn't met lately are cut into
parts of PART bytes (most words are one part), which become token-position rows; a recursive
query joins neighbours with the merge table and contracts each part's leftmost pair of least
rank until none is left. Decoding joins the ids with the vocabulary and aggregates the pieces
in order. The merge table follows from the ranks (every split of a token into two tokens),
so both tables have a fixed size.

Parts are put together by their seams. A row of tokens is the encoding of its bytes exactly
if each two neighbours are the encoding of theirs: up to the first contraction across a
boundary both sides go through the steps that they go through alone, so that contraction
would take place between the two neighbours alone as well. So two encodings are joined by
asking the same query for the tokens at the seam; where they change, the stretch grows by a
token, to the left while the new left end doesn't hold, to the right until a token of the
right side stands as it was. A query has at most ROWS rows in all its steps together, and a
word is worked on SLICE bytes at a time, so memory doesn't grow with a word or a text beyond
the ids themselves.

A null text is empty: no ids, and it decodes to nothing. Repeated rows stay, an empty
table gives no rows, a null ``doc_id`` is kept, other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Generator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_documents, release, small_batches
from .packing import blocks, read_vocabulary

RANKS = "byte_bpe_50k.tiktoken"
#: Words that a worker remembers, and their bytes at most.
WORDS, WORD_BYTES = 500_000, 32 << 20
#: Bytes of a part, rows of a query in all its steps, bytes of a word that are worked on at once.
PART, ROWS, SLICE = 32, 3_000_000, 1 << 20
#: Seams that a worker remembers.
SEAMS = 100_000
#: Ids that are decoded at once; a longer row of ids is decoded in several goes.
IDS = 1 << 18

ENCODE = """
WITH RECURSIVE t(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM start
  UNION ALL
  SELECT p.w, p.pos - CASE WHEN p.pos > b.place THEN 1 ELSE 0 END, CASE WHEN p.pos = b.place THEN b.merged ELSE p.tok END, p.step + 1
  FROM t p JOIN (
    SELECT w, CAST(k >> 24 AS INTEGER) AS merged, CAST(k & 16777215 AS INTEGER) AS place
    FROM (SELECT a.w, min((CAST(m.merged AS BIGINT) << 24) | a.pos) AS k
          FROM t a JOIN t n ON n.w = a.w AND n.pos = a.pos + 1 JOIN merges m ON m.l = a.tok AND m.r = n.tok GROUP BY a.w)) b ON b.w = p.w
  WHERE p.pos <> b.place + 1)
SELECT w, tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY w, pos
"""
DECODE = "SELECT doc, string_agg(piece, '' ORDER BY pos) AS text FROM ids JOIN vocabulary USING (id) GROUP BY doc"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def connect():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


Asking = Generator[tuple[int, ...], list[int], np.ndarray]


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pieces = {r: t for t, r in ranks.items()}
        self.con = connect()
        rows = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        merges = pa.table({k: pa.array(v, pa.int32()) for k, v in zip(("l", "r", "merged"), zip(*rows))})
        self.con.register("given", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.seams: dict[tuple[int, ...], list[int]] = {}

    def contract(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of short strings of bytes, by recursive queries: each takes as many strings as
        have ROWS rows in all steps together, or one."""
        out = []
        size = np.array([len(x) for x in parts], np.int64)
        rows = np.cumsum(size * (size + 1) // 2)
        i = 0
        while i < len(parts):
            j = max(i + 1, int(np.searchsorted(rows, (rows[i - 1] if i else 0) + ROWS, "right")))
            n, some = size[i:j], parts[i:j]
            ends = np.cumsum(n)
            start = {
                "w": np.repeat(np.arange(j - i, dtype=np.int32), n),
                "pos": (np.arange(ends[-1]) - np.repeat(ends - n, n)).astype(np.int32),
                "tok": self.byte[np.frombuffer(b"".join(some), np.uint8)],
            }
            self.con.register("start", pa.table(start))
            found = self.con.execute(ENCODE).fetchnumpy()
            ids = np.asarray(found["tok"]).astype("<u4")
            out += np.split(ids, np.cumsum(np.bincount(np.asarray(found["w"]), minlength=j - i))[:-1])
            i = j
        return out

    def joined(self, a: np.ndarray, b: np.ndarray) -> Asking:
        """The encoding of two strings' bytes together, from their encodings; asks for those
        of a few tokens' bytes."""
        left, ids, right = len(a), [], 0  # so far: a's first ``left`` tokens and ``ids``
        while right < len(b):
            stretch = new = [int(b[right])]
            right += 1
            while ids or left:
                before = ids[-1] if ids else int(a[left - 1])
                if (yield (before, new[0])) == [before, new[0]]:
                    break
                if ids:
                    ids.pop()
                else:
                    left -= 1
                stretch = [before, *stretch]
                new = yield tuple(stretch)
            ids += new
            if len(stretch) == 1:
                break  # it stands as it was, and so do those after it
        return np.concatenate([a[:left], np.array(ids, "<u4"), b[right:]])

    def together(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Joins many pairs of encodings; what they ask for goes into common queries."""
        out, seams = [np.zeros(0, "<u4")] * len(pairs), self.seams
        waiting = [(k, one, next(one)) for k, one in enumerate(self.joined(a, b) for a, b in pairs)]
        while waiting:
            if keys := list({key for _, _, key in waiting if key not in seams}):
                found = self.contract([b"".join(map(self.pieces.__getitem__, key)) for key in keys])
                seams.update(zip(keys, (x.tolist() for x in found)))
            still = []
            for k, one, key in waiting:
                try:
                    while key in seams:
                        key = one.send(seams[key])
                    still.append((k, one, key))
                except StopIteration as end:
                    out[k] = end.value
            waiting = still
        if len(seams) > SEAMS:
            seams.clear()
        return out

    def whole(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of strings of bytes: of their parts, which are then joined two by two."""
        cut = [[w[i : i + PART] for i in range(0, len(w), PART)] for w in words]
        parts = list({p for ps in cut for p in ps})
        ids = dict(zip(parts, self.contract(parts)))
        rows = [[ids[p] for p in ps] for ps in cut]
        while any(len(r) > 1 for r in rows):
            done = iter(self.together([(r[i], r[i + 1]) for r in rows for i in range(0, len(r) - 1, 2)]))
            rows = [[next(done) if i + 1 < len(r) else r[i] for i in range(0, len(r), 2)] for r in rows]
        return [r[0] for r in rows]

    def learn(self, words: set[str]) -> None:
        known, new = self.words, []
        for w in words:
            raw = w.encode()
            self.held += len(raw)
            if (r := self.ranks.get(raw)) is not None:
                known[w] = int(r).to_bytes(4, "little")
            else:
                new.append((w, raw))
        for i, j in blocks([len(raw) for _, raw in new], SLICE) if new else ():
            some = [raw for _, raw in new[i:j]]
            ids = self.whole([raw[:SLICE] for raw in some])
            for at in range(SLICE, len(some[0]), SLICE):  # of a word that is a block of its own
                ids = self.together([(ids[0], self.whole([some[0][at : at + SLICE]])[0])])
            known.update(zip([w for w, _ in new[i:j]], (x.tobytes() for x in ids)))

    def encode(self, texts: list[str]) -> list[bytes]:
        self.rest(WORDS, WORD_BYTES)
        parts = [self.split(t) for t in texts]
        if new := set().union(*parts).difference(self.words):
            self.learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def rest(self, words: int = WORDS // 2, size: int = WORD_BYTES // 2) -> None:
        """If it remembers more than that, forgets words but for half of it, of those met
        first, which are the common ones."""
        if len(self.words) <= words and self.held <= size:
            return
        self.held, kept = 0, {}
        for w, ids in islice(self.words.items(), WORDS // 2):
            self.held += len(w)
            if self.held > WORD_BYTES // 2:
                break
            kept[w] = ids
        self.words = kept


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.con = connect()
        # a byte is written as the character of its number
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in ranks])})
        self.con.register("given", vocabulary)
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")

    def decode(self, docs: list[bytes]) -> list[bytes]:
        """The bytes of rows of ids, IDS of them at a time."""
        size = np.array([len(d) // 4 for d in docs])
        ids = np.frombuffer(b"".join(docs), "<u4").astype(np.int32)
        owner, out = np.repeat(np.arange(len(docs), dtype=np.int32), size), [[] for _ in docs]
        for at in range(0, len(ids), IDS):
            some = ids[at : at + IDS]
            self.con.register("ids", pa.table({"doc": owner[at : at + IDS], "pos": np.arange(len(some), dtype=np.int32), "id": some}))
            for doc, text in self.con.execute(DECODE).fetchall():
                out[doc].append(text.encode("latin-1"))
        return [b"".join(x) for x in out]


_HELD: dict = {}


def _worker(kind, raw: bytes, *more):
    """The worker's own coder or decoder; it outlives a task."""
    key = (kind, hash(raw), *more)
    if key not in _HELD:
        _HELD[key] = kind(read_ranks(raw), *more)
    return _HELD[key]


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) of every text."""
    import public_tokenizers

    small_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(ranks))  # a file of fixed size
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches):
        coder = _worker(Coder, raw.value, pattern)
        for batch in batches:
            column = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            for i, j in blocks(sizes, 1 << 21):
                ids = coder.encode([t or "" for t in column.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        coder.rest()
        release()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``encoded`` (``doc_id, ids``) and ``decoded``, the bytes that the ids stand for."""
    raw = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(ranks))

    def run(batches):
        decoder = _worker(Decoder, raw.value)
        for batch in batches:
            column = batch.column(1)
            for i, j in blocks(pa.compute.binary_length(column).to_pylist(), 1 << 21):
                part = column.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), part, pa.array(decoder.decode(part.to_pylist()), pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    out = decode(encode(dealt_documents(spark, sf_dir)))
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
