"""Best-fit packing of tokenised documents (operator 1).

:func:`tokenize` turns each text into the ids of a tokenizer and a closing id, cut into
pieces of at most ``limit``; :func:`pack` puts pieces into sequences by bounded-space
online best fit: ``OPEN_BINS`` bins are open, a bitset keyed by free space finds the one
that a piece fills best, and when none fits and all are open, the fullest closes first. What
is open at the end of a task closes as it is; with ``repack`` (off unless asked for) the pieces
of these bins, at most OPEN_BINS x limit, are dealt anew, longest first. Neither step shuffles.

The ids are those that the tokenizer gives by default: a control string in a text, such as
``<|endoftext|>``, gives its own id. With ``controls=False`` such strings are text like other.

A null text is empty: its document is the closing id alone. A null ``doc_id`` is kept.
Repeated documents are packed as often as they come. An empty table gives no rows. Other
columns of the input aren't read by ``tokenize`` and are carried along by ``pack``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import release, small_batches, table

LIMIT, OPEN_BINS, VOCABULARY = 2048, 1024, "word_bpe_49k.json"
#: Words that a worker remembers the ids of before it starts afresh.
WORDS = 400_000


class WordCoder:
    """Ids of whole texts, looked up word by word.

    For a tokenizer that splits at white space and lower-cases (which ``by_words`` tries; any
    other is given whole texts): it splits at white space, so the ids of a text are those of its
    ASCII-space-separated words; it lower-cases, so words are kept with A-Z in lower case.
    It splits letters from ASCII punctuation after them too, so the two are learnt apart.
    Words of letters alone go to the tokenizer many at a time: each is one piece, whose
    last id ends a word. If the ends don't count up, and for all other words, it is asked
    word by word. Normalising is left out for words of a-z, which it doesn't change.

    A control string (an added token) is cut out of a text before anything else is done to it,
    and the text to its left and right is encoded on its own.
    """

    PROBE = "Ab cD,  the\nWord_s\tx2 it's É"
    TAIL = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")

    def __init__(self, vocabulary: str, controls: bool = True):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.whole = Tokenizer.from_str(vocabulary), Tokenizer.from_str(vocabulary)
        # words never hold a control string: those of the text are cut out, those that lower case makes are none
        self.tokenizer.encode_special_tokens, self.whole.encode_special_tokens = True, not controls
        added = self.tokenizer.get_added_tokens_decoder() if controls else {}
        self.controls = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in added.items() if t.special}
        longest = sorted(self.controls, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        simple = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values())
        self.plain = Tokenizer.from_str(vocabulary)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(tokens.values()) + 1, bool)
        suffix = json.loads(vocabulary)["model"].get("end_of_word_suffix") or "\0"
        for token, i in tokens.items():
            self.ends[i] = token.endswith(suffix)
        self.known: dict[bytes, bytes] = {}
        plain = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in (self.PROBE, *self.PROBE.lower().split())]
        self.by_words = simple and plain[0] == [i for ids in plain[1:] for i in ids]

    def learn(self, words: set[bytes]) -> None:
        known, split, other = self.known, [], []
        plain: set[bytes] = set()
        letters: set[bytes] = set()
        for w in words:
            if w.isalpha():
                plain.add(w)
            elif (x := w.decode()).isalpha():
                letters.add(w)
            elif "\u0130" not in x and (m := self.TAIL.fullmatch(x)):  # that letter's lower case ends in a mark
                core, tail = m[1].encode(), m[2].encode()
                split.append((w, core, tail))
                if core not in known:
                    (plain if core.isalpha() else letters).add(core)
            else:
                other.append(w)
        self._joined(self.plain, [*plain])
        self._joined(self.tokenizer, [*letters])
        self._singly([*other, *{tail for _, _, tail in split if tail not in known}])
        for w, core, tail in split:
            known[w] = known[core] + known[tail]

    def _joined(self, tokenizer, words: list[bytes]) -> None:
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                self._singly(some)
                continue
            raw, last = ids.tobytes(), 0
            for w, end in zip(some, (4 * ends).tolist()):
                self.known[w], last = raw[last:end], end

    def _singly(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)):
                self.known[w] = self._ids(e)

    def rest(self) -> None:
        """Forgets words but for those met first, which are the common ones."""
        if len(self.known) > WORDS // 2:
            self.known = dict(islice(self.known.items(), WORDS // 2))

    @staticmethod
    def _ids(encoding) -> bytes:
        return np.array(encoding.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [self._ids(e) for e in self.whole.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        if self.cut and any(map(self.cut.search, texts)):
            parts = [self.cut.split(t) for t in texts]  # text and control strings in turn
            own = iter(self._words([x for cut in parts for x in cut[::2]]))
            return [b"".join(self.controls[x] if k % 2 else next(own) for k, x in enumerate(cut)) for cut in parts]
        return self._words(texts)

    def _words(self, texts: list[bytes]) -> list[bytes]:
        split = [t.lower().split() for t in texts]
        if len(self.known) > WORDS:
            self.rest()
        if new := set().union(*split).difference(self.known):
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_CODERS: dict[tuple, WordCoder] = {}


def coder_of(vocabulary: str, controls: bool = True) -> WordCoder:
    """The worker's coder; it outlives a task."""
    key = hash(vocabulary), controls
    if key not in _CODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CODERS[key] = WordCoder(vocabulary, controls)
    return _CODERS[key]


def blocks(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes come to ``most``, or of one row."""
    begin = total = i = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if total or begin <= i:
        yield begin, i + 1


def read_vocabulary(name: str) -> bytes:
    """A tokenizer file, read on the driver: a path, or a file's name in public_tokenizers."""
    import public_tokenizers

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
        return f.read()


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])


def _tokenizing(held, limit: int, end_id: int, controls: bool):
    closing, width = np.array([end_id], "<u4").tobytes(), 4 * limit

    def run(batches):
        coder = coder_of(held.value, controls)
        for batch in batches:
            column, doc_ids = batch.column(1).cast(pa.large_binary()), batch.column(0).to_pylist()
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            for i, j in blocks(sizes, 1 << 21):
                rows = []
                for d, ids in zip(doc_ids[i:j], coder.encode([t or b"" for t in column.slice(i, j - i).to_pylist()])):
                    ids += closing
                    rows += [(d, k, at // 4, min(width, len(ids) - at) // 4, ids[at : at + width]) for k, at in enumerate(range(0, len(ids), width))]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=PIECES.names
                    )
        release()

    return run


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _held(docs: DataFrame, vocabulary: str):
    return docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary).decode())  # a file of fixed size


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, end_id: int = 0, controls: bool = True) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit) of every text."""
    return _texts(docs).mapInArrow(_tokenizing(_held(docs, vocabulary), limit, end_id, controls), PIECES)


class BestFit:
    """Open bins keyed by free space. ``add`` gives (bin, offset); ``closed`` the bins that
    closed since it was last read."""

    def __init__(self, capacity: int, open_bins: int | None):
        self.capacity, self.most, self.bins, self.bits, self.count, self.next, self.closed = capacity, open_bins, {}, 0, 0, 0, []

    def _put(self, free: int, one: int) -> None:
        if not free:
            self.closed.append(one)
            self.count -= 1
            return
        self.bins.setdefault(free, []).append(one)
        self.bits |= 1 << free

    def _take(self, free: int) -> int:
        held = self.bins[free]
        one = held.pop()
        if not held:
            del self.bins[free]
            self.bits ^= 1 << free
        return one

    def add(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} doesn't fit a sequence of {self.capacity}")
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            one = self._take(free)
        else:
            if self.most and self.count >= self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
                self.count -= 1
            one, free = self.next, self.capacity
            self.next += 1
            self.count += 1
        self._put(free - length, one)
        return one, self.capacity - free


def _packing(own: list[str], names: list[str], capacity: int, open_bins: int, repack: bool):
    def run(batches):
        from pyspark import TaskContext

        base, fit, at = TaskContext.get().partitionId() << 33, BestFit(capacity, open_bins), own.index("length")
        held: dict[int, list[tuple]] = {}
        kinds: list = []
        ready: list[tuple] = []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*kinds, pa.int64(), pa.int64()])], names=names)

        for batch in batches:
            kinds = batch.schema.types
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                one, offset = fit.add(row[at])
                held.setdefault(one, []).append((*row, base + one, offset))
                if fit.closed:
                    for x in fit.closed:
                        ready += held.pop(x)
                    fit.closed.clear()
                    if len(ready) >= 5000:
                        yield out(ready)
                        ready = []
        rest = (row for rows in held.values() for row in rows)
        if repack:
            again, first = BestFit(capacity, None), fit.next
            rest = ((*row[:-2], base + first + one, offset) for row in sorted(rest, key=lambda r: -r[at]) for one, offset in (again.add(row[at]),))
        for row in rest:
            ready.append(row)
            if len(ready) >= 5000:
                yield out(ready)
                ready = []
        if ready:
            yield out(ready)

    return run


def pack(pieces: DataFrame, capacity: int = LIMIT, open_bins: int = OPEN_BINS, repack: bool = False) -> DataFrame:
    """``pieces`` (with a ``length``) and where each goes: ``sequence_id, offset``.

    Columns of those names that it already has are replaced. A sequence's number is its
    task's, times 2**33, and its own."""
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows_in = pieces.select(*own)
    schema = T.StructType([*rows_in.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows_in.mapInArrow(_packing(own, schema.names, capacity, open_bins, repack), schema)


DIGESTS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, open_bins: int = OPEN_BINS, repack: bool = False, controls: bool = True) -> DataFrame:
    """``tokenize`` and ``pack`` in one worker, with a CRC-32 in place of the ids."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    tokenizing, packing = _tokenizing(_held(docs, vocabulary), limit, 0, controls), _packing(names[:5], names, limit, open_bins, repack)

    def digest(batches):
        for batch in batches:
            crc = pa.array([zlib.crc32(x) for x in batch.column(4).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], crc], names=names[:5])

    return _texts(docs).mapInArrow(lambda batches: packing(digest(tokenizing(batches))), DIGESTS)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack_documents(table(spark, sf_dir, "documents"))
