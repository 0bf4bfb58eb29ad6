"""Source divergence audit (operator 11), by sorting and run-length scans.

Terms are runs of letters and of characters beyond ASCII, A-Z in lower case. Documents are
counted where they lie: a task hands on ``lang, term, source, docs, n`` (documents with the
term, occurrences) of some HELD of them at a time. These rows are dealt by language and term
and sorted by language, term, source; one scan over a task's rows reads a term of a language
as one run: its document frequency is the run's sum, and each source's counts are a run within.
Terms of at least ``least`` documents of a language are kept, V of them.

With N the occurrences of a group (a language's source, or the whole language) over kept
terms, a count c has ``p = 1 + floor(10**9 * (c + 5) / (N + 5 V))``, in whole numbers throughout.

``pair``: the value of two sources of a language is the sum of ``|p - q|`` over all V terms.
Sources are numbered within their language and cut into blocks of BLOCK; kept terms go, dealt
over ``parts`` of each two blocks by the term, to a second scan, which adds each run to a matrix of BLOCK x BLOCK
sums and hands that on as partial pairs once the two blocks' runs end. Terms that no source of
two blocks holds are only counted. No task holds a language, and no term's pairs are emitted.

``term``: a source's kept terms whose p is above the language's q, by ``p - q``, TOP at most.

Null texts, languages and sources are empty; a source without terms has counts of nought.
Every row is a document, repeated ones too. An empty table gives no rows; other columns are
ignored. A very long text is held by the task that reads it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import vec
from .common import Scratch, dealt_documents, hinted, partitions, release, small_batches

LEAST, SMOOTH, TOP = 30, 5, 50
#: Partial counts that a task holds, and sources that are worked on together.
HELD, BLOCK = 1_000_000, 128
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
COUNTS = "lang string, term string, source string, docs long, n long"
KEYS = ["lang", "term", "source"]


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a block of texts, and each one's row."""
    inner = LETTER[data]
    starts, ends, begins = vec.runs(inner, offsets)
    ends = np.concatenate([[0], np.cumsum(ends - starts)])
    raw = pa.py_buffer(vec.LOWER[data[inner]])
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), raw])
    return terms, np.repeat(np.arange(len(offsets) - 1), np.diff(begins))


class _Counts:
    """Partial counts of a task: groups are numbered, terms coded, so merging sorts numbers and
    hashes no string twice but the distinct ones of a block."""

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.terms: list[pa.DictionaryArray] = []
        self.rows: list[np.ndarray] = []  # group, documents, occurrences
        self.fresh = 0

    def add(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        """A block of documents (``lang, source``, and their bytes)."""
        terms, row = _terms(data, offsets)
        if not len(terms):
            return
        coded = terms.dictionary_encode()
        width = len(coded.dictionary)
        # occurrences by document and term, then by group and term
        pairs, times = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
        names = zip(*(rows.column(c).to_pylist() for c in (0, 1)))
        group = np.array([self.groups.setdefault(k, len(self.groups)) for k in names], np.int64)
        self._put(coded.dictionary, group[pairs // width], pairs % width, np.ones(len(pairs), np.int64), times)
        self.fresh += len(self.terms[-1])

    def _put(self, dictionary: pa.Array, group: np.ndarray, code: np.ndarray, docs: np.ndarray, n: np.ndarray) -> None:
        keys = group * len(dictionary) + code
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.terms.append(pa.DictionaryArray.from_arrays(pa.array((keys[at] % len(dictionary)).astype(np.int32)), dictionary))
        self.rows.append(np.stack([keys[at] // len(dictionary), np.add.reduceat(docs[order], at), np.add.reduceat(n[order], at)]))

    def merge(self) -> int:
        """Adds up what is held; gives how many rows that is."""
        if len(self.terms) > 1:
            terms = pa.chunked_array(self.terms).unify_dictionaries()
            code = np.concatenate([c.indices.to_numpy() for c in terms.chunks]).astype(np.int64)
            group, docs, n = np.concatenate(self.rows, 1)
            dictionary = terms.chunk(terms.num_chunks - 1).dictionary
            self.terms, self.rows = [], []
            self._put(dictionary, group, code, docs, n)
        self.fresh = 0
        return sum(map(len, self.terms))

    def out(self, size: int = 50_000):
        """What is held, and begins anew."""
        self.merge()
        if self.terms:
            (term,), (rows,) = self.terms, self.rows
            lang, source = (pa.array([k[i] for k in self.groups], pa.string()) for i in (0, 1))
            for i in range(0, len(term), size):
                group, docs, n = (pa.array(x) for x in rows[:, i : i + size])
                some = term.slice(i, size)
                yield pa.RecordBatch.from_arrays([lang.take(group), some.dictionary.take(some.indices).cast(pa.string()), source.take(group), docs, n], names=_names(COUNTS))
        self.__init__()


def counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """``lang, term, source, docs, n``: partial counts, some ``held`` of a task's rows merged."""
    small_batches(docs.sparkSession)
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    rows_in = docs.select(name("lang"), name("source"), docs["text"].cast("string").alias("text"))

    def run(batches):
        now = _Counts()
        for batch in batches:
            for i, j, data, offsets in vec.text_blocks(batch.column(2)):
                now.add(batch.slice(i, j - i), data, offsets)
                if now.fresh >= held and now.merge() >= held:
                    yield from now.out()
        yield from now.out()
        release()

    return rows_in.mapInArrow(run, COUNTS)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Which rows begin a run of equal keys; the first row does."""
    first = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        changed = [pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)) for k in keys]
        first[1:] = np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in changed])
    return first


def _whole_runs(batches, keys: list[str]):
    """Batches, cut so that each run of equal keys is in one of them. The rows that are held
    back are one run's; a run's rows are as many as its sources come from tasks."""
    rest: list[pa.RecordBatch] = []

    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and all(rest[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
            cut = np.flatnonzero(_starts(batch, keys)[1:]) + 1
            if not len(cut):
                rest.append(batch)
                continue
            rest.append(batch.slice(0, cut[0]))
            batch = batch.slice(cut[0])
        if rest:
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        last = int(np.flatnonzero(_starts(batch, keys))[-1])
        if last:
            yield batch.slice(0, last)
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


KEPT = "lang string, term string, source string, n long, all_n long, lead boolean"


def kept_terms(partial: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, term, source, n, all_n, lead``: one row a source of every term that at least
    ``least`` documents of its language hold, with the language's count; ``lead`` marks the
    first of a term's rows."""

    def scan(batches):
        for batch in _whole_runs(batches, ["lang", "term"]):
            run, source = _starts(batch, ["lang", "term"]), _starts(batch, KEYS)
            at, own = np.flatnonzero(run), np.flatnonzero(source)
            n = batch.column("n").to_numpy()
            of = (np.cumsum(run) - 1)[own]
            docs, all_n = (np.add.reduceat(x, at)[of] for x in (batch.column("docs").to_numpy(), n))
            keep = np.flatnonzero(docs >= least)
            if len(keep):
                part = batch.select(KEYS).take(pa.array(own[keep]))
                columns = [*part.columns, *(pa.array(x[keep]) for x in (np.add.reduceat(n, own), all_n, run[own]))]
                yield pa.RecordBatch.from_arrays(columns, names=_names(KEPT))

    dealt = partial.repartition(partitions(partial.sparkSession), "lang", "term").sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(scan, KEPT)


def share(count: str, total: str) -> Column:
    """``1 + floor(10**9 * (count + SMOOTH) / total)`` in whole decimals; 1 for a total of 0."""
    above = f"cast(1000000000 as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(19,0))"
    return F.expr(f"1 + coalesce(({above}) div cast(nullif({total}, 0) as decimal(19,0)), 0)")


def sized(docs: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lang, source, id, block, blocks, terms, total, lang_total, nought``: every group, its
    number in its language, V, its N + 5 V and the language's, and its p of no occurrence."""
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct()
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("lead").cast("long")).alias("leads"))
    both = groups.join(by_group, ["lang", "source"], "left")
    of_lang, order = W.partitionBy("lang"), W.partitionBy("lang").orderBy("source")  # a row a source
    both = both.withColumns({
        "id": F.row_number().over(order) - 1,
        "blocks": F.ceil(F.count("*").over(of_lang) / block).cast("int"),
        "terms": F.coalesce(F.sum("leads").over(of_lang), F.lit(0)),
        "lang_n": F.coalesce(F.sum("n").over(of_lang), F.lit(0)),
    })
    both = both.select(
        "lang", "source", "id", F.floor(F.col("id") / block).cast("int").alias("block"), "blocks", "terms",
        (F.coalesce("n", F.lit(0)) + SMOOTH * F.col("terms")).alias("total"), (F.col("lang_n") + SMOOTH * F.col("terms")).alias("lang_total"),
    )
    return both.withColumn("nought", share("0", "total"))


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


MEET = "lang string, low int, high int, part int, term string, id int, p long"
MEETING = ["lang", "low", "high", "part"]
PARTIAL = "lang string, a int, b int, value long, seen long"


class _Meeting:
    """Sums of ``|p - q|`` over terms, of the sources of two blocks (or of one with itself)."""

    def __init__(self, key: tuple, ids: np.ndarray, nought: np.ndarray, size: int):
        self.lang, self.low, self.high, _ = key
        self.ids, self.nought, self.seen = ids, nought, 0
        block = ids // size
        self.left, self.right = np.flatnonzero(block == self.low), np.flatnonzero(block == self.high)
        self.sums = np.zeros((len(self.left), len(self.right)), np.int64)

    def add(self, run: np.ndarray, ids: np.ndarray, p: np.ndarray) -> None:
        """Rows of whole terms; ``run`` numbers the terms from 0."""
        for first in range(0, int(run[-1]) + 1, 1024):
            i, j = np.searchsorted(run, [first, first + 1024])
            shares = np.tile(self.nought, (int(run[j - 1]) - first + 1, 1))
            shares[run[i:j] - first, np.searchsorted(self.ids, ids[i:j])] = p[i:j]
            right = shares[:, self.right]
            for k, a in enumerate(self.left):
                self.sums[k] += np.abs(right - shares[:, a : a + 1]).sum(0)
            self.seen += len(shares)

    def out(self) -> pa.RecordBatch:
        a, b = (x.ravel() for x in np.meshgrid(self.ids[self.left], self.ids[self.right], indexing="ij"))
        keep = a < b
        n = int(keep.sum())
        columns = [pa.array([self.lang] * n, pa.string()), *(pa.array(x[keep].astype(np.int32)) for x in (a, b)), pa.array(self.sums.ravel()[keep]), pa.array([self.seen] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=_names(PARTIAL))


def _meet(size: int):
    """Partial pairs of each meeting: its sources come first, as rows of an empty term, then its
    terms, a run each."""

    def run(batches):
        now: _Meeting | None = None
        for batch in _whole_runs(batches, [*MEETING, "term"]):
            begins = np.flatnonzero(_starts(batch, MEETING))
            for i, j in zip(begins, np.append(begins[1:], batch.num_rows)):
                rows = batch.slice(i, j - i)
                ids, p = rows.column("id").to_numpy(), rows.column("p").to_numpy()
                heads = int(pc.sum(pc.equal(rows.column("term"), "")).as_py())
                if heads:
                    if now is not None:
                        yield now.out()
                    now = _Meeting(tuple(rows.column(k)[0].as_py() for k in MEETING), ids[:heads], p[:heads], size)
                if heads < len(ids):
                    now.add(np.cumsum(_starts(rows, ["term"])[heads:]) - 1, ids[heads:], p[heads:])
        if now is not None:
            yield now.out()

    return run


def pairs(shares: DataFrame, sizes: DataFrame, parts: int, block: int = BLOCK) -> DataFrame:
    """``lang, a, b, value`` of each two sources' numbers, ``a < b``."""
    # about ``parts`` pieces of work a language
    pieces = F.ceil(parts / (F.col("blocks") * (F.col("blocks") + 1) / 2)).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    others = F.explode(every(F.col("blocks"))).alias("other")
    heads = sizes.select("lang", "block", "id", F.col("nought").alias("p"), others, every(pieces).alias("all")).select("*", F.explode("all").alias("part"))
    heads = heads.withColumn("term", F.lit(""))
    terms = shares.select("lang", "block", "id", "p", others, F.pmod(F.xxhash64("term"), pieces).cast("int").alias("part"), "term")
    meeting = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    rows = heads.select("lang", *meeting, "part", "term", "id", "p").unionByName(terms.select("lang", *meeting, "part", "term", "id", "p"))
    dealt = rows.repartition(partitions(rows.sparkSession), *MEETING).sortWithinPartitions(*MEETING, "term", "id")
    summed = dealt.mapInArrow(_meet(block), PARTIAL).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    of = lambda k: sizes.select("lang", F.col("id").alias(k), F.col("source").alias(f"{k}_source"), F.col("nought").alias(f"{k}_nought"), *(["terms"] if k == "a" else []))
    named = summed.join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"])
    # terms that no source of the two blocks holds
    rest = (F.col("terms") - F.col("seen")) * F.abs(F.col("a_nought") - F.col("b_nought"))
    return named.select("lang", "a_source", "b_source", (F.col("value") + rest).alias("value"))


def audit(docs: DataFrame, scratch: Scratch, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``."""
    kept = scratch.keep(kept_terms(counts(docs), least), "kept")
    sizes = scratch.keep(sized(docs, kept, block), "sizes")
    few = hinted(sizes, sizes.count(), 128)
    shares = kept.join(few, ["lang", "source"]).withColumn("p", share("n", "total"))
    found = pairs(shares, sizes, partitions(docs.sparkSession), block)
    both = F.inline(F.array(*(F.struct(F.col(s).alias("source"), F.col(i).alias("item")) for s, i in (("a_source", "b_source"), ("b_source", "a_source")))))
    apart = found.select("lang", "value", both).withColumn("part", F.lit("pair"))
    above = shares.withColumn("value", F.col("p") - share("all_n", "lang_total")).where("value > 0 and n > 0")
    above = above.select("lang", "value", "source", F.col("term").alias("item"), F.lit("term").alias("part"))
    order = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = apart.withColumn("rank", order).unionByName(above.withColumn("rank", order).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all documents."""
    return audit(dealt_documents(spark, sf_dir).select("lang", "source", "text"), Scratch(spark, "op11"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(sum(n), 0) + 5 * coalesce(any_value(v), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY lang, source
),
l AS (SELECT lang, sum(n) + 5 * any_value(v) AS total FROM c JOIN v USING (lang) GROUP BY lang),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // total AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 5) // any_value(total) AS q FROM p JOIN l USING (lang) GROUP BY lang, term),
pairs AS (SELECT lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
found AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g AS a JOIN g AS b USING (lang) LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source WHERE a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
