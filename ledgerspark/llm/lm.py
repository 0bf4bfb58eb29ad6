"""Language-model scoring by a log-bilinear model (operator 5).

Words are taken in lower case (A-Z) with an end token per text, and known by 64-bit hashes
of their bytes. Training documents are those whose ``crc32(doc_id as text) % 7 != 2``.

1. All words of all documents are counted (summed in the tasks before the shuffle).
2. The ``HEAD`` commonest words are held by every task; the others go through a join. The
   VOCAB commonest in training have vectors of their own, every other word belongs to one of
   BUCKETS buckets by its last two bytes, which has one. These units are cut, by frequency,
   into CLASSES classes.
3. The model: ``h`` is the sum over the CONTEXT words before, each vector times the matrix of
   its position; ``p(class | h)`` and ``p(unit | class, h)`` have the scores ``h . p_c + a_c``
   and ``h . q_u + b_u``; a bucket's word has ``(c + 1) / (n + v + 1)`` of the bucket's n
   tokens and v words. At first all vectors p, q are zero, which is the smoothed unigram model.
4. Training is in numpy by noise-contrastive estimation (noise classes by frequency, noise
   units by frequency within the class) and AdaGrad. A task warms up on a sample of at most
   WARM_DOCS documents; from there every task goes once over all its training tokens, and the
   tasks' vectors are averaged by how often each unit stood in them: steps grow with the
   corpus, what the driver sees are the averages alone.
5. Scoring: products of matrices give all classes' and the class's units' scores, and so
   normalised log-probabilities. ``score`` is the text's log10 probability, ``base_score``
   that of the smoothed unigram model.

A null text is empty (its end token is scored), a null ``doc_id`` counts as the empty text
for the fold. Repeated rows count and are scored as often as they come. An empty table
gives no rows. Other columns are ignored. How the input is dealt to tasks moves ``score`` a
little (averages of other parts), never ``base_score``.
"""

from __future__ import annotations

import contextlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .common import Scratch, small_batches, table

FOLDS, HELD_OUT = 7, 2
HEAD, VOCAB, CLASSES, BUCKETS = 200_000, 16_384, 128, 192
#: Tokens whose counts a task sums before it hands them on.
FLUSH = 3_000_000
#: NOISE: noise classes a batch, noise units a class of a batch. RATES: of the warm-up, of all.
DIM, CONTEXT, NOISE, BATCH, RATES, SEED = 16, 2, (32, 8), 16_384, (0.1, 0.03), 7
#: Bound of the sample that a task warms up on; all training documents follow.
WARM_DOCS = 2048
U = np.uint64
END = U(0x5851F42D4C957F2D)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and buckets of all tokens, each row's end token last, and where rows begin."""
    data = vec.LOWER[data]
    starts, ends, begins = vec.words(data, offsets)
    hashes = vec.word_hashes(data, starts, ends)
    tail = data[np.maximum(ends - 1, 0)].astype(np.int64) * 257 + np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(begins))
    at = np.arange(len(hashes)) + row
    all_hashes, buckets = np.full(len(hashes) + n, END), np.zeros(len(hashes) + n, np.int64)
    all_hashes[at] = hashes
    buckets[at] = (tail * 40503 >> 4) % BUCKETS
    return all_hashes, buckets, begins + np.arange(n + 1)


def _folds(column: pa.Array) -> np.ndarray:
    return np.array([not held_out(d) for d in column.to_pylist()], bool)


def count_words(docs: DataFrame) -> DataFrame:
    """``word, bucket, trained, total``: each word's count in training and in all documents."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            hashes, buckets, train = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(hashes)
            hashes = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            total = np.diff(np.concatenate([first, [len(hashes)]]))
            trained = np.add.reduceat(train[order].astype(np.int64), first)
            for i in range(0, len(first), 200_000):
                s = slice(i, i + 200_000)
                columns = (hashes[first[s]].view(np.int64), buckets[order][first[s]].astype(np.int32), trained[s], total[s])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "bucket", "trained", "total"])

        for batch in batches:
            folds = _folds(batch.column(0))
            for i, j, data, offsets in vec.text_blocks(batch.column(1)):
                hashes, buckets, begins = tokens(data, offsets)
                held.append((hashes, buckets.astype(np.int16), np.repeat(folds[i:j], np.diff(begins))))
                size += len(hashes)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    counted = docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, "word long, bucket int, trained long, total long")
    return counted.groupBy("word").agg(F.max("bucket").alias("bucket"), F.sum("trained").alias("trained"), F.sum("total").alias("total"))


class Lexicon:
    """What every task knows of words: the head's hashes in order, their counts and units;
    and of units their classes and shares.

    ``words, trained, buckets`` are those of the head; ``sums`` are, by bucket, the training
    tokens and words of all words."""

    def __init__(self, words: np.ndarray, trained: np.ndarray, buckets: np.ndarray, sums: np.ndarray):
        order = np.argsort(words)
        self.words, self.trained, buckets = words[order], trained[order], buckets[order]
        own = np.argsort(-self.trained, kind="stable")[:VOCAB]
        taken = np.stack([np.bincount(buckets[own], w, BUCKETS) for w in (self.trained[own], self.trained[own] > 0)], 1)
        mass = (sums - taken).sum(1) + 1.0
        share = np.concatenate([self.trained[own] + 1.0, mass])
        falling = np.argsort(-share, kind="stable")
        unit = np.empty(len(share), np.int64)
        unit[falling] = np.arange(len(share))
        self.bucket_units = unit[len(own) :]
        self.units = self.bucket_units[buckets]
        self.units[own] = unit[: len(own)]
        self.own = np.zeros(len(self.words), bool)
        self.own[own] = True
        self.mass_log = np.log10(mass)
        share = share[falling]
        at = np.cumsum(np.sqrt(share))
        self.classes = np.unique((at / at[-1] * (CLASSES - 1e-6)).astype(np.int64), return_inverse=True)[1]
        self.n_classes = int(self.classes[-1]) + 1
        self.starts = np.searchsorted(self.classes, np.arange(self.n_classes + 1))
        whole = np.add.reduceat(share, self.starts[:-1])
        self.class_log = np.log(whole / whole.sum()).astype(np.float32)
        self.unit_log = np.log(share / whole[self.classes]).astype(np.float32)
        self.below = np.concatenate([[0.0], np.cumsum(share)])
        self.end = int(self.units_of(self.find(np.array([END])), np.array([0]))[0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the head, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def units_of(self, at: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        other = self.bucket_units[buckets]
        return (np.where(at >= 0, self.units[at], other) if len(self.words) else other).astype(np.uint16)

    def stream(self, units: np.ndarray, begins: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units of chosen rows one after the other, CONTEXT ends before each row, and which
        of them are tokens."""
        sizes = np.diff(begins)[chosen] + CONTEXT
        token = np.ones(int(sizes.sum()), bool)
        first = np.cumsum(sizes) - sizes
        token[(first[:, None] + np.arange(CONTEXT)).ravel()] = False
        out = np.full(len(token), self.end, np.uint16)
        out[token] = units[np.repeat(chosen, np.diff(begins))]
        return out, token


@contextlib.contextmanager
def one_thread():
    """Keeps OpenBLAS to one thread: on matrices this small its threads wait for each other."""
    import ctypes
    import os

    found = []
    if os.path.exists("/proc/self/maps"):
        with open("/proc/self/maps") as f:
            paths = {line.split(None, 5)[5].strip() for line in f if "openblas" in line}
        for lib in map(ctypes.CDLL, sorted(paths)):
            for prefix, suffix in (("scipy_", "64_"), ("scipy_", ""), ("", "64_"), ("", "")):
                put, get = (getattr(lib, f"{prefix}openblas_{x}_num_threads{suffix}", None) for x in ("set", "get"))
                if put and get:
                    found.append((put, get()))
                    put(1)
                    break
    try:
        yield
    finally:
        for put, n in found:
            put(n)


def _groups(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Vectors of units as context (r) and as target (q, b), of classes (p, a), and the
    positions' matrices (m)."""

    PARTS = ("r", "q", "p", "m", "b", "a")

    def __init__(self, lexicon: Lexicon, parts: dict | None = None):
        self.lex = lexicon
        n = len(lexicon.classes)
        if parts is None:
            rng = np.random.default_rng(SEED)
            parts = {
                "r": rng.normal(0, 0.3, (n, DIM)), "q": np.zeros((n, DIM)), "p": np.zeros((lexicon.n_classes, DIM)),
                "m": np.stack([np.eye(DIM) * 0.6**k for k in range(CONTEXT)]), "b": lexicon.unit_log, "a": lexicon.class_log,
            }
        for k in self.PARTS:
            setattr(self, k, np.array(parts[k], np.float32))
        self.squares = {k: np.full(getattr(self, k).shape, 1e-3, np.float32) for k in self.PARTS}
        self.seen = np.zeros(n)

    def parts(self) -> dict:
        return {k: getattr(self, k) for k in self.PARTS}

    def _step(self, name: str, grad: np.ndarray, rate: float, rows=slice(None)) -> None:
        squares, x = self.squares[name], getattr(self, name)
        sums = squares[rows] + grad * grad
        squares[rows] = sums
        x[rows] -= rate * grad / np.sqrt(sums)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """``h`` of each place from CONTEXT on, from the vectors at all places."""
        n = len(x) - CONTEXT
        return sum(x[CONTEXT - 1 - k : CONTEXT - 1 - k + n] @ self.m[k] for k in range(CONTEXT))

    def learn(self, units: np.ndarray, token: np.ndarray, rate: float, rng) -> None:
        """One pass over a stream, BATCH places a step."""
        self.seen += np.bincount(units[token], minlength=len(self.seen))
        for at in range(CONTEXT, len(units), BATCH):
            self._learn(units[at - CONTEXT : at + BATCH], token[at - CONTEXT : at + BATCH], rate, rng)

    def _learn(self, units: np.ndarray, token: np.ndarray, rate: float, rng) -> None:
        lex, (k_class, k_unit) = self.lex, NOISE
        x = self.r[units]
        places = np.flatnonzero(token[CONTEXT:])
        if not len(places):
            return
        places = places[np.argsort(units[CONTEXT:][places], kind="stable")]
        h, y = self.hidden(x)[places], units[CONTEXT:][places]
        c = lex.classes[y]
        # classes: the one seen against noise classes that the batch shares
        drawn = lex.below[-1] * rng.random(k_class)
        noise = lex.classes[np.searchsorted(lex.below, drawn, "right") - 1]
        known, odds = self.a - lex.class_log, np.float32(np.log(k_class))
        pc = self.p[c]
        gp = _sigmoid(np.einsum("ij,ij->i", h, pc) + known[c] - odds) - 1
        gn = _sigmoid(h @ self.p[noise].T + known[noise] - odds)
        gh = gp[:, None] * pc + gn @ self.p[noise]
        begin = _groups(c)
        here = c[begin]
        grad_p, grad_a = np.zeros_like(self.p), np.zeros_like(self.a)
        grad_p[here], grad_a[here] = np.add.reduceat(gp[:, None] * h, begin), np.add.reduceat(gp, begin)
        np.add.at(grad_p, noise, gn.T @ h)
        np.add.at(grad_a, noise, gn.sum(0))
        # units: the one seen against noise units of its class
        qy, odds = self.q[y], np.float32(np.log(k_unit))
        alone = np.diff(lex.starts) == 1
        gp = _sigmoid(np.einsum("ij,ij->i", h, qy) + self.b[y] - lex.unit_log[y] - odds) - 1
        gp[alone[c]] = 0
        gh += gp[:, None] * qy
        first = _groups(y)
        at, grad_q, grad_b = [y[first]], [np.add.reduceat(gp[:, None] * h, first)], [np.add.reduceat(gp, first)]
        low, high = lex.below[lex.starts[here]], lex.below[lex.starts[here + 1]]
        noise = np.searchsorted(lex.below, low[:, None] + (high - low)[:, None] * rng.random((len(here), k_unit)), "right") - 1
        noise = np.clip(noise, lex.starts[here][:, None], lex.starts[here + 1][:, None] - 1).astype(np.uint16)
        q_noise, shift = self.q[noise], (self.b - lex.unit_log)[noise] - odds
        ends = [*begin[1:].tolist(), len(y)]
        for k in np.flatnonzero(~alone[here]).tolist():
            own, q = slice(begin[k], ends[k]), q_noise[k]
            g = _sigmoid(h[own] @ q.T + shift[k])
            gh[own] += g @ q
            at.append(noise[k])
            grad_q.append(g.T @ h[own])
            grad_b.append(g.sum(0))
        at = np.concatenate(at)
        order = np.argsort(at, kind="stable")
        first = _groups(at[order])
        rows = at[order][first]
        grad_q, grad_b = (np.add.reduceat(np.concatenate(g)[order], first) for g in (grad_q, grad_b))
        # and back to the words before
        back = np.zeros((len(units) - CONTEXT, DIM), np.float32)
        back[places] = gh
        grad_x, grad_m = np.zeros_like(x), np.empty_like(self.m)
        for k in range(CONTEXT):
            before = slice(CONTEXT - 1 - k, CONTEXT - 1 - k + len(back))
            grad_m[k] = x[before].T @ back
            grad_x[before] += back @ self.m[k].T
        order = np.argsort(units, kind="stable")
        first = _groups(units[order])
        self._step("r", np.add.reduceat(grad_x[order], first), rate, units[order][first])
        self._step("q", grad_q, rate, rows)
        self._step("b", grad_b, rate, rows)
        self._step("p", grad_p, rate)
        self._step("a", grad_a, rate)
        self._step("m", grad_m, rate)

    def log_probabilities(self, units: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the units that are tokens, in order."""
        lex, out = self.lex, np.zeros(int(token.sum()), np.float32)
        places = np.flatnonzero(token)
        if not len(places):
            return out
        h = self.hidden(self.r[units])[places - CONTEXT]
        y = units[places]
        order = np.argsort(y, kind="stable")
        y, h = y[order], h[order]
        c = lex.classes[y]
        got = np.empty(len(y), np.float32)
        rows = np.arange(2048)
        for i in range(0, len(y), 2048):
            score = h[i : i + 2048] @ self.p.T
            score += self.a
            np.minimum(score, 60, out=score)
            mine = score[rows[: len(score)], c[i : i + 2048]]
            got[i : i + 2048] = mine - np.log(np.exp(score, out=score).sum(1))
        ends = np.searchsorted(c, np.arange(lex.n_classes + 1))
        for k in np.flatnonzero(np.diff(lex.starts) > 1).tolist():
            own = slice(lex.starts[k], lex.starts[k + 1])
            qk = np.ascontiguousarray(self.q[own].T)
            step = max(64, (1 << 18) // qk.shape[1])
            for i in range(ends[k], ends[k + 1], step):
                j = min(i + step, ends[k + 1])
                score = h[i:j] @ qk
                score += self.b[own]
                np.minimum(score, 60, out=score)
                mine = score[np.arange(j - i), y[i:j] - np.uint16(lex.starts[k])]
                got[i:j] += mine - np.log(np.exp(score, out=score).sum(1))
        out[order] = got
        return out


TRAINED = "part int, id int, weight double, " + ", ".join(f"v{k} double" for k in range(DIM + 1))


def _rows(model: Model) -> pa.RecordBatch:
    """A task's vectors, times how much they count: those of units by their tokens, others by
    all tokens. Parts: 0 r, 1 q and b, 2 p and a, 3 m."""
    total = model.seen.sum()
    some = np.flatnonzero(model.seen)
    wide = lambda x, last=None: np.concatenate([x, np.zeros((len(x), 1)) if last is None else last[:, None]], 1).astype(np.float64)
    blocks = (
        (some, model.seen[some], wide(model.r[some])), (some, model.seen[some], wide(model.q[some], model.b[some])),
        (np.arange(len(model.p)), np.full(len(model.p), total), wide(model.p, model.a)), (np.arange(CONTEXT * DIM), np.full(CONTEXT * DIM, total), wide(model.m.reshape(-1, DIM))),
    )
    part = np.concatenate([np.full(len(ids), k, np.int32) for k, (ids, _, _) in enumerate(blocks)])
    ids, weight, values = (np.concatenate(x) for x in zip(*blocks))
    values = values * weight[:, None]
    columns = [part, ids.astype(np.int32), weight, *np.ascontiguousarray(values.T)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in TRAINED.split(", ")])


def trained(docs: DataFrame, lexicon, parts, rate: float) -> DataFrame:
    """TRAINED rows, summed over the tasks: each begins with ``parts`` (a broadcast, None at
    first) and goes over all its training documents."""

    def run(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([SEED, TaskContext.get().partitionId()])
        with one_thread():
            model = Model(lexicon.value, parts and parts.value)
            for batch in batches:
                folds = _folds(batch.column(0))
                for i, j, data, offsets in vec.text_blocks(batch.column(1)):
                    if folds[i:j].any():
                        hashes, buckets, begins = tokens(data, offsets)
                        lex = model.lex
                        model.learn(*lex.stream(lex.units_of(lex.find(hashes), buckets), begins, folds[i:j]), rate, rng)
            if model.seen.any():
                yield _rows(model)

    rows = docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, TRAINED)
    return rows.groupBy("part", "id").agg(*[F.sum(c).alias(c) for c in rows.columns[2:]])


def averaged(lexicon: Lexicon, parts: dict | None, rows) -> dict:
    """The averages of ``trained``, as a pandas frame of some ten thousand rows, in place of
    what was there before."""
    model = Model(lexicon, parts)
    held = {0: (model.r, None), 1: (model.q, model.b), 2: (model.p, model.a), 3: (model.m.reshape(-1, DIM), None)}
    for k, (vectors, last) in held.items():
        own = rows[rows["part"] == k]
        values = own.iloc[:, 3:].to_numpy() / own[["weight"]].to_numpy()
        ids = own["id"].to_numpy()
        vectors[ids] = values[:, :DIM]
        if last is not None:
            last[ids] = values[:, DIM]
    return model.parts()


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document."""
    return scores(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


PARTIAL = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_tail long, tail array<struct<word:long,n:int>>"


def fitted(docs: DataFrame, counts: DataFrame, scratch: Scratch) -> tuple:
    """The lexicon and the model's parts, both as broadcasts of bounded size."""
    spark = docs.sparkSession
    # the commonest words; a histogram of counts keeps most others from the task that sorts
    level = F.floor(8 * F.log2("total"))
    levels, least, above = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect(), None, 0  # some hundred rows
    for row in levels:
        least, above = row["level"], above + row["count"]
        if above >= HEAD:
            break
    head = counts if least is None else counts.where(level >= least)
    head = head.orderBy(F.desc("total"), "word").limit(HEAD).toPandas()  # HEAD rows at most
    sums = np.zeros((BUCKETS, 2))
    for row in counts.groupBy("bucket").agg(F.sum("trained").alias("n"), F.count_if(F.col("trained") > 0).alias("v")).collect():  # BUCKETS rows
        sums[row["bucket"]] = row["n"], row["v"]
    lex = Lexicon(head["word"].to_numpy(np.int64).view(U), head["trained"].to_numpy(np.int64), head["bucket"].to_numpy(np.int64), sums)
    lexicon, parts, held = spark.sparkContext.broadcast(lex), None, None
    share = min(1.0, 8 * WARM_DOCS / max(1, docs.count()))
    sample = docs.withColumn("h", F.xxhash64("text", "doc_id")).where(F.col("h") <= int(-(2**63) + share * (2**64 - 2**12)))
    sample = sample.orderBy("h").limit(WARM_DOCS).select("doc_id", "text").coalesce(1)
    for some, rate, name in ((sample, RATES[0], "warm"), (docs, RATES[1], "trained")):
        parts = averaged(lex, parts, scratch.keep(trained(some, lexicon, held, rate), name).toPandas())
        held = spark.sparkContext.broadcast(parts)
    return lexicon, held


def scores(docs: DataFrame, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    counts = scratch.keep(count_words(docs), "counts")
    n, v = counts.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count_if(F.col("trained") > 0)).first()
    lexicon, parts = fitted(docs, counts, scratch)
    base_log = float(np.log10(n + v + 1))

    def scored(batches):
        from pyspark import TaskContext

        lex, model = lexicon.value, Model(lexicon.value, parts.value)
        key = TaskContext.get().partitionId() << 33
        plus = np.log10(lex.trained + 1.0)
        for batch in batches:
            folds = _folds(batch.column(0))
            for i, j, data, offsets in vec.text_blocks(batch.column(1)):
                hashes, buckets, begins = tokens(data, offsets)
                size = np.diff(begins)
                at = lex.find(hashes)
                inside = at >= 0
                log_c = np.where(inside, plus[at] if len(plus) else 0.0, 0.0)
                own = inside & (lex.own[at] if len(plus) else False)
                score = model.log_probabilities(*lex.stream(lex.units_of(at, buckets), begins, np.ones(j - i, bool)))
                score = score / np.log(10) + np.where(own, 0.0, log_c - lex.mass_log[buckets])
                total = lambda x: np.add.reduceat(x, begins[:-1])  # noqa: E731  no row is without a token
                known = total((inside & (lex.trained[at] > 0 if len(plus) else False)).astype(np.int64))
                row = np.repeat(np.arange(j - i), size)
                out_at = np.flatnonzero(~inside)
                order = np.lexsort((hashes[out_at], row[out_at]))
                h, r = hashes[out_at][order], row[out_at][order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([first, [len(h)]])).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(r[first], minlength=j - i))]).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(times)], names=["word", "n"]))
                columns = [
                    pa.array(key + np.arange(j - i)), batch.column(0).slice(i, j - i), pa.array(~folds[i:j]), pa.array(size.astype(np.int64)), pa.array(known),
                    pa.array(total(log_c) - size * base_log), pa.array(total(score)), pa.array(total((~inside).astype(np.int64))), tail,
                ]
                key += j - i
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PARTIAL.split(", ")])

    def run(batches):
        with one_thread():
            yield from scored(batches)

    part = scratch.keep(docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, PARTIAL), "part")
    tail = part.select("key", F.inline("tail"))
    found = tail.join(counts.where("trained > 0").select("word", "trained"), "word")
    sums = found.groupBy("key").agg(F.sum(F.col("n") * F.log10(F.col("trained") + 1)).alias("more"), F.sum("n").alias("also"))
    out = part.drop("tail").join(sums, "key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
