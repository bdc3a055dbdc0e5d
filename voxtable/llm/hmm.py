"""Language-model scores by a hidden Markov model over words.

Tokens are the lower-cased words and one end per document. Emissions are factored: a state emits a word class, the class
emits the word. The ``HEAD`` most frequent words are classes of their own; every other word, known or not, belongs to
one of ``TAIL`` classes by its crc32, and ``P(word | class) = (c + 0.1) / (C + 0.1 (V + 1))`` from the class's training
counts. So the state tables are bounded (states x (HEAD + TAIL + 1)), while word counts are summed and joined by Spark
over an unbounded vocabulary.

Baum-Welch: each task runs scaled forward and backward recursions over the training documents of its chunks in step,
expected counts are summed by class in a shuffle, and the driver normalises the bounded tables. The score is the scaled
forward recursion's exact log10 likelihood plus the class-to-word terms. Documents stay whole in training, too; where their
forward vectors are more than a task keeps, only that at every ``CUT``-th token is, and the steps of a block are
computed again on the way back. Long documents wait for those of the next chunks, so that a step serves many of them.

Null and empty texts are one end token. Repeated rows are scored and learned from one by one. Very long texts are read whole.
Without training rows every table is the smoothed uniform one. Only ``doc_id`` and ``text`` are read, so other columns may have any
name. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import bounded, hash_rest, list_numpy, release, split_words, stored

STATES, ROUNDS = 8, 3
HEAD, TAIL = 28_000, 4_096
CHUNK_BYTES = 5 << 20
CUT = 1 << 11
VECTOR_BYTES = 64 << 20         # forward vectors that a task keeps; of more, every ``CUT``-th and the rest again
LONG, LONG_TOKENS = 1 << 11, 1 << 19    # longer documents of several chunks are taken together, about so many tokens
SMOOTH, SHARED = 0.1, 0.02      # added to every count; weight of the class prior in every state
_STICKY = 0.9


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", CHUNK_BYTES):
            found = split_words(b.column("text"), lower=True)[1].dictionary_encode()
            n = np.bincount(found.indices.to_numpy(zero_copy_only=False), minlength=len(found.dictionary))
            yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.string()), pa.array(n)], names=["word", "c"])
        release()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Head words with counts, and the totals of the tail classes."""

    def __init__(self, head: dict[str, int], tail_total: np.ndarray, tail_words: np.ndarray, ends: int):
        self.head = {w: i for i, w in enumerate(head)}
        self.counts = np.array([*head.values()], np.int64)
        self.tail_total, self.tail_words, self.ends = tail_total, tail_words, ends
        self.n = int(self.counts.sum() + tail_total.sum() + ends)
        self.distinct = int(len(head) + tail_words.sum() + (ends > 0))
        self.whole = self.n + SMOOTH * (self.distinct + 1)
        weight = np.concatenate([self.counts + SMOOTH, tail_total + SMOOTH * (tail_words + 1), [ends + SMOOTH]])
        self.prior = weight / weight.sum()
        added = weight - np.concatenate([self.counts, tail_total, [ends]])
        self.smooth = added / max(self.n, 1) + SHARED * self.prior         # per count that a state has

    @property
    def end(self) -> int:
        return len(self.head) + TAIL

    def classes(self, words: list[str]) -> np.ndarray:
        n = len(self.head)
        return np.array([i if (i := self.head.get(w, -1)) >= 0 else n + zlib.crc32(w.encode()) % TAIL for w in words],
                        np.int32)


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    """From the stored word counts: the words frequent enough to be among ``HEAD``, and one row per tail class.

    The least count of such a word comes from the counts of counts, so no more than those words reach the driver.
    """
    levels = counts.groupBy("c").agg(F.count(F.lit(1)).alias("v"))
    above = F.sum("v").over(Window.orderBy(F.desc("c")))                # one row per distinct count
    least = levels.withColumn("above", above).filter(F.col("above") <= HEAD).agg(F.min("c")).first()[0]
    top = counts.filter(F.col("c") >= least).collect() if least is not None else []
    head = dict(sorted(((r["word"], r["c"]) for r in top), key=lambda x: (-x[1], x[0])))
    kind = (F.crc32("word") % TAIL).alias("k")
    total, words = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in counts.groupBy(kind).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        total[r["k"]], words[r["k"]] = r["c"], r["v"]
    for w, c in head.items():
        k = zlib.crc32(w.encode()) % TAIL
        total[k] -= c
        words[k] -= 1
    return Vocabulary(head, total, words, documents)


_ENCODED = ("chunk long, doc_ids array<long>, train array<boolean>, sizes array<int>, base array<double>, codes binary, "
            "tail_row array<int>, tail_word array<string>, tail_n array<int>")


def encode(docs: DataFrame, shared) -> DataFrame:
    """Chunks of documents ``docs(doc_id, text, train)`` as class codes, with the tail words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, number = shared.value, TaskContext.get().partitionId() << 32
        for b in bounded(batches, "text", CHUNK_BYTES):
            number += 1
            offsets, words = split_words(b.column("text"), lower=True)
            coded = words.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names = coded.dictionary.to_pylist()
            kind = vocab.classes(names)
            rows = b.num_rows
            row = np.repeat(np.arange(rows), np.diff(offsets))
            codes = np.full(len(index) + rows, vocab.end, np.uint16)
            codes[np.arange(len(index)) + row] = kind[index]
            inner = kind[index] < len(vocab.head)
            logs = np.log10((vocab.counts + SMOOTH) / vocab.whole)
            base = np.bincount(row[inner], weights=logs[kind[index[inner]]], minlength=rows)
            base = base + np.log10((vocab.ends + SMOOTH) / vocab.whole)
            pairs, n = np.unique(row[~inner] << 32 | index[~inner], return_counts=True)
            tail_word = coded.dictionary.take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string())

            def whole(values, kind):
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([b.column("train").to_pylist()], pa.list_(pa.bool_())),
                 whole(np.diff(offsets) + 1, pa.int32()), whole(base, pa.float64()),
                 pa.array([codes.tobytes()], pa.binary()), whole(pairs >> 32, pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, len(tail_word)], pa.int32()), tail_word), whole(n, pa.int32())],
                names=[c.split()[0] for c in _ENCODED.split(", ")])
        release()

    return docs.select("doc_id", "text", "train").mapInArrow(run, _ENCODED)


class Hmm:
    """Start, transition and class emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit.T)      # emit by class

    @classmethod
    def first(cls, prior: np.ndarray, states: int = STATES) -> Hmm:
        """States that tend to stay, with the class prior disturbed by a fixed generator."""
        rng = np.random.default_rng(11)
        emit = prior * np.exp(rng.normal(0, 1, (states, len(prior))))
        move = np.full((states, states), (1 - _STICKY) / max(1, states - 1))
        np.fill_diagonal(move, _STICKY if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def from_counts(cls, start, move, emit, smooth) -> Hmm:
        """Normalised expected counts; a word without counts is as likely in every state as in the unigram."""
        emit = emit + smooth * np.maximum(emit.sum(axis=1, keepdims=True), 1.0)
        start, move = start + 1e-3, move + 1e-3
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def forward(self, codes, starts, sizes, dtype=np.float64):
        """Log likelihood (natural) of every sequence, all taken one step at a time; longest first."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        move, emit = self.move.astype(dtype), self.emit.astype(dtype)
        logs = np.zeros(len(sizes))
        alpha, first = None, 0
        for size in _stretches(sizes[:1]):
            alpha, *_ = self._steps(alpha, codes, starts, sizes, first, size, move, emit, logs)
            first += size
        out = np.empty(len(sizes))
        out[order] = logs
        return out

    def _steps(self, alpha, codes, starts, sizes, first, size, move, emit, logs, keep=False):
        """``size`` forward steps from step ``first`` on, added to ``logs``: ``(last vectors, live, vectors, scales)``.

        Sequences come longest first, ``live`` counts those that reach a step; the lists are empty without ``keep``.
        """
        live = np.searchsorted(-sizes, -np.arange(first + 1, first + size + 1), side="right")
        steps, scales = [], []
        for t, n in enumerate(live, first):
            seen = emit[codes[starts[:n] + t]]
            alpha = self.start.astype(move.dtype) * seen if t == 0 else (alpha[:n] @ move) * seen
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            logs[:n] += np.log(scale)
            if keep:
                steps.append(alpha)
                scales.append(scale)
        return alpha, live, steps, scales

    def expected(self, codes, starts, sizes):
        """``(log likelihood, start, move, emit)`` expected counts of the whole sequences, in single precision."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        move, emit = self.move.astype(np.float32), self.emit.astype(np.float32)
        small = sizes.sum() * len(self.start) * move.itemsize <= VECTOR_BYTES
        blocks = sizes[:1] if small else _stretches(sizes[:1])
        logs, unused = np.zeros(len(sizes)), np.zeros(len(sizes))
        entering, alpha, first = [], None, 0
        for size in blocks[:-1]:
            entering.append(alpha)
            alpha, *_ = self._steps(alpha, codes, starts, sizes, first, size, move, emit, logs)
            first += size
        entering.append(alpha)
        pairs, k = np.zeros(move.shape), len(self.start)
        emit_counts = np.zeros((k, len(emit)))
        start_counts = np.zeros(k)
        beta = np.ones((0, k), np.float32)
        for i in range(len(blocks) - 1, -1, -1):
            before, last = entering.pop(), i == len(blocks) - 1
            _, live, steps, scales = self._steps(before, codes, starts, sizes, first, blocks[i], move, emit,
                                                 logs if last else unused, keep=True)
            to = np.cumsum(live)
            gamma, kind = np.empty((to[-1], k), np.float32), np.empty(to[-1], codes.dtype)
            for j in range(len(live) - 1, -1, -1):
                n, alpha, t = live[j], steps.pop(), first + j
                if len(beta) < n:
                    beta = np.concatenate([beta, np.ones((n - len(beta), k), np.float32)])
                seen = codes[starts[:n] + t]
                gamma[to[j] - n:to[j]] = alpha * beta
                kind[to[j] - n:to[j]] = seen
                if t:
                    back = emit[seen] * beta
                    back /= scales[j][:, None]
                    pairs += (steps[j - 1] if j else before)[:n].T @ back
                    beta = back @ move.T
                else:
                    start_counts = gamma[:n].sum(axis=0, dtype=float)
            for x in range(k):
                emit_counts[x] += np.bincount(kind, weights=gamma[:, x], minlength=len(emit))
            first -= blocks[i - 1] if i else 0
        return logs.sum(), start_counts, pairs * self.move, emit_counts


def _stretches(sizes: np.ndarray) -> np.ndarray:
    """Lengths of the blocks of at most ``CUT`` steps that sequences are taken in."""
    if not len(sizes) or sizes.max() <= CUT:
        return sizes
    return np.array([min(CUT, n - a) for n in sizes for a in range(0, n, CUT)], np.int64)


def _groups(batches, learn: bool):
    """``(codes, starts, sizes, about)``: sequences to take in step, with a row about each.

    Those of a chunk up to ``LONG`` tokens make a group, longer ones of several chunks another. ``learn`` leaves training
    documents only.
    """
    held, tokens = [], 0

    def together():
        sizes = np.array([len(c) for c, _ in held], np.int64)
        about = pa.Table.from_batches([a for _, a in held]).combine_chunks().to_batches()[0]
        return np.concatenate([c for c, _ in held]), np.cumsum(sizes) - sizes, sizes, about

    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            codes = np.frombuffer(row.column("codes")[0].as_buffer(), np.uint16).astype(np.int32)
            sizes = list_numpy(row.column("sizes"), np.int64)[1]
            train = np.array(row.column("train")[0].as_py(), bool)
            about = pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), row.column("chunk")[0].as_py())), pa.array(np.arange(len(sizes), dtype=np.int32)),
                 *(row.column(c).flatten() for c in ("doc_ids", "train", "base") if c in b.schema.names)],
                names=["chunk", "row", *(c for c in ("doc_ids", "train", "base") if c in b.schema.names)])
            starts = np.cumsum(sizes) - sizes
            wanted = train if learn else np.ones(len(sizes), bool)
            short = np.flatnonzero(wanted & (sizes <= LONG))
            if len(short):
                yield codes, starts[short], sizes[short], about.take(pa.array(short))
            for j in np.flatnonzero(wanted & (sizes > LONG)):
                held.append((codes[starts[j]:starts[j] + sizes[j]].copy(), about.slice(j, 1)))
                tokens += sizes[j]
                if tokens >= LONG_TOKENS:
                    yield together()
                    held, tokens = [], 0
    if held:
        yield together()


def baum_welch(encoded: DataFrame, model: Hmm, smooth: np.ndarray) -> tuple[Hmm, float]:
    """One round over all training documents: the new model, and the log likelihood under the old one."""
    k, classes = len(model.start), len(smooth)
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    # Rows past the classes carry the start counts, one row of transitions per state, and the log likelihood.
    names = [f"s{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes + k + 2, k))
        for codes, starts, sizes, _ in _groups(batches, learn=True):
            logs, start, move, emit = shared.value.expected(codes, starts, sizes)
            total[:classes] += emit.T
            total[classes] += start
            total[classes + 1:classes + 1 + k] += move
            total[-1, 0] += logs
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(total[at, i]) for i in range(k)]],
                                         names=["class", *names])
        release()

    sums = (encoded.select("chunk", "train", "sizes", "codes")
            .mapInArrow(run, "class int, " + ", ".join(f"{n} double" for n in names))
            .groupBy("class").agg(*[F.sum(n).alias(n) for n in names]).toPandas())
    total = np.zeros((classes + k + 2, k))
    total[sums["class"].to_numpy(np.int64)] = sums[names].to_numpy()
    made = Hmm.from_counts(total[classes], total[classes + 1:classes + 1 + k], total[:classes].T, smooth)
    shared.unpersist()
    return made, float(total[-1, 0])


def _forward_scores(encoded: DataFrame, model: Hmm) -> DataFrame:
    """``chunk, row, doc_id, train, n_tokens, base, log10p`` by the forward recursion over classes."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, starts, sizes, about in _groups(batches, learn=False):
            logs = shared.value.forward(codes, starts, sizes)
            yield pa.RecordBatch.from_arrays(
                [*(about.column(c) for c in ("chunk", "row", "doc_ids", "train")), pa.array(sizes), about.column("base"),
                 pa.array(logs / np.log(10))],
                names=["chunk", "row", "doc_id", "train", "n_tokens", "base", "log10p"])
        release()

    return encoded.select("chunk", "doc_ids", "train", "sizes", "base", "codes").mapInArrow(
        run, "chunk long, row int, doc_id long, train boolean, n_tokens long, base double, log10p double")


def score(docs: DataFrame, train=None, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text."""
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text").withColumn("train", hash_rest("doc_id", 10) != 0 if train is None else train)
    counts = stored(word_counts(marked.filter("train")), "words")
    vocab = vocabulary(counts, marked.filter("train").count())
    shared = spark.sparkContext.broadcast(vocab)
    encoded = stored(encode(marked, shared), "encoded")
    model = Hmm.first(vocab.prior, states)
    for _ in range(rounds):
        model, _ = baum_welch(encoded, model, vocab.smooth)
    tails = (encoded.select("chunk", F.explode(F.arrays_zip("tail_row", "tail_word", "tail_n")).alias("t"))
             .select("chunk", F.col("t.tail_row").alias("row"), F.col("t.tail_word").alias("word"),
                     F.col("t.tail_n").alias("n")))
    whole = spark.createDataFrame(
        [(k, float(vocab.tail_total[k] + SMOOTH * (vocab.tail_words[k] + 1))) for k in range(TAIL)], "k long, whole double")
    weight = F.coalesce(F.col("c"), F.lit(0)) + F.lit(SMOOTH)
    sums = (tails.join(counts, "word", "left").withColumn("k", F.crc32("word") % TAIL)
            .join(F.broadcast(whole), "k").groupBy("chunk", "row")
            .agg(F.sum(F.col("n") * F.log10(weight / F.col("whole"))).alias("tail_score"),
                 F.sum(F.col("n") * F.log10(weight / F.lit(float(vocab.whole)))).alias("tail_base"),
                 F.sum(F.when(F.col("c") > 0, 0).otherwise(F.col("n"))).alias("unknown")))
    rows = _forward_scores(encoded, model).join(sums, ["chunk", "row"], "left")
    zero = F.lit(0.0)
    unknown = F.coalesce(F.col("unknown"), F.lit(0)) + F.lit(0 if vocab.ends else 1)
    return rows.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_tokens") - unknown).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"),
        (F.col("log10p") + F.coalesce("tail_score", zero)).alias("score"))
