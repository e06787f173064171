"""Language-model scores from a hidden Markov model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.llm.common import U64, Words, quoted, ship, text_chunks, written

STATES = 8
BUCKET_BITS = 14  # emission buckets; bucket 0 is the end of a text alone
SEQ_BITS = 17  # words of one bucket in one block
BLOCK_BYTES = 16 << 20  # text of a block
PIECE = 256  # tokens of a training sequence
ROUNDS = 14  # Baum-Welch rounds, each over all training documents
TASKS = 2  # tasks of a round for each core; a task gives 1 MB of counts
SMOOTH = 2000.0  # words' worth of the bucket frequencies in every state


# ---------------------------------------------------------------- tokens


def _tokenise(rows: DataFrame) -> DataFrame:
    """Token table. Texts are cut into blocks of bounded size; in a block, a
    word's code is its emission bucket and a number within it. Document rows
    carry codes (with the end, code 0); one row per block carries the
    block's vocabulary: codes, 64-bit word hashes, training counts."""
    ship(rows.sparkSession)
    schema = StructType.fromDDL("block long").add(rows.schema["id"])
    for f in StructType.fromDDL("held boolean, codes array<int>, hashes array<long>, counts array<int>"):
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        number, size = 0, 0
        code_of: dict[int, int] = {}
        hashes, counts, used = [], [], np.zeros(1 << BUCKET_BITS, np.int64)
        codes = np.zeros(1 << 12, np.int32)
        id_type = None

        def close() -> pa.RecordBatch:
            n = len(hashes)
            order = np.argsort(codes[:n], kind="stable")
            cells = [pa.array([codes[:n][order]], pa.list_(pa.int32())), pa.array([np.array(hashes, np.int64)[order]], pa.list_(pa.int64())), pa.array([np.array(counts, np.int32)[order]], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([task + number]), pa.nulls(1, id_type), pa.nulls(1, pa.bool_()), *cells], names=schema.names)

        for part, data, offs in text_chunks(batches):
            id_type = part.column(0).type
            w = Words(data, offs)
            h = w.hashes()
            ends = w.first[1:] + np.arange(1, part.num_rows + 1)  # with one end per document
            held = np.asarray(part.column(1).to_pylist(), bool)
            keys, back = np.unique(np.append(h, U64(0)), return_inverse=True)  # hash 0: the end
            if size and (size + len(data) > BLOCK_BYTES or used.max() + len(keys) >= 1 << SEQ_BITS):
                yield close()
                number, size, code_of, hashes, counts, used = number + 1, 0, {}, [], [], np.zeros(1 << BUCKET_BITS, np.int64)
            size += len(data)
            place = np.empty(len(keys), np.int64)
            for i, k in enumerate(keys.tolist()):
                p = code_of.get(k)
                if p is None:
                    p = code_of[k] = len(hashes)
                    hashes.append(k - (1 << 64) if k >= 1 << 63 else k)
                    counts.append(0)
                    if p >= len(codes):
                        codes = np.resize(codes, 2 * len(codes))
                    b = bucket_of(k)
                    codes[p] = (b << SEQ_BITS) | used[b]
                    used[b] += 1
                place[i] = p
            word = np.empty(len(h) + part.num_rows, np.int64)
            is_end = np.zeros(len(word), bool)
            is_end[ends - 1] = True
            word[~is_end] = place[back[:-1]]
            word[is_end] = place[back[-1]]
            train = np.repeat(~held, np.diff(np.concatenate([[0], ends])))
            c = np.bincount(word[train], minlength=len(hashes))
            for i in np.flatnonzero(c).tolist():
                counts[i] += int(c[i])
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(codes[word]))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, task + number)), part.column(0), pa.array(held), cells, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], names=schema.names)
        if size or hashes:
            yield close()

    return rows.select("id", "held", "text").mapInArrow(run, schema)


def bucket_of(h: int) -> int:
    """Emission bucket of a word hash; the end has bucket 0 to itself."""
    if not h:
        return 0
    return 1 + (h >> 20) % ((1 << BUCKET_BITS) - 1)


# ---------------------------------------------------------------- model


class Model:
    """Initial, transition and bucket emission probabilities of the states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: buckets x states
        self.by_state = np.ascontiguousarray(emit.T)
        # where a sequence that does not begin a text starts from
        mid = np.full(len(start), 1 / len(start))
        for _ in range(50):
            mid = mid @ move
        self.mid = mid / mid.sum()

    def _ordered(self, codes: np.ndarray, ends: np.ndarray):
        """Longest first, so that the sequences still running at step t are a
        leading part; their buckets by step."""
        lens = np.diff(np.concatenate([[0], ends]))
        order = np.argsort(-lens, kind="stable")
        lens = lens[order]
        running = np.searchsorted(-lens, -np.arange(int(lens.max(initial=0))), "left")
        return order, lens, running, (ends - np.diff(np.concatenate([[0], ends])))[order]

    def log_likelihood(self, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log of the probability of whole sequences (none is empty),
        by the forward recursion, scaled at every step."""
        order, lens, running, begin = self._ordered(buckets, ends)
        out = np.zeros(len(ends))
        a = np.tile(self.start, (len(ends), 1))
        for t, m in enumerate(running.tolist()):
            if m < len(a):
                a = a[:m]
            if t:
                a = a @ self.move
            a = a * self.emit[buckets[begin[:m] + t]]
            s = a.sum(1)
            a /= s[:, None]
            out[:m] += np.log(s)
        back = np.empty(len(out))
        back[order] = out
        return back

    def counts(self, buckets: np.ndarray, ends: np.ndarray, first: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Add the expected counts of starts, moves and emissions of the
        sequences; ``first`` says which begin a text."""
        start, move, emit = into
        order, lens, running, begin = self._ordered(buckets, ends)
        first = first[order]
        steps, size, k = len(running), len(ends), len(self.start)
        # states x sequences, so that every operation runs along the sequences
        alpha, given, scale = np.empty((steps, k, size)), np.empty((steps, k, size)), np.ones((steps, size))
        seen = np.zeros((steps, size), np.int64)
        a = np.where(first, self.start[:, None], self.mid[:, None])
        for t, m in enumerate(running.tolist()):
            seen[t, :m] = buckets[begin[:m] + t]
            given[t, :, :m] = np.take(self.by_state, seen[t, :m], axis=1)
            a = (self.move.T @ a[:, :m] if t else a) * given[t, :, :m]
            scale[t, :m] = a.sum(0)
            a /= scale[t, :m]
            alpha[t, :, :m] = a
        beta = np.ones((k, size))
        for t in range(steps - 1, -1, -1):
            m = int(running[t])
            g = alpha[t, :, :m] * beta[:, :m]
            g /= g.sum(0)
            if t:
                back = given[t, :, :m] * beta[:, :m]
                back /= scale[t, :m]
                move += self.move * (alpha[t - 1, :, :m] @ back.T)
                beta[:, :m] = self.move @ back
            else:
                start += g[:, first].sum(1)
            alpha[t, :, :m] = g
        live = np.arange(size)[None, :] < running[:, None]
        full = live.all()
        flat = seen.ravel() if full else seen[live]
        for s in range(k):
            emit[:, s] += np.bincount(flat, alpha[:, s].ravel() if full else alpha[:, s][live], minlength=len(emit))


def empty_counts(states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(states), np.zeros((states, states)), np.zeros((1 << BUCKET_BITS, states))


def maximise(counts: tuple[np.ndarray, np.ndarray, np.ndarray], prior: np.ndarray) -> Model:
    """Model of expected counts, smoothed towards the bucket frequencies."""
    start, move, emit = counts
    emit = emit + SMOOTH * prior[:, None]
    return Model((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def pieces(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of training sequences of at most PIECE tokens, and which of them
    begin a text."""
    begin = np.concatenate([[0], ends[:-1]])
    n = -(-(ends - begin) // PIECE)
    own = np.repeat(np.arange(len(ends)), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(begin[own] + (k + 1) * PIECE, ends[own]), k == 0


def add_counts(model: Model, codes: np.ndarray, ends: np.ndarray, into, batch: int = 512) -> None:
    """Adds the expected counts of texts; sequences of about one length meet in a batch."""
    stop, first = pieces(codes, ends)
    begin = np.concatenate([[0], stop[:-1]])
    order = np.argsort(begin - stop, kind="stable")
    for lo in range(0, len(order), batch):
        who = order[lo : lo + batch]
        lens = stop[who] - begin[who]
        to = np.cumsum(lens)
        model.counts(codes[np.repeat(begin[who] - (to - lens), lens) + np.arange(to[-1])], to, first[who], into)


def first_model(prior: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    """Model that learning starts from: emissions differ at random."""
    rng = np.random.default_rng(seed)
    emit = prior[:, None] * (0.5 + rng.random((len(prior), states)))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _learn(docs: DataFrame, prior: np.ndarray, states: int) -> Model:
    """Baum-Welch rounds, each over all training rows: every task adds up its
    expected counts, which are summed by slices of the buckets in two steps."""
    spark = docs.sparkSession
    model = first_model(prior, states)
    docs = docs.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    slices = 16
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)  # buckets x states, whatever the data

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            into, any_ = empty_counts(states), False
            for b in batches:
                cells = b.column(0)
                ends = np.cumsum(np.asarray(cells.value_lengths().to_numpy(zero_copy_only=False), np.int64))
                if len(ends):
                    any_ = True
                    add_counts(m, cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64) >> SEQ_BITS, ends, into)
            if any_:
                task = TaskContext.get().partitionId()
                parts = [np.concatenate([into[0], into[1].ravel()]), *into[2].reshape(slices, -1)]
                yield pa.RecordBatch.from_arrays([pa.array(range(slices + 1), pa.int32()), pa.array([task % 64] * (slices + 1), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "salt", "sums"])

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return rows.head(1).assign(sums=[sum(np.frombuffer(x) for x in rows.sums).tobytes()])

        schema = "part int, salt int, sums binary"
        got = docs.select("codes").mapInArrow(expect, schema).groupBy("part", "salt").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema).collect()
        sums = {r.part: np.frombuffer(r.sums) for r in got}
        if not sums:
            break
        into = sums[0][:states], sums[0][states:].reshape(states, states), np.concatenate([sums[i + 1] for i in range(slices)]).reshape(1 << BUCKET_BITS, states)
        model = maximise(into, prior)
    return model


# ---------------------------------------------------------------- scores


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES) -> DataFrame:
    """Per document ``held_out``, ``n_tokens`` (words and one end), ``n_known``,
    ``train_tokens``, ``base_score`` (log10 under smoothed token frequencies)
    and ``score`` (log10 of the model's probability of the whole text).

    Both learn from all rows that are not ``held``. The model gives a word
    the probability of its emission bucket in the hidden state times the
    word's smoothed share of the bucket, where one more word stands for all
    unknown ones. The exact counts reach the texts block by block: a block
    asks only for the words it holds.

    Null and empty texts are one end; a null ``held`` trains; repeated rows
    are documents each; other columns are left out; without training rows
    base scores are 0 and the model is uniform; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    tokens = written(_tokenise(rows), "tokens")
    each = tokens.where("hashes IS NOT NULL").select("block", F.explode(F.arrays_zip("codes", "hashes", "counts")).alias("w"))
    by_word = Window.partitionBy("hash")
    words = each.select("block", F.col("w.codes").alias("code"), F.col("w.hashes").alias("hash"), F.col("w.counts").cast("long").alias("n"))
    words = words.select("block", "code", "n", F.sum("n").over(by_word).alias("c"), F.count(F.lit(1)).over(by_word).alias("blocks"), F.min("block").over(by_word).alias("low"))
    words = written(words, "words")
    once = words.where("block = low").groupBy(F.shiftright("code", SEQ_BITS).alias("bucket")).agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v"))
    total, distinct = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for r in once.collect():  # one row per bucket
        total[r.bucket], distinct[r.bucket] = r.c, r.v
    n, v = int(total.sum()), int(distinct.sum())
    room = total + 0.5 * (distinct + 1)
    room[0] = max(room[0], 0.5)
    model = _learn(tokens.where("hashes IS NULL AND NOT held").select("codes"), room / room.sum(), states)
    sent = spark.sparkContext.broadcast((model, room))
    shared = words.where("blocks > 1").select("block", "code", "c")
    schema = rows.select(quoted("id").alias(id_col), F.lit(True).alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema

    def block(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        m, room_ = sent.value
        head = texts[texts.hashes.notna()]
        codes, count = np.concatenate([np.asarray(c, np.int64) for c in head.codes]), np.concatenate([np.asarray(c, np.float64) for c in head.counts])
        count[np.searchsorted(codes, known.code.to_numpy(np.int64))] = known.c.to_numpy(np.float64)
        bucket = codes >> SEQ_BITS
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        share = np.where(bucket == 0, 0.0, np.log10((count + 0.5) / room_[bucket]))
        t = texts[texts.hashes.isna()]
        lens = np.array([len(c) for c in t.codes], np.int64)
        out = {k: np.zeros(len(t)) for k in ("known", "base", "score")}
        order = np.argsort(-lens, kind="stable")
        cells = list(t.codes)
        for lo in range(0, len(order), 256):
            who = order[lo : lo + 256]
            flat = np.concatenate([np.asarray(cells[i], np.int64) for i in who])
            ends = np.cumsum(lens[who])
            at = np.searchsorted(codes, flat)
            tot = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
            out["known"][who] = tot(count[at] > 0)
            out["base"][who] = [base[at[a:b]].sum() for a, b in zip(ends - lens[who], ends)]
            out["score"][who] = np.array([share[at[a:b]].sum() for a, b in zip(ends - lens[who], ends)]) + m.log_likelihood(flat >> SEQ_BITS, ends) / np.log(10)
        return pd.DataFrame({id_col: t.id.to_numpy(), "held_out": t.held.to_numpy(bool), "n_tokens": lens, "n_known": out["known"].astype(np.int64), "train_tokens": np.full(len(t), n), "base_score": out["base"], "score": out["score"]})

    return tokens.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(block, schema)
