"""Language-model scoring with a hidden Markov model.

Words of the learning rows are counted over the whole corpus. The model's symbols are SYMBOLS classes of words, by a hash
of the word, and one symbol for the end of a text; inside its class a word keeps its share of the smoothed unigram
distribution. So every word of a corpus of any size has a probability of its own in each state, what reaches the workers
has a fixed bound, and no word is treated otherwise because of its rank or of the size of the vocabulary.
Each Baum-Welch round sends the parameters out, runs the scaled forward and backward recursions over all learning texts,
whatever their length, and sums the expected counts of states, transitions and emissions of all partitions
(pre-aggregated in each task). Scoring runs the scaled forward recursion over whole texts, which gives the exact
log-likelihood. The words of a text meet their corpus counts in a join; only those of the up to HEAD most frequent words
come by broadcast, which saves time and changes nothing.

Texts are processed in bounded batches, many side by side, each column of a batch one recursion step.

Defined cases: a null or empty text is the end token alone; unknown words have the smoothed probability of a count of
0; with no learning text the counts are 0 and the model is the smoothed unigram; an empty table gives an empty result;
repeated rows are learnt from as often as they occur.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juristrata.llm.common import Scratch, gathered, small_batches

SYMBOLS = 1 << 16
HEAD = 1 << 15
STATES = 6
ROUNDS = 3
LANES = 512
TEXTS = 4096
"""Recursions that run side by side; texts of which lanes of similar length are made."""
LONGEST = 1 << 10
"""Steps of the recursion whose arrays are held at once; longer texts go through in pieces, with the states carried over."""
END = 0
ADD, PRIOR = 0.1, 4.0
"""Added count of the unigram model; added occurrences of a symbol in the emissions of the states."""
HELD = 200_000
SEED = 42
"""Of the SQL function xxhash64, which sums up the counts of the classes."""


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of docs, pre-aggregated in each task."""

    def run(batches):
        held: Counter[bytes] = Counter()

        def handed():
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for rb in batches:
            for text in rb.column(0).to_pylist():
                held.update(words(text))
                if len(held) > HELD:
                    yield handed()
        yield handed()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbol_of(word: bytes, symbols: int) -> int:
    """The class of a word, from 1 on; the same as class_counts() takes."""
    return 1 + xxhash.xxh64_intdigest(word, SEED) % symbols


def class_counts(counts: DataFrame, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class, from 0 on; symbols is a power of two."""
    got = counts.groupBy(F.pmod(F.xxhash64("word"), F.lit(symbols)).alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow()  # at most `symbols` rows
    tokens, distinct = np.zeros(symbols), np.zeros(symbols)
    at = got.column(0).to_numpy()
    tokens[at], distinct[at] = got.column(1).to_numpy(), got.column(2).to_numpy()
    return tokens, distinct


class Model:
    """Symbols: END, then the classes of words. start (K), move (K, K), emit (symbols, K): probabilities; unigram
    (symbols): smoothed probabilities, of a class those of its words and an even share of that of one unknown word, so that
    they add up to 1; tokens, distinct: N and V of the learning rows."""

    def __init__(self, tokens: np.ndarray, distinct: np.ndarray, docs: int):
        self.tokens, self.distinct, self.docs = int(tokens.sum()) + docs, int(distinct.sum()) + (1 if docs else 0), docs
        self.total = self.tokens + ADD * (self.distinct + 1)
        self.unigram = np.append(docs + ADD, tokens + ADD * distinct + ADD / len(tokens)) / self.total
        rng = np.random.default_rng(11)
        k = STATES
        self.start, self.move = np.full(k, 1 / k), np.full((k, k), 0.1 / (k - 1)) if k > 1 else np.ones((1, 1))
        if k > 1:
            np.fill_diagonal(self.move, 0.9)
        self.emit = self.unigram[:, None] * rng.uniform(0.3, 1.7, (len(self.unigram), k))
        self.emit /= self.emit.sum(0)

    def log_base(self, count: int) -> float:
        """log10 of the smoothed unigram probability of a word of that count."""
        return math.log10((count + ADD) / self.total)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """The maximisation step on expected counts. The states in which a symbol occurs are smoothed by PRIOR occurrences
        dealt like all tokens, so a rare symbol keeps nearly its unigram probability in every state."""
        self.start = (start + 1) / (start + 1).sum()
        self.move = (move + 1) / (move + 1).sum(1, keepdims=True)
        state = (emit.sum(0) + 1) / (emit.sum(0) + 1).sum()
        inside = (emit + PRIOR * state) / (emit.sum(1, keepdims=True) + PRIOR)
        emit = self.unigram[:, None] * inside / state
        self.emit = emit / emit.sum(0)


def _batches(codes: list[np.ndarray]):
    """Rows of codes in groups of LANES of similar length, longest first."""
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    for at in range(0, len(order), LANES):
        yield order[at : at + LANES]


def _grid(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes as (steps, lanes), and how many lanes are still running at each step (lanes are longest first)."""
    steps = len(rows[0])
    grid = np.zeros((steps, len(rows)), np.int32)
    for j, r in enumerate(rows):
        grid[: len(r), j] = r
    alive = np.searchsorted(-np.array([len(r) for r in rows]), -np.arange(1, steps + 1), side="right")
    return grid, alive


def _seen(grid: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Emission probabilities as (steps, states, lanes), lanes side by side in memory."""
    out = np.empty((grid.shape[0], emit.shape[1], grid.shape[1]))
    for j in range(emit.shape[1]):
        out[:, j] = np.ascontiguousarray(emit[:, j])[grid]
    return out


def likelihoods(codes: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each code sequence by the scaled forward recursion."""
    out, onward = np.zeros(len(codes)), np.ascontiguousarray(move.T)
    for order in _batches(codes):
        rows = [codes[i] for i in order]
        total, a = np.zeros(len(rows)), None
        for at in range(0, len(rows[0]), LONGEST):
            part = [r[at : at + LONGEST] for r in rows if len(r) > at]
            grid, alive = _grid(part)
            seen, scale = _seen(grid, emit), np.ones(grid.shape)
            for t, n in enumerate(alive):
                a = seen[t, :, :n] * start[:, None] if a is None else (onward @ a[:, :n]) * seen[t, :, :n]
                c = a.sum(0)
                a /= c
                scale[t, :n] = c
            total[: len(part)] += np.log(scale).sum(0)
        out[order] = total
    return out


def _forward(seen: np.ndarray, alive: np.ndarray, before: np.ndarray | None, start: np.ndarray, onward: np.ndarray, alpha: np.ndarray | None = None, scale: np.ndarray | None = None) -> np.ndarray:
    """The scaled forward recursion over a piece; before: the state at the end of the piece before. Gives the state at the
    end of the piece, and fills alpha and scale."""
    for t, n in enumerate(alive):
        a = seen[t, :, :n] * start[:, None] if before is None else (onward @ before[:, :n]) * seen[t, :, :n]
        c = a.sum(0)
        a /= c
        if alpha is not None:
            alpha[t, :, :n], scale[t, :n] = a, c
        before = a
    return before


def expectations(codes: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Expected counts (start, move, symbols x states) of the sequences, by scaled forward and backward recursions.

    A text longer than LONGEST goes through in pieces: a first pass keeps the forward state at the end of each piece, a
    second takes the pieces from the last to the first, each with its forward states again and the backward state of the
    piece behind it. The counts are those of whole texts, and the memory is that of one piece.
    """
    k, onward = len(start), np.ascontiguousarray(move.T)
    first, moves, found = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape)
    for order in _batches(codes):
        rows, ends, beyond = [codes[i] for i in order], [None], None
        places = range(0, len(rows[0]), LONGEST)
        piece = lambda at: _grid([r[at : at + LONGEST] for r in rows if len(r) > at])  # noqa: E731, B023
        for at in places[:-1]:
            grid, alive = piece(at)
            ends.append(_forward(_seen(grid, emit), alive, ends[-1], start, onward))
        for number in range(len(places) - 1, -1, -1):
            grid, alive = piece(places[number])
            steps, lanes = grid.shape
            seen = _seen(grid, emit)
            alpha, scale = np.zeros((steps, k, lanes)), np.ones((steps, lanes))
            _forward(seen, alive, ends[number], start, onward, alpha, scale)
            beta = np.ones((k, lanes))
            if beyond is not None:
                beta[:, : beyond.shape[1]] = beyond
            for t in range(steps - 1, -1, -1):
                n = alive[t]
                weighted = seen[t, :, :n] * beta[:, :n]
                weighted /= scale[t, :n]
                seen[t, :, :n] = alpha[t, :, :n] * beta[:, :n]  # from here on the chances of the states
                seen[t, :, n:] = 0
                before = alpha[t - 1] if t else ends[number]
                if before is not None:
                    moves += before[:, :n] @ weighted.T
                beta[:, :n] = move @ weighted
            beyond = beta
            if not number:
                first += seen[0].sum(1)
            flat = grid.ravel()
            for j in range(k):
                found[:, j] += np.bincount(flat, seen[:, j].ravel(), len(emit))
    return first, moves * move, found


class _Classes(dict):
    """Classes of words, kept while they are few."""

    def __init__(self, symbols: int):
        self.symbols = symbols

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        self[word] = c = symbol_of(word, self.symbols)
        return c


def encode(docs: DataFrame, head: list[tuple[bytes, int]], model: Model) -> DataFrame:
    """(rid, doc_id, learn, codes, known, base, rare) of each row of docs (doc_id, text, learn): the text's symbols, the
    end among them, as 32-bit integers; how many of its tokens are frequent words or a known end, and the sum of their
    unigram logarithms; and the other words with their counts."""
    symbols, end_known = len(model.unigram) - 1, model.docs > 0
    index = docs.sparkSession.sparkContext.broadcast(([w for w, _ in head], np.array([model.log_base(n) for _, n in head])))
    end = model.log_base(model.docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        frequent, logs = index.value
        get, classes = {w: i for i, w in enumerate(frequent)}.get, _Classes(symbols)
        own = np.array([symbol_of(w, symbols) for w in frequent], np.int32)
        for rb in batches:
            codes, known, base, rare = [], [], [], []
            for text in rb.column(2).to_pylist():
                found = words(text)
                c = np.fromiter(map(get, found, repeat(-1)), np.int32, len(found))
                at, others = c[c >= 0], [found[i] for i in np.flatnonzero(c < 0)]
                symbol = np.zeros(len(found) + 1, np.int32)
                symbol[:-1][c >= 0] = own[at]
                symbol[:-1][c < 0] = np.fromiter(map(classes.__getitem__, others), np.int32, len(others))
                codes.append(symbol.tobytes())
                known.append(len(at) + end_known), base.append(float(logs[at].sum()) + end)
                rare.append(list(Counter(others).items()))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(1), rb.column(3), pa.array(codes, pa.binary()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, pa.map_(pa.binary(), pa.int64()))],
                names=["rid", "doc_id", "learn", "codes", "known", "base", "rare"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "learn")
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, learn boolean, codes binary, known long, base double, rare map<binary,bigint>")


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int32) for b in column.to_pylist()]


def score_corpus(docs: DataFrame, learn: Column, rounds: int = ROUNDS, head: int = HEAD, symbols: int = SYMBOLS) -> DataFrame:
    """Learn from the rows of docs (doc_id, text) where learn holds, and score all rows: doc_id, n_tokens, n_known,
    train_tokens, base_score, score (log10)."""
    scratch = Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", learn.alias("learn"))
    counts = scratch.table(count_words(docs.where("learn")), "word-counts")
    model = Model(*class_counts(counts, symbols), docs.where("learn").count())
    codes = scratch.table(encode(docs, head_words(counts, head), model), "hmm-codes")
    if model.docs:
        baum_welch(codes.where("learn"), model, rounds)
    return score(codes, model, counts)


def head_words(counts: DataFrame, head: int) -> list[tuple[bytes, int]]:
    """The most frequent words as (word, n), at most `head`: all that occur more often than a cut, which a histogram of
    the counts gives. (A sorted limit would send `head` rows of every partition to the driver.)"""
    total, cut = 0, None
    for n, words_of in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(head).collect():
        total += words_of
        if total > head:
            break
        cut = n
    return [] if cut is None else sorted(((bytes(r[0]), r[1]) for r in counts.where(F.col("n") >= cut).collect()), key=lambda r: (-r[1], r[0]))


def baum_welch(codes: DataFrame, model: Model, rounds: int) -> None:
    """Fit the model to all rows of codes, whose expected counts are summed over tasks and then over the cluster."""
    spark, k = codes.sparkSession, len(model.start)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.start, model.move, model.emit.astype(np.float32)))

        def run(batches, shared=shared):
            start, move, emit = shared.value
            held, first, moves = np.zeros((len(emit), k)), np.zeros(k), np.zeros((k, k))
            for rb in gathered(batches, TEXTS):
                f, m, e = expectations(_symbols(rb.column(0)), start, move, emit)
                first, moves = first + f, moves + m
                held += e
            at = np.flatnonzero(held.any(1))
            yield from _counted(at, held[at], k)
            yield from _counted(np.array([-1]), first[None], k)
            yield from _counted(-2 - np.arange(k), moves, k)

        sums = codes.select("codes").mapInArrow(run, "symbol int, " + ", ".join(f"s{j} double" for j in range(k))).groupBy("symbol").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(k)))
        emit, first, moves = np.zeros((len(model.emit), k)), np.zeros(k), np.zeros((k, k))
        got = sums.toArrow()  # at most SYMBOLS + STATES + 2 rows
        symbol, values = got.column(0).to_numpy(), np.column_stack([got.column(1 + j).to_numpy() for j in range(k)])
        emit[symbol[symbol >= 0]] = values[symbol >= 0]
        first += values[symbol == -1].sum(0)
        for s, v in zip(symbol, values, strict=True):
            if s <= -2:
                moves[-2 - s] += v
        model.update(first, moves, emit)
        shared.unpersist()


def _counted(symbols: np.ndarray, values: np.ndarray, k: int):
    for lo in range(0, len(symbols), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(symbols[lo : lo + 50_000], pa.int32())] + [pa.array(values[lo : lo + 50_000, j].astype(float), pa.float64()) for j in range(k)], names=["symbol", *(f"s{j}" for j in range(k))])


def score(codes: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """For each row of codes: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = codes.sparkSession
    kind = codes.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit.astype(np.float32), np.log10(model.unigram)))

    def run(batches):
        start, move, emit, log_unigram = shared.value
        log_unigram = np.append(0.0, log_unigram[1:])  # the end is a symbol of its own and shares it with no word
        for rb in gathered(batches, TEXTS):
            rows = _symbols(rb.column(4))
            full = likelihoods(rows, start, move, emit) / math.log(10)
            # A word has the probability of its class times its share of the class's unigram mass; the end its own.
            inside = full - np.array([log_unigram[c].sum() for c in rows])
            yield pa.RecordBatch.from_arrays([*rb.columns[:4], pa.array([len(c) for c in rows], pa.int64()), pa.array(inside, pa.float64())], names=["rid", "doc_id", "known", "base", "n_tokens", "inside"])

    rows = codes.select("rid", "doc_id", "known", "base", "codes").mapInArrow(run, f"rid long, doc_id {kind}, known long, base double, n_tokens long, inside double")
    # Other words meet their counts by word. Then one row a text, pre-aggregated.
    found = codes.select("rid", F.explode("rare").alias("word", "times")).join(counts, "word", "left")
    log_n = F.log10((F.coalesce("n", F.lit(0)) + ADD) / F.lit(model.total))
    tail = found.groupBy("rid").agg(F.sum(F.col("times") * log_n).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    more = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("base") + more("rare_base")
    end = math.log10(model.unigram[END])
    return rows.join(tail, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + more("rare_known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("inside") + base - F.lit(end)).alias("score"),
    )
