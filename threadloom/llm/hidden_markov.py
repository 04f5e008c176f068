"""Hidden Markov language model over word classes.

Every training word is counted (a shuffle that grows with the corpus). A word belongs to a class: one of the
N_FREQUENT most frequent words has a class of its own, any other the class of its ending; the end of a text is class 0.
Latent states emit classes, a class emits its words by their smoothed counts. Each task runs the scaled forward and
backward recursions on the class sequences it reads and adds up expected counts; their sum over all tasks
(states x (states + classes) numbers, whatever the input) re-estimates the model. The scaled forward recursion over a
whole text gives its exact likelihood.

Texts are dealt into blocks of about BLOCK_BYTES by a hash of the row. A block brings each of its distinct words once
to the counts, and gets its own part of the vocabulary back, so no task holds the whole of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.shared import discard, documents, in_fold, stored
from threadloom.llm.wordgrid import mix, slices, words

HELD_OUT = 1
N_STATES, N_FREQUENT, N_ENDINGS, ITERATIONS = 6, 2000, 64, 3
BLOCK_BYTES = 16 << 20
ROUNDS = 3  # of k-means over all training texts, which give the first states
PIECE, CONTEXT = 512, 8  # training sequences run in pieces, each with so many tokens of its neighbours; scoring never cuts
END_HASH = 0  # no word hashes to it but by a chance of 2**-64
DENSE = 1 << 20


def _ending(w) -> np.ndarray:
    """0 .. N_ENDINGS - 1 by a word's last four bytes."""
    code = np.zeros(len(w.end), dtype=np.uint64)
    for back in range(1, 5):
        at = w.end - back
        inside = at >= w.start
        byte = w.data[np.maximum(at, 0)].astype(np.uint64)
        byte += np.uint64(32) * ((byte >= 65) & (byte <= 90))
        code = code * np.uint64(257) + np.where(inside, byte, np.uint64(0))
    return (mix(code) % np.uint64(N_ENDINGS)).astype(np.int32)


def _block_words(table: pa.Table) -> pa.Table:
    """The distinct words of one block: hash, occurrences in training texts, ending."""
    parts = []
    ends = 0
    for b in slices(iter(table.to_batches())):
        w = words(b.column("text"))
        train = np.repeat(b.column("train").to_numpy(zero_copy_only=False), w.counts)
        ends += int(b.column("train").to_numpy(zero_copy_only=False).sum())
        distinct, first, at = np.unique(w.hashes(lower=True), return_index=True, return_inverse=True)
        parts.append((distinct, np.bincount(at.ravel(), weights=train, minlength=len(distinct)), _ending(w)[first]))
    h, own, ending = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int32))
    distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
    count = np.bincount(at.ravel(), weights=own, minlength=len(distinct)).astype(np.int64)
    block = table.column("block")[0].as_py() if table.num_rows else 0
    hashes = np.append(distinct.view(np.int64), END_HASH)
    return pa.table({"block": pa.array(np.full(len(hashes), block), pa.int32()), "word": hashes, "own": np.append(count, ends), "ending": pa.array(np.append(ending[first], -1), pa.int32())})


@dataclass
class Vocabulary:
    """Training tokens and distinct words, the most frequent words (sorted hashes), and each class's mass."""

    tokens: int
    distinct: int
    frequent: np.ndarray
    mass: np.ndarray

    def classes(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.frequent, word)
        at[at == len(self.frequent)] = 0
        own = self.frequent[at] == word if len(self.frequent) else np.zeros(len(word), bool)
        return np.where(ending < 0, 0, np.where(own, 1 + N_ENDINGS + at, 1 + ending)).astype(np.int16)


def _vocabulary(counted: DataFrame) -> Vocabulary:
    """counted: a row for each (block, word) with the word's count over all blocks; ``lead`` marks one a word."""
    lead = counted.where("lead and count > 0")
    total = lead.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = np.sort(np.array([r[0] for r in lead.where("ending >= 0").orderBy(F.desc("count"), "word").limit(N_FREQUENT).select("word").collect()], dtype=np.int64))
    vocabulary = Vocabulary(total["n"], total["v"], frequent, np.full(1 + N_ENDINGS + N_FREQUENT, 0.5))
    known = F.col("word").isin([int(x) for x in frequent]) if len(frequent) else F.lit(False)
    for r in lead.where("ending >= 0").where(~known).groupBy("ending").agg(F.sum(F.col("count") + 0.5).alias("mass")).collect():
        vocabulary.mass[1 + r["ending"]] += r["mass"]
    return vocabulary


def _encoder(v: Vocabulary):
    """Joins a block's texts with its part of the vocabulary: base score, word terms and the class sequence of each."""
    total = np.log10(v.tokens + 0.5 * (v.distinct + 1))

    def encode(texts: pa.Table, part: pa.Table) -> pa.Table:
        word, count, ending = (part.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("word", "count", "ending"))
        order = np.argsort(word)
        word, count, ending = word[order], count[order], ending[order]
        kind = v.classes(word, ending)
        base = np.log10(count + 0.5) - total
        # a word's share of its class; frequent words and the end are their classes
        inside = np.where((kind > 0) & (kind <= N_ENDINGS), np.log10(count + 0.5) - np.log10(v.mass[kind]), 0.0)
        out = []
        for b in slices(iter(texts.to_batches())):
            w = words(b.column("text"))
            at = np.searchsorted(word, w.hashes(lower=True).view(np.int64))
            end = int(np.searchsorted(word, END_HASH))
            n = w.counts
            owner = np.repeat(np.arange(b.num_rows), n)
            add = lambda x, last: np.bincount(owner, weights=x[at], minlength=b.num_rows) + last  # noqa: B023, E731
            first = w.first + np.arange(b.num_rows + 1)
            sequence = np.zeros(first[-1], dtype=np.int16)
            spot = np.ones(len(sequence), dtype=bool)
            spot[first[1:] - 1] = False
            sequence[spot] = kind[at]
            out.append(pa.record_batch([
                b.column("doc_id"), b.column("train"), pa.array(n + 1), pa.array((add(count > 0, count[end] > 0)).astype(np.int64)),
                pa.array(add(base, base[end])), pa.array(add(inside, 0.0)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sequence)),
            ], ["doc_id", "train", "n_tokens", "n_known", "base_score", "inside", "classes"]))
        return pa.Table.from_batches(out) if out else ENCODED.empty_table()

    return encode


ENCODED = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("inside", pa.float64()), ("classes", pa.list_(pa.int16()))])


@dataclass
class Hmm:
    """First-state, transition and class probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states

    def pieces(self, first: np.ndarray, piece: int) -> tuple[np.ndarray, ...]:
        """Begin and length of the sequences, cut to piece tokens (0: whole), by falling length, and the first and the end
        of the tokens that are the piece's own and no context."""
        begin, size = first[:-1], np.diff(first)
        own, end = np.zeros(len(size), np.int64), size
        if piece:
            n = -(-size // piece)
            owner = np.repeat(np.arange(len(size)), n)
            nth = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
            left = size[owner] - nth * piece
            own = np.where(nth > 0, CONTEXT, 0)
            end = np.minimum(left, piece) + own
            begin, size = begin[owner] + nth * piece - own, np.minimum(left, piece + CONTEXT) + own
        order = np.argsort(-size, kind="stable")
        return begin[order], size[order], own[order], end[order]

    def usual(self) -> np.ndarray:
        """The share of the states in the long run."""
        return np.linalg.matrix_power(self.move, 1 << 12)[0]

    def log_likelihood(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of every whole class sequence (all have a token at least)."""
        begin, size = self.pieces(first, 0)[:2]
        out, live = np.zeros(len(size)), len(size)
        alpha = np.repeat(self.start[None], live, axis=0)
        for t in range(int(size[0]) if live else 0):
            while size[live - 1] <= t:
                live -= 1
            alpha = (alpha[:live] if t == 0 else alpha[:live] @ self.move) * self.emit[classes[begin[:live] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            out[:live] += np.log10(scale)
        result = np.empty(len(out))
        result[np.argsort(-np.diff(first), kind="stable")] = out
        return result

    def expected(self, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected first states, transitions and emissions (scaled forward and backward recursion over pieces). A piece
        begins CONTEXT tokens early, from the usual states, ends as many late, and counts none of these nor moves to them."""
        begin, size, own, end = self.pieces(first, PIECE)
        usual = self.usual()
        k = len(self.start)
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit)
        width = max(1, DENSE // ((PIECE + 2 * CONTEXT) * k))
        for a in range(0, len(size), width):
            b, n, early, late = (x[a : a + width] for x in (begin, size, own, end))
            steps = int(n[0])
            live = np.searchsorted(-n, -np.arange(steps), side="left")  # sequences longer than t
            forward, scales = [], []
            alpha = np.where((early == 0)[:, None], self.start[None], usual[None])
            for t in range(steps):
                m = live[t]
                alpha = (alpha[:m] if t == 0 else alpha[:m] @ self.move) * self.emit[classes[b[:m] + t]]
                scales.append(alpha.sum(axis=1))
                alpha = alpha / scales[-1][:, None]
                forward.append(alpha)
            beta = np.ones((len(n), k))
            seen, weight = [], []
            for t in range(steps - 1, -1, -1):
                m = live[t]
                c = classes[b[:m] + t]
                counts = ((early[:m] <= t) & (t < late[:m]))[:, None]
                gamma = forward[t] * beta[:m] * counts
                seen.append(c)
                weight.append(gamma)
                if t:
                    back = self.emit[c] * beta[:m] / scales[t][:, None]
                    moves += forward[t - 1][:m].T @ (back * counts)
                    beta[:m] = back @ self.move.T
            moves_seen, gammas = np.concatenate(seen), np.concatenate(weight)
            for s in range(k):
                emits[:, s] += np.bincount(moves_seen, weights=gammas[:, s], minlength=len(emits))
            starts += weight[-1].sum(axis=0)
        return starts, moves * self.move, emits


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = b.column("classes")
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _sums(encoded: DataFrame, count, size: int) -> np.ndarray:
    """``size`` numbers that count gives for each 2,000 class sequences of training texts, summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                total += count(*_arrays(b.slice(a, 2000)))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "value"])

    out = np.zeros(size)
    for r in encoded.where("train").select("classes").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def _profiles(classes: np.ndarray, first: np.ndarray, n_classes: int) -> np.ndarray:
    """Shares of the classes in each text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = np.bincount(owner * n_classes + classes, minlength=(len(first) - 1) * n_classes).reshape(-1, n_classes)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _first_model(encoded: DataFrame) -> Hmm:
    """States from k-means on the square roots of all training texts' class profiles. The first clusters are the texts that
    share one of the N_STATES commonest favourites, a text's most frequent word class."""
    n_classes = 1 + N_ENDINGS + N_FREQUENT

    def favourites(profile: np.ndarray) -> np.ndarray:
        return profile[:, 1:].argmax(axis=1) + 1

    liked = _sums(encoded, lambda c, f: np.bincount(favourites(_profiles(c, f, n_classes)), minlength=n_classes).astype(float), n_classes)
    label = np.arange(n_classes) % N_STATES
    label[np.argsort(-liked, kind="stable")[:N_STATES]] = np.arange(N_STATES)
    centres, sums = None, np.zeros((N_STATES, 2 * n_classes + 1))
    for _ in range(ROUNDS):

        def cluster(c: np.ndarray, f: np.ndarray, centres=centres) -> np.ndarray:
            profile = _profiles(c, f, n_classes)
            x = np.sqrt(profile)
            near = label[favourites(profile)] if centres is None else np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
            rows = np.hstack([profile, x, np.ones((len(x), 1))])
            return (np.eye(N_STATES)[near].T @ rows).ravel()

        sums = _sums(encoded, cluster, N_STATES * (2 * n_classes + 1)).reshape(N_STATES, -1)
        many = np.maximum(sums[:, -1:], 1)
        centres = sums[:, n_classes:-1] / many
    whole = sums[:, :n_classes].sum(axis=0) / max(sums[:, -1].sum(), 1)
    own = np.where(sums[:, -1:] > 0, sums[:, :n_classes] / np.maximum(sums[:, -1:], 1), whole)
    emit = (0.8 * own + 0.15 * whole + 0.05 / n_classes).T
    move = np.full((N_STATES, N_STATES), 0.02 / max(N_STATES - 1, 1))
    np.fill_diagonal(move, 0.98)
    return Hmm(np.full(N_STATES, 1.0 / N_STATES), move, emit / emit.sum(axis=0))


def baum_welch(encoded: DataFrame, model: Hmm) -> Hmm:
    """One re-estimation from all training sequences."""
    k, n_classes = len(model.start), len(model.emit)
    sums = _sums(encoded, lambda c, f: np.concatenate([x.ravel() for x in model.expected(c, f)]), k + k * k + n_classes * k)
    start, move, emit = sums[:k] + 1e-3, sums[k : k + k * k].reshape(k, k) + 1e-3, sums[k + k * k :].reshape(n_classes, k) + 1e-3
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def score_texts(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null and empty texts are the end token alone; null ids count as training rows; repeated rows count each time; an
    empty table gives none; other columns are ignored. Words never seen in training share half a count in their class."""
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_blocks = max(1, -(-(row.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(n_blocks)).cast("int")
    dealt = row.select("doc_id", "text", (~in_fold(F.col("doc_id"), HELD_OUT)).alias("train"), block.alias("block"))
    own = dealt.groupBy("block").applyInArrow(_block_words, "block int, word long, own long, ending int")
    own = stored(own, "lm-block-words")
    total = stored(own.groupBy("word").agg(F.sum("own").alias("count"), F.min("block").alias("least")), "lm-counts")  # summed before the shuffle
    counted = stored(own.drop("own").join(total, "word").withColumn("lead", F.col("block") == F.col("least")).drop("least"), "lm-words")
    discard(own)
    vocabulary = _vocabulary(counted)
    part = counted.select("block", "word", "count", "ending")
    encoded = dealt.groupBy("block").cogroup(part.groupBy("block")).applyInArrow(_encoder(vocabulary), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, inside double, classes array<short>")
    encoded = stored(encoded, "lm-classes")
    model = _first_model(encoded)
    for _ in range(iterations):
        model = baum_welch(encoded, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 4000):
                s = b.slice(a, 4000)
                total = model.log_likelihood(*_arrays(s)) + s.column("inside").to_numpy()
                yield pa.record_batch([*(s.column(c) for c in ("doc_id", "train", "n_tokens", "n_known", "base_score")), pa.array(total)], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    out = encoded.mapInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see score_texts for null and repeated texts and ids."""
    return score_texts(documents(spark, sf_dir))
