"""Linear experts over vocabularies of their own, fitted for all folds at once by gradients that are summed over the rows.

Rows are held once, not once a fold: a block of rows of one fold is a sparse matrix of term counts, and what differs from model to
model (which terms it knows, their idf, the rows' lengths) is applied to weights and to sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text
from veriloom.functions.hashing import expit
from veriloom.operators.contracts import ContractError, require
from veriloom.operators.ranking import label_top, position_within, prevalence
from veriloom.session import bound_batches, materialised


#: Of the texts of words: numbers of a row's terms by which words it has, in order; and the texts of such numbers.
Counted = tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], pa.Array]]


@dataclass(frozen=True)
class Terms:
    """Terms of one kind: the words of a text, and what is counted of them."""

    words: Callable[[str], Column]
    of: Callable[[pa.Array], Counted]


def _padded_grams(words: pa.Array) -> Counted:
    """`text.padded_ngrams` of each word, 3 to 5 signs long. A gram's number comes from the number of the gram that is one shorter,
    and its last sign."""
    texts = words.to_pylist()
    joined = " " + "  ".join(texts) + " "
    size = np.array([len(w) + 2 for w in texts], np.int64)
    sign, total = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64), int(size.sum())
    left = np.repeat(np.cumsum(size), size) - np.arange(total)
    number, place, first = np.full((total, 3), -1), [], 0
    for i, n in enumerate((3, 4, 5)):
        at = np.flatnonzero(left >= n)
        shorter = sign[at] << 21 | sign[at + 1] if i == 0 else number[at, i - 1]
        code, known = pd.factorize(shorter << 21 | sign[at + n - 1])
        number[at, i] = code + first
        place.append(np.empty((len(known), 2), np.int64))
        place[i][code] = np.stack([at, at + n], axis=1)
        first += len(known)
    place, count = np.concatenate(place), sum(np.maximum(0, size - n + 1) for n in (3, 4, 5))
    number = number.ravel()[number.ravel() >= 0].astype(np.int32)
    begin = np.cumsum(count) - count

    def numbers(row: np.ndarray) -> np.ndarray:
        n = count[row]
        return number[np.repeat(begin[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    return numbers, lambda found: pa.array([joined[i:j] for i, j in place[found].tolist()], pa.string())


def _words_and_pairs(words: pa.Array) -> Counted:
    """Words, and pairs of words that follow each other."""
    wide = len(words)

    def numbers(row: np.ndarray) -> np.ndarray:
        row = row.astype(np.int64)
        return np.concatenate([row, (row[:-1] + 1) * wide + row[1:]])

    def texts(found: np.ndarray) -> pa.Array:
        second = words.take(pa.array(found % max(wide, 1)))
        joined = pc.binary_join_element_wise(words.take(pa.array(np.maximum(found // max(wide, 1) - 1, 0))), second, " ")
        return pc.if_else(pa.array(found < wide), second, joined)

    return numbers, texts


#: Character 3- to 5-grams of padded words; and words of two characters or more, and pairs of them.
char_terms = Terms(text.spaced_words, _padded_grams)
word_terms = Terms(lambda c: F.filter(text.contract_tokens(c), lambda w: F.length(w) >= 2), _words_and_pairs)


@dataclass(frozen=True)
class Block:
    """Terms of one kind and the vocabulary's bounds."""

    terms: Terms
    most: int
    min_df: int = 2


#: The vocabularies' sizes of the two experts.
B1 = (Block(char_terms, 250_000), Block(word_terms, 120_000))
CHAR = (Block(char_terms, 160_000),)


def train_folds(folds: Sequence[int], forward: int | None = None) -> dict[int, list[int]]:
    """The folds that the model of each fold is fitted on: all others but the forward fold, which is never trained on."""
    forward = max(folds) if forward is None else forward
    return {q: [k for k in folds if k not in (q, forward)] for q in folds}


def _narrow(x: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _wide(data: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{max(1, data.size // max(n, 1))}") if n else np.zeros(0, np.uint8)


def _term_counts(row: np.ndarray, of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(of(row), return_counts=True)


def _matrices(held: DataFrame, blocks: Sequence[Block]) -> DataFrame:
    """Rows (id, fold, label, s, text) as matrices of one fold each: ids, label, s; and for each block of terms the texts of the
    columns (terms), the rows that have them (df), their counts (cf), the rows' sizes (n), and columns (at) and counts (tf) of the
    entries, row by row. Terms are counted inside their rows; nothing is shuffled."""
    bound_batches(held.sparkSession)
    ids = held.schema["id"].dataType.simpleString()
    parts = ", ".join(f"terms{b} array<string>, df{b} array<int>, cf{b} array<long>, n{b} binary, at{b} binary, tf{b} binary" for b in range(len(blocks)))
    of = [block.terms.of for block in blocks]

    def counted(words: pa.ListArray, make: Callable[[pa.Array], Counted]) -> tuple[list[tuple[np.ndarray, np.ndarray]], Callable]:
        coded, first = words.flatten().dictionary_encode(), np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy())])
        numbers, texts = make(coded.dictionary)
        at = coded.indices.to_numpy()
        return [_term_counts(at[a:b], numbers) for a, b in zip(first, first[1:], strict=False)], texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_row, folds = [counted(batch.column(f"w{b}"), make) for b, make in enumerate(of)], batch.column("fold").to_numpy()
            for k in np.unique(folds).tolist():
                mine = np.flatnonzero(folds == k)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                out = [pa.array([k], pa.int32()), *[one(batch.column(c).take(pa.array(mine))) for c in ("id", "label", "s")]]
                for rows, texts in of_row:
                    found = np.concatenate([rows[i][0] for i in mine]).astype(np.int64)
                    tf = np.concatenate([rows[i][1] for i in mine])
                    at, known = pd.factorize(found)
                    df, cf = np.bincount(at, minlength=len(known)), np.bincount(at, tf, len(known))
                    out += [one(texts(known)), one(pa.array(df, pa.int32())), one(pa.array(cf.astype(np.int64)))]
                    out += [pa.array([x], pa.binary()) for x in (_narrow(np.array([len(rows[i][0]) for i in mine])), _narrow(at), _narrow(tf))]
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["fold", "ids", "label", "s", *[f"{c}{b}" for b in range(len(blocks)) for c in ("terms", "df", "cf", "n", "at", "tf")]]
    words = [block.terms.words("text").alias(f"w{b}") for b, block in enumerate(blocks)]
    return held.select("id", "fold", "label", "s", *words).mapInArrow(run, f"fold int, ids array<{ids}>, label array<int>, s array<double>, {parts}")


def _vocabulary(matrices: DataFrame, b: int, block: Block, trained: Mapping[int, Sequence[int]]) -> pa.Table:
    """(term, a column of df for each query fold, null where its vocabulary lacks the term) of one block, in the terms' order.

    A fold's vocabulary ends inside the terms of one count; only those are put in order.
    """
    known = [k for ks in trained.values() for k in ks]
    each = matrices.select("fold", F.explode(F.arrays_zip(F.col(f"terms{b}").alias("term"), F.col(f"df{b}").alias("df"), F.col(f"cf{b}").alias("cf"))).alias("o"))
    sums = {f"{c}_{k}": F.sum(F.when(F.col("fold") == k, F.col(f"o.{c}")).otherwise(0)) for k in sorted(set(known)) for c in ("df", "cf")}
    wide = each.where(F.col("fold").isin(known)).groupBy(F.col("o.term").alias("term")).agg(*[x.alias(c) for c, x in sums.items()])
    of = lambda c, q: reduce(lambda x, y: x + y, (F.col(f"{c}_{k}") for k in trained[q]))
    options = F.array(*[F.struct(F.lit(q).alias("query"), of("df", q).alias("df"), of("cf", q).alias("cf")) for q in trained if trained[q]])
    rows = materialised(wide.select("term", F.filter(options, lambda o: o["df"] >= block.min_df).alias("o")).where(F.size("o") > 0))
    long_ = rows.select("term", F.explode("o").alias("o")).select("term", "o.query", "o.df", "o.cf")
    counts = long_.groupBy("query", "cf").count().toPandas()
    cut, room = {}, {}
    for q, mine in counts.groupby("query"):
        mine = mine.sort_values("cf", ascending=False)
        before = (mine["count"].cumsum() - mine["count"]).to_numpy()
        last = np.flatnonzero(before < block.most)[-1] if block.most else 0
        cut[q], room[q] = int(mine["cf"].iloc[last]), block.most - int(before[last])
    if not cut:
        return pa.table({"term": pa.array([], pa.string()), **{f"df_{q}": pa.array([], pa.int64()) for q in trained}})
    at = lambda held: F.create_map(*[F.lit(int(x)) for q in cut for x in (q, held[q])])[F.col("query")]
    above, level = long_.where(F.col("cf") > at(cut)), long_.where(F.col("cf") == at(cut))
    level = position_within(level, ["query"], ["term"], "place").where(F.col("place") < at(room)).drop("place")
    kept = above.unionByName(level).groupBy("term").agg(*[F.max(F.when(F.col("query") == q, F.col("df"))).alias(f"df_{q}") for q in trained])
    return kept.toArrow().sort_by("term").combine_chunks()


@dataclass(frozen=True)
class Space:
    """The columns of all models: texts by block, where a block begins, and by query fold the columns that it has with their idf
    (0: not in its vocabulary) and the size of each of its vocabularies."""

    terms: list[pa.Array]
    first: list[int]
    at: dict[int, np.ndarray]
    idf: dict[int, np.ndarray]
    sizes: dict[int, list[int]]

    @property
    def size(self) -> int:
        return sum(map(len, self.terms))


def _space(matrices: DataFrame, blocks: Sequence[Block], trained: Mapping[int, Sequence[int]], n: Mapping[int, int]) -> Space:
    """A term's idf is ln((1 + rows) / (1 + df)) + 1 over the query fold's training rows. Vocabularies are held by the driver and sent
    to all tasks, as the weights are; their bounds are the blocks'."""
    tables = [_vocabulary(matrices, b, block, trained) for b, block in enumerate(blocks)]
    df = {q: np.concatenate([np.asarray(t[f"df_{q}"].fill_null(0), np.int64) for t in tables]) for q in trained}
    idf = {q: np.where(d > 0, np.log((1.0 + n[q]) / (1.0 + d)) + 1.0, 0.0) for q, d in df.items()}
    sizes = {q: [t.num_rows - t[f"df_{q}"].null_count for t in tables] for q in trained}
    first = np.cumsum([0, *[t.num_rows for t in tables]])[:-1].tolist()
    texts = [t["term"].combine_chunks() if t.num_rows else pa.array([], pa.string()) for t in tables]
    return Space(texts, first, {q: np.flatnonzero(d) for q, d in df.items()}, idf, sizes)


class _Room:
    """Arrays that are used again, matrix after matrix: to get new ones takes longer than what is done in them."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, n: int, kind: type = np.float64) -> np.ndarray:
        if len(self.held.get(name, ())) < n:
            self.held[name] = np.empty(n * 5 // 4, kind)
        return self.held[name][:n]


@dataclass
class Rows:
    """A matrix of rows of one fold, opened: entries by row and, inside it, by block of terms. A row's value of a term is
    (1 + ln tf) times the idf, of unit length in each block. What is returned is in `room` and holds until the next call."""

    fold: int
    label: np.ndarray
    s: np.ndarray
    n: np.ndarray
    at: np.ndarray
    x: np.ndarray
    room: _Room

    def valued(self, weights: np.ndarray) -> np.ndarray:
        """Each entry times its column's weight."""
        out = np.take(weights, self.at, out=self.room("value", len(self.at)), mode="clip")
        return np.multiply(out, self.x, out=out)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """(rows, blocks) of an entry's values."""
        out = np.zeros(self.n.size)
        held = np.flatnonzero(self.n.ravel())
        if len(held):
            out[held] = np.add.reduceat(values, (np.cumsum(self.n.ravel()) - self.n.ravel())[held])
        return out.reshape(self.n.shape)

    def part(self) -> np.ndarray:
        """Which of the (rows, blocks) an entry is of."""
        out = self.room("part", len(self.at), np.int64)
        out[:] = 0
        first = (np.cumsum(self.n.ravel()) - self.n.ravel())[1:]
        np.add.at(out, first[first < len(out)], 1)
        return np.cumsum(out, out=out)

    def spread(self, values: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Each entry times the value of its (row, block)."""
        out = np.take(values.ravel(), part, out=self.room("value", len(self.at)), mode="clip")
        return np.multiply(out, self.x, out=out)


def _opened(batch: pa.RecordBatch, i: int, blocks: int, room: _Room) -> Rows:
    label, s = (batch.column(c)[i].values.to_numpy() for c in ("label", "s"))
    n = _wide(batch.column("n")[i].as_buffer(), len(label) * blocks).astype(np.int64).reshape(len(label), blocks)
    entries = int(n.sum())
    at, tf = room("at", entries, np.int64), room("tf", entries, np.int64)
    at[:], tf[:] = (_wide(batch.column(c)[i].as_buffer(), entries) for c in ("at", "tf"))
    logs = np.log(np.maximum(1, np.arange(int(tf.max(initial=1)) + 1))) + 1.0
    return Rows(batch.column("fold")[i].as_py(), label, s, n, at, np.take(logs, tf, out=room("x", entries), mode="clip"), room)


def _numbered(matrices: DataFrame, space: Space, blocks: int) -> DataFrame:
    """(fold, ids, label, s, n, at, tf, norms): the matrices with the columns of `space`, without terms that no model knows; norms:
    (query folds, rows, blocks), one over a row's length, 0 where it has no term."""
    sent = matrices.sparkSession.sparkContext.broadcast((space.terms, space.first, space.idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (terms, first, idf), room = sent.value, _Room()
        for batch in batches:
            for i in range(batch.num_rows):
                count = len(batch.column("ids")[i])
                parts = []
                for b in range(blocks):
                    n = _wide(batch.column(f"n{b}")[i].as_buffer(), count).astype(np.int64)
                    a, t = (_wide(batch.column(f"{c}{b}")[i].as_buffer(), int(n.sum())) for c in ("at", "tf"))
                    number = pc.index_in(batch.column(f"terms{b}")[i].values, terms[b]).fill_null(-1).to_numpy()[a]
                    known = number >= 0
                    n = np.bincount(np.repeat(np.arange(count), n)[known], minlength=count)
                    parts.append((n, number[known] + first[b], t[known]))
                n = np.stack([x[0] for x in parts], axis=1)
                begin = (np.cumsum(n.ravel()) - n.ravel()).reshape(n.shape)
                at, tf = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
                for b, (own, a, t) in enumerate(parts):
                    to = np.repeat(begin[:, b] - (np.cumsum(own) - own), own) + np.arange(len(a))
                    at[to], tf[to] = a, t
                rows = Rows(0, np.zeros(count), np.zeros(count), n, at, 1.0 + np.log(tf), room)
                lengths = np.stack([np.sqrt(rows.sums(np.square(rows.valued(v)))) for v in idf.values()])
                norms = np.divide(1.0, lengths, out=np.zeros_like(lengths), where=lengths > 0)
                kept = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in ("fold", "ids", "label", "s")], *[pa.array([x], pa.binary()) for x in (_narrow(n), _narrow(at), _narrow(tf), norms.tobytes())]], names=["fold", "ids", "label", "s", "n", "at", "tf", "norms"])

    ids = matrices.schema["ids"].dataType.simpleString()
    return matrices.mapInArrow(run, f"fold int, ids {ids}, label array<int>, s array<double>, n binary, at binary, tf binary, norms binary")


#: Weights of one chunk of a sum of gradients.
CHUNK = 1 << 14


def _passes(rows: DataFrame, space: Space, trained: Mapping[int, Sequence[int]], blocks: int, c: float, factors: Mapping[int, tuple[float, float]]) -> Callable:
    """evaluate(weights by fold): squared hinge loss and its gradient of each fold, in one pass. Tasks sum up their matrices, chunks of
    those sums are added by key; the weights, whose number the vocabularies bound, are sent to all tasks."""
    spark = rows.sparkSession
    place, size = {q: i for i, q in enumerate(trained)}, space.size

    def added(t: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(p.as_py()) for p in t["part"]))
        return pa.table({"query": t["query"][:1], "chunk": t["chunk"][:1], "loss": [sum(t["loss"].to_pylist())], "part": [total.tobytes()]})

    def evaluate(weights: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        sent = spark.sparkContext.broadcast({q: (_scaled(w, space.at[q], space.idf[q]), w[-1]) for q, w in weights.items()})

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, room, scaled = {}, _Room(), sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    asked = [q for q in scaled if batch.column("fold")[i].as_py() in trained[q]]
                    if not asked:
                        continue
                    held = _opened(batch, i, blocks, room)
                    part = held.part()
                    norms = np.frombuffer(batch.column("norms")[i].as_buffer()).reshape(len(place), *held.n.shape)
                    y = np.where(held.label == 1, 1.0, -1.0)
                    for q in asked:
                        norm, s = norms[place[q]], held.s * np.where(held.label == 1, factors[q][1], factors[q][0])
                        short = np.maximum(0.0, 1 - y * ((held.sums(held.valued(scaled[q][0])) * norm).sum(axis=1) + scaled[q][1]))
                        pull = -2 * c * s * y * short
                        if q not in total:
                            total[q] = [0.0, np.zeros(size + 1)]
                        total[q][0] += c * float((s * short**2).sum())
                        total[q][1][-1] += pull.sum()
                        np.add.at(total[q][1], held.at, held.spread(pull[:, None] * norm, part))
            for q, (loss, gradient) in total.items():
                for k in range(0, len(gradient), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([k], pa.int32()), pa.array([loss if k == 0 else 0.0]), pa.array([gradient[k : k + CHUNK].tobytes()], pa.binary())], names=["query", "chunk", "loss", "part"])

        schema = "query int, chunk int, loss double, part binary"
        found = rows.mapInArrow(partial, schema).groupBy("query", "chunk").applyInArrow(added, schema).toArrow().to_pylist()
        sent.destroy()
        loss, raw = {q: 0.5 * float(w @ w) for q, w in weights.items()}, {q: np.zeros(size + 1) for q in weights}
        for r in found:
            part = np.frombuffer(r["part"])
            loss[r["query"]] += r["loss"]
            raw[r["query"]][r["chunk"] : r["chunk"] + len(part)] = part
        return {q: (loss[q], w + np.append(raw[q][space.at[q]] * space.idf[q][space.at[q]], raw[q][-1])) for q, w in weights.items()}

    return evaluate


def _scaled(w: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of a fold's columns, times their idf, over the columns of all."""
    out = np.zeros(len(idf))
    out[at] = w[:-1] * idf[at]
    return out


class _Descent:
    """Limited-memory BFGS of one fold, with a line search by halves; asks for one evaluation at a time."""

    def __init__(self, size: int, memory: int = 12) -> None:
        self.w, self.loss, self.gradient, self.step, self.pairs, self.memory = np.zeros(size), math.inf, None, 1.0, [], memory
        self.trial, self.direction, self.first = self.w, None, 0.0

    def told(self, loss: float, gradient: np.ndarray, tolerance: float) -> bool:
        """Takes the trial's value and sets the next trial; whether the gradient is small enough to stop."""
        if self.gradient is None:
            self.first = float(np.linalg.norm(gradient))
        elif loss > self.loss + 1e-4 * self.step * float(self.gradient @ self.direction):
            if self.step < 1e-10:
                return True
            self.step /= 2
            self.trial = self.w + self.step * self.direction
            return False
        else:
            s, y = self.trial - self.w, gradient - self.gradient
            if float(s @ y) > 1e-12 * float(s @ s):
                self.pairs = [*self.pairs[1 - self.memory :], (s, y)]
        self.w, self.loss, self.gradient = self.trial, loss, gradient
        if float(np.linalg.norm(gradient)) <= tolerance * max(1e-12, self.first):
            return True
        q, held, room = gradient.copy(), [], np.empty(len(gradient))
        for s, y in reversed(self.pairs):
            a = float(s @ q) / float(s @ y)
            held.append(a)
            q -= np.multiply(y, a, out=room)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y), a in zip(self.pairs, reversed(held), strict=True):
            q += np.multiply(s, a - float(y @ q) / float(s @ y), out=room)
        self.direction, self.step = -q, 1.0
        self.trial = self.w + self.direction
        return False


#: Spark's setting that a query's shuffle files go when it ends: a fit has a shuffle of gradients a pass.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fit(evaluate: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]], sizes: Mapping[int, int], tolerance: float = 1e-4, rounds: int = 500) -> dict[int, np.ndarray]:
    """The weights of each fold, the intercept last, that make 0.5 |w|^2 + c * sum of s * max(0, 1 - y * (w.x + b))^2 least.

    All folds that have not come to an end take part in each pass over the rows. The intercept counts as a weight. A fold stops
    when its gradient is `tolerance` of what it was; not to stop is an error.
    """
    open_, done = {q: _Descent(n + 1) for q, n in sizes.items()}, {}
    for _ in range(rounds):
        if not open_:
            return done
        for q, (loss, gradient) in evaluate({q: d.trial for q, d in open_.items()}).items():
            if open_[q].told(loss, gradient, tolerance):
                done[q] = open_.pop(q).w
    raise ContractError(f"folds {sorted(open_)} have not come to an end after {rounds} passes")


def margins(rows: DataFrame, weights: dict[int, np.ndarray], space: Space, blocks: int) -> DataFrame:
    """(id, fold, label, margin) of rows by the weights of their fold."""
    sent = rows.sparkSession.sparkContext.broadcast(({q: _scaled(w, space.at[q], space.idf[q]) for q, w in weights.items()}, {q: w[-1] for q, w in weights.items()}))
    place, ids = {q: i for i, q in enumerate(space.at)}, rows.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (scaled, intercept), room = sent.value, _Room()
        for batch in batches:
            for i in range(batch.num_rows):
                held = _opened(batch, i, blocks, room)
                q = held.fold
                norm = np.frombuffer(batch.column("norms")[i].as_buffer()).reshape(len(place), *held.n.shape)[place[q]]
                out = (held.sums(held.valued(scaled[q])) * norm).sum(axis=1) + intercept[q]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(np.full(len(out), q), pa.int32()), pa.array(held.label, pa.int32()), pa.array(out)], names=["id", "fold", "label", "margin"])

    return rows.mapInArrow(run, f"id {ids}, fold int, label int, margin double")


def out_of_fold(rows: DataFrame, column: str, blocks: Sequence[Block], weight: Column | None = None, balanced: bool = False, id_: str = "id", fold: str = "fold", label: str = "label", component: str = "component_key", forward: int | None = None, c: float = 1.0, tolerance: float = 1e-4) -> tuple[DataFrame, dict[int, dict[str, Any]]]:
    """(id, fold, label, margin): every row scored by the model of its fold, all models fitted at once; and per fold the number of
    training rows, of positives among them, and the vocabularies' sizes.

    weight: of a row (component weights are the caller's); balanced: times rows / (2 * rows of the class), fold by fold. A null
    text has no terms. An id that repeats or is null, a component in two folds, a fold whose training rows are of one class, and a
    row that is not scored exactly once are errors.
    """
    spark = rows.sparkSession
    held = materialised(rows.select(F.col(id_).alias("id"), F.col(fold).cast("int").alias("fold"), F.col(label).cast("int").alias("label"), F.col(component).alias("component"), F.col(column).alias("text"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("s")))
    require(held, labels_are_0_or_1=F.col("label").isin(0, 1), ids_are_there=F.col("id").isNotNull(), folds_are_there=F.col("fold").isNotNull())
    if held.groupBy("component").agg(F.count_distinct("fold").alias("n")).where("n > 1 and component is not null").limit(1).count():
        raise ContractError("a component lies in two folds")
    of_fold = {r.fold: (r.n, r.p) for r in held.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()}
    folds = sorted(of_fold)
    trained = train_folds(folds, forward)
    counts = {q: tuple(sum(of_fold[k][i] for k in ks) for i in (0, 1)) for q, ks in trained.items()}
    if bad := [q for q in folds if counts[q][1] in (0, counts[q][0])]:
        raise ContractError(f"the training rows of folds {bad} are of one class")
    factors = {q: (n / 2 / (n - p), n / 2 / p) if balanced else (1.0, 1.0) for q, (n, p) in counts.items()}
    matrices = materialised(_matrices(held, blocks))
    space = _space(matrices, blocks, trained, {q: n for q, (n, _) in counts.items()})
    # As many tasks as cores: each has a sum of gradients to pass on, whatever the rows it has read.
    numbered = materialised(_numbered(matrices, space, len(blocks)).coalesce(max(2, spark.sparkContext.defaultParallelism)))
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        weights = fit(_passes(numbered, space, trained, len(blocks), c, factors), {q: len(at) for q, at in space.at.items()}, tolerance)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = materialised(margins(numbered, weights, space, len(blocks)))
    n, ids, asked = out.count(), out.select("id").distinct().count(), held.count()
    if not n == ids == asked:
        raise ContractError(f"{asked} rows, {n} scores of {ids} ids")
    return out, {q: {"rows": n, "positives": p, "terms": space.sizes[q]} for q, (n, p) in counts.items()}


def by_prevalence(scored: DataFrame, shares: Mapping[int, float], tie: str, out: str = "prediction") -> DataFrame:
    """`out`: in each fold the share of rows with the highest margins that is positive among the fold's training rows."""
    parts = []
    for q, share in sorted(shares.items()):
        mine = scored.where(F.col("fold") == q)
        parts.append(label_top(mine, prevalence(mine.count(), share), "margin", tie, out))
    return reduce(DataFrame.unionByName, parts)


def by_sign(scored: DataFrame, out: str = "prediction") -> DataFrame:
    """The margin's sigmoid (score) and whether it is not negative."""
    return scored.withColumns({"score": expit(F.col("margin")), out: (F.col("margin") >= 0).cast("int")})
