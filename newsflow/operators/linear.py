"""Linear text models, trained to convergence.

``reg / 2 * |w|^2 + mean loss`` over unit-norm TF-IDF vectors is minimised by a limited-memory quasi-Newton method that starts from the
diagonal of the curvature.

Up to ``MAX_BROADCAST_BYTES`` of coefficients and ``BROADCAST_ENTRIES`` entries of the training rows, the rows are stored once as sparse blocks, the
coefficients are broadcast, and one pass gives the losses along a direction and the gradient at its end, summed slice by slice before they reach the driver.

Beyond that terms are cut into slices. A slice is one group of rows of a bucketed table in the shared folder: the hashes and idf of its terms,
and their counts in the documents as blocks by range of documents, in term order. What has the terms' size - coefficients, gradient, curvature
and the last ``MEMORY`` steps - lies beside it, a table per step, bucketed alike, so that neither side moves. What has the documents' size - margins, slopes, and the
margins that the stored steps make - is held by the driver. A step is one job: each slice takes the slopes, takes its part of the step, adds
up its gradient, and returns the margins that the gradient makes (divided by the curvature) and dot products of its stored vectors. From these the driver has the next direction, its
margins as a combination of those it knows, and the step's length, without another pass.

The ridge makes the objective strongly convex, so ``|g|^2 / (2 reg)`` bounds what is left to gain: training ends when that is
below ``GAP`` of the objective (``BROADCAST_GAP`` where the coefficients could be broadcast).
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.operators.features import term_counts, tfidf_fit, weigh_terms
from newsflow.operators import lookup
from newsflow.operators.lookup import lookup_join
from newsflow.session import discard, stage, staging_path

DIGITS = 9
SCORE_DIGITS = 6
MEMORY = 5
# What the objective may be above its minimum, and steps after which training gives up.
GAP = 1e-3
MAX_STEPS = 200
# Step lengths that are tried in one pass: a quarter more from one to the next.
LENGTHS = tuple(1.25**i for i in range(-16, 13))
# Where the coefficients are broadcast a step costs little, and rows near a border come out on its right side.
BROADCAST_GAP = 1e-4
# Along the diagonal alone, whose length says little when terms come together, they go down to nearly nothing.
FIRST_LENGTHS = tuple(2.0**-i for i in range(24))
# Bytes of stored steps where the coefficients are broadcast, and steps at most; rows of a sparse block; numbers that are summed up as one slice.
HISTORY_BYTES = 256 << 20
HISTORY = 30
BLOCK_ROWS = 4_096
SLICE = 1 << 16
# Entries (terms of documents, each once) beyond which rows are not placed by document to be stored as blocks.
BROADCAST_ENTRIES = 10_000_000
# Of a slice of terms: bytes of coefficients and entries, at most on average; entries that are worth a slice of their own. Documents of a range.
SLICE_BYTES = 8 << 20
SLICE_ENTRIES = 16_000_000
LEAST_ENTRIES = 500_000
RANGE_ROWS = 8_192

# Margins (rows, outputs) and labels to the loss of each row and its slope by each margin.
Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class LinearModel:
    """``terms`` is the stored ``(term, idf, coefs)``; one coefficient and one bias per output."""

    terms: DataFrame
    bias: list[float]
    objective: float
    gap: float
    steps: int

    def scores(self, df: DataFrame, tokens: Column, id_col: str = "id") -> DataFrame:
        """``(id, scores)`` of every row: one lookup and one sum per document; unseen terms are ignored."""
        known = lookup_join(term_counts(df, tokens, id_col), self.terms, "term").filter(F.col("idf").isNotNull())
        raw = F.col("tf") * F.col("idf")
        outputs = range(len(self.bias))
        sums = known.groupBy(id_col).agg(
            F.sqrt(F.sum(raw * raw)).alias("_norm"), *[F.sum(raw * F.get("coefs", F.lit(k))).alias(f"_s{k}") for k in outputs]
        )
        values = [
            F.round(F.coalesce(F.col(f"_s{k}") / F.col("_norm"), F.lit(0.0)) + F.lit(self.bias[k]), SCORE_DIGITS) for k in outputs
        ]
        return df.select(id_col).join(sums, id_col, "left").select(id_col, F.array(*values).alias("scores"))


# --- losses ----------------------------------------------------------------------


def squared_hinge(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One output; labels 0 and 1."""
    sign = np.where(label == 1, 1.0, -1.0)
    short = np.maximum(0.0, 1.0 - sign * margins[:, 0])
    return short * short, (-2.0 * sign * short)[:, None]


def softmax(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One output per class; labels are 0 .. classes - 1."""
    rows = np.arange(len(label))
    shifted = margins - margins.max(1, keepdims=True)
    raised = np.exp(shifted)
    total = raised.sum(1)
    slope = raised / total[:, None]
    slope[rows, label] -= 1.0
    return np.log(total) - shifted[rows, label], slope


def _lists(values: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    ends = np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values).ravel()))


# --- coefficients that are broadcast -----------------------------------------------------


def _matrix(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries of a sparse block (row, term, weight), its labels and its number of rows."""
    sizes, label = np.frombuffer(block["sizes"], np.int32), np.frombuffer(block["label"], np.int32)
    return np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(block["terms"], np.int32), np.frombuffer(block["weights"]), label, len(sizes)


def _products(row: np.ndarray, term: np.ndarray, weight: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The block times ``values``, whose last line is the bias."""
    return np.stack([np.bincount(row, weight * values[term, k], n) for k in range(values.shape[1])], axis=1) + values[-1]


class _BroadcastFit:
    """One training run whose coefficients, the bias as the last line, are sent to the tasks in each pass."""

    def __init__(self, rows: DataFrame, names: list[str], targets: DataFrame, loss: Loss, outputs: int, reg: float, id_col: str):
        self.spark, self.names, self.loss, self.outputs, self.reg = rows.sparkSession, names, loss, outputs, reg
        self.n = max(targets.count(), 1)
        self.blocks = self._stored(rows, targets, id_col)
        self.point = np.zeros((len(names) + 1, outputs))
        self.ridge = np.full((len(names) + 1, 1), reg)
        self.ridge[-1] = 0.0
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.keep = max(MEMORY, min(HISTORY, HISTORY_BYTES // (2 * self.point.nbytes)))
        nothing = np.zeros_like(self.point)
        (self.mean_loss,), self.gradient = self._pass(nothing, [0.0], 0.0)
        # No margin bends the loss more than by 2 (squared hinge) or 1/2 (softmax).
        self.curvature = 0.5 * self._squares() / self.n + np.maximum(self.ridge, reg)

    def _stored(self, rows: DataFrame, targets: DataFrame, id_col: str) -> DataFrame:
        """Labels and sparse vectors, ``BLOCK_ROWS`` documents a row; one without terms has an empty vector."""
        numbers = self.spark.createDataFrame(pa.table({"term": pa.array(self.names, pa.string()), "_at": pa.array(range(len(self.names)), pa.int32())}))
        found = rows.join(F.broadcast(numbers), "term").groupBy(id_col).agg(F.collect_list(F.struct("_at", "weight")).alias("_entries"))
        sent = targets.join(found, id_col, "left").select("_label", F.col("_entries")["_at"].alias("at"), F.col("_entries")["weight"].alias("weight"))

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            held = pa.Table.from_batches(parts).combine_chunks()
            label, at, weight = (held[c].chunk(0) for c in ("_label", "at", "weight"))
            if label.null_count:
                raise ValueError(f"{label.null_count} rows without a label")
            sizes = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)
            columns = [sizes.astype(np.int32), label.to_numpy().astype(np.int32), at.flatten().to_numpy(), weight.flatten().to_numpy()]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["sizes", "label", "terms", "weights"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = []
            for batch in batches:
                for first in range(0, batch.num_rows, BLOCK_ROWS):
                    parts.append(batch.slice(first, BLOCK_ROWS))
                    if sum(p.num_rows for p in parts) >= BLOCK_ROWS:
                        yield block(parts)
                        parts = []
            if parts:
                yield block(parts)

        return stage(sent.mapInArrow(run, "sizes binary, label binary, terms binary, weights binary"), "linear-blocks")

    def _summed(self, part: Callable[[dict], np.ndarray], size: int) -> np.ndarray:
        """Sum of ``part``, a row of ``size`` numbers, over all blocks: added up in the task, then by slice."""

        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                for block in batch.to_pylist():
                    own = part(block)
                    held = own if held is None else np.add(held, own, out=held)
            for first in range(0, size if held is not None else 0, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([first // SLICE], pa.int32()), pa.array([held[first : first + SLICE].tobytes()], pa.binary())], names=["slice", "v"])

        def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, v in zip(batch["slice"].to_pylist(), batch["v"].to_pylist()):
                    held[at] = held.get(at, 0.0) + np.frombuffer(v)
            for at, v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["slice", "v"])

        form, count = "slice int, v binary", -(-size // SLICE)
        places = min(count, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        total = np.zeros(size)
        for at, v in self.blocks.mapInArrow(tasks, form).repartition(places, "slice").mapInArrow(slices, form).collect():
            own = np.frombuffer(v)
            total[at * SLICE : at * SLICE + len(own)] = own
        return total

    def _squares(self) -> np.ndarray:
        """Sums of the squared entries, of a bias column of ones too."""
        size = len(self.point)

        def part(block: dict) -> np.ndarray:
            _, term, weight, _, n = _matrix(block)
            found = np.bincount(term, weight * weight, size)
            found[-1] = n
            return found

        return self._summed(part, size)[:, None]

    def _pass(self, direction: np.ndarray, lengths: list[float], at: float) -> tuple[np.ndarray, np.ndarray]:
        """Mean losses at some lengths along a direction, and the gradient of the objective at the length ``at``."""
        sent = self.spark.sparkContext.broadcast((self.point, direction))
        loss, (size, outputs) = self.loss, self.point.shape

        def part(block: dict) -> np.ndarray:
            point, along = sent.value
            row, term, weight, label, n = _matrix(block)
            m = _products(row, term, weight, point, n)
            p = _products(row, term, weight, along, n) if along.any() else np.zeros_like(m)
            slope = loss(m + at * p, label)[1]
            sums = np.stack([np.bincount(term, weight * slope[row, k], size) for k in range(outputs)], axis=1)
            sums[-1] = slope.sum(0)
            return np.concatenate([sums.ravel(), [loss(m + t * p, label)[0].sum() for t in lengths]])

        total = self._summed(part, size * outputs + len(lengths)) / self.n
        sent.destroy()
        return total[size * outputs :], total[: size * outputs].reshape(size, outputs) + self.ridge * (self.point + at * direction)

    def _objective(self, mean_loss: float, point: np.ndarray) -> float:
        return float(mean_loss + (self.ridge * point * point).sum() / 2)

    @property
    def objective(self) -> float:
        return self._objective(self.mean_loss, self.point)

    @property
    def gap(self) -> float:
        """What is left to gain at most, as a part of the objective."""
        return float((self.gradient**2).sum() / (2 * self.reg) / max(self.objective, 1e-300))

    def _direction(self) -> np.ndarray:
        """Two-loop recursion from the scaled diagonal."""
        q, alpha = -self.gradient, []
        for s, y in reversed(self.steps):
            alpha.append((s * q).sum() / (s * y).sum())
            q = q - alpha[-1] * y
        scale = 1.0
        if self.steps:
            s, y = self.steps[-1]
            scale = (s * y).sum() / (y * y / self.curvature).sum()
        q = scale * q / self.curvature
        for (s, y), a in zip(self.steps, reversed(alpha)):
            q = q + (a - (y * q).sum() / (s * y).sum()) * s
        return q

    def step(self) -> bool:
        """One step; false if no length along the direction gains anything. The whole direction is taken unless another length gains clearly more."""
        p, lengths = self._direction(), LENGTHS if self.steps else FIRST_LENGTHS
        losses, gradient = self._pass(p, list(lengths), 1.0)
        values = [self._objective(x, self.point + t * p) for t, x in zip(lengths, losses)]
        before, best = self.objective, int(np.argmin(values))
        if not values[best] < before:
            if not self.steps:
                return False
            # Once more without what earlier steps told.
            self.steps = []
            return self.step()
        whole = lengths.index(1.0)
        if before - values[whole] > 0.8 * (before - values[best]):
            best = whole
        else:
            _, gradient = self._pass(p, [], lengths[best])
        moved = lengths[best] * p
        change = gradient - self.gradient
        if (moved * change).sum() > 0:
            self.steps = [*self.steps, (moved, change)][-self.keep :]
        self.point, self.gradient, self.mean_loss = self.point + moved, gradient, float(losses[best])
        return True

    @property
    def bias(self) -> np.ndarray:
        return self.point[-1]

    def coefficients(self) -> DataFrame:
        """``(term, w)``."""
        return self.spark.createDataFrame(pa.table({"term": pa.array(self.names, pa.string()), "w": _lists(self.point[:-1])}))

    def forget(self) -> None:
        """Nothing has a name in the catalogue."""


# --- terms in slices ------------------------------------------------------------------------


PIECE = "slice int, role string, number bigint, a binary, b binary, c binary, d binary"
STORED = PIECE.replace("role", "part string, role", 1)
STATE = "slice int, part string, role string, number bigint, data binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows), fields)] if rows else [pa.array([], f[1]) for f in fields], names=[f[0] for f in fields])


def _small(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _whole(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // max(count, 1) or 1}")


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)


def _counted(flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the number of rows that have each, and these rows with their counts, hash by hash."""
    order = np.lexsort((row, flat))
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])]) if len(flat) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(flat)])
    flat, row = flat[first], row[first]
    terms = _runs(flat)
    return flat[terms], np.diff(np.r_[terms, len(flat)]), row, count


def _pieces(bounds: np.ndarray, ids: list[int], id_col: str, keyed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents ``(id, _label, _hashes)`` to their entries by slice, and to the labels by range.

    ``keyed``: all rows of an id are in one task and make one vector; else a row is a vector of its own. A task cuts its rows into ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, known = TaskContext.get().partitionId() << 20, 0, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if batch["_label"].null_count:
                raise ValueError(f"{batch['_label'].null_count} rows without a label")
            if keyed:
                # Rows without an id have no terms and share no vector.
                at = np.array([known.setdefault((None, len(known)) if x is None else x, len(known)) for x in batch[id_col].to_pylist()])
            else:
                if held and held + n > RANGE_ROWS:
                    number, held = number + 1, 0
                at = held + np.arange(n)
                held += n
            rows = [(ids[number % len(ids)], "targets", number, at.astype(np.int32).tobytes(), batch["_label"].to_numpy().astype(np.int32).tobytes(), None, None)]
            sizes = pc.fill_null(pc.list_value_length(batch["_hashes"]), 0).to_numpy(zero_copy_only=False)
            terms, uses, row, count = _counted(batch["_hashes"].flatten().to_numpy(), np.repeat(np.arange(n), sizes))
            cuts, ends = np.r_[0, np.searchsorted(terms, bounds), len(terms)], np.r_[0, np.cumsum(uses)]
            for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                if lo < hi:
                    own = slice(ends[lo], ends[hi])
                    rows.append((ids[k], "entries", number, terms[lo:hi].tobytes(), _small(uses[lo:hi]), _small(at[row[own]]), _small(count[own])))
            yield _batch(rows, PIECE)

    return run


def _vocabulary(bounds: np.ndarray, ids: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(h, idf)`` by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, idf = batch["h"].to_numpy(), batch["idf"].to_numpy()
            order = np.argsort(h)
            h, idf = h[order], idf[order]
            cuts = np.r_[0, np.searchsorted(h, bounds), len(h)]
            yield _batch([(ids[k], "vocabulary", 0, h[lo:hi].tobytes(), idf[lo:hi].tobytes(), None, None) for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if lo < hi], PIECE)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a slice to its vocabulary and its blocks; sums of squares by document, and labels, in a part of their own."""
    words: dict[int, list] = {}
    entries: dict[tuple[int, int], list] = {}
    for batch in batches:
        for x in batch.to_pylist():
            if x["role"] == "targets":
                yield _batch([(x["slice"], "rows", "targets", x["number"], x["a"], x["b"], None, None)], STORED)
            elif x["role"] == "vocabulary":
                words.setdefault(x["slice"], []).append((np.frombuffer(x["a"], np.int64), np.frombuffer(x["b"])))
            else:
                entries.setdefault((x["slice"], x["number"]), []).append((x["a"], x["b"], x["c"], x["d"]))
    for at, found in words.items():
        h, idf = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(h)
        words[at] = h[order], idf[order]
        yield _batch([(at, "terms", "vocabulary", 0, *(x.tobytes() for x in words[at]), None, None)], STORED)
    for at, number in sorted(entries):
        if at not in words:
            continue
        h, idf = words[at]
        parts = []
        for a, b, c, d in entries.pop((at, number)):
            own = np.frombuffer(a, np.int64)
            uses = _whole(b, len(own))
            place = np.minimum(np.searchsorted(h, own), len(h) - 1)
            # Terms of other rows than those of the idf are not known.
            place = np.repeat(np.where(h[place] == own, place, -1), uses)
            parts.append((place, _whole(c, len(place)), _whole(d, len(place))))
        place, row, count = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(place, kind="stable")
        order = order[np.searchsorted(place[order], 0) :]
        place, row, count = place[order], row[order], count[order]
        if len(place):
            first = _runs(place)
            squares = np.bincount(row, (count * idf[place]) ** 2)
            yield _batch([
                (at, "terms", "block", number, place[first].astype(np.int32).tobytes(), _small(np.diff(np.r_[first, len(place)])), _small(row), _small(count)),
                (at, "rows", "squares", number, squares.tobytes(), None, None, None),
            ], STORED)


def _summed_by_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the numbers in ``data`` by ``number``; a shorter row has zeros at its end."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, data in zip(batch["number"].to_pylist(), batch["data"]):
            own = np.frombuffer(data.as_buffer())
            have = held.get(number)
            if have is None or len(have) < len(own):
                held[number] = np.r_[own if have is None else own + np.r_[have, np.zeros(len(own) - len(have))]]
            else:
                have[: len(own)] += own
    for number, v in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["number", "data"])


class _Slice:
    """What one slice has stored, within a task."""

    def __init__(self, table: pa.Table):
        self.blocks = []
        for x in table.to_batches():
            for role, number, a, b, c, d in zip(*(x[k] for k in ("role", "number", "a", "b", "c", "d"))):
                bytes_ = [None if not v.is_valid else v.as_buffer() for v in (a, b, c, d)]
                if role.as_py() == "vocabulary":
                    self.hashes, self.idf = np.frombuffer(bytes_[0], np.int64), np.frombuffer(bytes_[1])
                else:
                    terms = np.frombuffer(bytes_[0], np.int32)
                    uses = _whole(bytes_[1], len(terms))
                    size = int(uses.sum(dtype=np.int64))
                    self.blocks.append((number.as_py(), terms, uses, _whole(bytes_[2], size), _whole(bytes_[3], size)))

    def pass_(self, slopes: dict[int, np.ndarray], squared: bool = False) -> np.ndarray:
        """Sums over a term's documents of its weight (its square) times the slopes of the range's documents (outputs, documents)."""
        outputs = len(next(iter(slopes.values())))
        total = np.zeros((len(self.idf), outputs))
        for number, terms, uses, row, count in self.blocks:
            first, row, weight = np.cumsum(uses, dtype=np.int64) - uses, row.astype(np.intp), count.astype(float)
            weight = weight * weight if squared else weight
            for k, e in enumerate(slopes[number]):
                total[terms, k] += np.add.reduceat(weight * e[row], first)
        return total * (self.idf * self.idf if squared else self.idf)[:, None]

    def margins(self, values: np.ndarray, sizes: dict[int, int]) -> dict[int, np.ndarray]:
        """Sums over a document's terms of weight times ``values``, by range (outputs, documents)."""
        found: dict[int, np.ndarray] = {}
        values = values * self.idf[:, None]
        for number, terms, uses, row, count in self.blocks:
            row, own = row.astype(np.intp), values[terms]
            have = found.setdefault(number, np.zeros((values.shape[1], sizes[number])))
            for k in range(values.shape[1]):
                have[k] += np.bincount(row, np.repeat(own[:, k], uses) * count, sizes[number])
        return found


class _SlicedFit:
    """One training run with terms in slices. ``tokens`` of rows that share an id make one vector, a row without an id has none."""

    def __init__(self, train: DataFrame, tokens: Column, idf: DataFrame, loss: Loss, outputs: int, reg: float, label: str, id_col: str):
        self.spark, self.idf, self.loss, self.outputs, self.reg = train.sparkSession, idf, loss, outputs, reg
        self.paths: dict[str, str] = {}
        # First and last row of each range in what the driver holds.
        self.places: dict[int, tuple[int, int]] = {}
        self.seed = self._hash_seed()
        words, entries = idf.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
        self.ids = _slice_ids(self.spark, words, entries, outputs)
        self.stored = self._stored(train, tokens, label, id_col)
        self._place_rows()
        self.keep = max(2, min(MEMORY, HISTORY_BYTES // max(1, 2 * 8 * outputs * len(self.scale))))
        self.bias, self.m = np.zeros(outputs), np.zeros((len(self.scale), outputs))
        self.pairs: list[int] = []
        self.steps, self.state = 0, None
        # Bias and margins of the stored steps and of the gradient's changes, the latter divided by the curvature.
        self.s_bias: list[np.ndarray] = []
        self.y_bias: list[np.ndarray] = []
        self.s_margins: list[np.ndarray] = []
        self.y_margins: list[np.ndarray] = []
        # No margin bends the loss more than by 2 (squared hinge) or 1/2 (softmax).
        self.bias_curvature = 0.5 + reg
        self.mean_loss = self._mean_loss(self.m)
        self._take(np.zeros(0), 0.0)

    # --- what is stored once

    def _hash_seed(self) -> int:
        """A seed with which all terms have different hashes."""
        n = self.idf.count()
        for seed in range(16):
            if self.idf.select(self._hash(F.col("term"), seed)).distinct().count() == n:
                return seed
        raise ValueError("terms can't be told apart by their hashes")

    def _hash(self, term: Column, seed: int | None = None) -> Column:
        return F.xxhash64(F.lit(self.seed if seed is None else seed), term)

    def _save(self, df: DataFrame, name: str, compression: str = "snappy") -> str:
        """Write ``df`` into the shared folder, bucketed by slice."""
        table = f"{name}_{uuid.uuid4().hex}"
        self.paths[table] = staging_path(self.spark, name)
        df.write.partitionBy("part").bucketBy(len(self.ids), "slice").option("path", self.paths[table]).option("compression", compression).saveAsTable(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        discard(self.spark, self.paths.pop(table))

    def forget(self) -> None:
        """Remove what was stored."""
        for table in list(self.paths):
            self._drop(table)

    def _stored(self, train: DataFrame, tokens: Column, label: str, id_col: str) -> str:
        n, given, distinct = train.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col)).first()
        hashes = F.transform(F.array_compact(tokens), lambda t: self._hash(t))
        rows = train.select(id_col, F.col(label).cast("int").alias("_label"), F.when(F.col(id_col).isNotNull(), hashes).alias("_hashes"))
        if given != distinct:
            rows = rows.repartition(max(1, -(-n // RANGE_ROWS)), id_col)
        count = len(self.ids)
        bounds = np.array([-(1 << 63) + (k << 64) // count for k in range(1, count)], np.int64)
        pieces = rows.mapInArrow(_pieces(bounds, self.ids, id_col, given != distinct), PIECE)
        words = self.idf.filter(F.col("idf").isNotNull()).select(self._hash(F.col("term")).alias("h"), "idf").mapInArrow(_vocabulary(bounds, self.ids), PIECE)
        return self._save(pieces.unionByName(words).repartition(count, "slice").mapInArrow(_slices, STORED), "linear_slices")

    def _place_rows(self) -> None:
        """Labels, their documents, and the documents' lengths to the driver, range after range."""
        rows = self.spark.table(self.stored).filter("part = 'rows'")
        found: dict[int, list] = {}
        for x in rows.filter("role = 'targets'").select("number", "a", "b").toArrow().to_pylist():
            found.setdefault(x["number"], []).append((np.frombuffer(x["a"], np.int32), np.frombuffer(x["b"], np.int32)))
        self.places = dict.fromkeys(found, (0, 0))
        squares = self._sums(rows.filter("role = 'squares'").select("number", F.col("a").alias("data")))
        owner, label, scale, at = [], [], [], 0
        for number in sorted(found):
            own, labels = (np.concatenate(c) for c in zip(*found[number]))
            norms, size = np.zeros(int(own.max()) + 1), int(own.max()) + 1
            have = squares.get(number, norms)
            norms[: len(have)] = have
            owner.append(own.astype(np.int64) + at)
            label.append(labels)
            scale.append(np.divide(1.0, np.sqrt(norms), out=np.zeros(size), where=norms > 0))
            self.places[number] = (at, at + size)
            at += size
        self.owner, self.label, self.scale = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((owner, np.int64), (label, np.int32), (scale, float)))
        self.n = max(len(self.label), 1)

    def _sums(self, df: DataFrame) -> dict[int, np.ndarray]:
        """Sums of ``(number, data)`` by number, made by tasks."""
        n = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism, len(self.places) + 1)
        summed = df.repartition(n, "number").mapInArrow(_summed_by_number, "number bigint, data binary").toArrow()
        return {number: np.frombuffer(v.as_buffer()) for number, v in zip(summed["number"].to_pylist(), summed["data"])}

    # --- documents

    def _parts(self, m: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for first in range(0, len(self.label), 1 << 18):
            own = slice(first, first + (1 << 18))
            yield own, m[self.owner[own]], self.label[own]

    def _mean_loss(self, m: np.ndarray) -> float:
        return float(sum(self.loss(x, label)[0].sum() for _, x, label in self._parts(m))) / self.n

    def _slopes(self) -> np.ndarray:
        """Of the mean loss by each document's margins."""
        total = np.zeros_like(self.m)
        for own, x, label in self._parts(self.m):
            slope = self.loss(x, label)[1] / self.n
            for k in range(self.outputs):
                total[:, k] += np.bincount(self.owner[own], slope[:, k], len(total))
        return total

    # --- steps

    def _take(self, direction: np.ndarray, length: float) -> None:
        """Take the step in all slices, at whose end the margins are already; learn the gradient there, its margins and all dot products."""
        slopes = self._slopes()
        scaled = np.ascontiguousarray((slopes * self.scale[:, None]).T)
        by_range = {number: scaled[:, lo:hi] for number, (lo, hi) in self.places.items()}
        squared = None if self.state else {number: self.scale[None, lo:hi] ** 2 for number, (lo, hi) in self.places.items()}
        sent = self.spark.sparkContext.broadcast((by_range, squared))
        sizes = {number: hi - lo for number, (lo, hi) in self.places.items()}
        outputs, reg, n, pairs, step = self.outputs, self.reg, self.n, self.pairs, self.steps
        kept = [*pairs, step][-self.keep :] if self.state else []

        def run(stored: pa.Table, state: pa.Table | None) -> pa.Table:
            own, (slopes, squared) = _Slice(stored), sent.value
            have = {}
            if state is not None:
                for role, number, data in zip(*(state[k] for k in ("role", "number", "data"))):
                    kind = np.float32 if role.as_py() in "sy" else float
                    have[role.as_py(), number.as_py()] = np.frombuffer(data.as_buffer(), kind).reshape(-1, outputs if role.as_py() != "d" else 1)
            if state is None:
                w, old = np.zeros((len(own.idf), outputs)), None
                d = 0.5 * own.pass_(squared, True) / n + reg
            else:
                w, old, d = have["w", 0], have["g", 0], have["d", 0]
                m = len(pairs)
                bent = direction[3 * m + 1] * old
                for i, k in enumerate(pairs):
                    bent = bent + direction[2 * m + 1 + i] * have["y", k]
                p = bent / d
                for i, k in enumerate(pairs):
                    p += direction[i] * have["s", k]
                p *= length
                w = w + p
            g = own.pass_(slopes) + reg * w
            if old is not None:
                have["s", step], have["y", step] = p.astype(np.float32), (g - old).astype(np.float32)
            s, y = ([have[role, k] for k in kept] for role in "sy")
            size = 3 * len(kept) + 3
            gram, width = np.zeros((size, size)), max(1, SLICE // outputs)
            for first in range(0, len(w), width):
                at = slice(first, first + width)
                bent = [x[at] / d[at] for x in (*y, g)]
                rows = np.stack([x.astype(float).ravel() for x in (*(x[at] for x in (*s, *y, g)), *bent, w[at])])
                gram += rows @ rows.T
            at = stored["slice"][0].as_py()
            found = [(at, "sums", "gram", -1, gram.tobytes())]
            found += [(at, "sums", "margins", number, x.tobytes()) for number, x in own.margins(g / d, sizes).items()]
            found += [(at, "state", role, 0, x.tobytes()) for role, x in (("w", w), ("g", g), ("d", d))]
            found += [(at, "state", role, k, have[role, k].tobytes()) for role in "sy" for k in kept]
            return pa.Table.from_batches([_batch(found, STATE)])

        left = self.spark.table(self.stored).filter("part = 'terms'").groupBy("slice")
        if self.state:
            right = self.spark.table(self.state).filter("part = 'state'").groupBy("slice")
            after = left.cogroup(right).applyInArrow(lambda a, b: run(a, b), STATE)
        else:
            after = left.applyInArrow(lambda a: run(a, None), STATE)
        before, self.state = self.state, self._save(after, "linear_state", "uncompressed")
        sent.destroy()
        if before:
            self._drop(before)
        sums = self._sums(self.spark.table(self.state).filter("part = 'sums'").select("number", "data"))
        size = 3 * len(kept) + 3
        table = sums.pop(-1, np.zeros(size * size)).reshape(size, size)
        margins = np.zeros((self.outputs, len(self.scale)))
        for number, x in sums.items():
            lo, hi = self.places[number]
            margins[:, lo:hi] = x.reshape(self.outputs, hi - lo)
        margins = margins.T * self.scale[:, None]
        g_bias = slopes.sum(0)
        if kept:
            self.y_bias = [*self.y_bias, g_bias - self.g_bias][-self.keep :]
            self.y_margins = [*self.y_margins, margins - self.g_margins][-self.keep :]
        self.pairs, self.table_gram, self.g_bias, self.g_margins = kept, table, g_bias, margins
        self._forget_pairs([i for i in range(len(kept)) if not self._gram()[i, len(kept) + i] > 0])

    def _forget_pairs(self, gone: list[int]) -> None:
        """Leave stored steps out of all that follows."""
        m = len(self.pairs)
        if gone:
            stay = [i for i in range(m) if i not in gone]
            lines = [*stay, *(m + i for i in stay), 2 * m, *(2 * m + 1 + i for i in stay), 3 * m + 1, 3 * m + 2]
            self.table_gram = self.table_gram[np.ix_(lines, lines)]
            for name in ("pairs", "s_bias", "y_bias", "s_margins", "y_margins"):
                setattr(self, name, [getattr(self, name)[i] for i in stay])

    def _biases(self) -> np.ndarray:
        """Bias parts of the stored steps, the gradient's changes, the gradient, and the latter two divided by the curvature."""
        changes = [*self.y_bias, self.g_bias]
        return np.array([*self.s_bias, *changes, *[x / self.bias_curvature for x in changes]])

    def _gram(self) -> np.ndarray:
        """Dot products of all vectors but the coefficients, the bias included."""
        biases = self._biases()
        return self.table_gram[:-1, :-1] + biases @ biases.T

    @property
    def objective(self) -> float:
        return float(self.mean_loss + self.reg / 2 * self.table_gram[-1, -1])

    @property
    def gap(self) -> float:
        """What is left to gain at most, as a part of the objective."""
        at = 2 * len(self.pairs)
        return float(self._gram()[at, at] / (2 * self.reg) / max(self.objective, 1e-300))

    def _direction(self) -> np.ndarray:
        """Two-loop recursion from the scaled diagonal, on dot products: the direction's coefficients of the vectors of ``_biases``."""
        m, gram = len(self.pairs), self._gram()
        q, alpha, scale = np.zeros(3 * m + 2), np.zeros(m), 1.0
        q[2 * m] = -1.0
        for i in reversed(range(m)):
            alpha[i] = gram[i] @ q / gram[i, m + i]
            q[m + i] -= alpha[i]
        if m:
            scale = gram[m - 1, 2 * m - 1] / gram[2 * m - 1, 3 * m]
        p = np.zeros(3 * m + 2)
        p[2 * m + 1 :] = scale * q[m : 2 * m + 1]
        for i in range(m):
            p[i] += alpha[i] - gram[m + i] @ p / gram[i, m + i]
        return p

    def step(self) -> bool:
        """One step; false if no length along the direction gains anything. The whole direction is taken unless another length gains clearly more."""
        m, d = len(self.pairs), self._direction()
        p_bias = d @ self._biases()
        along = p_bias + d[3 * m + 1] * self.g_margins
        for i in range(m):
            along += d[i] * self.s_margins[i] + d[2 * m + 1 + i] * self.y_margins[i]
        w_norm, w_p, p_norm = self.table_gram[-1, -1], d @ self.table_gram[:-1, -1], d @ self.table_gram[:-1, :-1] @ d
        lengths, losses = LENGTHS if m else FIRST_LENGTHS, {}

        def value(i: int) -> float:
            if i not in losses:
                losses[i] = self._mean_loss(self.m + lengths[i] * along) if 0 <= i < len(lengths) else np.inf
            return losses[i] + self.reg / 2 * (w_norm + 2 * lengths[i] * w_p + lengths[i] ** 2 * p_norm) if 0 <= i < len(lengths) else np.inf

        # The objective is convex, so the best length is found downhill from the whole direction.
        whole = best = lengths.index(1.0)
        while (after := min((best - 1, best + 1), key=value)) != best and value(after) < value(best):
            best = after
        before = self.objective
        if not value(best) < before:
            if not m:
                return False
            # Once more without what earlier steps told.
            self._forget_pairs(list(range(m)))
            return self.step()
        if before - value(whole) > 0.8 * (before - value(best)):
            best = whole
        length = lengths[best]
        self.m, self.bias, self.mean_loss = self.m + length * along, self.bias + length * p_bias, losses[best]
        self.steps += 1
        self.s_bias = [*self.s_bias, length * p_bias][-self.keep :]
        self.s_margins = [*self.s_margins, length * (along - p_bias)][-self.keep :]
        self._take(d, length)
        return True

    def coefficients(self) -> DataFrame:
        """``(term, w)``."""
        outputs = self.outputs

        def run(stored: pa.Table, state: pa.Table) -> pa.Table:
            w = np.frombuffer(state["data"][0].as_buffer()).reshape(-1, outputs)
            return pa.table({"h": pa.array(np.frombuffer(stored["a"][0].as_buffer(), np.int64)), "w": _lists(w)})

        left = self.spark.table(self.stored).filter("part = 'terms' AND role = 'vocabulary'").groupBy("slice")
        right = self.spark.table(self.state).filter("part = 'state' AND role = 'w'").groupBy("slice")
        found = left.cogroup(right).applyInArrow(lambda a, b: run(a, b), "h bigint, w array<double>")
        return self.idf.select("term", self._hash(F.col("term")).alias("h")).join(found, "h").select("term", "w")


def _slice_ids(spark: SparkSession, words: int, entries: int, outputs: int) -> list[int]:
    """A number for each slice, chosen so that each has a bucket of its own."""
    tasks = spark.sparkContext.defaultParallelism
    count = max(-(-8 * outputs * words // SLICE_BYTES), -(-entries // SLICE_ENTRIES), min(tasks, -(-entries // LEAST_ENTRIES)), 1)
    if count > tasks:
        count = -(-count // tasks) * tasks
    tried = spark.range(64 * count).select(F.col("id").cast("int").alias("i")).withColumn("b", F.pmod(F.hash("i"), F.lit(count)))
    return sorted(r["i"] for r in tried.groupBy("b").agg(F.min("i").alias("i")).collect())


def fit_linear(
    train: DataFrame, tokens: Column, outputs: int, loss: Loss, reg: float, label: str = "label", id_col: str = "id",
    idf_rows: DataFrame | None = None, gap: float | None = None, max_steps: int = MAX_STEPS,
) -> LinearModel:
    """Fit on ``(id, label, ...)``; idf from ``idf_rows`` (default: the training rows)."""
    idf = stage(tfidf_fit(train if idf_rows is None else idf_rows, tokens), "idf")
    words, entries = idf.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    few = lookup.stored_bytes(idf) <= lookup.MAX_BROADCAST_BYTES and 8 * outputs * words <= lookup.MAX_BROADCAST_BYTES
    gap = (BROADCAST_GAP if few else GAP) if gap is None else gap
    if few and entries <= BROADCAST_ENTRIES:
        rows = weigh_terms(term_counts(train, tokens, id_col), idf, id_col).select(id_col, "term", "weight")
        targets = train.select(id_col, F.col(label).cast("int").alias("_label"))
        fit = _BroadcastFit(rows, idf.select("term").toArrow()["term"].to_pylist(), targets, loss, outputs, reg, id_col)
    else:
        fit = _SlicedFit(train, tokens, idf, loss, outputs, reg, label, id_col)
    steps = 0
    while fit.gap > gap and steps < max_steps and fit.step():
        steps += 1
    if fit.gap > gap:
        logging.getLogger(__name__).warning("stopped after %d steps with a gap of at most %.3g of the objective", steps, fit.gap)
    # Terms outside the training rows (idf of other rows) have no coefficient.
    nothing = F.array(*[F.lit(0.0)] * outputs)
    rounded = F.transform("w", lambda x: F.round(x, DIGITS))
    terms = idf.select("term", "idf").join(fit.coefficients().select("term", rounded.alias("coefs")), "term", "left")
    stored = stage(terms.select("term", "idf", F.coalesce("coefs", nothing).alias("coefs")), "linear-terms")
    fit.forget()
    return LinearModel(stored, [round(float(b), DIGITS) for b in fit.bias], fit.objective, fit.gap, steps)


def fit_svm(train: DataFrame, tokens: Column, c: float = 1.0, **options) -> LinearModel:
    """Binary linear SVM with squared hinge; the penalty ``C`` becomes a ridge of ``1 / (C n)``. The bias is free."""
    return fit_linear(train, tokens, 1, squared_hinge, 1.0 / (c * max(train.count(), 1)), **options)


def fit_logistic(train: DataFrame, tokens: Column, classes: int, reg: float = 1e-4, **options) -> LinearModel:
    """Multinomial logistic regression; labels are 0 .. classes - 1."""
    return fit_linear(train, tokens, classes, softmax, reg, **options)


def best_output(scores: Column) -> Column:
    """Index of the best output, the first among equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
