"""Log-probabilities of whole texts under a gated recurrent language model, trained here in numpy.

*Counts.* Words of the training documents are counted exactly, with map-side sums, into a table of all
words. The words above a count that at most ``HEAD_WORDS`` reach are sent to all tasks; all others take
part through joins by word.

*Model.* A gated recurrent network reads word by word; the most frequent ``MODEL_WORDS`` words have inputs
of their own, all others share one by the hash of their ending. The output is factored by classes:
the probability of the next word's class, times that of the word within its class. Frequent words are in
classes of ``CLASS_WORDS``, in order of their counts, each with a softmax of its own. The other words
are in ``RARE_CLASSES`` by their ending; within those, probabilities are (count + 1) over the sum of all
counts + 1, plus 1 for unseen words. So the probabilities of all words add up to one.

*Training* covers every training document once, by truncated backpropagation over windows of ``WINDOW``
words. Documents are laid end to end in parallel streams; the state is carried from window to window and
cleared where a document begins, and nowhere else. Each task trains a copy of the model on its documents; the copies are
averaged by their numbers of words, in steps of ``FOLD`` copies. There are ``ROUNDS`` rounds, each with
its own share of the documents, and each starts from the average of the one before.

*Scoring* carries the state through each document from its first word to its end. Words beyond the head
add the logarithm of their count plus one, which a join by word brings.

Defined results: a null text is empty and has the end token alone; a null doc_id counts as the empty
string in the choice of training documents; each row is a document of its own, also where rows repeat;
without training documents every count is 0 and V is 0; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import lowered, slices, stored

HEAD_WORDS = 1 << 18
HEAD_BYTES = 32
MODEL_WORDS = 4096
CLASS_WORDS = 64
RARE_CLASSES = 64
HIDDEN = 32
WINDOW = 24
STREAMS = 128
SCORE_STREAMS = 512
SCORE_WINDOW = 64
SCORE_WORDS = 1 << 13
RATE = 0.08
ROUNDS = (1, 3, 4)
FOLD = 16
FEW_ROWS = 8
MOST_LOGIT = 80
ENDINGS = 1 << 16
COUNTED_WORDS = 1 << 18
ROUND_BYTES = 1 << 23
TRAIN_WORDS = 1 << 20

END = b"\n"  # no word contains it

Arrays = dict[str, np.ndarray]


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % RARE_CLASSES


# -- counts ---------------------------------------------------------------------------------


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    for batch in batches:
        offsets, data = lowered(batch.column("text"))
        for n in range(batch.num_rows):
            seen.update(data[offsets[n] : offsets[n + 1]].split())
            seen[END] += 1
            if len(seen) >= COUNTED_WORDS:
                yield _counted(seen)
                seen = Counter()
    if seen:
        yield _counted(seen)


def _counted(seen: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])


def word_counts(training: DataFrame) -> DataFrame:
    """``word, n`` of all words of the texts; the end of a text counts as a word."""
    return training.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``HEAD_WORDS``, by falling count."""
    step = F.floor(F.log2("n") * 64).cast("int").alias("step")
    short = counts.filter(F.length("word") <= HEAD_BYTES)
    # At most 64 steps for each power of two.
    sizes = sorted(short.groupBy(step).count().collect(), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > HEAD_WORDS:
            break
        least = at
    if least is None:
        return []
    rows = short.filter(step >= least).collect()
    return sorted(((bytes(w), n) for w, n in rows), key=lambda r: (-r[1], r[0]))


def _tables(counts: DataFrame) -> dict:
    """What tasks need of the counts: the head's words, counts and model numbers, and the totals."""
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = _head(counts)
    words = [w for w, _ in head]
    n = np.array([c for _, c in head], np.int64)
    frequent = min(MODEL_WORDS, len(words))
    classes = -(-MODEL_WORDS // CLASS_WORDS)
    number = np.array([k if k < frequent else MODEL_WORDS + rare_class(w) for k, w in enumerate(words)], np.int64)
    # Totals of count + 1 of the rare classes: the head's here, those of all other words by a sum.
    mass = np.ones(RARE_CLASSES)
    np.add.at(mass, number[frequent:] - MODEL_WORDS, n[frequent:] + 1.0)
    least = int(n[-1]) if len(n) else 0
    beyond = counts.filter((F.col("n") < least) | (F.length("word") > HEAD_BYTES)) if least else counts
    for ending, total in beyond.groupBy(_ending()).agg(F.sum(F.col("n") + 1)).collect():
        mass[ending] += total
    share = np.zeros(classes + RARE_CLASSES)
    np.add.at(share, np.arange(frequent) // CLASS_WORDS, n[:frequent])
    share[classes:] = mass
    return {
        "words": words, "counts": n, "number": number, "mass": mass, "share": share,
        "train_tokens": int(totals["n"] or 0), "distinct": int(totals["v"]),
    }


def _ending() -> Column:
    """:func:`rare_class` as a column."""
    return (F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")) % RARE_CLASSES).cast("int")


# -- the model ------------------------------------------------------------------------------


def first_model(tables: dict) -> Arrays:
    """A model that gives each word its unigram probability, with small random weights."""
    rng = np.random.default_rng(3)
    classes = len(tables["share"])
    word_classes = classes - RARE_CLASSES
    frequent = np.zeros(word_classes * CLASS_WORDS)
    some = tables["counts"][:MODEL_WORDS]
    frequent[: len(some)] = some

    def small(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 0.1).astype(np.float32)

    return {
        "input": small(MODEL_WORDS + RARE_CLASSES + 1, 3 * HIDDEN),
        "hidden": small(HIDDEN, 3 * HIDDEN),
        "bias": np.zeros(3 * HIDDEN, np.float32),
        "class": small(classes, HIDDEN) * np.float32(0.1),
        "class_bias": np.log(tables["share"] + 1e-3).astype(np.float32),
        "word": small(word_classes, CLASS_WORDS, HIDDEN) * np.float32(0.1),
        "word_bias": np.log(frequent + 1e-3).astype(np.float32).reshape(word_classes, CLASS_WORDS),
    }


class Trace:
    """What backpropagation needs of a window: gates, what reset scales, and the states before the steps."""

    gates: np.ndarray
    inner: np.ndarray
    before: np.ndarray


def _blocks(hidden: np.ndarray) -> np.ndarray:
    """The weights of keep, reset and the new state apart, so that each is a whole block."""
    return np.ascontiguousarray(hidden.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))


def forward(model: Arrays, tokens: np.ndarray, clear: np.ndarray, state: np.ndarray, trace: Trace | None) -> np.ndarray:
    """States before each token of a window: steps x streams x hidden. ``tokens`` are those read."""
    steps, n = tokens.shape
    hidden = _blocks(model["hidden"])
    kind = hidden.dtype
    # sigmoid(x) is 1 / (1 + exp(-x)), tanh(x) is 1 - 2 / (1 + exp(2 x)).
    scale = np.array([-1, -1, 2], kind)[:, None, None]
    hidden *= scale
    x = model["input"].take(tokens, axis=0)
    x += model["bias"]
    gates = np.empty((steps, 3, n, HIDDEN), kind)
    np.multiply(x.reshape(steps, n, 3, HIDDEN).transpose(0, 2, 1, 3), scale, out=gates)
    out, y, part = np.empty((steps, n, HIDDEN), kind), np.empty((3, n, HIDDEN), kind), np.empty((n, HIDDEN), kind)
    inner = np.empty((steps, n, HIDDEN), kind) if trace is not None else None
    first, cleared, one, two = state, clear.any(axis=1).tolist(), kind.type(1), kind.type(2)
    recur, bent, both, news = y[2], y[:2], gates[:, :2], gates[:, 2]
    with np.errstate(over="ignore"):
        for t in range(steps):
            if cleared[t]:
                state = state * ~clear[t][:, None]
            np.matmul(state, hidden, out=y)
            gate, new = both[t], news[t]
            gate += bent
            np.exp(gate, out=gate)
            gate += one
            np.divide(one, gate, out=gate)
            if inner is not None:
                inner[t] = recur
            recur *= gate[1]
            new += recur
            np.exp(new, out=new)
            new += one
            np.divide(two, new, out=new)
            np.subtract(one, new, out=new)
            np.subtract(state, new, out=part)
            part *= gate[0]
            state = np.add(part, new, out=out[t])
    if trace is not None:
        inner *= kind.type(0.5)
        trace.gates, trace.inner = gates, inner
        trace.before = np.empty_like(out)
        trace.before[0], trace.before[1:] = first, out[:-1]
        trace.before[clear] = 0
    return out


def backward(model: Arrays, tokens: np.ndarray, clear: np.ndarray, trace: Trace, slope: np.ndarray) -> Arrays:
    """Gradients of the recurrent part from the slopes of the states."""
    steps, n = tokens.shape
    back = np.ascontiguousarray(_blocks(model["hidden"]).transpose(0, 2, 1))
    keep, reset, new = (trace.gates[:, k] for k in range(3))
    # All factors of a step but the slope of its state, which the steps after it make.
    factors, fresh = np.empty_like(trace.gates), 1 - keep
    np.subtract(trace.before, new, out=factors[:, 0])
    factors[:, 0] *= keep
    factors[:, 0] *= fresh
    fresh *= 1 - new * new
    np.multiply(fresh, reset, out=factors[:, 2])
    np.multiply(factors[:, 2], trace.inner, out=factors[:, 1])
    factors[:, 1] *= 1 - reset
    slope, cleared = slope.astype(keep.dtype), clear.any(axis=1).tolist()
    carried, parts = np.zeros_like(slope[0]), np.empty_like(factors[0])
    for t in range(steps - 1, -1, -1):
        total, step = slope[t], factors[t]
        total += carried
        step *= total
        np.matmul(step, back, out=parts)
        np.multiply(total, keep[t], out=carried)
        carried += parts[0]
        carried += parts[1]
        carried += parts[2]
        if cleared[t]:
            carried *= ~clear[t][:, None]
    inputs = np.empty((steps, n, 3, HIDDEN), keep.dtype)
    inputs[...] = factors.transpose(0, 2, 1, 3)
    rows = inputs.reshape(-1, 3 * HIDDEN)
    hidden = trace.before.reshape(-1, HIDDEN).T @ rows
    np.multiply(slope, fresh, out=inputs[:, :, 2])
    return {"hidden": hidden, "input": rows, "bias": rows.sum(axis=0)}


def _softmax(logits: np.ndarray, targets: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the targets, and the slopes of their losses in place of the logits."""
    at = np.arange(len(targets)) * logits.shape[1] + targets
    flat = logits.reshape(-1)
    # Within these bounds no exponential and no sum of them leaves the range of its type.
    if len(flat) and not (flat.max() < MOST_LOGIT and flat.min() > -MOST_LOGIT):
        logits -= logits.max(axis=1, keepdims=True)
    found = flat[at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    if learn:
        logits *= (1 / total)[:, None]
        flat[at] -= 1
    return found - np.log(total), logits


def _joined(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with their bias as a last column, for states with a last column of ones."""
    out = np.empty((*bias.shape, HIDDEN + 1), weights.dtype)
    out[..., :-1], out[..., -1] = weights, bias
    return out


def outputs(model: Arrays, states: np.ndarray, targets: np.ndarray, learn: bool):
    """Log-probabilities of the targets without the rare classes' own part; gradients if asked for."""
    word_classes = len(model["word"])
    owner = np.where(targets < MODEL_WORDS, targets // CLASS_WORDS, targets - MODEL_WORDS + word_classes)
    states = _joined(states, np.ones(len(states), states.dtype))
    found, wrong = _softmax(states @ _joined(model["class"], model["class_bias"]).T, owner, learn)
    found = found.astype(np.float64)
    # States side by side by class, so that each class is a slice.
    order = np.argsort(owner.astype(np.uint16), kind="stable")
    sizes = np.bincount(owner, minlength=word_classes)[:word_classes]
    order = order[: sizes.sum()]
    near, met = states[order], np.flatnonzero(sizes)
    ends = np.cumsum(sizes[met]).tolist()
    own = [slice(a, b) for a, b in zip([0, *ends], ends)]
    word = _joined(model["word"][met], model["word_bias"][met])
    logits = np.empty((len(order), CLASS_WORDS), near.dtype)
    for rows, weights in zip(own, word):
        np.matmul(near[rows], weights.T, out=logits[rows])
    logs, inner = _softmax(logits, targets[order] % CLASS_WORDS, learn)
    found[order] += logs
    if not learn:
        return found
    slope = wrong @ model["class"]
    classes, words = wrong.T @ states, np.empty_like(word)
    back = np.empty_like(near)
    for k, rows in enumerate(own):
        part = inner[rows]
        np.matmul(part, word[k], out=back[rows])
        np.matmul(part.T, near[rows], out=words[k])
    slope[order] += back[:, :-1]
    grads = {"class": classes[:, :-1], "class_bias": classes[:, -1]}
    grads |= {"word": np.zeros_like(model["word"]), "word_bias": np.zeros_like(model["word_bias"])}
    grads["word"][met], grads["word_bias"][met] = words[..., :-1], words[..., -1]
    return found, slope, grads


def sum_by(numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers and the sums of their rows."""
    order = np.argsort(numbers.astype(np.uint16), kind="stable")
    ordered = numbers[order]
    first = np.flatnonzero(np.r_[True, np.diff(ordered) > 0])
    sizes = np.diff(np.r_[first, len(ordered)])
    sums = rows[order[first]]
    # Numbers of few rows take these turn by turn, all others at once.
    few = np.flatnonzero((sizes > 1) & (sizes <= FEW_ROWS))
    for turn in range(1, FEW_ROWS):
        few = few[sizes[few] > turn]
        if not len(few):
            break
        sums[few] += rows[order[first[few] + turn]]
    for k in np.flatnonzero(sizes > FEW_ROWS).tolist():
        np.add.reduce(rows[order[first[k] : first[k] + sizes[k]]], axis=0, out=sums[k])
    return ordered[first], sums


# -- streams of documents -----------------------------------------------------------------------


def lay_out(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stream and first place of each document, and the streams' lengths, longest first."""
    streams = max(1, min(most, len(lengths), int(lengths.sum()) // (4 * WINDOW) + 1))
    loads = [(0, s) for s in range(streams)]
    stream, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for n in np.argsort(-lengths, kind="stable").tolist():
        load, s = heapq.heappop(loads)
        stream[n], place[n] = s, load
        heapq.heappush(loads, (load + int(lengths[n]), s))
    total = np.zeros(streams, np.int64)
    for load, s in loads:
        total[s] = load
    rank = np.argsort(-total, kind="stable")
    back = np.empty_like(rank)
    back[rank] = np.arange(streams)
    return back[stream], place, total[rank]


class Streams:
    """Documents' numbers laid end to end: what is read, what follows, and where states are cleared.

    The streams lie one after the other, so that a long document takes the memory of its own words only.
    """

    def __init__(self, documents: list[np.ndarray], most: int):
        self.lengths = np.fromiter(map(len, documents), np.int64, len(documents))
        stream, place, self.total = lay_out(self.lengths, most)
        self.first = np.cumsum(self.total) - self.total
        owner = np.repeat(np.arange(len(documents), dtype=np.int32), self.lengths)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        flat = np.concatenate(documents) if documents else np.zeros(0, np.int64)
        at = (self.first[stream] + place)[owner] + step
        self.target, self.read, self.owner = (np.empty(len(flat), np.int32) for _ in range(3))
        self.clear = np.empty(len(flat), bool)
        self.target[at] = flat
        self.read[at] = np.where(step > 0, np.roll(flat, 1), MODEL_WORDS + RARE_CLASSES)
        self.clear[at] = step == 0
        self.owner[at] = owner

    def windows(self, steps: int, words: int | None = None) -> Iterator[tuple]:
        """Windows of ``steps`` steps, or fewer where ``words`` words are reached."""
        longest, falling, t = int(self.total[0]), -self.total, 0
        while t < longest:
            n = int(np.searchsorted(falling, -t, side="left"))
            end = min(t + (steps if words is None else min(steps, max(1, words // n))), longest)
            step = np.arange(t, end)[:, None]
            at = self.first[:n] + step
            if end <= self.total[n - 1]:
                yield n, self.read[at], self.clear[at], self.target[at], self.owner[at]
            else:
                real = step < self.total[:n]
                at[~real] = 0
                read = np.where(real, self.read[at], MODEL_WORDS + RARE_CLASSES)
                yield n, read, self.clear[at] & real, np.where(real, self.target[at], -1), np.where(real, self.owner[at], -1)
            t = end


def score_documents(model: Arrays, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each document."""
    total = np.zeros(len(documents))
    streams = Streams(documents, SCORE_STREAMS)
    state = np.zeros((len(streams.total), HIDDEN), np.float32)
    for n, read, clear, target, owner in streams.windows(SCORE_WINDOW, SCORE_WORDS):
        states = forward(model, read, clear, state[:n], None)
        state = states[-1]
        real = target >= 0
        logs = outputs(model, *_chosen(real, states, target), False)
        total += np.bincount(owner[real], logs, len(documents))
    return total


def _chosen(real: np.ndarray, states: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if real.all():
        return states.reshape(-1, HIDDEN), target.ravel()
    return states[real], target[real]


class Trainer:
    """A copy of the model with the sums of squares that scale its steps."""

    def __init__(self, model: Arrays, squares: Arrays):
        self.model = {k: v.copy() for k, v in model.items()}
        self.squares = {k: v.copy() for k, v in squares.items()}
        self.tokens = 0

    def _move(self, name: str, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        squares, model = self.squares[name], self.model[name]
        step = gradient * gradient
        if rows is None:
            squares += step
            np.sqrt(squares, out=step)
        else:
            step += squares[rows]
            squares[rows] = step
            np.sqrt(step, out=step)
        gradient *= np.float32(RATE)
        np.divide(gradient, step, out=step)
        if rows is None:
            model -= step
        else:
            model[rows] -= step

    def learn(self, documents: list[np.ndarray]) -> None:
        streams = Streams(documents, STREAMS)
        state = np.zeros((len(streams.total), HIDDEN), np.float32)
        for n, read, clear, target, _ in streams.windows(WINDOW):
            trace = Trace()
            states = forward(self.model, read, clear, state[:n], trace)
            state = states[-1]
            real = target >= 0
            near, following = _chosen(real, states, target)
            words = len(following)
            self.tokens += words
            _, own, grads = outputs(self.model, near, following, True)
            if words == real.size:
                slope = own.reshape(states.shape)
            else:
                slope = np.zeros_like(states)
                slope[real] = own
            grads |= backward(self.model, read, clear, trace, slope)
            scale = np.float32(1 / max(words, 1))
            numbers, sums = sum_by(read.ravel(), grads.pop("input"))
            sums *= scale
            self._move("input", sums, numbers)
            # A class without words has no gradient, which makes no step.
            met = np.flatnonzero(np.bincount(following[following < MODEL_WORDS] // CLASS_WORDS))
            for name in ("word", "word_bias"):
                self._move(name, grads.pop(name)[met] * scale, met)
            for name, gradient in grads.items():
                self._move(name, gradient * scale)


# -- tasks -----------------------------------------------------------------------------------------


class Numbers:
    """Model numbers and counts of words; words beyond the head are kept apart."""

    def __init__(self, tables: dict):
        self.at = {w: n for n, w in enumerate(tables["words"])}
        self.end = self.at.get(END, -1)
        self.log_mass = np.log10(tables["mass"])
        # A last entry for the words beyond the head, whose place is -1.
        number, logs = tables["number"], np.log10(tables["counts"] + 1.0)
        self.number = np.append(number, 0).astype(np.int32)
        self.logs = np.append(logs, 0.0)
        rare = number >= MODEL_WORDS
        self.inner = np.zeros(len(self.logs))
        self.inner[:-1][rare] = logs[rare] - self.log_mass[number[rare] - MODEL_WORDS]

    def places(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places in the head with the end at last, where words beyond it are, and these words."""
        found = chain(map(self.at.get, words, repeat(-1)), (self.end,))
        place = np.fromiter(found, np.int32, len(words) + 1)
        missing = (place < 0).nonzero()[0]
        return place, missing, [words[n] if n < len(words) else END for n in missing.tolist()]

    def numbers(self, place: np.ndarray, missing: np.ndarray, beyond: list[bytes]) -> np.ndarray:
        """The model's numbers of words."""
        out = self.number[place]
        if beyond:
            out[missing] = [MODEL_WORDS + rare_class(w) for w in beyond]
        return out


class Inputs:
    """Model numbers alone, for which the words with inputs of their own and endings are enough."""

    def __init__(self, tables: dict):
        self.at = dict(zip(tables["words"][:MODEL_WORDS], tables["number"][:MODEL_WORDS].tolist()))
        self.rare = lru_cache(ENDINGS)(rare_class)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        words.append(END)
        out = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
        missing = (out < 0).nonzero()[0].tolist()
        if missing:
            out[missing] = [MODEL_WORDS + self.rare(words[n][-3:]) for n in missing]
        return out


def _train(held, turn: int):
    low, high = sum(ROUNDS[:turn]), sum(ROUNDS[: turn + 1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, model, squares = held.value
        inputs, trainer = Inputs(tables), Trainer(model, squares)
        waiting, words = [], 0
        for batch in batches:
            offsets, data = lowered(batch.column("text"))
            for n in range(batch.num_rows):
                text = data[offsets[n] : offsets[n + 1]]
                # The checksum is that of a whole text, so a text has the same turn everywhere.
                if not low <= zlib.crc32(text) % sum(ROUNDS) < high:
                    continue
                document = inputs.numbers(text.split())
                waiting.append(document)
                words += len(document)
                if words >= TRAIN_WORDS:
                    trainer.learn(waiting)
                    waiting, words = [], 0
        if waiting:
            trainer.learn(waiting)
        if trainer.tokens:
            weight = float(trainer.tokens)
            sums = [{k: v * np.float32(weight) for k, v in x.items()} for x in (trainer.model, trainer.squares)]
            yield _packed(weight, sums)

    return run


def _packed(weight: float, sums: list[Arrays]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([pickle.dumps(sums)], pa.binary())], ["weight", "sums"])


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the weighted copies that a task gets, one after the other."""
    weight, total = 0.0, None
    for batch in batches:
        for more, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums = pickle.loads(packed.as_py())
            weight += more
            total = sums if total is None else [{k: x[k] + y[k] for k in x} for x, y in zip(total, sums)]
    if total is not None:
        yield _packed(weight, total)


def train(training: DataFrame, tables: dict) -> Arrays:
    """The model after all rounds."""
    context = training.sparkSession.sparkContext
    model = first_model(tables)
    frequent = {k: tables[k][:MODEL_WORDS] for k in ("words", "number")}
    squares = {k: np.full_like(v, 1e-6) for k, v in model.items()}
    texts = training.select("text")
    parts = texts.rdd.getNumPartitions()
    for turn in range(len(ROUNDS)):
        held = context.broadcast((frequent, model, squares))
        copies = texts.mapInArrow(_train(held, turn), "weight double, sums binary")
        left = parts
        while left > 1:
            left = -(-left // FOLD)
            copies = copies.repartition(left).mapInArrow(_fold, "weight double, sums binary")
        for weight, packed in copies.collect():
            model, squares = ({k: v / np.float32(weight) for k, v in x.items()} for x in pickle.loads(packed))
        held.unpersist()
    return model


def _score(held):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, model = held.value
        numbers = Numbers(tables)
        for batch in batches:
            offsets, data = lowered(batch.column("text"))
            out = []
            for a, b in slices(offsets, ROUND_BYTES):
                documents, known = [], []
                for n in range(a, b):
                    place, missing, beyond = numbers.places(data[offsets[n] : offsets[n + 1]].split())
                    document = numbers.numbers(place, missing, beyond)
                    documents.append(document)
                    # Counts of rare words in the head; those beyond it come from a join.
                    inner = numbers.inner[place].sum() - numbers.log_mass[document[missing] - MODEL_WORDS].sum()
                    known.append((len(document), len(document) - len(beyond), float(numbers.logs[place].sum()), float(inner), beyond))
                scores = score_documents(model, documents) / np.log(10)
                out += [(*k[:4], s + k[3], k[4]) for k, s in zip(known, scores.tolist())]
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())]
            columns = [columns[0], columns[1], columns[2], columns[4], columns[5]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_tokens", "n_head", "base", "score", "beyond"],
            )

    return run


def score(docs: DataFrame, learn_from: Column) -> DataFrame:
    """Per row ``doc_id, n_tokens, n_known, train_tokens, base_score, score`` in log10.

    ``learn_from`` tells which rows of ``docs`` counts and model are made of.
    """
    training = docs.filter(learn_from).select("text")
    counts = stored(word_counts(training))
    tables = _tables(counts)
    model = train(training, tables)
    held = docs.sparkSession.sparkContext.broadcast((tables, model))
    shape = "doc_id long, n_tokens long, n_head long, base double, score double, beyond array<binary>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(texts.mapInArrow(_score(held), shape).withColumn("row", F.monotonically_increasing_id()))

    beyond = rows.select("row", F.explode("beyond").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    found = beyond.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs")
    )
    logs = F.coalesce("logs", F.lit(0.0))
    norm = float(np.log10(tables["train_tokens"] + tables["distinct"] + 1))
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tables["train_tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
