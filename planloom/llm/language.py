"""Language of words and texts by a linear-chain conditional random field.

Each word of a line has a language; the words of a line are a chain. A word's scores are sums of learned
weights of its affixes and inner n-grams (of two to four bytes, hashed) and of the word itself (the
lexicon, hashed); learned transitions link neighbouring words. Forward-backward gives each word's
probability of each language, so text that switches its language inside a line is labelled word by word.

The model is fitted in one task on a bounded sample of labelled rows: about ``SAMPLE_DOCS`` documents of
each language, chosen by the hash of their id, with up to ``SAMPLE_WORDS`` words each, taken in pieces of
``PIECE`` words from all over the text. Training chains are pieces put together, half of them from
different languages, so that transitions between languages are learned too. The model has a fixed size
and is sent to all tasks; every text is then labelled as a whole.

A text's language is that with the largest mean probability over its words with letters, and the mean is
the score. Defined results: ``und`` with score 0 for a null text or one without a letter; with no
labelled rows to learn from all texts are ``und``; of more than ``MOST_LANGUAGES`` languages those with the most
labelled rows are learned (ties by name), and texts in others get one of these; ties go to the first language
in order; each row is judged alone, so repeated rows repeat, and copies of a labelled row are learned once; an
empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import ALNUM_WORDS, slices, span_hashes, word_spans

UNDETERMINED = "und"
SAMPLE_DOCS = 400
SAMPLE_WORDS = 400
PIECE = 20
CHAIN_PIECES = 4
MOST_LANGUAGES = 1_000

GRAMS = (2, 3, 4)
GRAM_BITS = 16
WORD_BITS = 18
EPOCHS = 6
BATCH = 128
RATE = 0.15
DECAY = 1e-6

CHAIN_BYTES = 1 << 22
FEATURE_BYTES = 1 << 19


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


# -- words and features ---------------------------------------------------------------


class Words:
    """Words of some texts: features, letters, and the lines and texts they belong to."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join([b"", *texts, b"\n\n\n"])
        self.data = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.r_[1, 1 + np.cumsum(lengths + 1)]
        self.starts, self.ends, _ = word_spans(self.data, np.array([0, len(self.data)]), ALNUM_WORDS)
        self.text = np.searchsorted(self.offsets, self.starts, side="right") - 1
        breaks = np.cumsum(self.data == 10)
        self.line = breaks[self.starts] if len(self.starts) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per place the n-grams that begin there; a word's places begin one before it."""
        letters = np.where(ALNUM_WORDS[self.data], self.data, 0).astype(np.uint32)
        none = 1 << GRAM_BITS
        found, size = [], len(letters)
        code = letters + np.uint32(1)
        inner = np.ones(size, bool)
        for n in range(2, max(GRAMS) + 1):
            following = np.zeros(size, np.uint32)
            following[: size - n + 1] = letters[n - 1 :]
            if n > 2:
                inner = inner & (middle > 0)
            code = code * np.uint32(0x01000193) + following + np.uint32(1)
            # No blanks but at one end.
            real = inner & ((letters > 0) | (following > 0))
            middle = following
            if n in GRAMS:
                bucket = (code * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - GRAM_BITS)
                found.append(np.where(real, bucket, none).astype(np.int64))
        return self.starts - 1, found

    def lexicon(self) -> np.ndarray:
        return (span_hashes(self.data, self.starts, self.ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)

    def has_letter(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, bool)
        letter = ((self.data >= 97) & (self.data <= 122)) | (self.data >= 128)
        return np.maximum.reduceat(letter, self.starts)

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each line that has words."""
        first = np.flatnonzero(np.r_[True, self.line[1:] != self.line[:-1]]) if len(self) else np.zeros(0, np.int64)
        return first, np.diff(np.r_[first, len(self)])


def emissions(words: Words, model: dict) -> np.ndarray:
    """Scores of each word for each language."""
    if not len(words):
        return np.zeros((0, len(model["languages"])), np.float32)
    begin, grams = words.grams()
    total = model["words"][words.lexicon()]
    for table, found in zip(model["grams"], grams):
        total = total + np.add.reduceat(table[found], begin, axis=0)
    return total


# -- forward and backward ----------------------------------------------------------------


def marginals(scores: np.ndarray, first: np.ndarray, length: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Probabilities of each word's languages; with ``pairs`` also the expected transitions."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    weight = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves)
    alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right").tolist()
    ahead = np.empty_like(weight)
    state = np.exp(start - start.max())[None, :].repeat(len(first), axis=0).astype(weight.dtype)
    for at, n in enumerate(alive):
        rows = first[:n] + at
        state = (state[:n] @ step if at else state) * weight[rows]
        state /= state.sum(axis=1, keepdims=True)
        ahead[rows] = state
    out = np.empty_like(weight)
    expected = np.zeros_like(moves)
    for at in range(len(alive) - 1, -1, -1):
        n = alive[at]
        rows = first[:n] + at
        behind = np.ones((n, weight.shape[1]), weight.dtype)
        if at + 1 < len(alive):
            m = alive[at + 1]
            after = later[:m] * weight[rows[:m] + 1]
            if pairs:
                both = ahead[rows[:m]][:, :, None] * step[None] * after[:, None, :]
                expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            behind[:m] = after @ step.T
        behind /= behind.sum(axis=1, keepdims=True)
        later = behind
        both_ways = ahead[rows] * behind
        out[rows] = both_ways / both_ways.sum(axis=1, keepdims=True)
    return (out, expected) if pairs else out


# -- learning ---------------------------------------------------------------------------


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of ``PIECE`` words from all over each sampled text."""
    for batch in batches:
        rows = []
        for lang, text, key in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.lower().split()
            most = max(SAMPLE_WORDS // PIECE, 1)
            step = max(len(words) / most, PIECE)
            starts = sorted({int(k * step) for k in range(most) if k * step < len(words)})
            rows += [(lang, key, n, " ".join(words[a : a + PIECE])) for n, a in enumerate(starts)]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "key", "n", "piece"])


def fit_chains(chains: list[list[tuple[int, str]]], languages: list[str], seed: int = 1) -> dict:
    """Weights from chains of (language, piece), by likelihood gradients with falling step sizes."""
    k, rng = len(languages), np.random.default_rng(seed)
    model = {
        "languages": languages,
        "grams": [np.zeros(((1 << GRAM_BITS) + 1, k), np.float32) for _ in GRAMS],
        "words": np.zeros((1 << WORD_BITS, k), np.float32),
        "start": np.zeros(k, np.float32),
        "moves": np.zeros((k, k), np.float32),
    }
    squares = {n: [np.full_like(t, 1e-4) for t in (v if n == "grams" else [v])] for n, v in model.items() if n != "languages"}

    def move(name: str, at: int, table: np.ndarray, gradient: np.ndarray) -> None:
        squares[name][at] += gradient * gradient
        table -= RATE * (gradient / np.sqrt(squares[name][at]) + DECAY * table)

    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for a in range(0, len(order), BATCH):
            some = [chains[i] for i in order[a : a + BATCH]]
            words = Words([" ".join(p for _, p in chain).replace("\n", " ").encode() for chain in some])
            if not len(words):
                continue
            # The language of a word is that of the piece its bytes are in.
            cuts = np.cumsum([len(p.encode()) + 1 for chain in some for _, p in chain])
            owner = np.searchsorted(cuts, words.starts - 1, side="right")
            label = np.array([lang for chain in some for lang, _ in chain])[owner]
            first, length = words.chains()
            scores = emissions(words, model)
            found, moved = marginals(scores, first, length, model["start"], model["moves"], pairs=True)
            true = np.eye(k, dtype=np.float32)[label]
            seen = np.zeros((k, k), np.float32)
            linked = np.flatnonzero(words.line[1:] == words.line[:-1])
            np.add.at(seen, (label[linked], label[linked + 1]), 1)
            wrong = (found - true) / len(first)
            begin, grams = words.grams()
            spread = np.repeat(np.arange(len(words)), np.diff(np.r_[begin, len(words.data)]))
            for n, gram in enumerate(grams):
                used = gram[begin[0] :]
                gradient = np.stack([np.bincount(used, wrong[spread, j], (1 << GRAM_BITS) + 1) for j in range(k)], axis=1)
                gradient[-1] = 0
                move("grams", n, model["grams"][n], gradient.astype(np.float32))
            lexicon = words.lexicon()
            gradient = np.stack([np.bincount(lexicon, wrong[:, j], 1 << WORD_BITS) for j in range(k)], axis=1)
            move("words", 0, model["words"], gradient.astype(np.float32))
            move("start", 0, model["start"], wrong[first].sum(axis=0))
            move("moves", 0, model["moves"], (moved - seen) / len(first))
    return model


def _fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted({r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))})
    if rows:
        rng = np.random.default_rng(7)
        languages = sorted({r[0] for r in rows})
        number = {name: n for n, name in enumerate(languages)}
        pieces = [(number[lang], piece) for lang, _, _, piece in rows]
        by_language = [[p for p in pieces if p[0] == n] for n in range(len(languages))]
        chains = []
        for i in rng.permutation(len(pieces)).tolist():
            chain = [pieces[i]]
            while len(chain) < CHAIN_PIECES:
                n = chain[-1][0] if rng.random() < 0.5 else int(rng.integers(len(languages)))
                chain.append(by_language[n][int(rng.integers(len(by_language[n])))])
            chains.append(chain)
        # Half of the chains will do: a piece is in CHAIN_PIECES / 2 of them on average.
        model = fit_chains(chains[:: CHAIN_PIECES // 2], languages)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def learn(docs: DataFrame) -> dict | None:
    """A model from ``doc_id, text, lang``; None where nothing is labelled."""
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return None
    key = F.xxhash64("doc_id", "text")
    draw = F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, min(1.0, SAMPLE_DOCS / n))])
    sample = labelled.filter(draw < share[F.col("lang")]).select("lang", "text", key.alias("key"))
    pieces = sample.mapInArrow(_pieces, "lang string, key long, n int, piece string")
    # Copies of a row have the same pieces; they are combined before the one task.
    fitted = pieces.distinct().repartition(1).mapInArrow(_fit, "model binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else None


# -- labelling --------------------------------------------------------------------------


def label(texts: list[bytes], model: dict) -> tuple[Words, np.ndarray]:
    """The words of some lower-cased texts and their probabilities."""
    words, scores = Words(texts), []
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    for a, b in slices(offsets, FEATURE_BYTES):
        scores.append(emissions(Words(texts[a:b]), model))
    first, length = words.chains()
    return words, marginals(np.concatenate(scores), first, length, model["start"], model["moves"])


def judge(batch: pa.RecordBatch, column: str, model: dict | None, spans: bool = False) -> tuple[list, list, list]:
    """Languages, scores and, if asked for, runs of one language, of the texts of a batch."""
    texts = [(t or "").lower() for t in batch.column(column).to_pylist()]
    names, sure, runs = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if model is None:
        return names, sure, runs
    data = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))]
    for a, b in slices(offsets, CHAIN_BYTES):
        words, found = label(data[a:b], model)
        with_letter = words.has_letter()
        owner = words.text[with_letter]
        n = np.bincount(owner, minlength=b - a)
        total = np.stack([np.bincount(owner, p, b - a) for p in found[with_letter].T.astype(np.float64)], axis=1)
        mean = total / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        for k in np.flatnonzero(n).tolist():
            # Bytes beyond ASCII may be signs; a quick look at the first letters settles most texts.
            if any("a" <= c <= "z" for c in texts[a + k][:64]) or any(map(str.isalpha, texts[a + k])):
                names[a + k] = model["languages"][best[k]]
                sure[a + k] = float(min(mean[k, best[k]], 1.0))
        if spans:
            runs[a:b] = _runs(words, found, b - a, model["languages"])
    return names, sure, runs


def _identify(held, spans: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sure, runs = judge(batch, "text", held.value, spans)
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(sure, pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                columns.append(pa.array(runs, kind))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    return run


def _accept(held, text: str, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sure, _ = judge(batch, text, held.value)
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, sure)], pa.bool_()))

    return run


def _runs(words: Words, found: np.ndarray, texts: int, languages: list[str]) -> list[list[dict]]:
    """Per text, runs of words of one language as byte offsets in the lower-cased text."""
    out: list[list[dict]] = [[] for _ in range(texts)]
    best = found.argmax(axis=1)
    new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (words.text[1:] != words.text[:-1])]) if len(words) else []
    for a, b in zip(new, np.r_[new[1:], len(words)]) if len(words) else ():
        text = int(words.text[a])
        base = int(words.offsets[text])
        out[text].append({"start": int(words.starts[a]) - base, "end": int(words.ends[b - 1]) - base, "lang": languages[best[a]]})
    return out


def identify(docs: DataFrame, model: dict | None, spans: bool = False) -> DataFrame:
    """Per row ``doc_id, lang_pred, score``, and ``spans`` of each language if asked for."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    shape = f"doc_id {kind}, lang_pred string, score double"
    if spans:
        shape += ", spans array<struct<start: long, end: long, lang: string>>"
    return docs.select("doc_id", "text").mapInArrow(_identify(held, spans), shape)


def accept(docs: DataFrame, model: dict | None, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose language is known with a score of ``least`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_accept(held, text, least), docs.schema)
