"""Language identification, language model and secret scan."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import groupby, product
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty, rows, words
from pyspark.sql import functions as F

from planloom.llm import language, language_model, secrets_scan
from planloom.llm.common import table


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return language.learn(table(spark, sf_dir))


def test_languages_of_held_out_documents(spark, sf_dir, model):
    docs = table(spark, sf_dir)
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.filter(language.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_languages_inside_a_text_and_odd_texts(spark, model):
    mixed = "The ththtion and onlyhe by for ofthhaanou Den dem beber der für ch ber einlichst pfer un pour la leviou les"
    docs = spark.createDataFrame([(1, mixed), (2, None), (3, "123 —"), (4, ""), (5, mixed)], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(docs, model, spans=True).collect()}
    assert [s.lang for s in found[1].spans] == ["en", "de", "fr"]
    assert found[1].spans == found[5].spans and mixed[found[1].spans[1].start :].startswith("Den")
    assert all(found[n].lang_pred == "und" and found[n].score == 0 for n in (2, 3, 4))
    assert language.identify(empty(spark), model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    odd = documents(spark, 1, True)
    kept = language.accept(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() - odd.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).count()


def test_learning_without_labels(spark):
    assert language.learn(documents(spark).withColumn("lang", F.lit(None).cast("string"))) is None
    assert language.learn(empty(spark)) is None


def test_more_languages_than_the_model_holds(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(n, f"{kind * 3} {kind}", lang) for lang, kind, copies in (("a", "ba", 30), ("b", "du", 20), ("c", "ki", 20), ("d", "lo", 5)) for n in range(copies)]
    learned = language.learn(spark.createDataFrame([(n, t, lang) for n, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string"))
    assert learned["languages"] == ["a", "b"]


def test_copies_of_a_labelled_row_are_learned_once(spark):
    one = [(None, "the same text again", "en"), (3, "und noch ein text", "de")]
    schema = "doc_id long, text string, lang string"
    once, often = (language.learn(spark.createDataFrame(some, schema).repartition(4)) for some in (one, one * 40))
    assert np.array_equal(once["words"], often["words"]) and np.array_equal(once["moves"], often["moves"])


@pytest.mark.parametrize("seed", range(4))
def test_scores_of_texts_equal_enumeration(seed):
    """Mean probabilities over all label sequences of each line, on a tiny random model."""
    rng = np.random.default_rng(seed)
    names = ["de", "en", "fr"]
    small = {
        "languages": names,
        "grams": [rng.normal(0, 0.7, ((1 << language.GRAM_BITS) + 1, 3)).astype(np.float32) for _ in language.GRAMS],
        "words": rng.normal(0, 0.7, (1 << language.WORD_BITS, 3)).astype(np.float32),
        "start": rng.normal(0, 1, 3).astype(np.float32),
        "moves": rng.normal(0, 1, (3, 3)).astype(np.float32),
    }
    for grams in small["grams"]:
        grams[-1] = 0
    texts = ["Une maison the house\n42 ein Haus", "a", "1 2", "x y z\n\nw", "the the the"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got_names, got_scores, _ = language.judge(batch, "text", small)
    for text, name, score in zip(texts, got_names, got_scores):
        mean, n = np.zeros(3), 0
        for line in text.lower().split("\n"):
            found = language.Words([line.encode()])
            if not len(found):
                continue
            scores = language.emissions(found, small).astype(np.float64)
            total, each = 0.0, np.zeros((len(found), 3))
            for labels in product(range(3), repeat=len(found)):
                value = small["start"][labels[0]] + sum(scores[k, j] for k, j in enumerate(labels)) + sum(small["moves"][a, b] for a, b in zip(labels, labels[1:]))
                value = math.exp(value)
                total += value
                for k, j in enumerate(labels):
                    each[k, j] += value
            letters = found.has_letter()
            mean += (each / total)[letters].sum(axis=0)
            n += letters.sum()
        if n:
            assert name == names[int(np.argmax(mean))] and score == pytest.approx(mean.max() / n, abs=1e-4)
        else:
            assert (name, score) == ("und", 0.0)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    scores, moves, start = rng.standard_normal((7, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    first, length = np.array([0, 2]), np.array([2, 5])
    found, pairs = language.marginals(scores, first, length, start, moves, pairs=True)
    want, moved = np.zeros((7, 3)), np.zeros((3, 3))
    for a, n in zip(first, length):
        paths = {}
        for code in range(3**n):
            path = [code // 3**k % 3 for k in range(n)]
            paths[tuple(path)] = math.exp(start[path[0]] + sum(scores[a + k, s] for k, s in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
        total = sum(paths.values())
        for path, weight in paths.items():
            for k, s in enumerate(path):
                want[a + k, s] += weight / total
            for x, y in zip(path, path[1:]):
                moved[x, y] += weight / total
    assert np.allclose(found, want) and np.allclose(pairs, moved)


def base_brute(docs, held):
    tokens = [(i, [*words(t), "\n"]) for i, t in docs]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def scored(docs):
    out = language_model.held_out(F.col("doc_id"))
    return language_model.score(docs, ~out).withColumn("held_out", out).collect()


def test_base_scores_and_words_beyond_the_head(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD_WORDS", 60)
    monkeypatch.setattr(language_model, "MODEL_WORDS", 32)
    monkeypatch.setattr(language_model, "CLASS_WORDS", 8)
    docs = documents(spark, 1, True)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored(docs)), key=repr)
    want = [(*r[:5], round(r[5], 6)) for r in base_brute([r[:2] for r in rows(1, True)], held)]
    assert got == sorted(want, key=repr)


def test_model_scores_of_nothing_learned_and_no_rows(spark):
    docs = documents(spark, 1, True)
    found = language_model.score(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in found)
    assert language_model.score(empty(spark), F.lit(True)).count() == 0


def test_model_beats_the_unigram_on_held_out_documents(spark, sf_dir):
    docs = table(spark, sf_dir)
    found = [r for r in scored(docs) if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def tables(rng):
    counts = np.sort(rng.integers(1, 50, 70))[::-1]
    words_ = [b"w%d" % n for n in range(69)] + [language_model.END]
    number = np.array([n if n < 32 else 32 + language_model.rare_class(w) for n, w in enumerate(words_)])
    mass = np.ones(language_model.RARE_CLASSES)
    np.add.at(mass, number[32:] - 32, counts[32:] + 1.0)
    share = np.r_[[counts[k : k + 8].sum() for k in range(0, 32, 8)], mass]
    return {"words": words_, "counts": counts, "number": number, "mass": mass, "share": share}


def test_probabilities_add_up_and_gradients_are_right(monkeypatch):
    monkeypatch.setattr(language_model, "MODEL_WORDS", 32)
    monkeypatch.setattr(language_model, "CLASS_WORDS", 8)
    rng = np.random.default_rng(4)
    table_ = tables(rng)
    start = {k: v.astype(np.float64) for k, v in language_model.first_model(table_).items()}
    start["word"] += rng.standard_normal(start["word"].shape) * 0.3
    state = rng.standard_normal((1, language_model.HIDDEN))
    logs = language_model.outputs(start, state.repeat(32 + language_model.RARE_CLASSES, 0), np.arange(32 + language_model.RARE_CLASSES), False)
    assert abs(np.exp(logs).sum() - 1) < 1e-9

    read, target = rng.integers(0, 32, (6, 3)), rng.integers(0, 32 + language_model.RARE_CLASSES, (6, 3))
    clear = rng.random((6, 3)) < 0.3
    first = np.zeros((3, language_model.HIDDEN))

    def loss(model):
        states = language_model.forward(model, read, clear, first, None).astype(np.float64)
        return -language_model.outputs(model, states.reshape(-1, language_model.HIDDEN), target.ravel(), False).sum()

    trace = language_model.Trace()
    states = language_model.forward(start, read, clear, first, trace)
    _, slope, grads = language_model.outputs(start, states.reshape(-1, language_model.HIDDEN), target.ravel(), True)
    grads |= language_model.backward(start, read, clear, trace, slope.reshape(states.shape))
    dense = np.zeros_like(start["input"])
    np.add.at(dense, read.ravel(), grads["input"])
    grads["input"] = dense
    for name, gradient in grads.items():
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        up, down = ({k: v.copy() for k, v in start.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(gradient[at], rel=2e-2, abs=2e-3), name


def test_state_is_carried_through_whole_documents(monkeypatch):
    rng = np.random.default_rng(7)
    table_ = tables(rng)
    table_["number"] = np.minimum(table_["number"], language_model.MODEL_WORDS - 1)
    model_ = language_model.first_model(table_)
    documents_ = [rng.integers(0, 200, n) for n in (1, 5, 130, 24, 25, 3, 60)]
    together = language_model.score_documents(model_, documents_)
    alone = [language_model.score_documents(model_, [d])[0] for d in documents_]
    assert np.allclose(together, alone, rtol=1e-4)
    monkeypatch.setattr(language_model, "SCORE_WINDOW", 1000)
    assert np.allclose(together, language_model.score_documents(model_, documents_), rtol=1e-4)


def plain_score(model, document):
    """The model's log-probability without classes side by side, streams or windows, in double precision."""
    m = language_model
    model = {k: v.astype(np.float64) for k, v in model.items()}
    h, state, read, total = m.HIDDEN, np.zeros(m.HIDDEN), m.MODEL_WORDS + m.RARE_CLASSES, 0.0
    for word in document.tolist():
        x, y = model["input"][read] + model["bias"], state @ model["hidden"]
        keep, reset = (1 / (1 + np.exp(-(x[k : k + h] + y[k : k + h]))) for k in (0, h))
        state = keep * state + (1 - keep) * np.tanh(x[2 * h :] + reset * y[2 * h :])
        frequent = word < m.MODEL_WORDS
        owner = word // m.CLASS_WORDS if frequent else word - m.MODEL_WORDS + len(model["word"])
        parts = [(model["class"] @ state + model["class_bias"], owner)]
        if frequent:
            parts.append((model["word"][owner] @ state + model["word_bias"][owner], word % m.CLASS_WORDS))
        total += sum(logits[k] - np.logaddexp.reduce(logits) for logits, k in parts)
        read = word
    return total


def learned(rng):
    table_ = tables(rng)
    table_["number"] = np.minimum(table_["number"], language_model.MODEL_WORDS - 1)
    model = language_model.first_model(table_)
    return language_model.Trainer(model, {k: np.full_like(v, 1e-6) for k, v in model.items()})


def test_scores_equal_a_plain_recomputation():
    rng = np.random.default_rng(9)
    trainer = learned(rng)
    documents_ = [rng.choice([*range(200), 4096, 4100, 4159], n) for n in (1, 40, 300, 7)]
    trainer.learn(documents_)
    found = language_model.score_documents(trainer.model, documents_)
    assert np.allclose(found, [plain_score(trainer.model, d) for d in documents_], rtol=1e-5)


def test_only_rows_and_classes_that_were_met_are_moved(monkeypatch):
    moved = []
    monkeypatch.setattr(language_model.Trainer, "_move", lambda self, name, gradient, rows=None: moved.append((name, rows, gradient.shape)))
    learned(np.random.default_rng(9)).learn([np.array([3, 130, 3, 4100, 5])])
    rows = {name: (list(r), shape[0]) for name, r, shape in moved if r is not None}
    assert rows["word"] == rows["word_bias"] == ([0, 2], 2)
    assert rows["input"][0] == [3, 130, 4100, 4160]


def test_rows_are_summed_by_number():
    rng = np.random.default_rng(2)
    numbers = np.r_[rng.integers(0, 9, 300), np.arange(20, 60), [70] * 5]
    rows = rng.standard_normal((len(numbers), 6))
    found, sums = language_model.sum_by(numbers, rows)
    assert found.tolist() == sorted(set(numbers.tolist()))
    assert np.allclose(sums, [rows[numbers == n].sum(axis=0) for n in found])


def test_far_logits_stay_finite():
    logits = np.array([[300.0, 1, 2], [-400, -401, -402], [0, 0, 0]], np.float32)
    found, slopes = language_model._softmax(logits.copy(), np.array([0, 2, 1]), True)
    want = logits - np.logaddexp.reduce(logits.astype(np.float64), axis=1)[:, None]
    assert np.allclose(found, want[[0, 1, 2], [0, 2, 1]], atol=1e-4)
    assert np.allclose(slopes, np.exp(want) - np.eye(3)[[0, 2, 1]], atol=1e-5)


def test_windows_of_scoring_hold_a_bounded_number_of_words():
    streams = language_model.Streams([np.arange(n) for n in [400] * 40 + [3000]], 64)
    windows = list(streams.windows(64, 1024))
    assert max(read.size for _, read, *_ in windows) <= 1024 and max(map(len, (w[1] for w in windows))) == 64
    assert sum(int((target >= 0).sum()) for *_, target, _ in windows) == 40 * 400 + 3000


def test_training_numbers_equal_those_of_the_whole_head():
    words_ = [b"w%d" % n for n in range(5000)] + [language_model.END]
    number = np.array([n if n < language_model.MODEL_WORDS else language_model.MODEL_WORDS + language_model.rare_class(w) for n, w in enumerate(words_)])
    table_ = {"words": words_, "counts": np.arange(5001, 0, -1), "number": number, "mass": np.ones(language_model.RARE_CLASSES)}
    head, inputs = language_model.Numbers(table_), language_model.Inputs(table_)
    text = b"w1 w4999 new w4095 w4096 \xc3\xa4 w1".split()
    want = [1, number[4999], 4096 + language_model.rare_class(b"new"), 4095, number[4096], 4096 + language_model.rare_class(b"\xc3\xa4"), 1, number[5000]]
    assert head.numbers(*head.places(text)).tolist() == want
    assert inputs.numbers(list(text)).tolist() == want


def test_model_of_full_size():
    m = language_model
    assert (m.MODEL_WORDS, m.HIDDEN, m.RARE_CLASSES, m.WINDOW, m.STREAMS) == (4096, 32, 64, 24, 128)


def test_training_carries_the_state_through_long_documents(monkeypatch):
    texts = ["w1 w2 " * 2000, "w3", "w4 w5 " * 30]
    learned = []
    monkeypatch.setattr(language_model.Trainer, "learn", lambda self, documents: learned.extend(documents))
    monkeypatch.setattr(language_model, "ROUNDS", (1,))
    table_ = tables(np.random.default_rng(7))
    broadcast = SimpleNamespace(value=(table_, language_model.first_model(table_), {}))
    list(language_model._train(broadcast, 0)([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert [len(d) for d in learned] == [4001, 2, 61]
    streams = language_model.Streams(learned, language_model.STREAMS)
    cleared = sum(int(clear.sum()) for _, _, clear, _, _ in streams.windows(language_model.WINDOW))
    assert cleared == len(texts) and streams.read.size == 4064


def test_secrets(spark, sf_dir):
    found = secrets_scan.scan(table(spark, sf_dir.replace("0.001", "0.01"))).collect()
    judged = [r for r in found if r.label is not None]
    assert any(r.label for r in judged) and not all(r.label for r in judged)
    assert all(r.is_secret == (r.label == 1) for r in judged)


def test_secrets_of_odd_rows(spark):
    rng = random.Random(3)
    key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    token = "%040x" % rng.getrandbits(160)
    texts = [f'use {key} now', f'token = "{token}"', "4111111111111111", "mail some.one01@mail7.example.com", None, "", "x" * 5000 + "1"]
    docs = spark.createDataFrame([(n, t, None if n % 2 else f"src/test/{n}") for n, t in enumerate([*texts, *texts[:2]])], "doc_id long, text string, source string")
    found = secrets_scan.scan(docs).collect()
    assert {(r.doc_id, r.core) for r in found if r.known} == {(0, key), (1, token), (7, key), (8, token)}
    assert secrets_scan.candidates(docs).filter("doc_id = 6").count() == 1
    assert secrets_scan.scan(empty(spark)).count() == 0
    assert secrets_scan.scan(documents(spark, 1, True)).filter("is_secret").count() == 0


def test_secrets_learn_from_given_labels(spark):
    docs = spark.createDataFrame([(n, f"id {'%032x' % (n * 7919 ** 8)} end" if n % 2 else f"ref {n:020d}", "s") for n in range(60)], "doc_id long, text string, source string")
    labelled = secrets_scan.candidates(docs).select("doc_id", "position", (F.col("doc_id") % 2).alias("label"))
    found = secrets_scan.scan(docs, labelled).collect()
    assert len(found) == 60 and sum(r.is_secret == (r.doc_id % 2 == 1) for r in found) >= 58


def test_rare_positives_and_hot_copies_reach_the_forest(spark, monkeypatch):
    monkeypatch.setattr(secrets_scan, "SAMPLE", 20)
    rng = random.Random(4)
    key = lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))
    numbers = [f"{rng.randrange(10**20):020d}" for _ in range(200)] + ["77777777777777777777"] * 200
    texts = [f"ref {x} end" for x in numbers] + [f"key {key()} end" for _ in range(12)]
    docs = spark.createDataFrame([(n, t, "s") for n, t in enumerate(texts)], "doc_id long, text string, source string")
    found = secrets_scan.scan(docs).collect()
    assert len(found) == 412 and sum(r.label == 1 for r in found) == 12
    # Probabilities of the forest, not of the formats alone.
    assert all(r.is_secret == (r.label == 1) for r in found) and len({r.probability for r in found}) > 2


def features_brute(core):
    kinds = "".join("A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else "-" for c in core)
    n = len(core)
    return {
        "n_chars": n,
        "digits": sum(c.isdigit() for c in core) / n,
        "capitals": sum("A" <= c <= "Z" for c in core) / n,
        "hexadecimal": sum(c in "0123456789abcdefABCDEF" for c in core) / n,
        "vowels": sum(c in "aeiouAEIOU" for c in core) / n,
        "distinct": len(set(core)) / n,
        "transitions": sum(1 for _ in groupby(kinds)) / n,
    }


def test_candidates_and_features_equal_brute_force(spark):
    rng = random.Random(9)
    letters = "abcXYZ0123456789_+/=-"
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            core = "".join(rng.choices(letters, k=rng.randint(3, 40)))
            parts.append(rng.choice(["", '"', "token:", "(", "'"]) + core + rng.choice(["", '"', ")", "'", ";"]))
        texts.append(rng.choice([" ", "\n", "\t"]).join(parts))
    docs = spark.createDataFrame([(n, t, "a/b") for n, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    found = {(r.doc_id, r.position, r.part): r for r in secrets_scan.scan(docs).collect()}
    want = {}
    for n, text in enumerate(texts):
        tokens = re.findall(r"\S+", text)
        for at, token in enumerate(tokens):
            cores = [m for m in re.finditer(r"[A-Za-z0-9_+/=-]+", token) if len(m[0]) >= secrets_scan.MIN_CHARS and re.search(r"\d", m[0])]
            for part, m in enumerate(cores):
                want[n, at, part] = m[0]
    assert len(want) > 60 and {(d, part): sorted(r.core for k, r in found.items() if k[0] == d and k[2] == part) for d, _, part in found} == {
        (d, part): sorted(c for k, c in want.items() if k[0] == d and k[2] == part) for d, _, part in want
    }
    for r in found.values():
        assert all(r[k] == pytest.approx(x) for k, x in features_brute(r.core).items())


def test_all_secrets_of_a_token_without_blanks(spark):
    rng = random.Random(5)
    token, other = ("%040x" % rng.getrandbits(160) for _ in range(2))
    key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    github = "ghp_" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36))
    path = "/srv/releases/2024/artifacts/build-0001/output/file"
    texts = [
        f'{{"token":"{token}","path":"{path}"}}',
        f"aws_access_key_id={key}",
        f"GITHUB={github},PATH={path},{key}",
        f'x="{path}";token:{token};token:{token};auth:{other}',
    ]
    docs = spark.createDataFrame([(n, t, "s") for n, t in enumerate(texts)], "doc_id long, text string, source string")
    found = secrets_scan.scan(docs).collect()
    assert sorted((r.doc_id, r.part, r.core) for r in found if not r.known) == [(0, 1, path), (2, 1, f"PATH={path}"), (3, 0, path)]
    want = [(0, 0, token), (1, 0, f"aws_access_key_id={key}"), (2, 0, f"GITHUB={github}"), (2, 2, key), (3, 1, token), (3, 2, token), (3, 3, other)]
    assert sorted((r.doc_id, r.part, r.core) for r in found if r.known) == want
    assert all(r.probability == r.known == r.is_secret for r in found if r.known)
