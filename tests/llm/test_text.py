"""Repeated passages, tokens and decontamination against brute force."""

import hashlib
import random
import re

import pytest
from cases import documents, empty, hot, lower, rows
from tokenizers import Tokenizer

from planloom.llm import bpe, decontaminate, repeated_text, token_counts
from planloom.llm.queries import vocabulary


def repeats_brute(table, depth=100):
    seen, out = set(), {}
    for doc_id, text in sorted(table, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - depth + 1):
            window = data[s : s + depth]
            if window in seen:
                gone[s : s + depth] = b"\1" * depth
            seen.add(window)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[doc_id] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))
    return out


def repeats(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeated_text.remove_repeats(docs).collect()}


@pytest.mark.parametrize("piece", [None, 3000])
def test_repeated_passages(spark, monkeypatch, piece):
    if piece:
        monkeypatch.setattr(repeated_text, "SLICE_BYTES", piece)
    table = [r[:2] for r in rows()]
    assert repeats(documents(spark)) == repeats_brute(table)
    rng = random.Random(6)
    part = ["".join(rng.choice("abé \n") for _ in range(rng.randint(60, 220))) for _ in range(12)]
    made = [(n, "".join(rng.choice(part) if rng.random() < 0.7 else str(rng.random()) for _ in range(rng.randint(0, 9)))) for n in range(60)]
    assert repeats(spark.createDataFrame(made, "doc_id long, text string").repartition(4)) == repeats_brute(made)


def test_repeated_passages_of_hot_texts_odd_ids_and_no_rows(spark):
    table = hot(spark, 200)
    assert repeats(table) == repeats_brute([tuple(r) for r in table.collect()])
    text = "".join(random.Random(3).choices("abcdefgh", k=300))
    twice = [(7, text), (7, text), (None, text), (8, text[:99])]
    got = sorted(((r.doc_id, r.n_removed) for r in repeated_text.remove_repeats(spark.createDataFrame(twice, "doc_id long, text string")).collect()), key=repr)
    assert got == [(7, 300), (7, 300), (8, 0), (None, 0)]
    assert repeated_text.remove_repeats(empty(spark)).count() == 0


def test_different_texts_without_doc_id_stay(spark):
    rng = random.Random(12)
    table = [(None if n % 3 else n % 50, "".join(rng.choices("abcdefghijklmnop", k=110))) for n in range(20_000)]
    got = repeated_text.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(4))
    assert got.filter("n_removed = 0 AND n_bytes = 110").count() == 20_000


def test_repeated_passages_of_shared_doc_ids(spark):
    rng = random.Random(13)
    part = ["".join(rng.choices("abcdef \n", k=rng.randint(60, 220))) for _ in range(10)]
    table = [(rng.choice([None, 1, 2, 3, 50 + n]), "".join(rng.choice(part) if rng.random() < 0.6 else str(rng.random()) for _ in range(rng.randint(0, 7)))) for n in range(80)]
    order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()))
    want = repeats_brute([(n, text) for n, (_, text) in enumerate(order)])
    got = repeated_text.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: (repr(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key) == sorted(((i, *want[n]) for n, (i, _) in enumerate(order)), key=key)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_pair_merges_equal_the_library(spark, tokenizer):
    odd = ["It's WE'LL x'RE 'S", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "aaaaaaaaaaa" * 9, "ΑΣ σας ΣΣ", "İstanbul ǅ é"]
    docs = documents(spark, 1, True).select("doc_id", "text").unionByName(spark.createDataFrame([(n, t) for n, t in enumerate(odd)], "doc_id long, text string"))
    texts = docs.collect()
    got = sorted((r.doc_id or -1, bytes(r.ids), r.decoded, r.n_tokens) for r in bpe.encode_decode(docs, vocabulary("word_bpe_49k.json")).collect())
    want = []
    for r in texts:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or -1, b"".join(i.to_bytes(4, "little") for i in ids), tokenizer.decode(ids, skip_special_tokens=False), len(ids)))
    assert got == sorted(want)
    assert bpe.encode_decode(empty(spark), vocabulary("word_bpe_49k.json")).count() == 0


def test_pair_merges_of_many_characters(tokenizer):
    rng = random.Random(8)
    pool = "aAbB sS'tTlL 019 .,;!<|>\n\t\x0b\x1c\x85\xa0　éÉßſİıΣσς̧́ǅÅK½²Ⅷ٣中한\U0001f600‍_-/ªẞ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += [f"x{chr(c)}Y 1{chr(c)}{chr(c)}" for c in range(0x80, 0x30000, 23) if not 0xD800 <= c < 0xE000]
    table = bpe.WordTable(bpe.load_vocabulary(vocabulary("word_bpe_49k.json")))
    numbers = [table.number(t) for t in texts]
    table.fill()
    assert [table.encode(n).tolist() for n in numbers] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def greedy(word, pieces, longest):
    at = n = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if k == 1 or word[at : at + k] in pieces)
        n += 1
    return n


def test_automaton_counts_equal_greedy_matching():
    rng = random.Random(1)
    for _ in range(100):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 25))}
        found = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 15))) for _ in range(60)]
        counts = token_counts.count_words(found, token_counts.build_automaton(pieces))
        assert counts.tolist() == [greedy(w, pieces, 6) for w in found]


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 50)
    pieces = token_counts.load_pieces(vocabulary("piece_bpe_32k.model"))
    held, longest = set(pieces), max(map(len, pieces))
    docs = documents(spark, 1, True)
    got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, pieces).collect()), key=repr)
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        found = (text or "").encode().split()
        want.append((doc_id, len(found), sum(greedy("▁".encode() + w, held, longest) for w in found)))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(empty(spark), pieces).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination_brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        found = WORD.findall(lower(text))
        size = min(window, len(found))
        for k in range(len(found) - size + 1 if size else 0):
            windows.setdefault(tuple(found[k : k + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        found = WORD.findall(lower(text))
        hit, named = set(), set()
        for size in sizes:
            for k in range(len(found) - size + 1):
                owners = windows.get(tuple(found[k : k + size]))
                if owners:
                    hit |= set(range(k, k + size))
                    named |= owners
        ids = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc_id, len(found), len(hit), len(named), ids, bool(hit) and 20 * len(hit) >= len(found)))
    return out


def benchmark(spark):
    rng, table = random.Random(12), rows()
    found = [WORD.findall(t) for _, t, *_ in table if t and len(WORD.findall(t)) > 30]
    items = [(n, " ".join(w[a : a + rng.randint(2, 40)])) for n, w in enumerate(found) for a in [rng.randint(0, 10)]]
    items += [(500, "The"), (501, "und"), (502, None), (503, ""), (504, " -- "), (None, items[3][1]), (505, items[3][1]), (505, items[3][1])]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("nulls", [False, True])
def test_decontamination(spark, nulls):
    items, table = benchmark(spark)
    docs = documents(spark, 1, nulls)
    got = [tuple(r) for r in decontaminate.decontaminate(docs, table).collect()]
    want = contamination_brute([r[:2] for r in rows(1, nulls)], items)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_decontamination_of_empty_tables(spark):
    _, table = benchmark(spark)
    assert decontaminate.decontaminate(empty(spark), table).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.decontaminate(documents(spark), nothing).collect()
    assert len(found) == len(rows()) and not any(r.n_hit or r.contaminated for r in found)
