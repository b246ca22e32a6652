"""Exact, line and near duplicates against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from cases import documents, empty, hot, lower, rows, sentence, words

from planloom.llm import exact_dedup, line_dedup, simhash
from planloom.llm.components import components

BLANKS = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def exact_brute(table):
    groups = defaultdict(list)
    for doc_id, text in table:
        groups[lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        for k, i in enumerate(ids):
            kept = i == best and ids.index(i) == k
            out.append((i, best, len(ids), kept, sha(text)))
    return out


@pytest.mark.parametrize("nulls", [False, True])
def test_exact_dedup(spark, nulls):
    table = [r[:2] for r in rows(1, nulls)]
    got = [tuple(r) for r in exact_dedup.exact_dedup(documents(spark, 1, nulls)).collect()]
    assert sorted(got, key=repr) == sorted(exact_brute(table), key=repr)


def test_exact_dedup_of_a_hot_text_and_of_no_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LIVE_DIGESTS", 20)
    table = hot(spark)
    got = [tuple(r) for r in exact_dedup.exact_dedup(table).collect()]
    assert sorted(got) == sorted(exact_brute([tuple(r) for r in table.collect()]))
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_cuckoo_index_holds_what_is_live():
    rng, index, live = random.Random(2), exact_dedup.CuckooIndex(2), {}
    for n in range(5000):
        digest = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if rng.random() < 0.3:
            gone = index.delete(digest)
            assert (gone[0] if gone else None) == (digest if live.pop(digest, None) else None)
        else:
            index.add(digest, n, n, 1)
            live[digest] = live.get(digest, 0) + 1
        assert len(index) == len(live)
    assert {g[0]: g[3] for g in index.groups()} == live
    assert all(index.find(d)[3] == n for d, n in live.items())


def line_brute(table, chars=40, docs=5):
    def key(line):
        return lower(line.strip(BLANKS))

    holders = defaultdict(list)
    for doc_id, text in table:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= chars:
                holders[k].append(doc_id)
    out = []
    for doc_id, text in table:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            held = holders.get(key(line), [])
            known = [i for i in held if i is not None]
            keep = max(known) if known else None
            if len(held) < docs or doc_id == keep:
                kept.append(line)
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("nulls", [False, True])
def test_line_dedup(spark, nulls):
    docs = documents(spark, 1, nulls)
    kept = line_dedup.drop_shared_lines(docs)
    assert kept.columns == [*docs.columns, "n_lines_", "n_dropped"]
    got = [tuple(r) for r in kept.select("doc_id", "text", "n_lines_", "n_dropped").collect()]
    want = line_brute([r[:2] for r in rows(1, nulls)])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[3] for r in want)


def test_line_dedup_of_a_hot_line_and_of_no_rows(spark):
    table = hot(spark)
    got = line_dedup.drop_shared_lines(table).select("doc_id", "text", "n_lines", "n_dropped")
    assert sorted(map(tuple, got.collect())) == sorted(line_brute([tuple(r) for r in table.collect()]))
    assert line_dedup.drop_shared_lines(empty(spark)).count() == 0


def print_brute(text):
    found = words(text)
    shingles = [" ".join(found[k : k + 4]) for k in range(len(found) - 3)] if len(found) >= 4 else [" ".join(found)][: len(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_brute(ids, prints, radius=4):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = np.array(prints, np.uint64)
    for a in range(len(prints)):
        for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= radius).tolist():
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    least = {}
    for n, i in enumerate(ids):
        if i is not None:
            least[top(n)] = min(least.get(top(n), i), i)
    return [least.get(top(n)) for n in range(len(prints))]


@pytest.mark.parametrize("nulls", [False, True])
def test_near_duplicates(spark, nulls):
    table = [r[:2] for r in rows(1, nulls)]
    prints = [print_brute(t) for _, t in table]
    groups = groups_brute([i for i, _ in table], prints)
    got = [tuple(r) for r in simhash.near_duplicates(documents(spark, 1, nulls)).collect()]
    want = [(i, f"{p:016x}", g) for (i, _), p, g in zip(table, prints, groups)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_links_of_dense_and_spread_fingerprints(spark, monkeypatch, parts):
    rng = np.random.default_rng(parts)
    centres = rng.integers(0, 1 << 63, 60, np.int64)
    flips = rng.integers(0, 64, (60, 25, 3))
    near = (centres[:, None] ^ (np.int64(1) << flips.astype(np.int64)).sum(axis=2)).ravel()
    prints = np.unique(np.r_[near, rng.integers(-(1 << 63), 1 << 63, 500, np.int64)])
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 500)
    nodes = spark.createDataFrame([(int(p),) for p in prints], "fingerprint long").repartition(3)
    labels = {r.node: r.root for r in components(simhash.hamming_links(nodes, 4, parts)).collect()}
    got = [labels.get(int(p), int(p)) for p in prints]
    want = groups_brute(range(len(prints)), prints.view(np.uint64))
    assert [got.index(g) for g in got] == want


def test_thresholds_add_up():
    rng = np.random.default_rng(1)
    groups = simhash.group_bits(np.abs(rng.standard_normal((64, 64))), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    prints = rng.integers(-(1 << 63), 1 << 63, 300, np.int64)
    bits = simhash._unpacked(prints)
    balls = []
    for group in groups:
        counts = np.bincount(simhash.values(bits, group), minlength=1 << 16)
        balls.append(simhash.ball_counts(counts, 16, 4))
        own = simhash.values(bits, group)
        far = np.bitwise_count((own[:, None] ^ own[None, :]).astype(np.uint64))
        assert (balls[-1][2][own] == (far == 2).sum(axis=1)).all()
    plan = {"radius": 4, "groups": groups, "pieces": simhash.blocks_of(groups), "balls": balls, "rows": 300}
    assert (simhash.thresholds(plan, bits).sum(axis=0) == 5).all()


def test_a_component_with_a_third_of_all_nodes_is_split(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    table = []
    for n in range(300):
        found = list(base) if n % 3 == 0 else [f"w{rng.randrange(5000)}" for _ in range(60)]
        found[rng.randrange(len(found))] = f"v{n}"
        table.append((n, " ".join(found)))
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    changed = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = groups_brute([i for i, _ in table], [print_brute(t) for _, t in table])
    assert [got[i] for i, _ in table] == want and want.count(0) >= 90
