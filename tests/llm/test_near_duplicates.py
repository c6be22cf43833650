import random
from dataclasses import replace

import numpy as np
import pytest

import corpus_pipeline
from conftest_words import words
from oreworks.llm.common import connected_components
from oreworks.llm.near_duplicates import Settings, near_duplicates, signatures
from oreworks.llm.shingles import WordHashes, shingles

SMALL = Settings(block_shingles=4_000, range_shingles=1_000, range_sets=50, rare=4, side=8)


def shingle_set(text):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    found = (text or "").encode().translate(table).split()
    return frozenset(tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))) if found else frozenset()


def brute(pairs):
    sets = [(i, shingle_set(t)) for i, t in pairs]
    group = list(range(len(sets)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            one, two = sets[a][1], sets[b][1]
            if one and two and 100 * len(one & two) >= 75 * len(one | two):
                group[root(a)] = root(b)
    lowest = {}
    for k, (i, _) in enumerate(sets):
        lowest[root(k)] = min(lowest.get(root(k), i), i)
    return sorted((i, len(s), lowest[root(k)]) for k, (i, s) in enumerate(sets))


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed):
    """A large group of near copies at all distances, a chain, exact copies, and a passage that many texts share."""
    rng = random.Random(seed)
    base, passage = words(rng, 90), words(rng, 60, 50)
    texts = [edited(rng, base, rng.randrange(0, 6)) for _ in range(70)]
    texts += [" ".join(base).upper()] * 15
    for _ in range(40):
        texts.append(" ".join(words(rng, rng.randrange(2, 60)) + passage))
    chain = words(rng, 60)
    for _ in range(12):
        chain = chain[6:] + words(rng, 6)
        texts.append(" ".join(chain))
    texts += [" ".join(words(rng, n)) for n in (1, 2, 3, 4, 5, 6, 7) for _ in range(3)] + ["a b c d"] * 3 + ["", " "]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, documents, seed):
    pairs = corpus(seed)
    found = near_duplicates(documents(pairs).repartition(3, "doc_id"), SMALL)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == brute(pairs)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    settings = replace(SMALL, rare=1)
    for _ in range(200):
        size = int(rng.integers(3, 400))
        one = rng.choice(2**60, size, replace=False).astype(np.uint64)
        cut = int(rng.integers(0, size // 4 + 1))
        two = np.append(one[cut:], rng.choice(2**60, int(rng.integers(0, 3)), replace=False).astype(np.uint64))
        shared = len(np.intersect1d(one, two))
        if 100 * shared < 75 * (len(one) + len(two) - shared):
            continue
        # Every token is frequent in the whole collection, so that only pairs can match.
        signs = [signatures(np.sort(s), np.full(len(s), 9), len(s), settings) for s in (one, two)]
        assert np.array_equal(np.sort(one), np.sort(two)) or len(np.intersect1d(*signs))


def test_odd_rows(odd):
    rows = near_duplicates(odd, SMALL).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 4)} == {1, 2, 4}
    assert [r["component_id"] for r in rows if r["doc_id"] == 3] == [3, 3, 3]
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert [r["n_shingles"] for r in rows if r["doc_id"] == 5][0] > 29_000


def test_no_rows(none):
    assert near_duplicates(none).collect() == []


def test_short_texts_are_one_run():
    hashes = WordHashes()
    assert len(shingles("a b c", hashes)) == 1 and len(shingles("", hashes)) == 0 and len(shingles(None, hashes)) == 0
    assert np.array_equal(shingles("A b\x0bC", hashes), shingles("a\tb c", hashes))
    assert not np.array_equal(shingles("É b", hashes), shingles("é b", hashes))


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    rng.shuffle(links)
    rows = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in links], "a string, b string")
    found = {r["node"]: r["component"] for r in connected_components(rows).collect()}
    assert len(found) == 61 + 40 + 3
    assert {found[n] for n in found if n < "0100"} == {"0000"} and found["0139"] == "0100" and found["0202"] == "0200"


def test_stage_keeps_one_of_each_group_and_every_clean_document(spark, documents):
    pairs = corpus(4)
    docs = documents(pairs + [pairs[0]])  # a row that repeats
    kept = [r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    components = {i: c for i, _, c in brute(pairs)}
    assert sorted(kept) == sorted(set(components.values()))


def test_stage_with_odd_rows(spark, odd, none):
    kept = corpus_pipeline.one_of_each_group(spark, odd, "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) == 2 and ids.count(None) == 2 and {1, 2, 4, 5, 6, 7, 8} <= set(ids)
    assert corpus_pipeline.one_of_each_group(spark, none, "").collect() == []
