import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreworks.llm import simhash
from oreworks.llm.top_k import Settings, top_k

VECTOR = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    whole = [
        (i, [int(np.floor(1024 * float(np.float32(x)))) for x in v])
        for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, q in whole:
        if i % 100 == 0:
            score = lambda v: min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1)
            scored = sorted((-score(v), j) for j, v in whole if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def search(spark, rows, **settings):
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTOR)
    found = top_k(vectors, vectors.where("vec_id % 100 = 0"), Settings(**settings))
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("block", [16, 1024])
def test_top_k_equals_brute_force(spark, block):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(size=8) * draw.lognormal()).tolist()) for i in range(500)]
    rows += [(1000 + i, [0.5] * 8) for i in range(40)]  # ties, and one common vector
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 8), (2003, [None] * 8), (2100, [float("inf")] * 8), (None, [1.0] * 8)]
    assert search(spark, rows, block=block, queries=3, run=2) == brute(rows, 10)


def test_products_of_large_components_are_exact(spark):
    big = [(100, [2.2e6, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])]
    assert [r[2:] for r in search(spark, big)] == [(2, 4_613_734_400_000), (1, 2_306_867_200_000)]
    draw = np.random.default_rng(5)
    for size in (1e5, 8e5, 1e8):  # products beyond 2**53, beyond 2**62, and beyond a long
        rows = [(i, (draw.normal(size=3) * size).tolist()) for i in range(120)]
        assert search(spark, rows, block=16, run=2) == brute(rows, 10)


def test_top_k_with_few_or_no_rows(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0, 2.0])]) == []
    assert search(spark, [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.5, 9.0])]) == [(0, 1, 2, 512 * 1024), (0, 2, 1, -(1024**2))]


def test_fingerprints_and_edits(spark, documents):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 90))) + "é" * (k % 3) for k in range(60)]
    texts[10] = texts[40] = "equal texts"
    ids = list(range(0, 6000, 100))
    rows = {r["doc_id"]: r for r in simhash.compare_with_edits(documents(list(zip(ids, texts)))).collect()}
    assert rows[1000]["fingerprint"] == rows[4000]["fingerprint"]
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    for k, (i, text) in enumerate(zip(ids, texts)):
        following = (k + 1) % len(ids)
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + texts[following][:quarter]
        row = rows[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["near_edited"] == 1 - bits(row["fingerprint"], row["edited_fingerprint"]) / 128
        assert row["near_next"] == 1 - bits(row["fingerprint"], rows[ids[following]]["fingerprint"]) / 128
        others = {r["fingerprint"] for r in rows.values()} - {row["fingerprint"]}
        assert row["near_fingerprints"] == sum(bits(row["fingerprint"], o) <= 3 for o in others)


def test_bits_are_majorities(spark):
    texts = spark.createDataFrame([(0, "only")], "k int, text string")
    term = spark.range(1).select(F.xxhash64(F.lit("only")).alias("a"), F.xxhash64(F.lit("only"), F.lit(1)).alias("b")).first()
    found = simhash.fingerprints(texts, ["k"]).first()["fingerprint"]
    assert found == f"{term['a'] % 2**64:016x}{term['b'] % 2**64:016x}"


def test_within_finds_every_fingerprint_of_the_radius(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(128) for _ in range(20)]
    near = [b ^ sum(1 << p for p in rng.sample(range(128), n)) for b in base for n in range(0, 6)]
    table = spark.createDataFrame([(f"{x:032x}",) for x in base + near] + [(None,)], "fingerprint string")
    queries = spark.createDataFrame([(f"{x:032x}",) for x in base], "fingerprint string")
    found = {(r["query"], r["fingerprint"], r["distance"]) for r in simhash.within(queries, table, 4).collect()}
    expected = {
        (f"{a:032x}", f"{b:032x}", bin(a ^ b).count("1")) for a in base for b in {*base, *near} if bin(a ^ b).count("1") <= 4
    }
    assert found == expected


def test_near_copies_are_within_the_radius(spark, documents):
    """Texts with a few edited words; the recall of the radius is measured, not assumed."""
    rng = random.Random(8)
    pairs = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(120, 500))]
        changed = list(words)
        for k in rng.sample(range(len(words)), max(1, len(words) // 50)):
            changed[k] = f"v{rng.randrange(5000)}"
        pairs.append((" ".join(words), " ".join(changed)))
    docs = documents([t for pair in pairs for t in pair])
    found = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(docs.select("doc_id", "text"), ["doc_id"]).collect()}
    frame = lambda ids: spark.createDataFrame([(found[k],) for k in ids], "fingerprint string")
    got = {(r["query"], r["fingerprint"]) for r in simhash.within(frame(range(0, 80, 2)), frame(range(1, 80, 2))).collect()}
    hits = sum((found[k], found[k + 1]) in got for k in range(0, 80, 2))
    assert hits >= 36 and len(got) == hits  # nine of ten, and no strangers


def test_order_with_gaps_and_many_buckets(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)
    monkeypatch.setattr(simhash, "GROUP_BUCKETS", 4)
    ids = [-50, -49, -3, 0, 1, 2, 3, 4, 900, 901, 5000, 5001, 5002, 10**6]
    chained = simhash.with_next(documents([(i, f"t{i}") for i in ids]).select("doc_id", "text")).collect()
    assert {r["doc_id"]: r["next_text"] for r in chained} == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1])}


def test_odd_rows(odd, none):
    rows = simhash.compare_with_edits(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert {r["fingerprint"] for r in rows if r["n_chars"] == 0} == {"0" * 32}
    assert simhash.compare_with_edits(none).collect() == []
