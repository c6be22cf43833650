import math
import random
import re
import zlib
from collections import Counter as Bag
from hashlib import sha256

import pytest

from conftest_words import words
from oreworks.llm import resampling, token_counts
from oreworks.llm.resampling import Settings, resample
from oreworks.llm.token_counts import Counter, count_tokens

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_texts(rng, n, parts):
    return ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 20, 200]))) for _ in range(n)]


def test_counts_of_cut_texts_are_those_of_whole_ones():
    parts = [*"ab e  \n\t▁.,é🙂日本語0123\x00½Å", "<s>", "</s>", "the ", "ing", "<0x0A>", "     ", "aaaa"]
    whole = Counter()
    texts = odd_texts(random.Random(1), 600, parts)
    wanted = [len(whole.model.encode(t)) for t in texts]
    for part, call_bytes in ((1, 1), (5, 50), (40, 1 << 18)):
        assert Counter(token_counts.Settings(part=part, call_bytes=call_bytes)).counts(texts) == wanted


def test_a_stretch_without_a_safe_place_stays_whole():
    counter = Counter(token_counts.Settings(part=10))
    text = "a" * 100
    assert list(counter.parts(text)) == [text]
    parts = list(counter.parts("word " * 50))
    assert "".join(parts) == "word " * 50 and max(map(len, parts)) <= 10


def test_token_counts_of_odd_rows(spark, odd, none):
    model = Counter().model
    rows = count_tokens(odd).collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(rows[0].asDict())
    for r in rows:
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(model.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert any(r["over_limit"] for r in rows)
    assert count_tokens(none).isEmpty()
    clash = odd.selectExpr("doc_id", "text", "'x' AS n_tokens", "1 AS n_bytes", "1 AS over_limit")
    assert dict(count_tokens(clash).dtypes) | {"n_tokens": "bigint", "over_limit": "boolean"} == dict(count_tokens(clash).dtypes)


def test_only_lengths_come_back(spark, documents):
    docs = documents(["a b c"] * 3)
    plan = count_tokens(docs).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan


def features(text, n, buckets):
    found = WORDS.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(found[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(found) - k + 1)], len(found)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_of_a_batch_match_brute_force(n):
    rng = random.Random(n)
    found = resampling.Features(Settings(words=n))
    parts = [*"abC dE1é🙂\x00\n.-_日Ä ", "word ", "x" * 70 + " ", "\x00\x00"]
    for size in (0, 1, 2, 30):
        texts = [None if k % 9 == 4 else t for k, t in enumerate(odd_texts(rng, size, parts))]
        bucket, owner, n_words = found.of(texts)
        for k, text in enumerate(texts):
            wanted, count = features(text, n, 10_000)
            assert Bag(bucket[owner == k].tolist()) == Bag(wanted) and n_words[k] == count


def drawn_by_hand(rows, target, settings):
    s, t = Bag(), Bag()
    for _, text in rows:
        s.update(features(text, settings.words, settings.buckets)[0])
    for text in target:
        t.update(features(text, settings.words, settings.buckets)[0])
    big_s, big_t = sum(s.values()) + settings.buckets, sum(t.values()) + settings.buckets
    out = []
    for doc_id, text in rows:
        found, n_words = features(text, settings.words, settings.buckets)
        gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    long = sorted((r for r in out if r[4] >= settings.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(long[: settings.percent * len(long) // 100])}
    return Bag((*r[:4], ranks.get(id(r))) for r in out)


def drawn(docs, target, settings=Settings()):
    rows = resample(docs, target, settings).collect()
    return Bag((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows)


def test_resampling_matches_brute_force(spark, documents):
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randrange(0, 60))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, texts[0] + " and more " * 10), (7, " ".join(texts[:3])), (5000, None)]
    rows += [(6000, " ".join(texts[5:8]))] * 150  # a third are copies
    target = [" ".join(words(rng, 40, 30)) for _ in range(20)] + [None, ""]
    docs = documents(rows).repartition(5)
    for settings in (Settings(), Settings(buckets=50, words=3, least_words=1, percent=60, seed=1)):
        assert drawn(docs, documents(target), settings) == drawn_by_hand(rows, target, settings)


def test_resampling_draws_more_of_what_the_target_has(documents):
    rng = random.Random(6)
    texts = [" ".join(words(rng, 40, 30) if k % 4 == 0 else [f"z{rng.randrange(300)}" for _ in range(40)]) for k in range(400)]
    target = [" ".join(words(rng, 40, 30)) for _ in range(50)]
    rows = resample(documents(texts), documents(target)).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 101))
    # In proportion, 25 would be.
    assert sum(r["doc_id"] % 4 == 0 for r in rows) > 45


def test_resampling_of_odd_rows(odd, none, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for target in ([], ["some words"], [None]):
        assert drawn(odd, documents(target) if target else none) == drawn_by_hand(rows, target, Settings())
    assert resample(none, none).isEmpty()
