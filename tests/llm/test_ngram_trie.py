"""Language-model scores against plain versions, the levels' parts, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import catalog, ngram_trie as nt

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain_scores(rows, prior=nt.PRIOR):
    """(doc_id, held, tokens, known, N, base, score) by dictionaries; no quantisation."""
    cut = []
    for doc_id, text in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        cut.append((doc_id, zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0, re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]))
    one, two, three, first, second = Counter(), Counter(), Counter(), Counter(), Counter()
    for _, held, words in cut:
        if not held:
            for u, v, w in zip([0, 0, *words], [0, *words], words):
                one[w] += 1
                first[v] += 1
                two[v, w] += 1
                second[u, v] += 1
                three[u, v, w] += 1
    total, distinct = sum(one.values()), len(one)
    out = []
    for doc_id, held, words in cut:
        base = score = 0.0
        for u, v, w in zip([0, 0, *words], [0, *words], words):
            p1 = (one[w] + 0.1) / (total + 0.1 * (distinct + 1))
            p2 = (two[v, w] + prior[0] * p1) / (first[v] + prior[0])
            p3 = (three[u, v, w] + prior[1] * p2) / (second[u, v] + prior[1])
            base, score = base + math.log10(p1), score + math.log10(p3)
        out.append((doc_id, held, len(words), sum(one[w] > 0 for w in words), total, base, score))
    return out


def same(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        # Three codes a token at most, each half a step off at most.
        assert abs(a[6] - b[6]) <= 1.5 * a[2] / nt.STEPS + 1e-9


def test_scores_equal_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = catalog.queries()["op12_lm_scoring"](spark, sf).collect()
    same(found, plain_scores([(r.doc_id, r.text) for r in docs.collect()]))
    # A model that has seen more than single words tells held-out texts better.
    held = [r for r in found if r.held_out]
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held) and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_many_blocks_shards_and_split_words(spark, sf, monkeypatch):
    for name, value in (("BLOCK_TOKENS", 3000), ("SHARD_TOKENS", 2000), ("SPLIT_TOKENS", 2000), ("PIECE", 100), ("SLICE", 64), ("SAMPLED", 16)):
        monkeypatch.setattr(nt, name, value)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "the", "the", "of", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(300))) for _ in range(150)] + ["a " * 4000, "the " * 2500]
    rows = list(enumerate(texts + texts[:20]))
    found = nt.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    same(found, plain_scores(rows))


def test_scores_of_odd_rows(spark):
    rows = [(1, "Some plain\x0b words"), (1, "Some plain\x0b words"), (2, None), (3, ""), (None, "SOME ÄÖ words"), (None, None), (4, "word " * 30_000), (5, "éß😀 \x0b\t x\x85y\xa0z"), (19, "some plain unknown words"), (6, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("block", "score", "held", "n")})
    same(nt.score_documents(df).collect(), plain_scores(rows))
    assert nt.score_documents(df.limit(0)).count() == 0
    (held,) = [[k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0]]
    none = nt.score_documents(spark.createDataFrame([(held[0], "only held out"), (held[1], "")], "doc_id long, text string")).collect()
    assert {(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in none} == {(True, 0, 0, 0.0, 0.0)}


def test_elias_fano_round_trip():
    rng = np.random.default_rng(4)
    for n, most in ((0, 1), (1, 0), (1, 10**12), (1000, 3), (5000, 10**9), (300_000, 10**7), (2000, 2**40)):
        values = np.sort(rng.integers(0, most + 1, n))
        ef = nt.EliasFano.of(values)
        assert (ef.decode(0, n) == values).all()
        for start, end in ((0, 1), (n // 3, n // 2), (n - 1, n), (511, 514), (n, n + 5)):
            assert (ef.decode(start, end) == values[max(0, start) : end]).all()
        if n > 1000 and most >= 10**7:
            size = ef.low.nbytes + ef.high.nbytes + ef.samples.nbytes
            assert size * 8 <= n * (math.log2(most / n) + 2.2) + 1000  # within a fraction of a bit of the bound


def test_successors_are_relative_to_their_list():
    rng = np.random.default_rng(5)
    lists = {k: sorted(rng.choice(50, rng.integers(0, 20), replace=False).tolist()) for k in range(200)}
    owner = np.array([k for k, t in lists.items() for _ in t])
    targets = np.array([x for t in lists.values() for x in t])
    sequence = nt.EliasFano.of(nt.relative(owner, targets))
    pointers = nt.EliasFano.of(np.searchsorted(owner, np.arange(201)))
    asked, target = np.repeat(np.arange(200), 52), np.tile(np.arange(52), 200)
    found = nt.successors(sequence, pointers, asked, target)
    flat = targets.tolist()
    for k, t, at in zip(asked.tolist(), target.tolist(), found.tolist()):
        assert (at >= 0) == (t in lists[k]) and (at < 0 or (flat[at] == t and owner[at] == k))


def test_bytes_round_trip():
    rng = np.random.default_rng(6)
    for n in (0, 1, 1000):
        columns = [rng.integers(0, most, n) for most in (1, 256, 257, 2**33)]
        for a, b in zip(columns, nt.from_bytes(nt.to_bytes(*columns), 4)):
            assert (a == b).all()
        v, u = np.sort(rng.integers(0, 9, n)), rng.integers(0, 99, n)
        order = np.lexsort((u, v))
        v, u = v[order], u[order]
        for a, b in zip((v, u), nt._pairs_of(*nt._steps_of(v, u))):
            assert (a == b).all()
    big = [rng.integers(0, 2**40, 500) for _ in range(3)]
    assert (np.argsort(nt.packed(*big), kind="stable") == np.lexsort(big[::-1])).all()
