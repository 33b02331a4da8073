"""Repeated strings against brute force, and suffix arrays against sorting."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from bandscan.llm import repeats
from bandscan.llm.numtext import prefix_sums, span_hash, width_hashes
from bandscan.llm.repeats import repeat_digests, without_repeats
from bandscan.llm.suffix_array import common_prefixes, suffix_array


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(400):
        top = rng.choice([1, 2, 3, 5, 200])
        t = [rng.randint(1, top) for _ in range(rng.randint(0, 60))]
        t = t[: len(t) // 3] * 3 if rng.random() < 0.3 else t
        s = np.array([*t, 0])
        want = sorted(range(len(s)), key=lambda i: list(s[i:]))
        sa = suffix_array(s, int(s.max()) + 1)
        assert sa.tolist() == want
        plcp = common_prefixes(s, sa, 5)
        for a, b in zip(want, want[1:]):
            n = 0
            while n < min(len(s) - a, len(s) - b, 5) and s[a + n] == s[b + n]:
                n += 1
            assert plcp[b] == n


def brute(rows, size):
    seen, out = set(), []
    for i, text in sorted({(i, t or "") for i, t in rows}):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - size + 1):
            if raw[k : k + size] in seen:
                gone[k : k + size] = True
            seen.add(raw[k : k + size])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cde fgh ij klm nop é qr stu vw".split()) * rng.randint(1, 2)
    passages = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(6)]
    texts = [None, "", "short", "x" * 700, "x" * 99, "ab" * 300, "abcd" * 100 + "z" + "abcd" * 100]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        for k in range(2):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 20)
                parts[k] += p[a : len(p) - rng.randint(0, 20)]
        texts.append("".join(parts))
    texts += rng.sample(texts[7:], 8)
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"group": 2}), (3, {"shard": 500, "gram": 60})])
def test_matches_brute_force(spark, seed, options):
    rows = corpus(seed)
    got = repeat_digests(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    assert sorted(map(tuple, got.collect())) == brute(rows, 100)


@pytest.mark.parametrize("options", [{}, {"group": 2}])
def test_regular_texts(spark, options):
    """Texts of two letters, whose hashes by powers of one number could be equal."""
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = list(enumerate([word, other, word[:500] + other[500:], other + word, "c" + word[100:900], (word + other) * 2]))
    got = repeat_digests(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    assert sorted(map(tuple, got.collect())) == brute(rows, 100)


def test_shards_stay_within_their_size(monkeypatch):
    """Only a gram that is larger by itself makes a larger shard, alone; nothing is left out."""
    made = []
    monkeypatch.setattr(repeats, "shard_repeats", lambda h, doc, tag, lo, contexts, size: made.append((h.tolist(), doc.tolist(), sum(map(len, contexts)))) or [])
    grams = [1] * 4 + [2] * 5 + [3] * 30 + [4] + [5] * 6 + [6] * 9
    rows = [(h, k, 0, 0, b"x" * 100) for k, h in enumerate(grams)]
    names = ["h", "doc", "tag", "lo", "ctx"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + 7]]) for k in range(0, len(rows), 7)]
    assert not list(repeats._sharded(iter(batches), 100, 1000))
    assert [k for _, docs, _ in made for k in docs] == list(range(len(rows)))
    assert [sorted(set(h)) for h, _, _ in made] == [[1, 2], [3], [4, 5], [6]]
    assert all(total <= 1000 or len(set(h)) == 1 for h, _, total in made)


def test_hashes_of_one_width():
    sums = prefix_sums(np.random.default_rng(1).integers(0, 9, 500).astype(np.uint64))
    at = np.arange(500 - 40 + 1)
    assert (width_hashes(sums, 40) == span_hash(sums, at, at + 40)).all()


def test_prefixes_of_marked_positions():
    rng = np.random.default_rng(5)
    s = np.append(rng.integers(1, 3, 300), 0)
    sa = suffix_array(s, 3)
    every, only = common_prefixes(s, sa, 9), rng.random(301) < 0.5
    before = np.append(sa[-1], sa)[np.argsort(sa)]
    assert (common_prefixes(s, sa, 9, only) == np.where(only & only[before] & (np.arange(301) != sa[0]), every, 0)).all()


def test_edges(spark):
    empty = repeat_digests(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    t = "".join(chr(97 + k % 26) * (k % 3 + 1) for k in range(80))
    rows = [(3, t, 1), (3, t, 1), (None, t, 2), (4, "q" + t, 3)]
    got = {(r["doc_id"], len(r["kept"]), tuple(map(tuple, r["spans"]))) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string, tag int")).collect()}
    n = len(t)
    assert got == {(None, n, ()), (3, 0, ((0, n),)), (4, 1, ((1, n + 1),))}
