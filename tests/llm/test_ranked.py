"""Exact dedup, importance resampling and lexical search against loops over odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import exact, resampling, search
from tests.llm.test_llm import LONG, ODD, SCHEMA

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: The odd rows, with copies in other case (a null id among them), ties, a repeated row and a hot text.
ROWS = [*ODD, (9, "Two Words"), (None, "TWO words"), (10, "ÄÖ two"), (11, "äö two"), (12, LONG.upper()), *((100 + k, "hot text") for k in range(300))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(7)


def clashing(spark, rows=ROWS):
    """The same rows with columns whose names the operators use themselves."""
    names = ["key", "norm", "n", "id", "th", "score", "rank", "salt", "bucket", "word", "pos", "part", "gain", "digest", "item", "terms"]
    return spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], SCHEMA + ", " + ", ".join(f"{c} int" for c in names)), names


# ---- 13


def groups_by_loop(rows, largest=True):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(UPPER)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(UPPER)
        ids = [x for x in by[norm] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        out.append((i, keep, len(by[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("largest", [True, False])
def test_exact_groups_equal_a_loop(odd, largest):
    assert as_rows(exact.exact_groups(odd, largest)) == groups_by_loop(ROWS, largest)


def test_colliding_hashes_are_told_apart_by_the_bytes(odd):
    few = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 3), 32, "0"))  # noqa: E731  three keys for all texts
    assert as_rows(exact.exact_groups(odd, hashed=few)) == groups_by_loop(ROWS)


def test_one_row_of_each_text_stays_with_its_columns(spark):
    df, names = clashing(spark)
    out = exact.without_copies(df).collect()
    assert list(out[0].asDict()) == ["doc_id", "text", *names]
    kept = {(i, (t or "").translate(UPPER)) for i, k, _, same, _ in groups_by_loop(ROWS) for j, t in ROWS if same and i == j and hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest() == _}
    assert sorted(((r.doc_id, (r.text or "").translate(UPPER)) for r in out), key=repr) == sorted(kept, key=repr)
    assert as_rows(exact.exact_groups(df)) == groups_by_loop(ROWS)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert exact.exact_groups(none).count() == exact.without_copies(none).count() == 0
    assert resampling.resampled(none, items).count() == 0
    assert search.search(none, items).count() == 0


# ---- 11

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = [(1, "two words hot"), (2, None), (2, ""), (3, "ünï cödé W1 two two"), (3, "hot text")]


def grams_by_loop(text, orders):
    w = WORD.findall((text or "").translate(UPPER))
    return [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def resampled_by_loop(rows, target, orders, buckets, percent, least):
    of = lambda texts: collections.Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams_by_loop(t, orders))
    s, t = of(x for _, x in rows), of(x for _, x in target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = []
    for i, text in rows:
        grams = grams_by_loop(text, orders)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in grams)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(grams_by_loop(text, 1)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("orders, percent, least", [(1, 10, 1), (3, 40, 2), (2, 100, 0), (1, 0, 20)])
def test_resampling_equals_a_loop(spark, orders, percent, least):
    df, _ = clashing(spark)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    out = resampling.resampled(df.repartition(5), target, orders, 500, percent, least)
    assert as_rows(out.select("doc_id", "n_features", "weight", "score", "rank")) == resampled_by_loop(ROWS, TARGET, orders, 500, percent, least)


def test_ranks_go_through_all_parts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 40)))) for i in range(3000)]
    out = resampling.resampled(spark.createDataFrame(rows, SCHEMA).repartition(9), spark.createDataFrame(TARGET, "item_id long, text string"), 1, 100, 50, 5)
    assert as_rows(out) == resampled_by_loop(rows, TARGET, 1, 100, 50, 5)


def test_more_buckets_than_a_broadcast_holds_are_refused(odd):
    with pytest.raises(ValueError):
        resampling.resampled(odd, odd, buckets=1 << 21)


# ---- 12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def search_by_loop(rows, items, k):
    own = [(i, collections.Counter(terms(t))) for i, t in rows]
    own = [(i, c) for i, c in own if c]
    n_docs, n_words = len(own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in own:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "Two words, HOT text"), (1, "Two words, HOT text"), (1, "W5x5 cödé"), (2, None), (3, ""), (None, "a lone text"), (4, "nothing of it zzz"), (5, "two two TWO äö"), (6, " ".join(f"w{k}x{k % 31}" for k in range(500)))]


@pytest.mark.parametrize("k, shard, block", [(50, 16_384, 1 << 22), (3, 2, 1 << 22), (5, 40, 200)])
def test_search_equals_a_loop(spark, monkeypatch, k, shard, block):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "BLOCK_CHARS", block)
    df, _ = clashing(spark)
    out = search.search(df.repartition(4), spark.createDataFrame(ITEMS, "item_id long, text string"), k)
    assert as_rows(out) == search_by_loop(ROWS, ITEMS, k)


def test_ties_at_the_cut_go_by_id():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 20))
        scores, ids = rng.integers(0, 4, n), rng.permutation(n)
        want = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], ids[i]))[:k]
        assert search.best(scores, ids, k).tolist() == want


def test_terms_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(search, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))  # by length alone
    v = search.Vocabulary(["ab cd efg", "cd xyz"])
    data, starts, ends, _ = search.words_of(np.frombuffer(b"CD zz efg ab, XYZ abc", np.uint8), np.array([0, 21]))
    at, term = v.terms(data, starts, ends)
    assert dict(zip(at.tolist(), term.tolist())) == {0: 1, 2: 2, 3: 0, 4: 3}


def test_texts_do_not_run_into_each_other():
    data, starts, ends, first = search.words_of(np.frombuffer("abCdé".encode(), np.uint8), np.array([0, 2, 2, 6]))
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", "cdé"] and first.tolist() == [0, 1, 1, 2]


# ---- long texts, and workers that only have what Spark ships


def test_spans_of_a_long_text_take_linear_work(spark):
    from driftline.llm import pii

    piece = "Mail joe@example.com or write to jane (at) example.org. "
    rows = [(0, piece * 4000), *((i, f"contact me at user{i}@example.com or jo{i} (at) example.org") for i in range(1, 39))]
    (long,) = [r for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id == 0]
    assert len(long.found) == 8000  # each plain and each spelled-out address
    ends = [(s.start, s.end) for s in long.found]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_windows_of_an_item_in_a_text_that_repeats_it():
    from driftline.llm.decontam import Index

    rng = random.Random(2)
    item = " ".join(f"w{rng.randrange(10_000)}" for _ in range(400))
    pair = " ".join(item.split()[:6])
    index = Index([1], [item])
    text = (f"{pair} and " * 40_000).encode()  # 280,000 words: the product of hits and the item's words would be 32 million
    assert list(index.search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))) == []
    both = f"{pair} and {item} {pair}".encode()
    (found,) = index.search(np.frombuffer(both, np.uint8), np.array([0, len(both)]))
    assert found[1] == 0 and found[2] == 1.0 and found[3] == 7


def test_workers_need_no_path(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from driftline.llm import search
docs, items = spark.createDataFrame([(1, "two words")], "doc_id long, text string"), spark.createDataFrame([(1, "words")], "item_id long, text string")
print("FOUND", [tuple(r)[:3] for r in search.search(docs, items).collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND [(1, 1, 1)]" in done.stdout, done.stderr[-2000:]
