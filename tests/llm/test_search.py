"""Exact copies, ranked search and periodic runs, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, lexical_search, periodic_runs, queries_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# exact copies


def plain_groups(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        best = keep(named) if named else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        stays = True
        for i in sorted(ids, key=lambda i: i != best):
            out[i, best, len(ids), stays, sha] += 1
            stays = False
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup_equals_plain_groups(docs, rows, keep, fan_in):
    got = exact_dedup.exact_dedup(docs.repartition(7), keep=keep, fan_in=fan_in)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_groups([r[:2] for r in rows], max if keep == "largest" else min)


def test_exact_dedup_of_hot_text_odd_rows_and_text_ids(spark, odd):
    rows = [(f"k{i % 600}", "the same words" if i % 3 else f"own {i % 50}") for i in range(900)] + [(None, "the same words"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(9)
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(df, fan_in=3, shards=5).collect()) == plain_groups(rows)
    assert exact_dedup.exact_dedup(odd).count() == odd.count()
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="largest"):
        exact_dedup.exact_dedup(odd, keep="any")


def test_exact_dedup_of_normalised_texts(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a  B "), (3, "a c")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df, normalise=lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")))
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}


def test_short_digests_that_collide_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    rows = [(i, f"text {i % 4}") for i in range(40)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), fan_in=2)
    assert Counter(tuple(r) for r in got.collect()) == plain_groups(rows)


# ranked search


def plain_search(docs, items, k=10):
    of = lambda t: TERM.findall((t or "").translate(LOWER))
    counted = [(i, Counter(of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(of(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scored[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    plain = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    more = [(9001, "WORT Zwei words"), (9001, "one é́"), (9002, ""), (9003, None), (None, "no id at all"), (9004, "zzzz-unknown")]
    return plain.unionByName(spark.createDataFrame(more, plain.schema)).cache()


@pytest.mark.parametrize("how", [{}, {"width": 2}, {"block_items": 3, "k": 4}])
def test_search_equals_plain_scores(docs, rows, items, how):
    got = lexical_search.lexical_search(docs, items, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain_search([r[:2] for r in rows], [tuple(r) for r in items.collect()], how.get("k", 10))


def test_search_with_ties_text_ids_and_empty_tables(spark, odd, items):
    rows = [(f"d{i:03}", "alpha beta" if i % 2 else "alpha gamma") for i in range(60)] + [("d001", "alpha beta"), (None, "alpha beta")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    asked = spark.createDataFrame([("q", "beta"), ("p", "alpha gamma delta")], "item_id string, text string")
    got = Counter(tuple(r) for r in lexical_search.lexical_search(docs, asked).collect())
    assert got == plain_search(rows, [("q", "beta"), ("p", "alpha gamma delta")])
    assert lexical_search.lexical_search(odd.limit(0), items).count() == 0
    assert lexical_search.lexical_search(odd, items.limit(0)).count() == 0
    assert lexical_search.lexical_search(odd, items).count() > 0


def test_bounds_are_never_below_scores_and_spare_most_of_them():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(60_000)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 60_000, 60)]
    batch = lexical_search.Batch([(str(i), " ".join(rng.sample(words, 8))) for i in range(20)], 10, 256)
    counted = [batch.count(t) for t in texts]
    df = Counter(int(t) for _, own, _ in counted for t in own)
    batch.weigh(len(texts), sum(n for n, _, _ in counted), df)
    best = lexical_search.Best(batch)
    for start in range(0, len(texts), 100):
        part = counted[start : start + 100]
        row = np.repeat(range(len(part)), [len(p[1]) for p in part])
        term, times = (np.concatenate([p[j] for p in part]) for j in (1, 2))
        sizes = np.array([p[0] for p in part])
        impact = batch.impacts(sizes, row, term, times)
        bounds = batch.sketches(len(part), row, term, impact) @ best.lookup
        exact = np.zeros((len(part), len(batch.number)))
        exact[row, term] = impact
        for q, own in enumerate(batch.items):
            assert (bounds[:, q] >= exact[:, own].sum(axis=1)).all()
        best.take(list(range(start, start + len(part))), sizes, row, term, times)
    assert best.scored < 0.5 * best.seen


# periodic runs


def plain_runs(words, least, repeats):
    out = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, repeats * q) and not any(all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_blocks_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 10)):
            n, k = rng.randint(0, 50), rng.choice([1, 2, 2, 3, 5])
            t = [b"w%d" % rng.randrange(k) for _ in range(n)]
            unit = [b"w%d" % rng.randrange(4) for _ in range(rng.randint(1, 9))]
            texts.append(t[: rng.randint(0, n)] + unit * rng.randint(0, 9) + t[rng.randint(0, n) :])
        least, repeats = rng.choice([(6, 4), (6, 4), (2, 2), (4, 2), (10, 3), (20, 2), (40, 4)])
        assert periodic_runs.block_runs(texts, least, repeats) == [plain_runs(t, least, repeats) for t in texts]


def test_runs_of_long_texts():
    assert periodic_runs.block_runs([[b"a"] * 30_000, [b"x", b"y", b"z"] * 9_000 + [b"y"]], 6, 4) == [[(0, 30_000, 1)], [(0, 27_000, 3)]]
    fibonacci = [b"a"], [b"a", b"b"]
    while len(fibonacci[1]) < 1500:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert periodic_runs.block_runs([fibonacci[1]], 4, 2) == [plain_runs(fibonacci[1][:], 4, 2)]


def plain_op11(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 6, 4)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_query_equals_plain_version(spark, docs, rows, tmp_path):
    short = [r for r in rows if len(r[1] or "") < 30_000]
    docs.where(F.coalesce(F.length("text"), F.lit(0)) < 30_000).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries_search.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_op11(*r[:2]) for r in short)


def test_runs_of_odd_rows(spark, odd):
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(odd).collect()}
    assert len(got) == len({r.doc_id for r in odd.select("doc_id").collect()})
    assert got[9001].n_words == 0 and got[9001].collapsed == "" and got[9001].runs == []
    assert [tuple(r) for r in got[9004].runs] == [(0, 24_000, 4)] and got[9004].collapsed == "ab cd. Ef, gh"
    assert [tuple(r) for r in got[9010].runs] == [(0, 40, 1)] and got[9010].collapsed == "Wort"
    assert periodic_runs.periodic_runs(odd).count() == odd.count()
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "x y x y x y x y"), (None, "x " * 9)], "doc_id string, text string")
    assert {(r.doc_id, r.collapsed) for r in periodic_runs.periodic_runs(named).collect()} == {("a", "x y"), (None, "x")}
    with pytest.raises(ValueError, match="periods"):
        periodic_runs.periodic_runs(odd, min_repeats=1)
