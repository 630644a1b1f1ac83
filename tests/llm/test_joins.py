"""Operators that hold documents against others, against plain versions; and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, ngram_join, packing, quality_rules, toxicity
from tidemark.llm.components import components


def sets(text, n):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def brute_components(rows, n, percent):
    """Smallest reachable doc_id and set size of each (doc_id, text)."""
    each = [(i, sets(t, n)) for i, t in rows]
    above = {i: i for i, _ in each if i is not None}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for k, (i, a) in enumerate(each):
        for j, b in each[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b) and top(i) != top(j):
                above[max(top(i), top(j))] = min(top(i), top(j))
    return sorted((str(i), len(s), str(top(i)) if i is not None else "None") for i, s in each)


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(docs, odd, rows, n, percent):
    assert found(ngram_join.ngram_components(docs, n=n, percent=percent)) == brute_components([(i, t) for i, t, *_ in rows], n, percent)
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0
    assert ngram_join.ngram_components(odd).count() == odd.count()


def planted(seed: int):
    """Chains and crowds of near copies, passages that many share, and one id with two texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    out = [(k, " ".join(base)) for k in (500, 501, 502)]
    for k in range(80):  # a crowd
        near = base[:]
        near[rng.randrange(120)] = word()
        out.append((600 + k, " ".join(near)))
    step = base[:]
    for k in range(12):  # a chain
        step = step[:]
        step[-1 - k] = word()
        out.append((900 + k, " ".join(step)))
    passage = [word() for _ in range(60)]
    for k in range(100):  # a shared passage
        out.append((2000 + k, " ".join([word() for _ in range(rng.randrange(0, 90))] + passage)))
    out += [(3000, "x y"), (3001, "X  Y"), (3002, "x"), (500, "p q r s"), (3003, "p q r s")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("frequent", [8, 64])
def test_ngram_join_on_planted_groups(spark, frequent):
    rows = planted(frequent)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(ngram_join.ngram_components(df, frequent=frequent)) == brute_components(rows, 3, 90)


@pytest.mark.parametrize("pairs", [0, 1 << 40])
def test_ngram_join_on_one_template(spark, pairs, monkeypatch):
    """Documents of one template with few and many words of their own: some link by chance, most don't."""
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)  # 0: leads are drawn again and again; else all pairs with room at once
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    template = [word() for _ in range(160)]
    rows = []
    for k in range(150):
        text = template[:]
        for at in rng.sample(range(160), rng.choice([1, 2, 3, 5])):
            text[at] = word()
        rows.append((k, " ".join(text[: rng.choice([150, 155, 160])])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(ngram_join.ngram_components(df, frequent=16)) == brute_components(rows, 3, 90)


def test_keep_one(spark, docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and None in ids
    expected = {r.doc_id for r in ngram_join.ngram_components(docs).collect() if r.doc_id == r.component_id}
    assert set(ids) == expected


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(1, 41)}, 100: 90, 95: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_finds_all_and_nothing_else(spark, docs, odd):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.choice([6, 15, 33, 58, 300])))) for k in range(60)] + [(70, "tiny item"), (71, None), (72, ""), (72, "")]
    text = dict(items)
    out = [(k, f"{' '.join(word() for _ in range(40))} {text[k].upper().replace(' ', ', ')} {' '.join(word() for _ in range(30))}") for k in range(60)]
    near = text[2].split()
    near[-1] = "changed"
    out += [(100, "start " + " ".join(near) + " end words"), (101, text[5]), (102, None), (103, ""), (104, " ".join(word() for _ in range(500))), (105, text[7] + " " + text[7]), (105, text[7])]
    df = spark.createDataFrame([(*r, 1) for r in out], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.decontamination(df, bench).collect()}
    want = {(k, k) for k in range(60)} | {(101, 5), (105, 7)}
    assert want <= set(got) and set(got) - want <= {(100, 2)}
    assert all(got[p] == 1.0 for p in want)
    few = {(r.doc_id, r.item_id) for r in decontamination.decontamination(df, bench, slice_items=9).collect()}
    assert few == set(got)
    assert decontamination.decontamination(docs, bench.limit(0)).count() == 0
    assert decontamination.decontamination(df.limit(0), bench).count() == 0
    assert decontamination.decontamination(odd, bench).count() == 0
    assert {r.doc_id for r in decontamination.keep_unseen(df, bench).collect()} >= {102, 103, 104}


def test_decontamination_finds_near_copies(spark):
    """Copies edited at the edges or in one place, against the similarity of plain shingle multisets, with ids as text."""
    from collections import Counter

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopq") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (14, 14, 16, 19, 22, 25, 31, 40, 48, 55, 63, 80, 120, 200, 400) for _ in range(4)]
    shingled = lambda ws: Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    docs, want = [], set()
    for k, ws in enumerate(items):
        for _ in range(12):
            near, first, last = ws[:], rng.randrange(0, 4), rng.randrange(0, 4)
            near[:first], near[len(near) - last :] = [word() for _ in range(first)], [word() for _ in range(last)]
            if rng.random() < 0.4:
                near, length, at = ws[:], rng.randrange(1, max(2, len(ws) // 10)), rng.randrange(len(ws))
                near[at : at + length] = [word() for _ in range(rng.randrange(0, length + 1))]
            a, b = shingled(ws), shingled(near)
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                want.add((f"d{len(docs)}", f"i{k}"))
            docs.append((f"d{len(docs)}", " ".join([word() for _ in range(30)] + near + [word() for _ in range(30)])))
    got = decontamination.decontamination(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(f"i{k}", " ".join(ws)) for k, ws in enumerate(items)], "item_id string, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(want) > 250 and want <= found
    assert all(int(i[1:]) == int(d[1:]) // 12 for d, i in found)


def test_hamming_search_is_complete():
    import numpy as np

    rng = np.random.default_rng(5)
    marks = rng.integers(0, 2**63, 50, dtype=np.uint64)
    band = decontamination.Band([(int(m), i, 0) for i, m in enumerate(marks)])
    windows = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for k in range(200):  # within reach of a mark
        flips = rng.choice(64, rng.integers(0, decontamination.RADIUS + 1), replace=False)
        windows[k] = marks[k % 50] ^ np.bitwise_or.reduce(np.array([1 << int(b) for b in flips] or [0], np.uint64))
    at, mark, distance = band.search(windows)
    want = {(i, j) for i in range(400) for j in range(50) if int(windows[i] ^ marks[j]).bit_count() <= decontamination.RADIUS}
    assert set(zip(at.tolist(), mark.tolist())) == want and (distance <= decontamination.RADIUS).all()


def test_pipeline_stages_on_odd_rows(spark, odd, sf_dir):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    extra = plain.withColumn("length", F.lit("x")).withColumn("component", F.lit(1)).withColumn("centre", F.lit(2.0))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (extra, extra.limit(0), extra.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))):
            got = stage(spark, docs, sf_dir)
            if name == "best_fit_packing":
                assert got.select("doc_id", "piece").count() >= docs.count()
            else:
                assert got.columns == docs.columns and got.exceptAll(docs).count() == 0


def test_pipeline_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = [tuple(r) for r in docs.collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = spark.createDataFrame(left, docs.schema)
        after = stage(spark, before, sf_dir)
        assert after.columns == columns
        rows = [tuple(r) for r in after.collect()]
        assert set(rows) <= set(left), name
        if name == "ngram_jaccard_join":
            want = {i for i, _, c in brute_components([(r[0], r[1]) for r in left], 5, 80) if i == c}
            assert {str(r[0]) for r in rows} == want
        if name == "quality_rules":
            bad = {r.doc_id for r in quality_rules.quality_rules(before).where("not kept").collect()}
            assert {r[0] for r in rows} == {r[0] for r in left} - bad
        if name == "benchmark_decontamination":
            items = [r.text.lower() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            held = {r[0] for r in left if any(t in r[1].lower() for t in items)}
            assert not held & {r[0] for r in rows} and len(rows) >= len(left) - len(held) - 2
        left = rows
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r[0] for r in left}
    from tidemark.llm.queries_text import tokenizer_path

    assert packed.count() == packing.pieces(spark.createDataFrame(left, docs.schema), tokenizer_path("byte_bpe_50k.json")).count()


def test_ids_that_are_text(spark, docs, labels, sf_dir):
    name = F.when(F.col("doc_id").isNotNull(), F.format_string("k%08d", "doc_id"))
    named, told = docs.withColumn("doc_id", name), labels.withColumn("doc_id", F.format_string("k%08d", "doc_id"))
    plain = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).withColumns({c: F.when(F.col(c).isNotNull(), F.format_string("k%08d", c)) for c in ("doc_id", "component_id")}).collect()}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(named).collect()} == plain
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for kept, same in (
        (quality_rules.keep_clean(named), quality_rules.keep_clean(docs)), (decontamination.keep_unseen(named, benchmark), decontamination.keep_unseen(docs, benchmark)),
    ):
        assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, same.withColumn("doc_id", name).collect()))
    civil = toxicity.keep_civil(named, told)
    assert civil.columns == docs.columns and 0.8 * docs.count() < civil.count() < docs.count()
    one = ngram_join.keep_one(named, n=5, percent=80)
    assert one.count() == ngram_join.keep_one(docs, n=5, percent=80).count()


def test_decontamination_of_scattered_edits(spark):
    """Copies with words changed all over: of those whose plain similarity is 0.8 or more at least 95 in 100 are found, and nothing below."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopq") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (40, 60, 90, 140, 220, 400) for _ in range(5)]
    shingled = lambda ws: Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    docs, want = [], set()
    for k, ws in enumerate(items):
        for _ in range(10):
            near = ws[:]
            for at in rng.sample(range(len(ws)), max(1, len(ws) // 60)):
                near[at] = word()
            a, b = shingled(ws), shingled(near)
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                want.add((len(docs), k))
            docs.append((len(docs), " ".join([word() for _ in range(20)] + near + [word() for _ in range(20)])))
    got = decontamination.decontamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(items)], "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(want) > 200 and len(want & found) >= 0.95 * len(want)
    assert all(i == d // 10 for d, i in found)


def test_decontamination_weighs_shingles_as_a_plain_sum_does(spark):
    """Similarities of all reported windows against weighted multisets of word shingles; a shingle of many items counts less."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopq") for _ in range(6))
    common = [word() for _ in range(12)]
    items = [[word() for _ in range(20)] + common + [word() for _ in range(20)] for _ in range(30)]
    docs = []
    for k, ws in enumerate(items):
        near = ws[:]
        near[rng.choice((0, 1, 50, 51))] = word()
        docs.append((k, " ".join([word() for _ in range(9)] + near + [word() for _ in range(9)])))
    index = decontamination.Items([(str(k), " ".join(ws)) for k, ws in enumerate(items)], 5, 0.8)
    got = decontamination.decontamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(30)}
    bags = [Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) for ws in items]
    holders = Counter(s for b in bags for s in b)
    by_hash = {s: index.rarity[next(iter(decontamination.shingles(decontamination.hashes(list(s)), 5)))] for s in holders}
    assert len({round(v, 12) for s, v in by_hash.items() if holders[s] == 1}) == 1  # one weight for each number of items
    assert min(v for s, v in by_hash.items() if holders[s] == 1) > max(v for s, v in by_hash.items() if holders[s] == 30)
    for r in got:
        ws = docs[r.doc_id][1].split()[r.start : r.start + r.n_words]
        a, b = bags[r.item_id], Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        weight = lambda s: by_hash.get(s, index.unseen)
        both = sum(min(a[s], b[s]) * weight(s) for s in a if s in b)
        every = sum(n * weight(s) for s, n in a.items()) + sum(n * weight(s) for s, n in b.items()) - both
        assert r.similarity == pytest.approx(both / every, abs=1e-9) and r.similarity >= 0.8


def test_windows_counted_in_bytes_have_the_same_fingerprints():
    h = np.random.default_rng(7).integers(0, 1 << 64, 900, np.uint64)
    h[300:620] = h[300]  # every count of these windows is 0 or the window's size
    for size in (1, 2, 10, 254, 255):
        assert decontamination._kind(size) == np.uint8
        assert np.array_equal(decontamination.fingerprints(decontamination.running_ones(h, np.uint8), size), decontamination.fingerprints(decontamination.running_ones(h), size))
    assert decontamination._kind(256) == np.uint16


def test_words_of_a_batch_are_hashed_as_those_of_each_text():
    texts = ["A, b--C! ... 'x' ΑΣ. ΑΣ'Β İx", None, "", " -- ", "E.g. a b\tc\n", "...a"]
    index = decontamination.Items([("i", "one two three")], 5, 0.8)
    seen = []
    index.candidates = lambda h, edges: seen.append((h.tolist(), edges.tolist())) or []
    index.matches(texts, 0.8)
    words = [decontamination.plain_words(t) for t in texts]
    assert seen == [(decontamination.hashes([w for ws in words for w in ws]).tolist(), [0, *np.cumsum([len(ws) for ws in words]).tolist()])]


def test_ones_and_searches_equal_plain_loops():
    rng = np.random.default_rng(3)
    for n in (1, 31, 32, 33, 300):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1).astype(np.uint16)
        assert np.array_equal(decontamination.running_ones(h), np.concatenate((np.zeros((1, 64), np.uint16), np.cumsum(bits, 0, dtype=np.uint16))))
    marks = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    flipped = [int(m) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k, m in zip(list(range(10)) * 6, marks)]
    windows = np.array([*flipped, *rng.integers(0, 1 << 63, 2000).tolist()], np.uint64)
    band = decontamination.Band([(int(m), i, -i) for i, m in enumerate(marks)])
    want = [(w, m, d) for w, x in enumerate(windows.tolist()) for m, y in enumerate(marks.tolist()) if (d := (x ^ y).bit_count()) <= decontamination.RADIUS]
    assert list(zip(*(p.tolist() for p in band.search(windows)))) == want and len(want) >= 40
    assert [len(p) for p in band.search(windows[:0])] == [0, 0, 0]
