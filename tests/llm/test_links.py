"""Near-duplicate joins, vector links, components and the pipeline."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from tabsieve.llm import chosen_path, multi_index
from tabsieve.llm.components import connected_components


def parts_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    links += [(2000, 2000 + k) for k in range(1, 200)]
    wanted = parts_of({x for p in links for x in p}, links)
    wanted = {n: c for n, c in wanted.items() if any(n in p for p in links if p[0] != p[1])}
    made = connected_components(spark.createDataFrame([*links, (None, 5), (5, None)], "a long, b long"), "test")
    assert {r.node: r.component for r in made.collect()} == wanted
    assert made.count() == len(wanted)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


# Texts


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                links.append((j, i))
    return links


def check_links(rows, got):
    links = brute_links(rows)
    classes = parts_of(range(len(rows)), links)
    degree = defaultdict(int)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and len(by_id) == len(rows)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[classes[k]] = min(i, first.get(classes[k], i))
    for k, (i, _) in enumerate(rows):
        r = by_id[i]
        assert (r.n_links, r.class_id, r.kept) == (degree[k], first[classes[k]], i == first[classes[k]])


def variants(seed, n, words, changes):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = f"v{rng.randint(0, 10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("sizes", [None, (4, 60, 25), (64, 16_384, 1_024, 1)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, sizes):
    """Also with small buckets and blocks, by rows or shingles, so that groups are split and dealt."""
    if sizes:
        for name, size in zip(("SMALL_BUCKET", "SKETCH_BLOCK", "TEXT_BLOCK", "TEXT_SHINGLES"), sizes, strict=False):
            monkeypatch.setattr(chosen_path, name, size)
    passage = " ".join(f"p{k}" for k in range(60))
    rng = random.Random(9)
    rows = [t for k in range(3) for t in variants(k, 70, 120, 9)]
    rows += [passage + " " + " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(200)) for _ in range(80)]
    rows += ["", None, "a b", "a  b\n", "a b c d e f", "x " * 30_000, "x " * 20_000] + [rows[0]] * 5
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "c", 1, "s") for i, t in rows], "doc_id long, text string, set string, links int, class_id string")
    check_links(rows, chosen_path.near_duplicates(docs).collect())


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check_links([(r.doc_id, r.text) for r in docs.collect()], chosen_path.near_duplicates(docs).collect())


def test_near_duplicates_odd_ids(spark):
    text = variants(5, 1, 50, 0)[0]
    rows = [(None, text), (None, "lone one"), (7, text + " x"), (7, text), (7, text), (3, "other")]
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in got) == [(-1, -1, 0), (-1, 7, 3), (3, 3, 0), (7, 7, 3), (7, 7, 3), (7, 7, 3)]
    assert {(r.doc_id, r.text_hash) for r in got if r.kept and r.class_id == 7}.__len__() == 1
    assert chosen_path.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Vectors


def brute_vectors(rows, similarity=0.9):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in rows if v), default=0)
    x = np.zeros((len(good), width))
    for at, k in enumerate(good):
        v = np.array(rows[k][1], float)
        x[at, : len(v)] = v / np.abs(v).max()
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= similarity
    return [(good[i], good[j]) for i in range(len(good)) for j in range(i) if near[i, j]]


def test_vector_recall(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(900, 32))
    base[600:] = base[rng.integers(0, 600, 300)] + rng.normal(size=(300, 32)) * 0.44
    rows = [(k, [float(y) for y in v]) for k, v in enumerate(base.astype(np.float32))]
    got = {r.vec_id: r for r in multi_index.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    links, degree = brute_vectors(rows), defaultdict(int)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    assert len(links) > 100 and all(got[k].n_links <= degree[k] for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.95 * 2 * len(links)


def test_vectors_of_one_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 40)
    monkeypatch.setattr(multi_index, "TILE", 16)
    rng = np.random.default_rng(2)
    center = rng.normal(size=16)
    rows = [list(map(float, center + rng.normal(size=16) * 0.2)) for _ in range(150)]
    rows += [list(map(float, rng.normal(size=16))) for _ in range(150)]
    rows += [rows[0]] * 30 + [[2 * x for x in rows[0]]]
    rows += [None, [0.0] * 16, [float("nan")] * 16, [None, *[1.0] * 15], [float("inf"), *[0.0] * 15], [], [1e308] * 16, [1e308] * 15 + [9e307], [-0.0] + rows[0][1:]]
    rows = list(enumerate(rows))
    got = {r.vec_id: r for r in multi_index.link_vectors(spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, component long"), recall=1.0).collect()}
    links, degree = brute_vectors(rows), defaultdict(int)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    parts = parts_of(range(len(rows)), links)
    assert len(got) == len(rows)
    for k in got:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (degree[k], parts[k], parts[k] == k)


def test_vectors_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert multi_index.link_vectors(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, None)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in multi_index.link_vectors(spark.createDataFrame(rows, kind)).collect())
    assert got == [(-1, 2, 4), (4, 2, 4), (4, 2, 4), (5, 0, 5)]


# Pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, FOLDER)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()

    text = {r.doc_id: r.text or "" for r in docs.collect()}
    once = stages["exact dedup"](spark, docs, FOLDER)
    best = {}
    for i in sorted(text):
        key = re.sub(r"[\x20\x09-\x0D]", "", text[i])
        if key not in best or len(text[i]) > len(text[best[key]]):
            best[key] = i
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(best.values())

    near = stages["n-gram Jaccard join"](spark, once, FOLDER)
    left = sorted(best.values())
    parts = parts_of(range(len(left)), brute_links([(i, text[i]) for i in left]))
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted({left[p] for p in parts.values()})

    mixed = stages["mixing sources to target weights"](spark, near, FOLDER)
    assert mixed.columns == columns
    counts = mixed.groupBy("doc_id").count()
    assert counts.agg(F.max("count")).first()[0] <= 2 and counts.join(near, "doc_id", "left_anti").count() == 0
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
    assert words(mixed) == pytest.approx(1.5 * words(near), rel=0.02)

    last = stages["BPE encoding and decoding"](spark, mixed, FOLDER)
    assert last.count() == mixed.count() and {"doc_id", "n_tokens", "ids_sha256"} <= set(last.columns)


def test_pipeline_of_repeated_and_missing_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string"
    rows = [(1, "a b c", "en", "s", 5, "x"), (1, "a b c", "en", "s", 5, "x"), (None, None, None, None, None, None), (2, "ab c", "en", None, 4, "y")]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, FOLDER)
        assert made.columns == docs.columns, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        if name == "exact dedup":
            assert sorted(r.doc_id or 0 for r in made.collect()) == [0, 1]


def test_sketches_of_a_pair_at_the_threshold():
    import math

    for alike, linked in ((36, True), (35, False)):
        sketch = np.zeros((2, chosen_path.SKETCH), np.int64)
        sketch[1, alike:] = 1
        assert (chosen_path._sketch_roots(sketch)[1] == 0) == linked
    assert sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(36)) < 5e-6
