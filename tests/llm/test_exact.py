"""Perfect-hash deduplication, entropy-balanced mixing and minimax shards."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from tabsieve.llm import entropy, minimax, perfect_hash, queries, sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, digest string"
TEXTS = [
    (0, "a b", None, "s", 3, 7, "x", "y"),
    (1, " ab ", "en", "s", None, None, None, None),
    (2, "a\tb\n", "en", None, 3, 7, "x", "y"),
    (3, None, "en", "t", 3, 7, "x", "y"),
    (4, "", "en", "t", 3, 7, "x", "y"),
    (5, "é " * 50_000, "fr", "u", 3, 7, "x", "y"),
    (6, "other words here", "fr", "u", 3, 7, "x", "y"),
    (6, "other words here", "fr", "u", 3, 7, "x", "y"),
    (None, "other words here", "fr", "u", 3, 7, "x", "y"),
    (None, "lone", "fr", None, 3, 7, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(TEXTS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 3000):
        digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        salt, pilots, slots = perfect_hash.build_perfect_hash(digests)
        assert sorted(slots) == list(range(n))
        assert (perfect_hash.perfect_slots(digests, salt, pilots, n) == slots).all()


def test_dedup_matches_sql(spark):
    con = compare.connect(FOLDER)
    name = "op5_perfect_hash_dedup"
    assert compare.spark_rows(queries.QUERIES[name](spark, FOLDER)) == compare.duck_rows(con, sql.ORACLE[name])


def test_dedup_odd_rows(odd, none):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in perfect_hash.exact_duplicates(odd).collect()]
    assert Counter(got) == Counter(
        [
            (0, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True),
            (6, 6, 3, True), (6, 6, 3, True), (None, 6, 3, False), (None, None, 1, True),
        ]
    )
    assert perfect_hash.exact_duplicates(none).count() == 0


def test_members_and_others_are_grouped(spark):
    def rows(values):
        made = [(i, i, bytearray(hashlib.sha256(t.encode()).digest()), n) for i, t, n in values]
        return spark.createDataFrame(made, "doc_id long, text_hash long, digest binary, chars long")

    history = rows([(1, "a", 5), (2, "b", 5), (9, "a", 5)])
    incoming = rows([(3, "a", 6), (4, "c", 1), (5, "c", 1), (0, "b", 5)])
    got = {(r.keep_id, r.group_size, r.member) for r in perfect_hash.deduplicate(history, incoming).collect()}
    assert got == {(3, 3, True), (0, 2, True), (4, 2, False)}
    got = {(r.keep_id, r.group_size, r.member) for r in perfect_hash.deduplicate(history.limit(0), incoming).collect()}
    assert got == {(3, 1, False), (0, 1, False), (4, 2, False)}


def sizes(rows):
    return [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows]


def brute_targets(found):
    total = defaultdict(int)
    for _, source, n in found:
        total[source] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, left, target = set(), 1.5 * sum(total.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            return total, target | share
        for s in over:
            full.add(s)
            target[s] = 2.0 * total[s]
            left -= target[s]


@pytest.mark.parametrize("folder", [FOLDER, FOLDER.replace("0.001", "0.01")])
def test_mix_meets_its_targets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = sizes(docs.collect())
    total, target = brute_targets(found)
    got = {r.doc_id: r for r in entropy.mix(docs).collect()}
    assert len(got) == len(found)
    taken, largest = defaultdict(int), defaultdict(int)
    for i, s, n in found:
        r = got[i]
        assert (r.size, r.source_size) == (n, total[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * n
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)
    assert {r.doc_id: r.taken for r in entropy.mix(docs.repartition(7)).collect()} == {i: r.taken for i, r in got.items()}


def test_rates_are_exponentially_tilted(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    by_source = defaultdict(list)
    for r in entropy.mix(docs).collect():
        by_source[source[r.doc_id]].append(r)
    for rows in by_source.values():
        open_ = [r for r in rows if 0.01 < r.rate < 2 and r.size]
        slopes = [np.log(r.rate) / r.size for r in open_]
        assert not open_ or np.ptp(slopes) < 0.01 * abs(np.mean(slopes)) + 1e-6
        expected = sum(r.rate * r.size for r in rows)
        assert expected == pytest.approx(rows[0].target, rel=1e-4)


def test_mix_odd_rows(odd, none):
    got = entropy.mix(odd).collect()
    assert len(got) == len(TEXTS)
    assert {r.size for r in got if r.doc_id in (3, 4)} == {0}
    assert all(r.taken <= 2 * r.size for r in got)
    assert entropy.mix(none).count() == 0


def greedy(sizes_, capacity):
    shards, room = 1, capacity
    for s in sizes_:
        if s > capacity:
            return 10**9
        if s > room:
            shards, room = shards + 1, capacity
        room -= s
    return shards


def brute_capacity(sizes_, shards):
    low, high = 0, sum(sizes_)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(sizes_, middle) <= shards else (middle + 1, high)
    return low


def check_shards(rows, got, shards):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append((r.doc_id, len((r.text or "").encode()) + 1))
    order = sorted(groups.items(), key=lambda g: (min(i if i is not None else 10**9 for i, _ in g[1]), hashlib.sha256(g[0].encode()).digest()))
    best = brute_capacity([sum(n for _, n in g) for _, g in order], shards)
    held = Counter()
    for r in got:
        held[r.shard] += r.size
    assert max(held.values()) == best or sum(held.values()) == best
    for shard in held:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_shards_are_minimax(spark):
    rows = documents(spark)
    got = minimax.balanced_shards(spark.read.parquet(f"{FOLDER}/documents.parquet"), 16).collect()
    text = {r.doc_id: r.text or "" for r in rows}
    assert len(got) == len(rows)
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    shard = {}
    assert all(shard.setdefault(text[r.doc_id], r.shard) == r.shard for r in got)
    check_shards(rows, got, 16)


@pytest.mark.parametrize("shards", [1, 2, 3, 5, 16])
def test_shards_odd_rows(spark, shards):
    rows = [r for r in spark.createDataFrame(TEXTS, DOCS).collect() if r.doc_id is not None]
    got = minimax.balanced_shards(spark.createDataFrame(rows, DOCS), shards).collect()
    check_shards(rows, got, shards)


def test_shards_of_missing_ids_and_nothing(odd, none):
    assert minimax.balanced_shards(odd, 4).count() == len(TEXTS)
    assert minimax.balanced_shards(none, 4).count() == 0


def test_last_shard_smaller_than_capacity_less_the_largest(spark):
    sizes = [10, 10, 1]
    ends = spark.createDataFrame([(sum(sizes[: k + 1]), n) for k, n in enumerate(sizes)], "end long, size long")
    assert minimax._fill(ends, 10, [20], 2) == [[20, 21]]


def test_large_delivery_to_an_empty_store_is_split(spark, monkeypatch):
    monkeypatch.setattr(perfect_hash, "BUCKET_KEYS", 10)
    dealt, bucket = [], perfect_hash._bucket
    monkeypatch.setattr(perfect_hash, "_bucket", lambda n: dealt.append(n) or bucket(n))
    rows = perfect_hash.text_digests(spark.createDataFrame([(k, f"text {k}") for k in range(95)], "doc_id long, text string"))
    assert perfect_hash.deduplicate(rows.limit(0), rows).count() == 95
    assert set(dealt) == {10}


def test_shares_of_very_large_groups(spark):
    n, every, unit = 3 * 10**9 + 7, 5 * 10**9 + 11, entropy.UNIT
    rows = [(p, 1, n, every, 0, 0) for p in (1, 2, n // 2, n - 1, n)]
    rows += [(1, 1, n, 0, 10**18 + unit * k + 7, 2 * 10**6 * k) for k in (1, 3, 10**9)]
    df = spark.createDataFrame(rows, "place long, first long, n long, `all` long, upto long, rate long").withColumn("n", F.when(F.col("rate") > 0, 1).otherwise(F.col("n")))
    dealt = entropy._dealt("place - first + 1") - entropy._dealt("place - first")
    for r in df.select("*", dealt.alias("d"), entropy._copies(F.lit(31)).alias("c")).collect():
        if not r.rate:
            assert r.d == r.place * every // n - (r.place - 1) * every // n
        else:
            assert r.c == (r.upto + 31) // unit - (r.upto + 31 - r.rate) // unit
