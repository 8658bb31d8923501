"""Exact deduplication against a minimal perfect hash of earlier digests.

The index covers the distinct digests of the documents already held. Digests
are dealt to buckets by a hash; each bucket is one row with a
minimal perfect hash (hash and displace) and, slot by slot, the full digest, the
place of the winner, its length and the number of its copies. Incoming digests
are looked up in their bucket and compared byte by byte; those that are not
members are grouped among themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.tables import BLANKS, whole_text
from tabsieve.plans.held import hold

#: Digests for each bucket, on average; buckets are even because digests are.
BUCKET_KEYS = 20_000
#: Keys for each pilot value.
PILOT_KEYS = 4
_NO_ID = (1 << 63) - 1
_INDEX = "bucket int, salt int, pilots binary, digests binary, chars binary, ids binary, texts binary, copies binary"
_FOUND = "digest binary, chars long, id long, text long, copies long, member boolean"


def text_digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, digest, chars)``: SHA-256 of the text without blanks, and
    the code points of the whole text. A missing text is empty."""
    plain = whole_text()
    for blank in BLANKS:
        plain = F.replace(plain, F.lit(blank), F.lit(""))
    return docs.select(
        "doc_id",
        F.xxhash64(whole_text()).alias("text_hash"),
        F.unhex(F.sha2(plain, 256)).alias("digest"),
        F.length(whole_text()).cast("long").alias("chars"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: best ``(chars, id, text)`` and number of copies."""
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("i"), F.col("text_hash").alias("t")))
    return rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("copies")).select(
        "digest", (-F.col("b.c")).alias("chars"), F.col("b.i").alias("id"), F.col("b.t").alias("text"), "copies"
    )


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _hashes(digests: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash that chooses a pilot, and the one that the pilot mixes."""
    words = digests.view("<u8").reshape(len(digests), 4)
    return words[:, 1] ^ np.uint64(salt), words[:, 2] ^ np.uint64(salt << 40)


def build_perfect_hash(digests: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """``(salt, pilots, slots)`` for an ``n x 32`` array of distinct digests:
    ``slots`` is a permutation of 0..n-1. A pilot below zero names its only
    key's slot."""
    n = len(digests)
    for salt in range(1000):
        head, start = _hashes(digests, salt)
        groups = -(-n // PILOT_KEYS)
        of = (head % np.uint64(groups)).astype(np.int64)
        sizes = np.bincount(of, minlength=groups)
        by_group = np.argsort(of, kind="stable")
        begins = np.concatenate(([0], np.cumsum(sizes)))
        pilots, slots = np.zeros(groups, np.int64), np.full(n, -1, np.int64)
        free, placed = np.ones(n, bool), True
        for g in np.argsort(-sizes, kind="stable"):
            if sizes[g] < 2:
                break
            keys = by_group[begins[g] : begins[g + 1]]
            pilot = _find_pilot(start[keys], free)
            if pilot < 0:
                placed = False
                break
            at = _slot(start[keys], np.array([pilot], np.uint64), n)
            pilots[g], slots[keys] = pilot, at
            free[at] = False
        if placed:
            alone = by_group[begins[:-1][sizes == 1]]
            slots[alone] = np.flatnonzero(free)[: len(alone)]
            pilots[of[alone]] = -1 - slots[alone]
            return salt, pilots, slots
    raise ValueError("no perfect hash found: digests repeat")


def _slot(start: np.ndarray, pilot, n: int) -> np.ndarray:
    x = start ^ (pilot * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def _find_pilot(start: np.ndarray, free: np.ndarray) -> int:
    """The first pilot that sends all keys to different free slots, or -1."""
    n, first, width = len(free), 0, 64
    while first < 1 << 20:
        at = _slot(start[:, None], np.arange(first, first + width, dtype=np.uint64), n)
        ordered = np.sort(at, axis=0)
        fits = free[at].all(axis=0) & (ordered[1:] != ordered[:-1]).all(axis=0)
        if fits.any():
            return first + int(fits.argmax())
        first, width = first + width, min(4096, width * 2)
    return -1


def perfect_slots(digests: np.ndarray, salt: int, pilots: np.ndarray, n: int) -> np.ndarray:
    """The one slot where each digest can be."""
    head, start = _hashes(digests, salt)
    pilot = pilots[(head % np.uint64(len(pilots))).astype(np.int64)]
    moved = _slot(start, np.maximum(pilot, 0).astype(np.uint64), n)
    return np.where(pilot < 0, -1 - pilot, moved)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), 32)


def _pack(bucket: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(bucket["digest"])
    salt, pilots, slots = build_perfect_hash(digests)
    at = np.argsort(slots)
    packed = [bucket[c].to_numpy(np.int64)[at].tobytes() for c in ("chars", "id", "text", "copies")]
    row = (int(bucket["bucket"].iloc[0]), salt, pilots.tobytes(), digests[at].tobytes(), *packed)
    return pd.DataFrame([row], columns=["bucket", "salt", "pilots", "digests", "chars", "ids", "texts", "copies"])


def build_index(rows: DataFrame, buckets: int) -> DataFrame:
    """The index over the digests of ``rows``: one row for each bucket."""
    return _grouped(rows).withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(_pack, _INDEX)


def _look_up(incoming: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Members get the better winner and both counts; index entries that nothing
    asked for, and digests that are not members, pass as they are."""
    mine, out = incoming.drop(columns="bucket").assign(member=False), []
    for entry in index.itertuples(index=False):
        held = np.frombuffer(entry.digests, np.uint8).reshape(-1, 32)
        chars, ids, texts, copies = (np.frombuffer(x, np.int64).copy() for x in (entry.chars, entry.ids, entry.texts, entry.copies))
        if len(mine):
            asked = _matrix(mine["digest"])
            slots = perfect_slots(asked, entry.salt, np.frombuffer(entry.pilots, np.int64), len(held))
            same = (held[slots] == asked).all(axis=1)
            at, hit = slots[same], mine[same]
            new = [hit[c].to_numpy(np.int64) for c in ("chars", "id", "text")]
            # More code points, then the smaller id, then the smaller hash.
            better = new[0] > chars[at]
            better |= (new[0] == chars[at]) & ((new[1] < ids[at]) | ((new[1] == ids[at]) & (new[2] < texts[at])))
            for column, values in zip((chars, ids, texts), new, strict=True):
                column[at] = np.where(better, values, column[at])
            copies[at] += hit["copies"].to_numpy(np.int64)
            mine = mine[~same]
        out.append(pd.DataFrame({"digest": [x.tobytes() for x in held], "chars": chars, "id": ids, "text": texts, "copies": copies, "member": True}))
    return pd.concat([mine, *out])[["digest", "chars", "id", "text", "copies", "member"]]


def deduplicate(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Winners of the texts of two ``(doc_id, text_hash, digest, chars)`` tables:
    ``(digest, keep_id, keep_text, group_size, member)``, one row for each distinct
    digest; ``member`` tells those that the index holds.

    Copies are summed before anything moves, so a digest with a third of all
    rows counts as one key; buckets are even because digests are. Ties go to
    the smallest id, then the smallest hash of the text; a missing id comes last.
    """
    buckets = max(1, -(-max(history.count(), incoming.count()) // BUCKET_KEYS))
    index = build_index(history, buckets)
    asked = _grouped(incoming).withColumn("bucket", _bucket(buckets))
    found = asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_look_up, _FOUND)
    keep = F.when(F.col("id") != _NO_ID, F.col("id"))
    return found.select("digest", keep.alias("keep_id"), F.col("text").alias("keep_text"), F.col("copies").alias("group_size"), "member")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, digest, keep_id, group_size, kept)`` for each row of ``docs``.

    A half of the rows, by a hash of the id, plays the store that was indexed
    earlier and the other half the new delivery; the result is the same for
    any division. Missing texts are empty, empty texts equal each other. Rows
    that repeat an id and a text share ``kept``. An empty table gives none.
    """
    rows = hold(text_digests(docs), "digests")
    earlier = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    winners = deduplicate(rows.where(earlier), rows.where(~earlier))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_text"))
    return rows.join(winners, "digest").select("doc_id", "text_hash", "digest", "keep_id", "group_size", kept.alias("kept"))
