"""Personal data by pattern, and terms of the same documents that give them away.

Patterns find e-mail addresses, network addresses, card and phone numbers. Each
value found is a protected entity. In how many documents a term and the entity
stand together, against how often both occur in the corpus, is their pointwise
mutual information; a term that tells nearly all of what the entity's own rarity
tells reveals it. Wherever they stand in the documents of that entity, such
terms are generalised to a beginning that reveals less, or removed if that
reveals as much.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.tables import join_with_nulls, whole_text
from tabsieve.plans.held import hold
from tabsieve.plans.lookup import BROADCAST_BYTES, HOT_SHARE, lookup, measured_bytes

#: Kinds in the order of reports. Fixed values, as are the patterns.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A number starts where its digits start: the leftmost match always does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SPACED = re.compile(r"\S+")
_MARKS = ".,;:!?\"'()[]{}<>*#$%&|/\\-_…«»“”„"

#: A term reveals an entity if it tells this part of the entity's information.
DISCLOSURE = 0.95
#: A term's documents count as so many more, in which the entity is as frequent as
#: anywhere: what few documents say is shrunk towards no information.
SHRINK = 0.25
#: Letters that stay of a generalised term.
GENERAL = 3
#: Partial counts that a task holds.
COUNTED = 200_000
#: A document with more pairs of a term and a profile is dealt out by its profiles.
PAIRS_AT_ONCE = 1 << 20

_SPANS = "array<struct<kind: int, start: int, end: int>>"
_MARKED = "array<struct<start: int, end: int, action: string>>"
_KEY = ["doc_id", "text_hash"]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each begins with the whole run of letters before its @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _valid_card(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    if not 16 <= len(digits) <= 19:
        return False
    doubled = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in code points, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if _valid_ip(m[0])]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and _valid_card(m[0])]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else ''.join(c for c in value if c.isdigit())}"


def _trimmed(word: str, start: int) -> tuple[str, int, int]:
    inner = word.lstrip(_MARKS)
    start += len(word) - len(inner)
    inner = inner.rstrip(_MARKS)
    return inner.lower(), start, start + len(inner)


def terms_of(text: str) -> set[str]:
    """The terms of a text, and their beginnings*."""
    terms = {w.strip(_MARKS) for w in set(text.lower().split())}
    terms.discard("")
    return terms | {_general(t) for t in terms}


def _general(term: str) -> str:
    return term[:GENERAL] + "*"


def places_of(text: str, spans: list[tuple[int, int, int]], terms: Container[str]) -> list[tuple[int, int, str]]:
    """``(start, end, term)`` of each word of the whole text that is one of the terms;
    no part of a span is."""
    taken: list[list[int]] = []
    for start, end in sorted((a, b) for _, a, b in spans):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    out, k = [], 0
    for m in _SPACED.finditer(text):
        term, start, end = _trimmed(m[0], m.start())
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if term in terms and not (k < len(taken) and taken[k][0] < end):
            out.append((start, end, term))
    return out


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans, entities, terms, texts = [], [], [], []
        for text in batch.column("text"):
            text = text.as_py()
            found = base_spans(text)
            spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
            entities.append(sorted({_entity(k, text[a:b]) for k, a, b in found}))
            terms.append(sorted(terms_of(text)) if found else None)
            texts.append(text if found else None)
        more = [pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string())), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), pa.array(spans, span), *more], [*_KEY, "spans", "entities", "terms", "text"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def find_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, spans, entities, terms, text)`` for each row of ``docs``;
    terms and text are NULL where there is no span."""
    return _keyed(docs).mapInArrow(_find, f"doc_id long, text_hash long, spans {_SPANS}, entities array<string>, terms array<string>, text string")


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text, times in zip(batch.column("text"), batch.column("times").to_pylist(), strict=True):
            if times == 1:
                seen.update(terms_of(text.as_py()))
            else:
                seen.update(dict.fromkeys(terms_of(text.as_py()), times))
            if len(seen) > COUNTED:
                yield _counts(seen)
                seen = Counter()
    yield _counts(seen)


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])


def term_documents(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """``(term, n)``: in how many documents a term, or a beginning*, occurs.
    ``repeats`` are ``(doc_id, text_hash, more)``: rows beyond the first of a document."""
    counted = docs.select(whole_text().alias("text"), F.lit(1).cast("long").alias("times"))
    if not repeats.isEmpty():
        again = join_with_nulls(_keyed(docs), repeats, _KEY).dropDuplicates(_KEY)
        counted = counted.unionByName(again.select("text", (-F.col("more")).alias("times")))
    return counted.mapInArrow(_count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def reveals(total: int) -> Column:
    """Whether ``together`` of a term's ``n`` documents tell enough of an entity that is
    in ``documents`` of all. One that is in all has no information to tell."""
    part = F.col("documents") / F.lit(float(total))
    given = (F.col("together") + SHRINK * part) / (F.col("n") + SHRINK)
    return (F.log2(given / part) >= -DISCLOSURE * F.log2(part)) & (part < 1)


def private_documents(found: DataFrame) -> DataFrame:
    """Each document with spans once, with the ``(profile, documents)`` of its entities.
    Entities of the same documents share a profile, as all their terms do."""
    own = found.select(*_KEY, F.explode("entities").alias("entity")).distinct()
    where = own.groupBy("entity").agg(
        F.count("*").alias("documents"), F.bit_xor(F.xxhash64(*_KEY)).alias("a"), F.bit_xor(F.xxhash64(F.lit("b"), *_KEY)).alias("b")
    )
    profile = F.struct(F.xxhash64("documents", "a", "b").alias("profile"), "documents")
    profiles = own.join(where, "entity").groupBy(*_KEY).agg(F.collect_set(profile).alias("profiles"))
    return join_with_nulls(found.where(F.size("spans") > 0).drop("entities").dropDuplicates(_KEY), profiles, _KEY)


def most_documents(documents: int, total: int) -> float:
    """A term in more documents than this reveals no entity of ``documents`` of all ``total``:
    they cannot have it together in more than the entity's own."""
    part = documents / total
    return (documents + SHRINK * part) / part ** (1 - DISCLOSURE) - SHRINK


def _frequent(documents: DataFrame, least: float, total: int) -> DataFrame:
    """The terms in more documents than ``least`` and in the HOT_SHARE-th part of all, or in so much more
    that they can be broadcast."""
    share = max(1, total // HOT_SHARE)
    while True:
        found = documents.where((F.col("n") > least) & (F.col("n") >= share)).select("term")
        if measured_bytes(found) <= BROADCAST_BYTES:
            return found
        share *= 2


def revealing_terms(private: DataFrame, documents: DataFrame, total: int) -> DataFrame:
    """``(profile, term, action)``: what reveals the entities of a profile, and whether
    its beginning reveals as much and it is removed, or it is generalised.

    ``documents`` is held. Terms that are too frequent to reveal even the entity of the most
    documents are left out; the frequent ones among them before any row of theirs is shuffled.
    """
    most = private.select(F.explode("profiles.documents").alias("d")).agg(F.max("d")).first()[0] or 0
    least = most_documents(most, total) if most else 0.0
    pairs = _pairs(private, F.broadcast(_frequent(documents, least, total)))
    together = pairs.groupBy("profile", "term").agg(F.count("*").alias("together"), F.max("documents").alias("documents"))
    rare = documents.where(F.col("n") <= least)
    hot = rare.where(F.col("n") >= max(1, total // HOT_SHARE)).select("term")
    known = lookup(together, F.col("term"), rare, "term", measured_bytes(rare), hot).where("n IS NOT NULL")
    rated = hold(known.where(reveals(total)).select("profile", "term"), "revealing")
    terms = rated.where(~F.col("term").endswith("*")).withColumn("begin", F.concat(F.substring("term", 1, GENERAL), F.lit("*")))
    removed = rated.withColumnRenamed("term", "begin").withColumn("all", F.lit(True))
    action = F.when(F.col("all"), "remove").otherwise("generalise")
    return terms.join(removed, ["profile", "begin"], "left").select("profile", "term", action.alias("action"))


def _pairs(private: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """The terms of each document with each of its profiles."""
    many = F.size("terms").cast("long") * F.size("profiles") > PAIRS_AT_ONCE
    each = private.select(*_KEY, "terms", many.alias("many"), F.explode("profiles").alias("p"))
    each = each.where("NOT many").unionByName(each.where("many").repartition(*_KEY, "p"))
    out = each.select(*_KEY, "p.profile", "p.documents", F.explode("terms").alias("term"))
    return out if without is None else out.join(without, "term", "left_anti")


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("action", pa.string())]))
    for batch in batches:
        marked = []
        for text, spans, revealing in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "revealing")), strict=True):
            # "remove" sorts last and wins where entities disagree.
            action = dict(sorted((r["term"], r["action"]) for r in revealing))
            places = places_of(text, [(s["kind"], s["start"], s["end"]) for s in spans], action)
            marked.append([{"start": a, "end": b, "action": action[t]} for a, b, t in places] or None)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), pa.array(marked, kind)], [*_KEY, "terms"])


def protect(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, spans, terms)`` for each row of ``docs``: spans of the
    patterns, and ``(start, end, action)`` of the terms that reveal one of them,
    wherever they stand in the text.

    Places count code points, ends are exclusive. A missing text is empty. Rows
    that repeat an id and a text have the same spans and count as one document.
    Tables without entities have no terms.
    """
    found = hold(find_spans(docs), "found")
    repeats = hold(found.groupBy(*_KEY).agg((F.count("*") - 1).alias("more")).where("more > 0"), "repeats")
    private = hold(private_documents(found), "private")
    total = found.count() - repeats.agg(F.coalesce(F.sum("more"), F.lit(0))).first()[0]
    revealing = revealing_terms(private, hold(term_documents(docs, repeats), "term-documents"), total)
    mine = _pairs(private).join(revealing, ["profile", "term"])
    mine = mine.groupBy(*_KEY).agg(F.collect_set(F.struct("term", "action")).alias("revealing"))
    marked = join_with_nulls(private.select(*_KEY, "text", "spans"), mine, _KEY)
    marked = marked.select(*_KEY, "text", "spans", "revealing").mapInArrow(_mark, f"doc_id long, text_hash long, terms {_MARKED}")
    return join_with_nulls(found.select(*_KEY, "spans"), marked, _KEY, "left")


def span_text(spans: str, terms: str | None = None) -> Column:
    """``kind:start:end`` joined by commas; terms come after all other kinds."""
    names = F.array(*[F.lit(k) for k in KINDS])
    texts = F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    if terms:
        more = F.transform(F.col(terms), lambda s: F.concat_ws(":", F.lit(TERM), s["start"], s["end"]))
        texts = F.concat(texts, F.coalesce(more, F.array()))
    return F.array_join(texts, ",")


def span_count(spans: str, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == number)).cast("long")


def _replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "terms")), strict=True):
            cuts = [(s["start"], s["end"], f"[{KINDS[s['kind']]}]") for s in spans]
            for t in terms or []:
                cuts.append((t["start"], t["end"], text[t["start"] : t["start"] + GENERAL] + "*" if t["action"] == "generalise" else ""))
            out, at = [], 0
            for start, end, put in sorted(cuts):
                if start >= at:
                    out += [text[at:start], put]
                    at = end
                else:  # spans of two kinds overlap: the first one's name covers both
                    at = max(at, end)
            texts.append("".join(out) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def sanitise(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with every span replaced by its kind and every revealing
    term generalised or removed."""
    spans = protect(docs).dropDuplicates(["doc_id", "text_hash"])
    both = join_with_nulls(_keyed(docs), spans, ["doc_id", "text_hash"])
    return both.select("doc_id", "text", "spans", "terms").mapInArrow(_replace, "doc_id long, text string")
