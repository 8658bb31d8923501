"""Repair of conversations by iterative-deepening A*.

A conversation should read as an optional system turn and then user and
assistant in turns. Edits keep, rerole, delete or insert a turn. The cheapest
sequence of edits is sought depth first in the ASCII order of their initials
under a rising bound of cost; a table holds the states that failed with a given
remaining cost, and the first accepted path is the answer.

What is compared and counted is narrow: one row of a few bytes for each turn. Texts are
shuffled once, as a stream, to be hashed in the order of their conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.tables import BLANKS, join_with_nulls
from tabsieve.plans.held import hold

#: Costs of the edits, and what a truncated turn adds that is not deleted.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: The estimate knows the exact cost inside of a stretch of turns: at least so many, and
#: at most so many stretches, so that the bound rises a few times whatever the length.
STRETCH, STRETCHES = 32, 8
USER, ASSISTANT = "user", "assistant"

#: A turn as one byte: the initial of its role, and two marks.
SYSTEM, USERS, ASSISTANTS, OTHER, NO_ROLE = range(5)
INITIALS = {"s": SYSTEM, "u": USERS, "a": ASSISTANTS, "": NO_ROLE}
MUST_GO, CUT = 8, 16
#: Where the faults are kept above them.
BLANK, DUPLICATE = 32, 64

#: States of the roles so far: none, system, user, assistant. Nothing and assistant may end.
EMPTY, SAID, ASKED, ANSWERED = range(4)
ENDS = (EMPTY, ANSWERED)
NEVER = 1 << 30


def _keep(state: int, role: int) -> int:
    """The state after a turn is kept, or -1."""
    if role == NO_ROLE:
        return state
    if role == SYSTEM:
        return SAID if state == EMPTY else -1
    if role == USERS:
        return ASKED if state != ASKED else -1
    if role == ASSISTANTS:
        return ANSWERED if state == ASKED else -1
    return -1


KEEP = [[_keep(state, role) for role in range(5)] for state in range(4)]
#: A user follows everything but a user: the role of a reroled or inserted turn is a
#: matter of the state.
NEXT = [ANSWERED if state == ASKED else ASKED for state in range(4)]


def _estimate(turns: bytes) -> list[tuple[int, int, int, int]]:
    """For each place and state, a cost that no way to the end undercuts: exact to the
    end of the place's stretch, and the least cost of each later stretch."""
    n = len(turns)
    stretch = max(STRETCH, -(-n // STRETCHES))
    out: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * (n + 1)
    # After the last turn, one or two inserted ones may still be needed.
    ahead = out[n] = (0, 2 * INSERT, INSERT, 0)
    for i in range(n - 1, -1, -1):
        if i + 1 < n and (i + 1) % stretch == 0:
            least = min(ahead)
            ahead = (least, least, least, least)
        code = turns[i]
        role, late = code & 7, TRUNCATED if code & CUT else 0
        here = []
        for state in range(4):
            cost = DELETE + ahead[state]
            if not code & MUST_GO:
                kept = KEEP[state][role]
                if kept >= 0:
                    cost = min(cost, late + ahead[kept])
                cost = min(cost, REROLE + late + ahead[NEXT[state]])
            here.append(cost)
        # Insertions lead from state to state: three in a row pass through all.
        for _ in range(3):
            here = [min(here[s], INSERT + here[NEXT[s]]) for s in range(4)]
        ahead = out[i] = (here[0], here[1], here[2], here[3])
    return out


def cheapest_edits(turns: bytes) -> tuple[int, str]:
    """Cost and initials of the cheapest edits, the ASCII-least of equal cost.

    ``turns`` holds a byte for each turn: its role's initial, MUST_GO and CUT.
    """
    estimate, n = _estimate(turns), len(turns)
    bound = estimate[0][EMPTY]
    while True:
        found, bound = _within(turns, n, estimate, bound)
        if found is not None:
            return bound, found


def _within(turns: bytes, n: int, estimate: list, bound: int) -> tuple[str | None, int]:
    """One depth-first search: the first accepted path within the bound, or the
    next bound. ``failed`` holds, for a place and a state, the most cost that was left
    there in vain."""
    failed: dict[int, int] = {}
    above = NEVER
    path: list[str] = []
    # A frame is a place, a state, the cost so far, and the edit that it tries next.
    stack = [[0, EMPTY, 0, 0]]
    while stack:
        frame = stack[-1]
        place, state, cost, edit = frame
        if edit == 0 and place == n and state in ENDS:
            return "".join(path), bound
        if edit == 4:
            failed[place * 4 + state] = max(bound - cost, failed.get(place * 4 + state, -1))
            stack.pop()
            if path:
                path.pop()
            continue
        frame[3] += 1
        to, after, more = place + 1, state, 0
        if edit == 1:
            to, after, more = place, NEXT[state], INSERT
        elif place == n:
            continue
        else:
            code = turns[place]
            late = TRUNCATED if code & CUT else 0
            if edit == 0:
                more = DELETE
            elif code & MUST_GO:
                continue
            elif edit == 2:
                after, more = KEEP[state][code & 7], late
                if after < 0:
                    continue
            else:
                after, more = NEXT[state], REROLE + late
        spent = cost + more
        least = spent + estimate[to][after]
        if least > bound:
            above = min(above, least)
        elif bound - spent > failed.get(to * 4 + after, -1):
            stack.append([to, after, spent, 0])
            path.append("DIKR"[edit])
    return None, above


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the damage that ``crc32("conv_id:turn") % 20``
    decides: 0 drops the row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it,
    4 makes its role the user's. A missing value counts as one space."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", value("role").alias("role"), value("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, F.lit(USER)).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("times")
    )
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")


def faults(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, code, n)``: equal turns of one number as one row with their
    count ``n``, and ``code``, the byte of the first of them. The others are duplicates.

    The first fault counts: blank, duplicate (role and text were seen earlier), truncated.
    """
    bare = F.rtrim(F.translate("text", BLANKS[1:], " " * (len(BLANKS) - 1)))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USERS).when(initial == "a", ASSISTANTS).when(initial == "", NO_ROLE).otherwise(OTHER)
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    narrow = turns.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.when(bare == "", role + (MUST_GO + BLANK)).when(cut, role + CUT).otherwise(role).alias("code"),
    )
    rows = narrow.groupBy("conv_id", "turn", "role", "digest").agg(F.first("code").alias("code"), F.count("*").alias("n"))
    rows = hold(rows, "turns")
    # Blank turns are deleted whatever was seen before.
    full = rows.where(F.col("code").bitwiseAND(F.lit(BLANK)) == 0)
    seen = full.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"))).alias("first"), F.count("*").alias("times"))
    again = join_with_nulls(rows, seen.where("times > 1").drop("times"), ["conv_id", "role", "digest"], "left")
    late = F.col("first").isNotNull() & (F.col("code").bitwiseAND(F.lit(BLANK)) == 0) & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    code = F.when(late, F.col("code").bitwiseAND(F.lit(7)) + (MUST_GO + DUPLICATE)).otherwise(F.col("code"))
    return again.select("conv_id", "turn", "role", "digest", code.cast("int").alias("code"), "n")


def _ordered(rows: DataFrame, *more: str) -> DataFrame:
    """Conversations whole in a partition, their turns in order: those without a number first,
    equal numbers by role and text digest."""
    return rows.repartition("conv").sortWithinPartitions("conv", *more, F.col("turn").asc_nulls_first(), "role", "digest")


class _Plan:
    """Counts and edits of one conversation whose turns arrive in order."""

    def __init__(self):
        self.turns, self.blank, self.duplicate, self.truncated, self.illegal = bytearray(), 0, 0, 0, 0
        self.before, self.least, self.most, self.distinct = -1, None, None, 0

    def add(self, turn: int | None, code: int, n: int) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.distinct = turn, self.distinct + 1
        role = code & 7
        if code & BLANK:
            self.blank += n
        elif code & DUPLICATE:
            self.duplicate += n
        else:
            self.duplicate += n - 1
            self.truncated += 1 if code & CUT else 0
        if self.before >= 0:
            self.illegal += (self.before, role) not in LEGAL
        self.illegal += (n - 1) * ((role, role) not in LEGAL)
        self.before = role
        self.turns.append(code & 31)
        if n > 1:
            self.turns += bytes([code & 15 & ~CUT | MUST_GO]) * (n - 1)

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        cost, audit = cheapest_edits(bytes(self.turns))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


#: Role initials that may follow each other.
LEGAL = {(SYSTEM, USERS), (USERS, ASSISTANTS), (ASSISTANTS, USERS)}
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_plans(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` from ``faults``.

    A task keeps one byte for each turn of a conversation, as many as the audit
    that it returns has letters.
    """

    def plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, current, ready = None, None, []
        for batch in batches:
            for conv, turn, code, n in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "code", "n")], strict=True):
                if current is None or conv != name:
                    if current is not None:
                        ready.append((name, *current.result()))
                    name, current = conv, _Plan()
                current.add(turn, code, n)
            if ready:
                yield _plans(ready)
                ready = []
        if current is not None:
            yield _plans([(name, *current.result())])

    narrow = _ordered(rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "digest", "code", "n"))
    return narrow.select("conv", "turn", "code", "n").mapInArrow(plan, "conv string, " + ", ".join(f"{f} long" for f in FIGURES) + ", audit string")


def _plans(ready: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * len(FIGURES), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], k) for i, k in enumerate(kinds)], ["conv", *FIGURES, "audit"])


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv, place, role, text)``, the turns after the edits of their conversation,
    as a stream of sorted partitions: none is held whole. ``conv`` is the id as text."""

    def repair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _stream(batches):
            out = [(conv, place, role, text) for conv, place, role, text in found]
            del batch
            if out:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv", "place", "role", "text"])

    return _with_plans(turns, plans).mapInArrow(repair, "conv string, place long, role string, text string")


def repaired_hashes(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` over the repaired ``role:text`` joined by line feeds. A hash goes
    through a conversation from its beginning to its end, in one task that holds a turn at a time."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, running, begun = None, None, False
        for batch, found in _stream(batches, heads=True):
            ready = []
            for conv, place, role, text in found:
                if place < 0:
                    if begun:
                        ready.append((name, running.hexdigest()))
                    name, running, begun = conv, hashlib.sha256(), True
                    continue
                running.update((f"{role}:{text}" if place == 0 else f"\n{role}:{text}").encode())
            del batch
            if ready:
                yield _hashes(ready)
        if begun:
            yield _hashes([(name, running.hexdigest())])

    return _with_plans(turns, plans).mapInArrow(digest, "conv string, repaired_sha256 string")


def _hashes(ready: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], pa.string()) for i in (0, 1)], ["conv", "repaired_sha256"])


def _with_plans(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order."""
    nothing = lambda kind: F.lit(None).cast(kind)
    heads = plans.select("conv", F.lit(0).alias("kind"), nothing("long").alias("turn"), nothing("string").alias("role"), nothing("binary").alias("digest"), F.col("audit").alias("text"))
    rows = turns.select(
        F.col("conv_id").cast("string").alias("conv"), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text"
    )
    return _ordered(heads.unionByName(rows), "kind").select("conv", "kind", "role", "text")


def _stream(batches: Iterable[pa.RecordBatch], heads: bool = False) -> Iterator[tuple]:
    """For each batch, its edited turns as (conv, place, role, text); where ``heads`` is set, a
    conversation begins with a place of -1."""
    audit, at, state, place, conv = "", 0, EMPTY, 0, None

    def through(batch):
        nonlocal audit, at, state, place, conv
        for conv, kind, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text")], strict=True):
            if kind == 0:
                audit, at, state, place = text, 0, EMPTY, 0
                if heads:
                    yield conv, -1, "", ""
                yield from inserted()
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                made = (ASSISTANT if state == ASKED else USER) if edit == "R" else role
                yield conv, place, made, text
                state, place = KEEP[state][INITIALS[made[:1]]], place + 1
            yield from inserted()

    def inserted():
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            yield conv, place, (ASSISTANT if state == ASKED else USER), ""
            at, state, place = at + 1, NEXT[state], place + 1

    for batch in batches:
        yield batch, through(batch)


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of ``(conv_id, turn, role, text)`` after damage: its faults, the cheapest
    edits and the hash of what they lead to.

    Missing roles and texts are one space. Rows without a conversation are one of their
    own. Turns of the same number are in order of role and of their text's digest, so that
    repeated rows stand together and are duplicates. A conversation with no rows left has zeros, no edits and the hash
    of nothing. An empty table gives no rows; other columns are not read.
    """
    turns = damaged(conversations)
    plans = hold(repair_plans(faults(turns)), "plans")
    hashes = repaired_hashes(turns, plans)
    named = conversations.select("conv_id").distinct().withColumn("conv", F.col("conv_id").cast("string"))
    out = join_with_nulls(join_with_nulls(named, plans, ["conv"], "left"), hashes, ["conv"], "left")
    return out.select(
        "conv_id",
        *[F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in FIGURES],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
