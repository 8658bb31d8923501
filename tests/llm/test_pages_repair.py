"""Main text of pages, hard negatives and repaired conversations against brute force."""

import hashlib
import html
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import compare
import numpy as np
import pytest
from conftest import FOLDER

from tabsieve.llm import box_tree, host_paths, queries, repair, sql

# --- pages -----------------------------------------------------------------------------


def article_of(page):
    """The given tables' layout: one article, whose paragraphs are often left open."""
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", inner.group(1)) if inner else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages_of_the_given_table(spark):
    wanted = {r.page_id: article_of(r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = queries.QUERIES["op11_host_path_text"](spark, FOLDER).collect()
    assert len(got) == len(wanted) and all(r.text == wanted[r.page_id] and r.n_chars == len(r.text) for r in got)


def blocks(page, winners=()):
    return host_paths.main_blocks(page, list(winners))


def test_markup_of_a_page():
    page = """<html><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
    <header><a href="/">Home</a><h1>Site</h1></header><ul class="main-menu"><li>Menu</ul>
    <div class="cookie-notice">We use cookies, do you agree?</div>
    <div id="content"><article class="post-12"><header><h1>Title &amp; more</h1><p>By someone</p></header>
    <p title="a > b">First <b>bold<p>second line<br>goes  on &lt;here&gt; &#233;&nbsp;x</b>
    <script>var t = "</p><p>not this";</script><!-- <p>nor this --><ul><li>one<li>two <i>deep</i></ul>
    <table><tr><td>a<td>b<tr><td>c</table><aside>Aside</aside><div class="ad">Buy</div>
    <form><p>Your mail</p></form><pre>  code
    lines </pre><section id="comments"><p>A reader says something that is rather long, longer than all the rest.</p></section>
    </article></div><footer>&copy; 2020</footer>"""
    assert blocks(page) == ["Title & more", "First bold", "second line goes on <here> é x", "one", "two deep", "a", "b", "c", "code lines"]


def test_broken_pages():
    assert blocks("") == [] and blocks("   ") == [] and blocks("<") == ["<"]
    assert blocks("just text, 1 < 2 & more &am") == ["just text, 1 < 2 & more &am"]
    assert blocks("<nav>only a menu</nav><footer>foot</footer>") == []
    assert blocks("<article><p>open <b>text") == ["open text"]
    assert blocks('<article><p>cut <a href="x') == ["cut"]
    assert blocks("<p>one</b></div></article> two</p>three") == ["one two", "three"]
    assert blocks("<ARTICLE><P>Big letters</P></ARTICLE><SCRIPT>x</Script><p>rest") == ["Big letters"]
    deep = "<div>" * 50_000 + "bottom" + "</section>" * 50_000
    assert blocks(deep) == ["bottom"]
    assert blocks("<a '" * 20_000) == []


PAGE = "<body><div class='top'>{}</div><div class='text-{}'><p>{}</p></div><div class='side'>{}</div></body>"


def test_pages_of_a_host_agree(spark):
    # One page has little text in the host's place for it, and more beside it.
    rows = [(i, f"http://Host.example:80/{i}", PAGE.format("Top", i, "Long text of the page. " * 9, "Side"), "x", 1) for i in range(6)]
    rows.append((6, "https://me@host.example/6?x", PAGE.format("Top", 6, "Short.", "Beside " * 60), "x", 1))
    rows += [(7, None, rows[-1][2], "x", 1), (8, "http://host.example/8", None, None, None), (8, "http://host.example/8", None, None, None), (9, "no host", "", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = defaultdict(list)
    for r in host_paths.main_text(pages).collect():
        got[r.page_id].append((r.main_text, r.text, r.host, r.url))
    assert all(got[i] == [(" ".join(["Long text of the page."] * 9), "x", 1, rows[i][1])] for i in range(6))
    assert got[6][0][0] == "Short." and got[7][0][0] == " ".join(["Beside"] * 60)
    assert got[8] == [("", None, None, "http://host.example/8")] * 2 and got[9] == [("", "x", 1, "no host")]
    assert host_paths.main_text(pages.limit(0)).collect() == []
    paths = {r.host: r.paths for r in host_paths.winning_paths(pages.select(host_paths.host_of("url").alias("host"), "html").where("html IS NOT NULL")).collect()}
    assert paths == {"host.example": "div.text-\ndiv.side"}


# --- hard negatives --------------------------------------------------------------------


def mined(rows, anchors, positives=5, negatives=10):
    """All scores of each anchor."""
    out = []
    for a in anchors:
        scored = sorted(((-int(np.dot(a[2], r[2])), r[0], r[1]) for r in rows if r is not a))
        for s, p, _ in [t for t in scored if t[2] == a[1]][:positives]:
            fit = [t for t in scored if t[2] != a[1] and -30 * s <= -100 * t[0] <= -90 * s][:negatives]
            out += [(a[0], p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def negatives_of(spark, rows, every):
    frame = spark.createDataFrame([(i, lab, [float(v) for v in vec]) for i, lab, vec in rows], "vec_id long, label int, embedding array<double>")
    vectors, width = box_tree.whole_vectors(frame, scale=1)
    found = box_tree.hard_negatives(vectors, vectors.where(f"vec_id % {every} = 0"), width)
    return sorted(tuple(r) for r in found.collect())


def test_negatives_match_sql(spark):
    name = "op12_box_tree_negatives"
    con = compare.connect(FOLDER)
    assert compare.spark_rows(queries.QUERIES[name](spark, FOLDER)) == compare.duck_rows(con, sql.ORACLE[name])


def test_negatives_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(box_tree, "TILE_ROWS", 60)
    monkeypatch.setattr(box_tree, "LEAF", 8)
    monkeypatch.setattr(box_tree, "BOXES", 3)
    rng = np.random.default_rng(4)
    centres = rng.integers(-9, 10, (12, 6))
    rows = [(i, int(rng.integers(0, 4)), np.round(centres[i % 12] + rng.normal(0, 2, 6)).astype(int)) for i in range(700)]
    # A third of all rows are copies of one vector, some under each label.
    rows += [(700 + i, i % 3, centres[0]) for i in range(350)]
    assert negatives_of(spark, rows, 35) == mined(rows, [r for r in rows if r[0] % 35 == 0])


def test_best_first_queue_leaves_boxes_out():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(0, 3, (2_000, 3)) + np.repeat(rng.integers(-90, 90, (20, 3)), 100, axis=0))
    tree, anchor = box_tree.BoxTree(x), np.array([5.0, -3.0, 2.0])
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    least, most = tree.intervals(anchor[None])
    search = box_tree.Search(tree, x, np.arange(len(x)), anchor, least[0], most[0])
    scores = x @ anchor
    top = sorted(((-s, i) for i, s in enumerate(scores) if 100 <= s <= 300))[:10]
    assert search.top(10, np.ones(len(x), bool), 100, 300, -np.inf) == [(int(-s), i) for s, i in top]
    assert len(search.scored) < tree.leaves // 2


def test_negatives_of_odd_rows(spark):
    shape = "vec_id long, label int, embedding array<double>, score int, rank int, tile int"
    big = [1e150, 2.0]
    odd = [(0, 1, [2.0, 2.0]), (0, 1, [2.0, 2.0]), (0, 1, [3.0, 0.5]), (1, 1, [2.0, None]), (2, None, [2.0, 2.0]), (None, 1, [2.0, 2.0]), (3, 1, None)]
    odd += [(4, 1, [float("nan"), 1.0]), (5, 1, [float("inf"), 1.0]), (6, 2, [1.0]), (7, 2, []), (8, 1, [2.0, 1.0]), (9, 2, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in odd], shape)
    vectors, width = box_tree.whole_vectors(frame, scale=1)
    assert width == 3 and vectors.count() == 6
    got = sorted(tuple(r) for r in box_tree.hard_negatives(vectors, vectors.where("vec_id = 0"), width).collect())
    # Two rows share the anchor's id; each is the other's positive.
    valid = [(0, 1, (2, 2, 0)), (0, 1, (3, 0, 0)), (6, 2, (1, 0, 0)), (7, 2, (0, 0, 0)), (8, 1, (2, 1, 0)), (9, 2, (1, 0, 0))]
    assert got == mined(valid, valid[:2]) and len(got) > 0
    assert box_tree.hard_negatives(vectors, vectors.where("vec_id = 77"), width).collect() == []
    empty, width = box_tree.whole_vectors(frame.limit(0))
    assert box_tree.hard_negatives(empty, empty, width).collect() == []
    # Beyond what doubles and longs hold: no crash, the ends of a long.
    huge, width = box_tree.whole_vectors(spark.createDataFrame([(0, 1, big), (1, 1, big), (2, 2, big), (3, 2, [1.0, 1.0])], "vec_id long, label int, embedding array<double>"))
    assert box_tree.hard_negatives(huge, huge.where("vec_id = 0"), width).collect() == []


# --- conversations ---------------------------------------------------------------------


def cheapest(turns):
    """Least (cost, edits) by a search over (place, state) in that order."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, edits, place, state = heapq.heappop(queue)
        if (place, state) in done:
            continue
        done.add((place, state))
        if place == len(turns) and state in ("", "a"):
            return cost, edits
        other = "a" if state == "u" else "u"
        ways = [(2, "I", place, other)]
        if place < len(turns):
            role, must, cut = turns[place]
            ways.append((3, "D", place + 1, state))
            if not must:
                if role == "" or (state, role) in step:
                    ways.append((cut, "K", place + 1, step.get((state, role), state)))
                ways.append((2 + cut, "R", place + 1, other))
        for more, edit, to, after in ways:
            heapq.heappush(queue, (cost + more, edits + edit, to, after))


def coded(turns):
    initials = {"s": repair.SYSTEM, "u": repair.USERS, "a": repair.ASSISTANTS, "": repair.NO_ROLE}
    return bytes(initials.get(r, repair.OTHER) + repair.MUST_GO * m + repair.CUT * (c and not m) for r, m, c in turns)


def test_search_finds_the_least_edits():
    kinds = [(r, m, c) for r in "suax" for m, c in ((0, 0), (0, 1), (1, 0))] + [("", 0, 0), ("", 0, 1)]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert repair.cheapest_edits(coded(turns)) == cheapest(turns), turns
    rng = random.Random(3)
    for n in [5, 8, 13, 40, 90, 300]:
        for _ in range(30):
            turns = [rng.choice(kinds) if rng.random() < 0.4 else ("ua"[i % 2], 0, 0) for i in range(n)]
            assert repair.cheapest_edits(coded(turns)) == cheapest(turns)


def test_search_goes_through_long_conversations():
    rng = random.Random(5)
    turns = [(rng.choice("uuaasx"), rng.randrange(9) == 0, rng.randrange(4) == 0) for _ in range(20_000)]
    cost, edits = repair.cheapest_edits(coded(turns))
    assert len(edits) - edits.count("I") == len(turns) and cost > 0


def repaired(rows):
    """The whole contract, row by row."""
    blanks = " \t\n\x0b\x0c\r"
    value = lambda v: " " if v is None else str(v)
    groups = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        fate, role, text = zlib.crc32(f"{value(conv)}:{value(turn)}".encode()) % 20, value(role), value(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        groups[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        seen, faults, marked = set(), defaultdict(int), []
        for _, role, text in turns:
            bare = text.strip(blanks)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = cheapest(marked)
        numbers = {t[0] for t in turns if t[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        lines, state, rest = [], "", iter(turns)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rest)[1:]
            if edit in "IR":
                role = "assistant" if state == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
                state = role[:1] or state
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op13_conversation_repair"](spark, FOLDER).collect()}
    assert got == repaired(rows)


def odd_turns():
    rng = random.Random(8)
    texts = ["Done.", "And so", "Why? ", "", " \t", None, "x" * 50_000 + "!", "Same.", " ", "é."]
    rows = [(i % 40 or None, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(["user", "assistant", "system", "tool", "", None, "u"]), rng.choice(texts)) for i in range(400)]
    # One conversation holds a third of all rows, another nothing but repeated ones.
    rows += [(99, i, ("user", "assistant")[i % 2], f"{i % 90} said.") for i in range(300)] + [(98, 1, "user", "Same.")] * 30
    return rows


def test_repair_of_odd_rows(spark):
    rows = odd_turns()
    shape = "conv_id long, turn long, role string, text string, conv string, digest int, code int, n int"
    frame = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], shape)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair(frame).collect()}
    assert got == repaired(rows) and None in got
    assert repair.repair(frame.limit(0)).collect() == []


def test_dropped_conversation_and_texts(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repair(frame).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    turns = repair.damaged(frame.selectExpr(f"{kept}L AS conv_id", "turn", "role", "text"))
    plans = repair.repair_plans(repair.faults(turns))
    assert [tuple(r) for r in repair.repaired_turns(turns, plans).orderBy("place").collect()] == [(str(kept), 0, "user", "Hi."), (str(kept), 1, "assistant", "")]


@pytest.mark.parametrize("name", ["op11_host_path_text", "op12_box_tree_negatives", "op13_conversation_repair"])
def test_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries()
