"""Chat formatting, BPE, toxicity, pseudo-likelihood and personal data."""

import math
import random
import re
import zlib
from collections import Counter

import compare
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsieve.llm import bpe, chat, compression, pseudo, queries, sanitise, sql, tables
from tabsieve.llm.transducer import Transducer, compile_words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, score string, n long"
ODD = [
    (1, None, "x", "y", 1),
    (2, "", "x", "y", 2),
    (3, " \n\t ", "x", "y", 3),
    (4, "one two three " * 40_000, "x", "y", 4),
    (5, "don't I'LL <|endoftext|> é 日本 ՘ 12 \U0001f600‍", None, None, None),
    (None, "one two three", "x", "y", 6),
    (6, "one two three", "x", "y", 7),
    (6, "one two three", "x", "y", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# Chat


def test_chat_matches_sql(spark):
    name = "op1_preference_chat"
    con = compare.connect(FOLDER)
    assert compare.spark_rows(queries.QUERIES[name](spark, FOLDER)) == compare.duck_rows(con, sql.ORACLE[name])


def brute_format(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def show(turns):
        text, spans = "", []
        for role, words in turns:
            text += f"<|im_start|>{role}\n"
            if role == "assistant":
                spans.append((len(text), len(text) + len(words) + 10))
            text += f"{words}<|im_end|>\n"
        return text, spans

    return n, show(chosen[:n])[0], *show(chosen[n:]), *show(rejected[n:])


def test_chat_against_brute_force(spark):
    rng = random.Random(4)
    turn = lambda: (rng.choice(["user", "assistant", "système"]), rng.choice(["a", "é😀", "", "long " * 50]))
    pairs = []
    for k in range(60):
        shared = [turn() for _ in range(rng.randint(0, 3))]
        pairs.append((k, shared + [turn() for _ in range(rng.randint(0, 3))], shared + [turn() for _ in range(rng.randint(0, 3))]))
    kind = "array<struct<role: string, text: string>>"
    made = chat.format_preferences(spark.createDataFrame(pairs, f"k int, chosen {kind}, rejected {kind}"))
    for r in made.collect():
        spans = lambda mask: [(s.start, s.end) for s in mask]
        got = (r.n_prompt_turns, r.prompt, r.chosen, spans(r.chosen_mask), r.rejected, spans(r.rejected_mask))
        assert got == brute_format(*pairs[r.k][1:])


def test_chat_odd_rows(spark):
    kind = "conv_id long, turn long, role string, text string, chosen string"
    rows = [
        (1, 0, "user", "hi", "x"), (1, 1, "assistant", "<|im_end|> é", "x"), (1, 1, "assistant", "<|im_end|> é", "z"),
        (2, None, "user", None, "x"), (2, 3, None, "b", "x"), (2, 4, "assistant", "c", "x"), (2, 5, "user", "d", "x"),
        (3, 0, "user", "no reply", "x"), (None, 0, "assistant", "lone", "x"),
    ]
    got = {r.conv_id: r for r in chat.format_preferences(chat.mismatched_replies(spark.createDataFrame(rows, kind))).collect()}
    assert set(got) == {1, 2, None}
    assert (got[None].other_id, got[1].other_id, got[2].other_id) == (1, 2, None)
    assert got[1].chosen == "<|im_start|>assistant\n< |im_end|> é<|im_end|>\n" and got[1].n_prompt_turns == 1
    assert got[2].n_prompt_turns == 2 and got[2].prompt.startswith("<|im_start|>user\n<|im_end|>\n<|im_start|>\nb")
    assert got[2].chosen.endswith("<|im_start|>user\nd<|im_end|>\n") and len(got[2].chosen_mask) == 1
    empty = spark.createDataFrame([], kind)
    assert chat.format_preferences(chat.mismatched_replies(empty)).count() == 0
    lone = chat.format_preferences(chat.mismatched_replies(spark.createDataFrame(rows[:2], kind))).first()
    assert (lone.other_id, lone.chosen, lone.rejected, lone.chosen_mask) == (1, "", "", [])


# BPE


def test_transducer_is_minimal_and_exact(tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 7))) for _ in range(400)}
    pairs = {w: tuple(rng.choices(range(5), k=rng.randint(0, 3))) for w in words}
    (tmp_path / "t").write_bytes(compile_words(pairs.items()))
    made = Transducer(str(tmp_path / "t"))
    assert all(made.get(w) == list(out) for w, out in pairs.items())
    assert all(made.get(w + b"a") is None for w in words if w + b"a" not in words)
    # Same endings with the same output are shared.
    (tmp_path / "u").write_bytes(compile_words((a + b"tion", (7,)) for a in (b"a", b"b", b"na")))
    assert Transducer(str(tmp_path / "u")).states == 7
    (tmp_path / "e").write_bytes(compile_words([]))
    assert Transducer(str(tmp_path / "e")).get(b"x") is None


def test_words_are_cut_like_the_library():
    model, library = bpe.Model(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    words = bpe.Words(model)
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    for k in range(0, len(points), 40_000):
        for text in ("".join(f"{c}a" for c in points[k : k + 40_000]), "".join(f"!{c}1" for c in points[k : k + 40_000])):
            cuts = [at for _, at in library.pre_tokenizer.pre_tokenize_str(text)]
            own, place = [], 0
            for block in words.blocks(text):
                for word in block:
                    own.append((place, place + len(word)))
                    place += len(word)
            assert own == cuts


def test_merges_of_long_words():
    merger, library = bpe.Merger(bpe.Model(TOKENIZER)), Tokenizer.from_file(TOKENIZER)
    rng = random.Random(1)
    for n in (1, 40, 49, 300, 3000):
        word = "".join(rng.choice("aeionrst") for _ in range(n))
        assert merger.ids(word.encode()) == library.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("words", [bpe.WORDS_AT_A_TIME, 100])
def test_ids_are_those_of_the_library(spark, documents, odd, monkeypatch, words):
    monkeypatch.setattr(bpe, "WORDS_AT_A_TIME", words)
    library = Tokenizer.from_file(TOKENIZER)
    both = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = both.withColumn("given", F.col("text"))
    for r in bpe.encode(texts, TOKENIZER).collect():
        ids = library.encode(r.given or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (r.given or "")


def test_encode_keeps_other_columns(odd, none):
    assert bpe.encode(odd, TOKENIZER).columns == ["doc_id", "score", "n", "ids", "decoded"]
    assert bpe.encode(none, TOKENIZER).count() == 0


# Toxicity


def test_toxicity_of_held_out_rows(spark):
    folder = FOLDER.replace("0.001", "0.1")
    rows = queries.QUERIES["op3_compression_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    found = rows.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    flagged = [r for r in held if r.predicted]
    assert right > 0.96 and sum(r.toxic for r in flagged) / len(flagged) > 0.9
    assert sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held) > 0.75


def test_scores_come_from_both_dictionaries(spark):
    """Every score again, a window at a time, by compressors of its own."""
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    model = compression.fit(docs, labels)
    assert model["toxic"].endswith(model["ordinary"]) and len(model["toxic"]) > len(model["ordinary"]) > 500
    # zstandard writes this number before what it trained; a list of words has none.
    assert model["toxic"].count(b"\x37\xa4\x30\xec") >= 2
    sizes = {}

    def size(content: bytes, window: str) -> int:
        key = len(content), window
        if key not in sizes:
            packed = (compression.LEAD.decode() + f" {window} " + compression.TAIL.decode()).encode()
            sizes[key] = len(compression._compressor(content).compress(packed))
        return sizes[key]

    some = docs.orderBy("n_chars").limit(60)
    for r in compression.score(some, model).collect():
        words, row = r.text.lower().split(), [1.0]
        for width in (1, 3):
            windows = [" ".join(words[k : k + width]) for k in range(0, len(words), width)]
            gained = [max(-32, min(32, size(model["ordinary"], w) - size(model["toxic"], w))) for w in windows] or [0]
            best = sorted(gained)[-3:]
            over = [sum(g >= k for g in gained) for k in (2, 3, 4)]
            row += [best[-1] / 4, sum(best) / len(best) / 4, sum(gained) / len(gained), math.log1p(over[0]), math.log1p(over[1])]
            row += [math.log(k / len(gained) + 0.005) for k in over]
        z = sum(a * b for a, b in zip(row, model["weights"], strict=True))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_windows_of_a_long_text_by_blocks(monkeypatch):
    windows = compression.Windows(*compression.train_dictionaries(["vile scoundrel"] * 9, ["mild person"] * 9))
    text = " ".join(f"vile person number {k}" for k in range(50))
    whole = windows.gains(text, 3)
    monkeypatch.setattr(compression, "WINDOWS_AT_A_TIME", 7)
    assert (windows.gains(text, 3) == whole).all() and whole.sum() == 67


def test_only_windows_that_may_gain_are_compressed(monkeypatch):
    """The same gains as when all of them are, also beside a window that may."""
    rng = random.Random(3)
    made = ["".join(rng.choices("abcdeéß🙂~", k=rng.randint(1, 9))) for _ in range(4000)]
    toxic, ordinary = compression.train_dictionaries(["vile scoundrel"] * 9, ["mild person"] * 9)[::-1]
    texts = [" ".join(made[k : k + 40]) for k in range(0, 4000, 40)] + ["a scoundrels vilely", "x", "", "coun drel vil", "mild person"]
    compressed, lengths = [], compression._lengths
    monkeypatch.setattr(compression, "_lengths", lambda c, data: compressed.extend(data) or lengths(c, data))
    windows = compression.Windows(ordinary, toxic)
    got = [windows.gains(t, width) for t in texts for width in (1, 3)]
    assert 0 < len(compressed) < 200
    monkeypatch.setattr(compression.Windows, "may_gain", lambda self, data: list(range(len(data))))
    windows = compression.Windows(ordinary, toxic)
    assert all((a == windows.gains(t, width)).all() for a, (t, width) in zip(got, [(t, w) for t in texts for w in (1, 3)], strict=True))
    assert len(compressed) > 5000


def test_texts_to_score_travel_once(spark, documents):
    scored = compression.score(documents, {"ordinary": b"", "toxic": b"", "weights": None, "part": 0.5})
    assert "__whole" not in scored._jdf.queryExecution().toString()
    numbers = documents.select("doc_id", F.col("n_chars").alias("text"))
    assert compression.score(numbers, {"ordinary": b"", "toxic": b"", "weights": None, "part": 0.5}).schema["text"] == numbers.schema["text"]


def test_tasks_give_their_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(tables, "give_back", lambda: given.append(1))
    run = tables.giving_back(lambda batches: (2 * b for b in batches))
    assert list(run([1, 2])) == [2, 4] and len(given) == 1
    ended_early = run([1, 2])
    assert next(ended_early) == 2 and len(given) == 1
    ended_early.close()
    assert len(given) == 2


def test_labels_of_the_held_out_fold_do_not_matter(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(compression.is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert compression.fit(documents, labels) == compression.fit(documents.repartition(3), turned)


def test_toxicity_odd_rows(spark, odd, none, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = compression.fit(odd, labels)
    assert {r.score for r in compression.score(odd, model).collect()} == {0.0}
    ours = "vile scoundrel", "mild person"
    rows = [(k, f"the {ours[k % 2]} went home {k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(100)] + [(None, 1), (200, None), (0, 0)], "doc_id long, toxic int")
    model = compression.fit(docs, labels)
    got = {r.doc_id: r.score for r in compression.score(docs, model).collect()}
    assert min(got[k] for k in range(0, 100, 2)) > 0.5 > max(got[k] for k in range(1, 100, 2))
    scores = compression.score(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert compression.score(none, model).count() == 0


# Pseudo-likelihood


def test_log_probabilities_are_scaled_only_where_they_must_be():
    rng = np.random.default_rng(1)
    net = pseudo.Network(rng.integers(1, 50, 256).astype(float))
    around, target = [rng.integers(0, 257, 300) for _ in pseudo.PLACES], rng.integers(0, 256, 300)
    net.to_class[:], net.to_word[:] = rng.normal(0, 0.1, net.to_class.shape), rng.normal(0, 0.1, net.to_word.shape)
    # One class by one: moderate, far too large, far too small; and the classes' own scores.
    for shift in (0.0, 300.0):
        net.word_bias[1] += shift
        net.word_bias[2] -= shift
        net.class_bias += shift
        inner = pseudo._in_range(net.to_word, net.word_bias).tolist()
        assert inner == [True, not shift, not shift, True] and pseudo._in_range(net.to_class, net.class_bias).all() == (not shift)
        h = np.tanh(net.bias + sum(net.enter[k][around[k]] for k in range(len(around)))).astype(np.float64)
        outer = h @ net.to_class + net.class_bias
        group, member, rows = target // pseudo.CLASS, target % pseudo.CLASS, np.arange(len(target))
        own = np.einsum("nk,nkm->nm", h, net.to_word[group]) + net.word_bias[group]
        expected = outer[rows, group] - np.logaddexp.reduce(outer, axis=1) + own[rows, member] - np.logaddexp.reduce(own, axis=1)
        assert np.allclose(net.log_probabilities(around, target), expected, atol=1e-3)


def test_gradients():
    rng = np.random.default_rng(0)
    net = pseudo.Network(rng.integers(1, 50, 256).astype(float))
    net.to_class[:], net.to_word[:] = rng.normal(0, 0.1, net.to_class.shape), rng.normal(0, 0.1, net.to_word.shape)
    around, target = [rng.integers(0, 257, 40) for _ in pseudo.PLACES], rng.integers(0, 256, 40)
    learn = {}
    net.log_probabilities(around, target, learn)
    for name in ("to_class", "class_bias", "to_word", "word_bias", "bias"):
        weights = getattr(net, name)
        at = np.unravel_index(np.abs(learn[name]).argmax(), weights.shape)
        old, sums = weights[at], []
        for step in (1e-2, -1e-2):
            weights[at] = old + step
            sums.append(net.log_probabilities(around, target).astype(float).sum())
        weights[at] = old
        assert -(sums[0] - sums[1]) / 2e-2 == pytest.approx(learn[name][at], rel=2e-2)


def test_probabilities_add_up_to_one():
    net = pseudo.Network(np.arange(1.0, 257))
    around = [np.full(256, k + 3) for k in range(4)]
    assert np.exp(net.log_probabilities(around, np.arange(256))).sum() == pytest.approx(1, abs=1e-4)


def test_training_beats_counts(spark):
    docs = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    vocab = pseudo.vocabulary(docs)
    texts = [r.text or "" for r in docs.limit(200).collect()]
    count = Counter(w for t in [r.text or "" for r in docs.collect()] for w in pseudo.words_of(t))
    assert sum(vocab["n"]) == sum(count.values())
    assert sum(vocab["kinds"]) + len(vocab["words"]) >= len(count)
    ids = pseudo.Ids(vocab["words"])
    total = lambda net: sum(pseudo.score_ids([ids.of(t) for t in texts], net, pseudo.rare_shares(vocab)))
    before = pseudo.Network(vocab["n"])
    after = pseudo.Network(vocab["n"], pseudo.train(pseudo.number_words(docs, vocab), vocab["n"]))
    assert total(after) > total(before)


def test_scores_do_not_depend_on_neighbours():
    words = ["a", "b", "c"]
    n = np.concatenate(([5.0, 3, 2], np.ones(pseudo.BUCKETS)))
    net, ids, rare = pseudo.Network(n), pseudo.Ids(words), np.zeros(len(n))
    net.to_class[:] = 0.3
    texts = [ids.of(t) for t in ("a b c a", "", "zzz", "b " * 40_000)]
    together = pseudo.score_ids(texts, net, rare)
    for text, got in zip(texts, together, strict=True):
        assert got == pytest.approx(pseudo.score_ids([text], net, rare)[0], rel=1e-5)


def test_pseudo_scores_word_by_word(spark, monkeypatch):
    """Whole log-likelihoods from the final weights, in plain sums."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 400").limit(40).select("doc_id", "text").cache()
    monkeypatch.setattr(pseudo, "WORDS", 192)
    kept, real = [], pseudo.train
    monkeypatch.setattr(pseudo, "train", lambda numbers, n: kept.append((n, real(numbers, n))) or kept[-1][1])
    got = {r.doc_id: r.log_likelihood for r in pseudo.score(docs).collect()}
    net = pseudo.Network(*kept[0])
    words = pseudo.vocabulary(docs)["words"]
    texts = {r.doc_id: pseudo.words_of(r.text or "") for r in docs.collect()}
    count, place = Counter(w for t in texts.values() for w in t), {w: i for i, w in enumerate(words)}
    bucket = lambda w: len(words) + zlib.crc32(w.encode()) % pseudo.BUCKETS
    filled = Counter()
    for w, n in count.items():
        if w not in place:
            filled[bucket(w)] += n

    def softmax(x, i):
        e = np.exp(x - x.max())
        return np.log(e[i] / e.sum())

    for name, text in texts.items():
        ids = [place.get(w, bucket(w)) for w in text]
        total = 0.0
        for t, (w, i) in enumerate(zip(text, ids, strict=True)):
            around = [ids[t + p] if 0 <= t + p < len(ids) else net.outside for p in pseudo.PLACES]
            h = np.tanh(net.bias + sum(net.enter[k][a] for k, a in enumerate(around)).astype(np.float64))
            total += softmax(h @ net.to_class + net.class_bias, i // pseudo.CLASS)
            total += softmax(h @ net.to_word[i // pseudo.CLASS] + net.word_bias[i // pseudo.CLASS], i % pseudo.CLASS)
            if w not in place:
                total += np.log(count[w] / filled[i])
        assert got[name] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_pseudo_averages_in_lots(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").repartition(7)
    vocab = pseudo.vocabulary(docs)
    numbers = pseudo.number_words(docs, vocab)
    one = pseudo.train(numbers, vocab["n"])
    monkeypatch.setattr(pseudo, "LOT", 2)
    assert pseudo.train(numbers, vocab["n"]) == pytest.approx(one, rel=1e-4, abs=1e-5)


def test_words_split_in_lots_are_those_of_python(monkeypatch):
    texts = ["", " ", " a  B\tc ", "a\x1cb\x1fc", "A\x85b\u2003C\xa0d", "ΑΣ ΣΑΣ. İI", "\x00 \x0b\x0c x", "é" * 70 + " x " + "y" * 65, "z" * 64] * 3
    for part in (1, 20, 1 << 20):
        monkeypatch.setattr(pseudo, "PART", part)
        got = []
        for piece in pseudo._pieces(pa.array(texts)):
            words, sizes = pseudo._split(piece)
            got += np.split(np.array(words.to_pylist(), object), np.cumsum(sizes)[:-1])
        assert [list(w) for w in got] == [pseudo.words_of(t) for t in texts]
        counted = Counter()
        for batch in pseudo._count([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]):
            counted.update(dict(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
        assert counted == Counter(pseudo._short(w) for t in texts for w in pseudo.words_of(t))


def test_listed_words_are_not_joined(spark, monkeypatch):
    """The same scores whether the counts of rare words are listed or joined; only words that are not listed are sent to the join."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(200).cache()
    monkeypatch.setattr(pseudo, "WORDS", 192)
    monkeypatch.setattr(pseudo, "train", lambda numbers, n: pseudo.Network(n).flat)
    sent, scores = [], []
    for listed in (0, 1_000, 1 << 20):
        monkeypatch.setattr(pseudo, "LISTED", listed)
        vocab = pseudo.vocabulary(docs)
        assert vocab["listed"].num_rows <= listed
        sent.append(pseudo.number_words(docs, vocab).agg(F.sum(F.size("rare"))).first()[0])
        scores.append({r.doc_id: r.log_likelihood for r in pseudo.score(docs).collect()})
    assert sent[0] > sent[1] > sent[2] == 0
    for other in scores[1:]:
        assert other == pytest.approx(scores[0], rel=1e-9)


def test_sums_of_stretches(monkeypatch):
    rng = np.random.default_rng(0)
    rows, order = rng.normal(size=(500, 32)).astype(np.float32), rng.permutation(500)
    for piece in (2, 7, 32):
        monkeypatch.setattr(pseudo, "PIECE", piece)
        for first in ([0], [0, 1, 2, 300], np.arange(500), np.arange(60) * 8):
            want = np.add.reduceat(rows[order].astype(float), first, axis=0)
            assert np.allclose(pseudo._sums(rows, order, np.array(first), 500), want, atol=1e-4)


def test_layers_in_blocks(monkeypatch):
    """How the rows are cut changes neither probabilities nor gradients."""
    rng = np.random.default_rng(0)
    net = pseudo.Network(rng.integers(1, 50, 256).astype(float))
    net.to_class[:], net.to_word[:] = rng.normal(0, 0.1, net.to_class.shape), rng.normal(0, 0.1, net.to_word.shape)
    around, target = [rng.integers(0, 257, 900) for _ in pseudo.PLACES], rng.integers(0, 256, 900)
    made = []
    for block, few in ((2048, 256), (100, 16), (2048, 2048)):
        monkeypatch.setattr(pseudo, "BLOCK", block)
        monkeypatch.setattr(pseudo, "FEW", few)
        learn = {}
        net.log_probabilities(around, target, learn)
        made.append([net.log_probabilities(around, target), *learn.values()])
    for other in made[1:]:
        assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(made[0], other, strict=True))


def test_pseudo_odd_rows(odd, none):
    got = pseudo.score(odd).collect()
    assert len(got) == len(ODD)
    assert all((r.n_words == 0) == (r.per_word is None) for r in got)
    assert pseudo.score(none).count() == 0


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def as_text(spans):
    return [f"{sanitise.KINDS[k]}:{a}:{b}" for k, a, b in spans]


def test_spans_match_the_patterns(documents):
    rng = random.Random(1)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for alphabet in ("ab@.@..-+ 0123456789é(", "01.2+ -", "45 -") for _ in range(8000)]
    texts += [r.text or "" for r in documents.collect()] + ["4111 1111 1111 1111", "a@b@c.d.e@f.g", "1.2.3.4.5.6.7.8", "+1 (555) 010-2030"]
    for text in texts:
        assert as_text(sanitise.base_spans(text)) == brute_spans(text)


def test_long_texts_take_little_time():
    for text in ("a" * 500_000 + "@", "1" * 500_000, "+1 " * 100_000, "1." * 200_000, "a@" * 200_000):
        assert sanitise.base_spans(text) is not None


def test_query_of_spans(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op8_disclosure_sanitiser"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        wanted = brute_spans(r.text or "")
        found = got[r.doc_id].spans.split(",") if got[r.doc_id].spans else []
        assert [s for s in found if not s.startswith("term")] == wanted
        assert [getattr(got[r.doc_id], f"n_{k}") for k in PATTERNS] == [sum(s.startswith(k) for s in wanted) for k in PATTERNS]


def test_terms_that_reveal(spark):
    rows = [(k, f"word{k} Zorblax{'' if k % 2 else 'y'}, quuxy{k} writes from a@b.example today the end {k}") for k in range(4)]
    rows += [(k, f"people writes from c{k}@d.example today the end, zebra {k}") for k in range(4, 40)]
    rows += [(100, None), (101, ""), (None, "call +1 555 010 2030"), (None, "call +1 555 010 2030")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, spans string, terms string")
    docs = docs.unionByName(spark.createDataFrame([(k, f"Zorblaxy and zorblax x{k} a@b.example", "x", "y") for k in range(50, 54)], docs.schema))
    found = {r.doc_id: r for r in sanitise.protect(docs).collect() if r.doc_id is not None}
    assert {found[0].terms[0].action} == {"remove"}
    text = dict(rows)[0]
    assert [text[t.start : t.end] for t in found[0].terms] == ["Zorblaxy"]
    assert found[4].terms is None and found[100].spans == []
    clean = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    assert "orblax" not in clean[0] and "[email]" in clean[0] and clean[0].endswith("today the end 0")
    assert clean[4] == "people writes from [email] today the end, zebra 4"
    assert clean[None] == "call [phone]" and clean[100] == ""
    assert sanitise.protect(docs).count() == len(rows) + 4
    assert sanitise.protect(docs.limit(0)).count() == 0 and sanitise.sanitise(docs.limit(0)).count() == 0


def test_terms_of_rare_entities(spark):
    rows = [(k, f"some people write letters on day {k % 50}") for k in range(200)]
    rows += [(300, "write Quixano at rare@a.example on day 3"), (301, "some Dulcinea twice@a.example on day 4"), (302, "letters of Dulcinea to twice@a.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    assert "Quixano" not in clean[300] and "Dulcinea" not in clean[301] + clean[302]
    assert clean[300].startswith("write ") and clean[300].endswith("[email] on day 3") and clean[5] == rows[5][1]


def test_terms_far_from_the_value(spark):
    far = " ".join(f"day {k}" for k in range(50))
    rows = [(k, f"some people write letters of love to {far}") for k in range(200)]
    rows += [(300, f"Quixano write to rare@a.example {far}\n\nletters of (Quixano), {far} Rocinante"), (301, f"Sancho, {far} both@a.example"), (302, f"both@a.example {far} sancho")]
    rows += [(303, "once more"), (303, "once more"), (304, "Dorotea once@a.example"), (304, "Dorotea once@a.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [dict(rows)[r.doc_id][t.start : t.end] for t in r.terms or []] for r in sanitise.protect(docs).collect()}
    assert found[300] == ["Quixano", "Quixano", "Rocinante"]
    assert found[301] == ["Sancho"] and found[302] == ["sancho"] and found[303] == []
    assert found[304] == ["Dorotea"] and sanitise.protect(docs).count() == len(rows)
    clean = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    assert "uixano" not in clean[300] and "ancho" not in clean[301] + clean[302]


def test_words_of_a_bucket_have_their_own_counts(spark):
    bucket = lambda w: zlib.crc32(w.encode()) % pseudo.BUCKETS
    other = next(w for w in (f"once{k}" for k in range(10_000)) if bucket(w) == bucket("often"))
    rows = [(k, "often") for k in range(10)] + [(10, other), (11, " ".join(f"f{k}" for k in range(4_000)) + " ")]
    docs = spark.createDataFrame([(k, t * 20 if k == 11 else t) for k, t in rows], "doc_id long, text string")
    words = pseudo.vocabulary(docs)["words"]
    assert words == sorted(f"f{k}" for k in range(4_000))[: pseudo.WORDS]
    got = {r.doc_id: r.log_likelihood for r in pseudo.score(docs).collect()}
    assert len(got) == 12 and got[0] - got[10] == pytest.approx(np.log(10), abs=1e-4)


def test_every_word_is_trained_on(monkeypatch):
    for size in (0, 1, 2, 5, 37):
        data, outside = np.arange(size, dtype=np.int32), 256
        seen = []
        monkeypatch.setattr(pseudo.Trainer, "step", lambda self, around, target: seen.extend(target.tolist()))
        for turn in range(pseudo.ROUNDS):
            ids = pa.array([data.tolist()], pa.list_(pa.int32()))
            list(pseudo._trainer(np.ones(outside), pseudo.Network(np.ones(outside)).flat, turn)([pa.RecordBatch.from_arrays([ids], ["ids"])]))
        assert sorted(seen) == list(range(size))


def test_steps_are_full_whatever_the_batches(monkeypatch):
    """Numbers of 16 bits in slices of several batches: every word once, and every step but the last has BATCH words."""
    monkeypatch.setattr(pseudo, "BATCH", 8)
    cuts = np.cumsum([5, 0, 3, 300, 1, 0, 7, 21])
    texts = pa.array([x.astype(np.uint16).tobytes() for x in np.split(np.arange(400), cuts)])
    seen, sizes = [], []
    monkeypatch.setattr(pseudo.Trainer, "step", lambda self, around, target: (seen.extend(target.tolist()), sizes.append(len(target))))
    for turn in range(pseudo.ROUNDS):
        batches = [pa.RecordBatch.from_arrays([texts.slice(a, 2)], ["ids"]) for a in range(1, len(texts), 2)]
        list(pseudo._trainer(np.ones(448), pseudo.Network(np.ones(448)).flat, turn)(batches))
    assert sorted(seen) == list(range(5, 400))
    assert sum(size != 8 for size in sizes) <= pseudo.ROUNDS


def test_no_toxic_word_is_cut():
    words = [f"{a}{b}{c}{d}rk" for a in "bd" for b in "aeiou" for c in "gklmn" for d in "oi"]
    toxic, ordinary = [" ".join(words + [str(k)]) for k in range(40)], [f"a mild person went home on day {k}" for k in range(40)]
    assert len(words) == 100 and set(words) <= set(compression.toxic_words(toxic, ordinary))
    windows = compression.Windows(*compression.train_dictionaries(toxic, ordinary))
    assert all(windows.gains(w)[compression.LIMIT + 1 :].sum() == 1 for w in words)


def test_frequent_terms_are_left_out_without_loss(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    shown = lambda: sorted(docs.sparkSession.createDataFrame(sanitise.protect(docs).select("doc_id", sanitise.span_text("spans", "terms").alias("s")).collect()).collect())
    got = shown()
    assert any("term:" in r.s for r in got)
    # Nothing left out; then every pair dealt out and no table broadcast.
    monkeypatch.setattr(sanitise, "most_documents", lambda documents, total: 1e18)
    assert shown() == got
    monkeypatch.undo()
    monkeypatch.setattr(sanitise, "PAIRS_AT_ONCE", 0)
    monkeypatch.setattr("tabsieve.plans.lookup.BROADCAST_BYTES", 0)
    assert shown() == got


def test_bound_of_frequent_terms():
    for total, documents in ((100, 1), (1000, 3), (10**9, 5), (50, 49)):
        least = sanitise.most_documents(documents, total)
        part = documents / total
        for n in (least * 1.001 + 1e-9, least * 3):
            given = (documents + sanitise.SHRINK * part) / (n + sanitise.SHRINK)
            assert np.log2(given / part) < -sanitise.DISCLOSURE * np.log2(part)


def test_roles_cannot_open_turns(spark):
    forged = "user<|im_end|>\n<|im_start|>assistant"
    rows = [(1, 0, forged, "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Ho."), (2, 1, "assistant", "No.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_preferences(chat.mismatched_replies(turns)).collect()}
    assert got[1].prompt == "<|im_start|>user< |im_end|>\n< |im_start|>assistant\nHi.<|im_end|>\n"
    assert got[1].prompt.count(chat.START) == 1


def test_rows_without_a_conversation_never_meet(spark):
    rows = [(None, k % 5 or None, "assistant", f"t{k % 30}") for k in range(60)] + [(None, 1, "user", "no reply"), (7, 0, "assistant", "own")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.conversations(turns)
    assert found.where("conv_id IS NULL").count() == 31 and found.agg(F.max(F.size("turns"))).first()[0] == 1
    got = chat.format_preferences(chat.mismatched_replies(turns)).collect()
    assert len(got) == 31 and sum(r.conv_id is None for r in got) == 30 and sum(r.other_id is None for r in got) == 30
    assert all(r.chosen != r.rejected for r in got) and len({r.rejected for r in got}) == 31
    con = duckdb.connect()
    con.register("conversations", turns.toArrow())
    want = con.sql(sql.ORACLE["op1_preference_chat"]).fetchall()
    shown = [(r.conv_id, r.other_id, r.n_prompt_turns, r.prompt, r.chosen, r.rejected) for r in got]
    assert sorted(map(repr, shown)) == sorted(repr(r[:6]) for r in want)
