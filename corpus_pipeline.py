"""A corpus for training, from documents in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that it keeps
with the columns of ``docs``; the last one returns what it encoded. A row is
known by its id and a hash of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm import bpe, chosen_path, compression, entropy, perfect_hash
from tabsieve.llm.queries import TOKENIZER
from tabsieve.llm.tables import join_with_nulls, read_table, whole_text
from tabsieve.plans.held import drop_held, hold, released


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``dropped(doc_id, text_hash)``, and with one of
    the rows that repeat an id and a text."""
    keys = ["doc_id", "text_hash"]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64(whole_text()).alias("text_hash"))
    repeats = marked.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    if not repeats.isEmpty():
        marked = marked.dropDuplicates(keys)
    return join_with_nulls(marked, dropped.distinct(), keys, "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = compression.fit(docs, read_table(spark, sf_dir, "labels"))
    return compression.score(docs, model, "__toxic").where("__toxic < 0.5").drop("__toxic")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = perfect_hash.exact_duplicates(docs)
    return _without(docs, found.where("NOT kept").select("doc_id", "text_hash"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = chosen_path.near_duplicates(docs)
    return _without(docs, found.where("NOT kept").select("doc_id", "text_hash"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    taken = entropy.mix(docs).groupBy("doc_id", "text_hash", "source").agg(F.max("copies").alias("copies"))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64(whole_text()).alias("text_hash"), F.col("source").cast("string").alias("source")
    )
    both = join_with_nulls(marked, taken.where("copies > 0"), ["doc_id", "text_hash", "source"])
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), TOKENIZER)
    return made.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

#: A fitted classifier, sketches and rounding are not for SQL; tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the tables that stages hold, only the result of the last one
    but one stays: each stage's own and its input go once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with released(spark) as kept:
            kept.append(hold(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        drop_held(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
