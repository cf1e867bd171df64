"""Five text operators applied to `documents` one after the other; each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of `documents`, the last one the token ids.
The driver writes each stage's rows as Parquet and rereads them for the next; `run` does the same on shared storage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planiscope.llm import byte_bpe, decontamination, language_id, simhash, substring_dedup
from planiscope.llm.common import fresh, numbered, stored

#: Score of language identification below which a text is no prose of any learned language: with four languages held-out
#: documents of sf0.1 score 0.49 and more (three of 3358 0.33 to 0.38), strings of random letters 0.44 at most. With
#: one language to learn every text with a letter scores about 1, and none is rejected.
LEAST_SCORE = 0.45


#: Shingle and radius of the near-duplicate stage. The general rule is five words and a similarity of 0.8; a radius that
#: meets it (some 12 bits) would take 2**13 - 1 masks, so near copies beyond the radius stay: README has the shares.
SHINGLE, RADIUS = 5, 5


def _packed(docs: DataFrame, *extra: str) -> DataFrame:
    """text, `extra`, and all other columns in one, so that no name of theirs can clash with a stage's own."""
    others = [F.col(c) for c in docs.columns if c not in ("text", *extra)]
    return docs.select("text", *extra, F.struct(*others).alias("row"))


def _unpacked(found: DataFrame, columns: list[str], **changed: F.Column) -> DataFrame:
    return found.select(*[changed.get(c, F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language told with some certainty; `lang` becomes the language told.

    Null and empty texts go. Rows are judged alone, so ids do not matter and repeated rows stay or go together. Without a
    language to learn, `lang` stays and texts with a letter do. An empty table stays empty.
    """
    model = language_id.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(_packed(docs), model, keep=("text", "row"))
    found = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return _unpacked(found, docs.columns, lang=F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays: that of the smallest id, null before all.

    Rows are told apart by numbers, not by ids (see common.numbered): different texts of one id or of null ids are
    documents of their own, and of equal rows one stays. Null, empty and blank texts are one group. An empty table stays empty.
    """
    rows, uid = numbered(docs)
    found = simhash.near_duplicates(rows, uid, radius=RADIUS, shingle=SHINGLE)
    kept = stored(found.filter("id = component").select(F.col("id").alias(uid)), "kept")
    return rows.join(kept, uid, "left_semi").select(docs.columns)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows that repeat across the corpus leave the text; documents left without a word go.

    Every row is a document, whatever its id. `n_chars` follows the text where that changed. Null and blank texts go.
    """
    rows, uid = numbered(docs)
    packed = _packed(rows, uid).select(F.col(uid).alias("uid"), F.lit(None).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "row")
    found = substring_dedup.cleaned(packed, with_text=True, keep=("row",)).withColumnRenamed("kept", "text")
    found = found.filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("row")["n_chars"])
    return _unpacked(found, docs.columns, n_chars=changed)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, and only these, whatever ids they share. Null texts hold nothing."""
    rows, uid = numbered(docs)
    found = decontamination.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), uid)
    gone = stored(found.select(F.col("uid").alias(uid)).distinct(), "gone")
    return rows.join(gone, uid, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digest of what they decode to: a row for every row; null texts have no tokens."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_substrings),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The stages learn models and search by hashes: SQL has no form of them. tests/llm/test_pipeline.py holds the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
