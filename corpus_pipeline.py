"""A training-data pipeline over documents: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
one's docs.
"""

from __future__ import annotations

from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoglass.llm import decontam, exact_dedup, language, packing, simhash
from chronoglass.llm.common import made, materialise, remove, table
from chronoglass.llm.tokens import public


#: Units of text that a worker's encoder keeps in the last stage: executors have grown by then.
TOKEN_STORE = 80_000
#: Folders that a stage made on the way to its result.
_passing: list[str] = []


def stage(run, last=False):
    """A stage that first removes what the one before it made on the way: its result is written by now. Folders that
    docs itself is read from stay, and so do those of the last stage, whose result nobody may have written yet."""

    @wraps(run)
    def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        gone = [f for f in _passing if f in made() and not any(f.rsplit("/", 1)[1] in x for x in read)]
        _passing.clear()
        remove(spark, gone)
        before = set(made())
        out = run(spark, docs, sf_dir)
        _passing.extend(f for f in made() if f not in before and not last)
        return out

    return once


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter (`und`) go. A document whose lang is null gets the predicted one."""
    columns = docs.columns
    model = language.fit(docs.where(~language.held_out()))
    if not model.langs:
        return docs.where(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    numbered = docs.toDF(*(f"c{i}" for i in range(len(columns))))  # so that no column's name clashes with the result's
    found = language.identify(numbered, model, text=f"c{columns.index('text')}", carry=numbered.columns).where("lang_pred != 'und'")
    lang = f"c{columns.index('lang')}"
    return found.withColumn(lang, F.coalesce(lang, "lang_pred")).select(*numbered.columns).toDF(*columns)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest identifier."""
    return exact_dedup.drop_exact(docs).select(*docs.columns)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are at least 0.8 similar, that of the
    smallest identifier."""
    return simhash.drop_near(docs).select(*docs.columns)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@partial(stage, last=True)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens, with their ids' checksum."""
    out = packing.pack(docs, public("word_bpe_49k.json"), store=TOKEN_STORE)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", decontaminate), ("packing", packed)]

#: Models, fingerprints, alignments and token ids are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
