"""The corpus pipeline: STAGES applied to `documents` one after the other, each written and reread."""
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioseek.llm.bpe import bpe_encode  # noqa: E402
from folioseek.llm.common import Scratch, given  # noqa: E402
from folioseek.llm.decontaminate import drop_contaminated  # noqa: E402
from folioseek.llm.jaccard import first_of_each_component  # noqa: E402
from folioseek.llm.queries import SURROGATE_KEY, TOXIC_FROM, tokenizer_path, toxicity_labels  # noqa: E402
from folioseek.llm.surrogates import replace_entities  # noqa: E402
from folioseek.llm.toxicity import score, train  # noqa: E402


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go."""
    to = "__score__"
    return score(docs, train(docs, toxicity_labels(spark, sf_dir)), to=to).where(F.col(to) < TOXIC_FROM).drop(to)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return first_of_each_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    return drop_contaminated(docs, given(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates."""
    return replace_entities(docs, SURROGATE_KEY).drop("n_entities")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    rows = bpe_encode(docs.select("doc_id", "text"), tokenizer_path(), results=("n_tokens", "ids_sha256", "decoded_sha256"))
    return rows.drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("tokens", tokens),
]

#: Toxicity is a trained model and surrogates are keyed digests: SQL expresses neither.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name, lasting=True)
    return docs
