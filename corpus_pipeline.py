"""A corpus pipeline over the operators of coppice.llm: from raw documents to a mix of sources.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and
returns a DataFrame that is written as Parquet and reread. All but the last return the columns
of documents; columns of other names travel along, whatever their names. A stage's rows are
deleted once the next stage has written its own.

Null and empty texts and null ids pass the first four stages (nothing is known against them; they
are copies of nothing) and are taken 0 words of. Of repeated rows, one stays. An empty table gives
an empty mix. Ties are broken by hashes of id and text: reruns agree.
"""

from __future__ import annotations

import uuid

from coppice.llm import decontaminate, importance, mixing, near_duplicates, repeats, textops


def quality_classifier(spark, docs, sf_dir):
    """Documents that importance resampling doesn't select go."""
    return importance.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates (similarity 0.8) stays."""
    return near_duplicates.one_of_each(docs)


def repeat_dedup(spark, docs, sf_dir):
    """Strings of 400 bytes and passages of 50 words that occur again anywhere are taken out of the texts."""
    return repeats.remove_repeats(docs)


def decontamination(spark, docs, sf_dir):
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark, docs, sf_dir):
    """What a mix of the sources by weight takes of each document."""
    return mixing.taken(docs)


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing)]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{textops.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{home}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            textops.delete(spark, before)
        before = path
    return docs
