"""Mixing sources to target weights in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.prefix import prefix_sums
from ledgerloom.operators.joins import spread
from ledgerloom.session import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of ``documents`` (doc_id, source, text). A null text has no token; whole texts are counted."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield b[["doc_id", "source"]].assign(tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]])

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return spread(rows, "doc_id").mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """How often to use each document so that the sources meet ``targets`` (source, target_share, max_repeats) of all documents' tokens.

    Returns (doc_id, source, tokens, uses) for every document and (source, target_share, max_repeats, documents, tokens, budget, used_tokens,
    repeats, actual_share, short_tokens) for every target. The budget of a source is its share of the tokens of all documents. As
    many whole epochs as fit into it are used, at most ``max_repeats``, then documents in the order of a hash-random key as long as
    their running sum stays within what is left: the first that would go over ends the source, so it stays short of its
    budget by less than that document. A source that ``max_repeats`` keeps below its budget is reported short; what it lacks
    is not given to others, whose targets would then not be met.

    Documents of a null source or one without a target are used 0 times. A null share or cap counts as 0; of repeated targets of a source the
    largest share and cap hold. Repeated doc_ids are kept as rows of their own.
    """
    work = Workspace(spark, "mix")
    counted, m = work.write(token_counts(documents, tokenizer), "tokens", total=F.sum("tokens"))
    total = m["total"] or 0
    goal = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    have = counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    plan = goal.join(have, "source", "left").fillna(0, ["documents", "tokens"])
    plan = plan.withColumn("budget", F.floor(F.col("target_share") * F.lit(total) + F.lit(1e-6)).cast("bigint"))
    plan = plan.withColumn("want", F.least("budget", F.col("tokens") * F.col("max_repeats")))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("want") / F.col("tokens"))).otherwise(0).cast("bigint"))
    plan = work.table(plan.withColumn("rest", F.col("want") - F.col("epochs") * F.col("tokens")), "plan")
    keyed = counted.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    running = prefix_sums(work, keyed, ["source"], ["key", "doc_id"], "tokens", "until")
    sized = running.join(plan.select("source", "epochs", "rest", "target_share"), "source", "left")
    uses = F.when(F.col("target_share").isNull(), 0).otherwise(F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("until") <= F.col("rest")), 1).otherwise(0))
    uses = sized.select("doc_id", "source", "tokens", uses.cast("int").alias("uses"))
    used = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    report = plan.join(used, "source", "left").fillna(0, ["used_tokens"])
    everything = F.lit(max(1, report.agg(F.sum("used_tokens").alias("n")).first().n or 0))
    report = report.select(
        "source", "target_share", "max_repeats", "documents", "tokens", "budget", "used_tokens",
        F.round(F.col("used_tokens") / F.greatest("tokens", F.lit(1)), 4).alias("repeats"),
        F.round(F.col("used_tokens") / everything, 4).alias("actual_share"),
        (F.col("budget") - F.col("used_tokens")).alias("short_tokens"),
    )
    return uses, report
