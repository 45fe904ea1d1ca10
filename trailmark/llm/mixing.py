"""Mixtures of sources at target weights by systematic sampling.

A document of a source is due ``expected`` copies. Over the documents of the source the expected copies
are summed up by length, in a random order among equal ones, one random offset is added, and a document comes
out once for every whole number that its part of the sum crosses: the copies of any document differ from its
expectation by less than one, and a source's number of copies from its total by less than one. As neighbours
in the sum are of like length, so are the source's tokens close to its goal.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.hashing import name_key
from trailmark.operators.ranking import prefix_sum
from trailmark.session import materialize

#: Vocabulary file of a public byte-level tokenizer, as ranks; another one may be named.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Expected copies are counted in units of 2 ** -24, so that sums are exact and independent of their order.
UNIT = 1 << 24


@dataclass(frozen=True)
class Mixture:
    """``copies`` (doc_id, source, n_tokens, copies), one row per document that is in; ``report`` per source."""

    copies: DataFrame
    report: DataFrame


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens) over whole texts; a null text has none. Special tokens' strings are ordinary text."""
    documents.sparkSession.sparkContext.addFile(tokenizer)  # the vocabulary goes to every worker
    rows = documents.select(F.col(doc_id).alias("doc_id"), name_key(F.col("source")).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(Path(tokenizer).name), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield batch.drop(columns="text").assign(n_tokens=[len(encoding.encode_ordinary(t)) for t in batch["text"]])

    return rows.mapInPandas(run, schema)


def expected_copies(tokens: list[int], weights: list[float], caps: list[int], total: int) -> list[float]:
    """Copies that a document of each source is due: the source's goal in tokens over its size, at most its cap."""
    whole = sum(w for w, n in zip(weights, tokens)) or 1.0
    return [min(float(c), w / whole * total / n) if n else 0.0 for n, w, c in zip(tokens, weights, caps)]


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 11) -> Mixture:
    """Mix ``documents`` by ``targets`` (source, target_weight, max_repeats) to ``total_tokens`` (default: all tokens of the named sources).

    Source names are read trimmed and in lower case. Documents of null or unplanned sources aren't used and
    appear in the report with weight 0, likewise planned sources without documents. A source too small for
    its goal is repeated ``max_repeats`` times and the report says what is missing. Null weights or caps
    count as 0; of a source named twice the weights add up and the larger cap holds. Repeated documents are
    separate ones; empty texts have no tokens and are copied like any. Empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    counted = materialize(token_counts(documents, tokenizer), "tokens")
    found = _by_planned_source(counted, targets)
    sizes = {r.source: (r.docs, r.tokens) for r in found}
    longest = {r.source: r.longest for r in found}
    plan = targets.groupBy(name_key(F.col("source")).alias("source")).agg(F.sum("target_weight").alias("w"), F.max("max_repeats").alias("c"))
    plan = [(r.source, float(r.w or 0), int(r.c or 0)) for r in plan.where(F.col("source").isNotNull()).orderBy("source").collect()]
    tokens = [sizes.get(s, (0, 0))[1] for s, _, _ in plan]
    goal = sum(tokens) if total_tokens is None else total_tokens
    due = expected_copies(tokens, [w for _, w, _ in plan], [c for _, _, c in plan], goal)
    offset = [int.from_bytes(hashlib.sha256(f"{seed}:{s}".encode()).digest()[:8], "big") % UNIT for s, _, _ in plan]
    # However few copies a document is due, they count: one unit at least.
    rates = spark.createDataFrame([(s, max(1, round(e * UNIT)), o) for (s, _, _), e, o in zip(plan, due, offset) if e > 0], "source string, __e long, __o long")

    used = counted.join(F.broadcast(rates), "source").withColumn("__key", F.xxhash64("doc_id", "n_tokens", F.lit(seed)))
    summed = prefix_sum(used, ["source"], ["n_tokens", "__key", "doc_id"], F.col("__e"), "__sum")
    upto = F.col("__sum") + F.col("__o")
    copies = (F.shiftright(upto, 24) - F.shiftright(upto - F.col("__e"), 24)).cast("int")
    out = materialize(summed.select("doc_id", "source", "n_tokens", copies.alias("copies")).where(F.col("copies") > 0), "mixture")

    got = out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_out"), F.max("copies").alias("most_copies"))
    stated = [(s, w, c, *sizes.get(s, (0, 0)), longest.get(s, 0), e) for (s, w, c), e in zip(plan, due)]
    unplanned = sizes.get("\x02unplanned")
    if unplanned:
        stated.append((None, 0.0, 0, *unplanned, longest["\x02unplanned"], 0.0))
    whole = sum(w for _, w, *_ in stated) or 1.0
    table = spark.createDataFrame(
        [(s, w / whole, *rest) for s, w, *rest in stated], "source string, target_share double, max_repeats int, documents long, tokens_in long, longest long, expected_copies double"
    )
    joined = table.join(F.broadcast(got), "source", "left")
    put = F.coalesce("tokens_out", F.lit(0).cast("bigint"))
    total = out.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 0
    share = put / F.lit(float(max(total, 1)))
    report = joined.select(
        "source", "target_share", "max_repeats", "documents", "tokens_in", "longest", "expected_copies", put.alias("tokens_out"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), share.alias("reached_share"),
        (put - F.col("target_share") * F.lit(float(goal))).alias("tokens_beyond_goal"),
        (F.col("expected_copies") >= F.col("max_repeats")).alias("at_cap"),
    )
    return Mixture(out, report)


def _by_planned_source(counted: DataFrame, targets: DataFrame) -> list:
    """Documents and tokens of each planned source, all others as one: as many rows as targets, whatever the corpus names."""
    planned = targets.select(name_key(F.col("source")).alias("source")).where(F.col("source").isNotNull()).distinct().withColumn("__p", F.lit(True))
    named = counted.join(F.broadcast(planned), "source", "left")
    source = F.when(F.col("__p"), F.col("source")).otherwise(F.lit("\x02unplanned"))
    return named.groupBy(source.alias("source")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest")).collect()
