"""Repetition inside single documents, with thresholds that adapt to language and source.

Each document's repeated shares (runs of words, sentences, paragraphs) are measured on its worker. A
mergeable quantile sketch per measure, language and source gives a threshold for that group; documents at
or above a threshold of their group come out by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm import qdigest
from trailmark.llm.leakage import window_starts
from trailmark.llm.words import Words, in_chunks, mix
from trailmark.session import materialize

_MEASURES = "n_words bigint, runs bigint, repeated_runs bigint, sentence_share double, paragraph_share double"
#: Measures of repetition and the columns of their thresholds.
SHARES = {"run_share": "threshold", "sentence_share": "sentence_threshold", "paragraph_share": "paragraph_threshold"}
_SENTENCE = re.compile(r"[.!?\n]+[ \t\r\n\f]*")
_PARAGRAPH = re.compile(r"\n[ \t\r\n\f]*\n")


def _repeated_share(pieces: list[str]) -> float:
    """Share of characters in pieces that already stood before."""
    seen: set[str] = set()
    again = total = 0
    for piece in pieces:
        total += len(piece)
        if piece in seen:
            again += len(piece)
        else:
            seen.add(piece)
    return again / total if total else 0.0


def repeated_runs(words: Words, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of runs of ``run`` words of each text and how many repeat an earlier one."""
    starts, text = window_starts(words.offsets, run)
    key = np.zeros(len(starts), np.uint64)
    for i in range(run):
        key = (key ^ words.hashes[starts + i]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(31)
    # The text's number is mixed in, so that one sort finds the distinct runs of all texts.
    key = mix(key + text.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    order = np.argsort(key)
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    n = len(words.offsets) - 1
    return np.bincount(text, minlength=n), np.bincount(text[order][same], minlength=n)


def measure(documents: DataFrame, run: int = 5, doc_id: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, groups, n_words, runs, repeated_runs, run_share, sentence_share, paragraph_share), a row per document.

    ``run_share`` is 1 - distinct runs / runs. A null, empty or short text has no runs and shares of 0. Texts
    are read whole. Rows that repeat a document are measured each; other columns are ignored.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), *groups, F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *[f"{g} string" for g in groups], _MEASURES])

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk in in_chunks(zip(range(len(batch)), batch["text"])):
                texts = [t for _, t in chunk]
                words = Words(texts)
                total, again = repeated_runs(words, run)
                out = batch.iloc[chunk[0][0] : chunk[-1][0] + 1].drop(columns="text").reset_index(drop=True)
                yield out.assign(
                    n_words=words.counts(),
                    runs=total,
                    repeated_runs=again,
                    sentence_share=[_repeated_share(_SENTENCE.split(t)) for t in texts],
                    paragraph_share=[_repeated_share(_PARAGRAPH.split(t)) for t in texts],
                )

    got = rows.mapInPandas(run_, schema)
    share = F.when(F.col("runs") > 0, F.col("repeated_runs") / F.col("runs")).otherwise(F.lit(0.0))
    return got.withColumn("run_share", share)


def thresholds(measured: DataFrame, groups: tuple[str, ...] = ("lang", "source"), quantile: float = 0.99, k: int = 1600, measures: tuple[str, ...] = tuple(SHARES)) -> DataFrame:
    """A threshold per group and measure: the given quantile of each of ``measures``, from q-digests
    (groups, measure, n, threshold, rank_error). It is the lower edge of the quantile's leaf, so that equal shares reach it."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("share")) for m in measures]))
    shares = measured.where(F.col("runs") > 0).select(*groups, each.alias("m")).select(*groups, "m.*")
    digest = qdigest.build(shares, [*groups, "measure"], "share", k)
    return qdigest.quantiles(digest, [*groups, "measure"], [quantile], k).select(*groups, "measure", "n", F.col("edge").alias("threshold"), "rank_error")


def threshold_check(documents: DataFrame, groups: tuple[str, ...] = ("lang", "source"), quantile: float = 0.99, k: int = 1600) -> DataFrame:
    """(groups, measure, n, within): whether the rank of each threshold is within the digest's bound, by counting all shares."""
    measured = materialize(measure(documents, groups=groups), "repetition")
    found = thresholds(measured, groups, quantile, k).select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("measure").alias("__measure"), "n", "threshold", "rank_error")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("share")) for m in SHARES]))
    shares = measured.where(F.col("runs") > 0).select(*groups, each.alias("m")).select(*groups, "m.*")
    counts = shares.groupBy(*groups, "measure", qdigest.leaf(F.col("share")).alias("leaf")).agg(F.count("*").alias("c"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in (*groups, "measure")])
    # A leaf's edge falls to the leaf or, rounded, to the one before.
    at = qdigest.leaf(F.col("threshold") * F.lit(1 + 1e-9))
    joined = counts.join(found, same).withColumn("at", at)
    total = lambda some: F.coalesce(F.sum(F.when(some, F.col("c"))), F.lit(0))
    sums = joined.groupBy(*groups, "measure", "n", "rank_error").agg(total(F.col("leaf") < F.col("at")).alias("below"), total(F.col("leaf") <= F.col("at")).alias("upto"))
    rank = F.greatest(F.ceil(F.lit(quantile) * F.col("n")), F.lit(1))
    return sums.select(*groups, "measure", "n", ((F.col("below") + 1 - F.col("rank_error") <= rank) & (rank <= F.col("upto") + F.col("rank_error"))).alias("within"))


def flag(documents: DataFrame, groups: tuple[str, ...] = ("lang", "source"), quantile: float = 0.99, ceiling: float | None = None, min_words: int = 20, measures: tuple[str, ...] = tuple(SHARES)) -> DataFrame:
    """Documents of which a repeated share reaches its threshold in their group, with the measures and the thresholds.

    The thresholds are ``threshold`` of ``run_share``, ``sentence_threshold`` and ``paragraph_threshold``; one of
    ``measures`` that is above 0 and reaches its own is enough. They are quantiles of the group alone; a ``ceiling``
    keeps them from rising above it, for callers to whom a share is large in any group. Null languages and sources form
    groups of their own. The measures are written once, as both the sketches and the filter read them.
    """
    measured = materialize(measure(documents, groups=groups), "repetition")
    cut = F.col("threshold") if ceiling is None else F.least(F.lit(ceiling), F.col("threshold"))
    own = [F.max(F.when(F.col("measure") == m, cut)).alias(SHARES[m]) for m in measures]
    limits = thresholds(measured, groups, quantile, measures=measures).groupBy(*groups).agg(*own)
    limits = limits.select(*[F.col(g).alias(f"__{g}") for g in groups], *[SHARES[m] for m in measures])
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups])
    some = F.greatest(*[F.col(m) for m in measures], F.lit(0.0)) > 0
    joined = measured.where((F.col("n_words") >= min_words) & some).join(limits, same)
    reached = reduce(Column.__or__, [(F.col(m) > 0) & (F.col(m) >= F.col(SHARES[m])) for m in measures])
    return joined.where(reached).drop(*[f"__{g}" for g in groups])
