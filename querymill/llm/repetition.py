"""Repetition inside a single document, with verdicts per host.

The share of repeated words is a property of one document and is measured where the document is read:
no text is shuffled. Only (host, count) pairs move, to estimate for each host how often its documents
fail the rule; the rate is shrunk towards the corpus by a beta prior fitted to all hosts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.words import batches_of, mix64, word_ids
from querymill.runtime import cut


def repeated_words(ids: np.ndarray, starts: np.ndarray, window: int):
    """For each text the number of words that lie in a stretch of ``window`` words seen earlier in it.

    Stretches are compared by a 64-bit polynomial hash of mixed word ids together with the text they
    belong to; the first occurrence of a stretch isn't repeated, later ones may overlap it.
    """
    lengths = np.diff(starts)
    texts = np.repeat(np.arange(len(lengths)), lengths)
    n = len(ids)
    if n < window:
        return np.zeros(len(lengths), np.int64)
    word, base = mix64(ids), np.uint64(0x5851F42D4C957F2D)
    gram = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        gram = gram * base + word[k : n - window + 1 + k]
    at = np.flatnonzero(texts[: n - window + 1] == texts[window - 1 :])
    key = mix64(gram[at] ^ mix64(texts[at]))
    order = np.argsort(key, kind="stable")  # equal stretches stay in the order of the text
    same = key[order][1:] == key[order][:-1]
    later = at[order[1:][same]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, later, 1)
    np.add.at(edge, later + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[starts[1:]] - covered[starts[:-1]]


def repeated_share(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   window: int = 8, max_share: float = 0.3, batch_chars: int = 8_000_000) -> DataFrame:
    """One row per document: ``doc_id, host, n_words, n_repeated, repeated_share, fails``.

    Null and empty texts and texts without words have a share of 0 and don't fail. Hosts are compared
    without case and outer blanks; a null host is the host ''. Rows repeated under one id give
    one row each. Other columns of ``docs`` are ignored, whatever their names.
    """

    def measure(frames):
        for pdf in batches_of(frames, batch_chars):
            ids, starts = word_ids(pdf["text"])
            n, repeated = np.diff(starts), repeated_words(ids, starts, window)
            share = repeated / np.maximum(n, 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "host": pdf["host"].to_numpy(), "n_words": n, "n_repeated": repeated, "repeated_share": share, "fails": share >= max_share})

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lower(F.trim(F.coalesce(F.col(host_col).cast("string"), F.lit("")))).alias("host"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInPandas(measure, f"doc_id {kind}, host string, n_words long, n_repeated long, repeated_share double, fails boolean")


def host_rates(measured: DataFrame, *, max_rate: float = 0.2) -> DataFrame:
    """``host, n_docs, n_fail, raw_rate, shrunk_rate, host_fails`` from the documents' failures.

    The prior beta(a, b) comes from the moments of the hosts' raw rates, each host weighted by its
    documents; hosts that all agree, or a single host, give a prior as strong as the corpus.
    Counts are pre-aggregated per task, so a host with a third of all documents costs no more.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("fails").cast("long")).alias("n_fail"))
    rate = F.col("n_fail") / F.col("n_docs")
    prior = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_fail").alias("f"), F.count("*").alias("h"),
        F.sum(F.col("n_docs") * rate * rate).alias("s2"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("nn"),
    )
    m = F.col("f") / F.col("n")
    between = F.col("s2") / F.col("n") - m * m
    sampling = m * (1 - m) * (F.col("h") / F.col("n"))
    strength = F.when(between - sampling > 0, F.greatest(m * (1 - m) / F.nullif(between - sampling, F.lit(0.0)) - 1, F.lit(1.0))).otherwise(F.col("n").cast("double"))
    prior = prior.select((m * strength).alias("a"), ((1 - m) * strength).alias("b"))
    shrunk = (F.col("n_fail") + F.col("a")) / (F.col("n_docs") + F.col("a") + F.col("b"))
    # the prior is one row by construction
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_fail", rate.alias("raw_rate"), shrunk.alias("shrunk_rate"), (shrunk >= max_rate).alias("host_fails"))


def flag_repetition(docs: DataFrame, *, max_rate: float = 0.2, **options) -> DataFrame:
    """The rows of :func:`repeated_share` with their host's ``shrunk_rate`` and ``host_fails``, and a ``verdict``.

    ``verdict`` is 'document' where the document fails itself, 'host' where only its host does, else 'clean'; a filter by it drops
    repetitive documents and hosts. The measured rows are small (no text); the join with the hosts is left to the planner, which
    broadcasts the host table where it is small and splits hot hosts otherwise.
    """
    measured = cut(repeated_share(docs, **options))  # texts are read once for the three uses below
    rates = host_rates(measured, max_rate=max_rate)
    verdict = F.when(F.col("fails"), "document").when(F.col("host_fails"), "host").otherwise("clean")
    return measured.join(rates.select("host", "n_docs", "shrunk_rate", "host_fails"), "host").withColumn("verdict", verdict)
