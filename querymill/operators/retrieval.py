"""Ranking of documents for many queries at once: BM25, cosine, and fusion of ranked lists.

A query is a row. Scores are rounded before they are ranked and ties go to the smaller id, so ranks are the same
on every run. Top-k uses row_number per query, which Spark limits before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.runtime import cut


def top_k(hits: DataFrame, k: int, *, by: str = "query_id", score: str = "score", tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), tie)
    return hits.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def with_counts(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep, dl, term, tf``: the terms of each row's ``terms`` array, counted where the row is read, those of a row together; null terms don't count.

    Each row also gives one without term, with tf 0, which stands for the row itself.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keep).schema}

    def run(batches):
        for b in batches:
            lists = b.column("terms")
            flat, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, codes = np.repeat(np.arange(len(n)), n), flat.dictionary_encode()
            known = ~codes.indices.is_null().to_numpy(zero_copy_only=False)
            size = max(len(codes.dictionary), 1)
            key, tf = np.unique(owner[known] * size + pc.fill_null(codes.indices, 0).to_numpy(zero_copy_only=False)[known], return_counts=True)
            row = np.concatenate([key // size, np.arange(len(n))])
            order = np.argsort(row, kind="stable")
            term = pa.concat_arrays([codes.dictionary.take(pa.array(key % size)), pa.nulls(len(n), codes.dictionary.type)])
            dl = np.bincount(owner[known], minlength=len(n))
            take = pa.array(order)
            row = row[order]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(row)) for c in keep], pa.array(dl[row], pa.int64()), term.take(take).cast(pa.string()), pa.array(np.concatenate([tf, np.zeros(len(n), np.int64)])[order], pa.int64())], names=[*keep, "dl", "term", "tf"])

    return rows.select(*keep, "terms").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "dl long, term string, tf long"]))


def bm25(queries: DataFrame, docs: DataFrame, *, k: int = 5, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, same: list[str] | None = None, max_broadcast: int = 1_000_000) -> DataFrame:
    """``query_id, doc_id, score, rank`` from (query_id, terms) and (doc_id, terms) rows with term arrays.

    idf is ln(N - df + .5) - ln(df + .5); a negative one becomes ``floor`` times the mean idf over all terms. A term that a query repeats
    counts that often. Corpus statistics are taken over all documents, also where ``same`` names
    columns that a query and its documents must share. Documents without a query term have no score. Empty and null term arrays count as empty.

    Terms are counted inside each document's row, which never moves: the first pass shuffles one count a term and task, and in the second each task scores the documents
    it reads and passes on the ``k`` best of a query and batch. That holds for queries of at most ``max_broadcast`` terms in all (counted first), which are
    sent to the documents; larger sets are joined by term, and one row a query and document with a common term is shuffled.
    """
    same = same or []
    counted = with_counts(docs, "doc_id", *same)
    stats = cut(counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    n, length = stats.agg(F.max(F.when(F.col("term").isNull(), F.col("df"))), F.sum("cf")).first()
    layout = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    kind = queries.schema["query_id"].dataType.simpleString()
    if not n:
        return docs.sparkSession.createDataFrame([], f"query_id {kind}, doc_id {layout}, score double, rank int")
    avgdl = max(length / n, 1e-9)
    raw = stats.where("term is not null").select("term", (F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf")).first()[0] or 0.0
    asked = with_counts(queries, "query_id", *same).where("term is not null").groupBy("query_id", *same, "term").agg(F.sum("tf").alias("qf"))
    idf = raw.join(asked.select("term").distinct(), "term", "left_semi").select("term", F.when(F.col("idf") < 0, floor * mean).otherwise(F.col("idf")).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl))))
    held = asked.limit(max_broadcast + 1).toArrow()
    if held.num_rows > max_broadcast:
        weighed = counted.join(idf, "term").select("doc_id", *same, "term", weight.alias("w"))
        scored = weighed.join(asked, [*same, "term"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qf") * F.col("w")), 6).alias("score"))
        return top_k(scored, k)
    weighed = counted.join(F.broadcast(idf), "term").select("doc_id", *same, "term", weight.alias("w"))
    found = weighed.mapInPandas(_scorer(docs.sparkSession.sparkContext.broadcast(held.to_pandas()), same, k), f"query_id {kind}, doc_id {layout}, score double")
    return top_k(found.select("query_id", "doc_id", F.round("score", 6).alias("score")), k)


def _scorer(asked, same: list[str], k: int, cells: int = 2_000_000):
    """A function over batches of (doc_id, same, term, w) rows, those of a document together: the ``k`` best documents of each query and batch."""

    def run(frames):
        a = asked.value
        queries, q = np.unique(a["query_id"].to_numpy(), return_inverse=True)
        terms = {t: i for i, t in enumerate(pd.unique(a["term"]))}
        group = {g: i for i, g in enumerate(dict.fromkeys(zip(*[a[c] for c in same])))} if same else {(): 0}
        code = a["term"].map(terms).to_numpy()
        order = np.argsort(code, kind="stable")
        q, qf = q[order], a["qf"].to_numpy(np.float64)[order]
        own = np.array([group[x] for x in zip(*[a[c] for c in same])], np.int64)[order] if same else np.zeros(len(order), np.int64)
        start = np.searchsorted(code[order], np.arange(len(terms) + 1))

        def best(part):
            change = np.flatnonzero(np.diff(part["doc_id"].factorize()[0])) + 1
            first = np.concatenate([[0], change])
            at_once = max(1, cells // max(len(queries), 1))
            for i in range(0, len(first), at_once):
                end = first[i + at_once] if i + at_once < len(first) else len(part)
                yield dense(part.iloc[first[i] : end], first[i : i + at_once] - first[i])

        def dense(part, first):
            """Scores of all queries for a few documents, added up term by term."""
            n = len(first)
            ids, doc = part["doc_id"].to_numpy()[first], np.repeat(np.arange(n), np.diff(np.append(first, len(part))))
            t = part["term"].map(terms).to_numpy()
            many = start[t + 1] - start[t]
            g = np.array([group.get(x, -1) for x in zip(*[part[c] for c in same])], np.int64) if same else None
            w, cuts = part["w"].to_numpy(), np.flatnonzero(np.diff(np.cumsum(many) // cells)) + 1
            score, hit = np.zeros(len(queries) * n), np.zeros(len(queries) * n, bool)
            for rows in np.split(np.arange(len(part)), cuts):
                m = many[rows]
                row = np.repeat(rows, m)
                at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[t[rows]], m)
                if same:
                    fit = own[at] == g[row]
                    row, at = row[fit], at[fit]
                key = q[at] * n + doc[row]
                score += np.bincount(key, w[row] * qf[at], len(score))
                hit[key] = True
            score = np.where(hit, score, -np.inf).reshape(len(queries), n)
            # scores are rounded later: whatever may tie with the last place stays in
            last = np.partition(score, -k, axis=1)[:, -k] if n > k else np.full(len(queries), -np.inf)
            i, j = np.nonzero((score >= last[:, None] - 2e-6) & (score > -np.inf))
            return pd.DataFrame({"query_id": queries[i], "doc_id": ids[j], "score": score[i, j]})

        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            ids = pdf["doc_id"].to_numpy()
            # the last document's rows may go on in the next batch
            change = np.flatnonzero(ids[1:] != ids[:-1])
            if not len(change):
                rest = pdf
                continue
            end = int(change[-1]) + 1
            rest = pdf.iloc[end:]
            yield from best(pdf.iloc[:end])
        if rest is not None and len(rest):
            yield from best(rest)

    return run


def cosine_top_k(queries: DataFrame, vectors: DataFrame, *, k: int = 5, same: list[str] | None = None, block: int = 4_096) -> DataFrame:
    """``query_id, doc_id, score, rank``: exact cosine of stated queries against all vectors that share the columns ``same``, themselves left out.

    The queries are sent to the vectors in blocks of ``block`` (they must be a stated set; for each vector against all others use an index); each task multiplies
    its batches with a block and passes on the ``k`` best of a query and batch. Null, empty and all-zero vectors have no neighbours.
    """
    same = same or []
    spark = vectors.sparkSession
    usable = F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0)
    q = cut(queries.where(usable).select("query_id", *same, F.col("vec").cast("array<double>").alias("vec")).withColumn("b", F.monotonically_increasing_id()))
    v = vectors.where(usable).select("doc_id", *same, F.col("vec").cast("array<double>").alias("vec"))
    kinds = q.schema["query_id"].dataType.simpleString(), v.schema["doc_id"].dataType.simpleString()
    n, out = q.count(), None
    lanes = max(1, -(-n // block))
    for lane in range(lanes):
        held = spark.sparkContext.broadcast(q.where(F.pmod(F.xxhash64("b"), F.lit(lanes)) == lane).drop("b").toPandas())
        part = v.mapInPandas(_nearest(held, same, k), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out.select("query_id", "doc_id", F.round("score", 6).alias("score")), k)


def _nearest(held, same: list[str], k: int):
    def unit_(rows):
        x = np.array(rows.to_list(), np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(frames):
        q = held.value
        if not len(q):
            return
        a, name = unit_(q["vec"]), q["query_id"].to_numpy()
        for pdf in frames:
            if not len(pdf):
                continue
            s = a @ unit_(pdf["vec"]).T
            ok = name[:, None] != pdf["doc_id"].to_numpy()[None, :]
            for c in same:
                ok &= q[c].to_numpy()[:, None] == pdf[c].to_numpy()[None, :]
            s[~ok] = -2.0
            last = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -1.5)
            i, j = np.nonzero((s >= last[:, None] - 2e-6) & ok)
            yield pd.DataFrame({"query_id": name[i], "doc_id": pdf["doc_id"].to_numpy()[j], "score": s[i, j]})

    return run


def similar_within(vectors: DataFrame, *, group: str, least: float, block: int = 2_048) -> DataFrame:
    """``group, a, b, score`` (a < b): pairs of one group with a cosine of at least ``least``, by products of blocks.

    A group is cut into blocks of about ``block`` vectors by hash; every pair of blocks is one task's, so a large group is spread over many tasks.
    """
    usable = F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0)
    v = vectors.where(usable).select(group, F.col("doc_id").cast("string").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    size = v.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = v.join(size, group).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "vec")

    def run(key, pdf):
        x = np.array(pdf["vec"].to_list(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        first = (pdf["own"] == key[1]).to_numpy()
        left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if key[1] != key[2] else (np.arange(len(pdf)),) * 2
        ids, found = pdf["doc_id"].to_numpy(object), [(np.zeros(0, object), np.zeros(0, object), np.zeros(0))]
        s = x[left] @ x[right].T
        i, j = np.nonzero(s >= least - 1e-6)
        a, b = ids[left[i]], ids[right[j]]
        fit = (a < b) if key[1] == key[2] else (a != b)
        found.append((np.minimum(a[fit], b[fit]), np.maximum(a[fit], b[fit]), s[i, j][fit]))
        a, b, c = (np.concatenate(y) for y in zip(*found))
        return pd.DataFrame({group: key[0], "a": a, "b": b, "score": c})

    kind = v.schema[group].dataType.simpleString()
    out = dealt.groupBy(group, "i", "j").applyInPandas(run, f"{group} {kind}, a string, b string, score double")
    return out.withColumn("score", F.round("score", 6)).where(F.col("score") >= least)


def rrf(lists: list[tuple[DataFrame, float]], *, k: int = 60, top: int = 10) -> DataFrame:
    """Reciprocal rank fusion of (hits, weight) lists: ``query_id, doc_id, score, n_lists, rank``; score is the sum of weight / (k + rank)."""
    all_ = None
    for hits, weight in lists:
        part = hits.select("query_id", "doc_id", (F.lit(float(weight)) / (k + F.col("rank"))).alias("s"))
        all_ = part if all_ is None else all_.unionByName(part)
    fused = all_.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 8).alias("score"), F.count("*").alias("n_lists"))
    return top_k(fused, top)


def retrieve_multi(hits: DataFrame, *, k: int = 60, top: int = 10) -> DataFrame:
    """Fusion over the sub-queries of a query: ``hits`` has query_id, subq, doc_id, rank."""
    fused = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 8).alias("score"), F.min("rank").alias("best_rank"))
    return top_k(fused, top)
