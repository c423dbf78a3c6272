"""Passages of held-out items inside a training corpus, by suffix arrays over shards of the corpus.

Each Arrow batch of documents is a shard. Its words become integers of the items' vocabulary; a stretch
of a document that could hold a match consists of such words only, and each pair of neighbours in it must
be neighbours in some item. Those stretches alone enter the shard's suffix array (this loses no match of
two words or more), every item suffix is searched in it by bisection, and the suffixes with a match of
the wanted length give the document, the item, the place and the longest verbatim match. Documents
never move; only matches leave a shard.

Items are indexed in blocks of a bounded number of words, each by one task and once; the driver hands the blocks on, one after another. Where there
are several blocks, the corpus is still read once: a bit map of all items' word pairs, of fixed size, picks the stretches that can match any
block, and these are searched block by block.
"""

from __future__ import annotations

import pickle
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.words import WORD, batches_of, mix64
from querymill.runtime import cut


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``tokens`` in the order of their first ``depth`` tokens or more (prefix doubling)."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth and n:
        second = np.full(n, -1, np.int64)
        second[:-width] = rank[width:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        width *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


def bisect(tokens, order, query, starts, depth):
    """Intervals of ``order`` whose suffixes share ``depth`` tokens with the query suffixes at ``starts``.

    All query suffixes go through the binary search together, one token deeper each round; those
    without a match left are dropped. Returns (starts, low, high) of the ones that remain.
    """
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    for d in range(depth):
        want = query[starts + d]
        bounds = []
        for right in (False, True):
            lo, hi = low.copy(), high.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                at = order[np.minimum(mid, len(order) - 1)] + d
                have = np.where(at < len(tokens), tokens[np.minimum(at, len(tokens) - 1)], -1)
                up = open_ & ((have <= want) if right else (have < want))
                lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
            bounds.append(lo)
        keep = bounds[0] < bounds[1]
        starts, low, high = starts[keep], bounds[0][keep], bounds[1][keep]
        if not len(starts):
            break
    return starts, low, high


class ItemIndex:
    """A block of items as word integers, one after another; 0 stands between items."""

    def __init__(self, items: list[tuple], words: int):
        self.words, self.ids, self.vocabulary = words, [i for i, _ in items], {}
        tokens, owner = [0], [-1]
        for k, (_, text) in enumerate(items):
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall((text or "").lower())]
            tokens += [*found, 0]
            owner += [k] * (len(found) + 1)
        tokens += [0] * words
        self.tokens, self.owner = np.array(tokens, np.int64), np.array(owner + [-1] * words, np.int64)
        inside = np.lib.stride_tricks.sliding_window_view(self.tokens, words).all(axis=1)
        self.starts = np.flatnonzero(inside)
        self.wide = len(self.vocabulary) + 1
        self.pairs = np.unique(self.tokens[:-1] * self.wide + self.tokens[1:])

    def matches(self, texts) -> pd.DataFrame:
        """row (of texts), item (number), doc_word, item_word, n_words for each maximal match."""
        get, parts, counts = self.vocabulary.get, [np.zeros(1, np.int64)], []
        for text in texts:
            words = WORD.findall(text.lower()) if text else ()
            parts += [np.fromiter((get(w, 0) for w in words), np.int64, len(words)), parts[0]]
            counts.append(len(words) + 1)
        all_, begin = np.concatenate(parts), np.concatenate([[1], 1 + np.cumsum(counts)])
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "item", "doc_word", "item_word", "n_words")})
        if not len(self.starts):
            return none
        # words that stand in a run of item word pairs of at least the wanted length
        code = all_[:-1] * self.wide + all_[1:]
        near = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        linked = (self.pairs[near] == code) & (all_[:-1] > 0) & (all_[1:] > 0)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]  # a run of words is first..last, both within
        long_ = last - first + 1 >= self.words
        first, last = first[long_], last[long_]
        if not len(first):
            return none
        size = last - first + 2  # and a 0 behind each run
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(first, size)
        tokens = all_[place]
        tokens[ends - 1] = 0
        order = suffix_array(tokens, self.words)
        starts, low, high = bisect(tokens, order, self.tokens, self.starts, self.words)
        if not len(starts):
            return none
        count = high - low
        item_at = np.repeat(starts, count)
        doc_at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        # a hit whose left neighbours agree as well only continues another one
        left = (tokens[np.maximum(doc_at - 1, 0)] == self.tokens[item_at - 1]) & (doc_at > 0) & (self.tokens[item_at - 1] > 0)
        item_at, doc_at = item_at[~left], doc_at[~left]
        length, open_ = np.full(len(doc_at), self.words, np.int64), np.arange(len(doc_at))
        while len(open_):
            a, b = tokens[np.minimum(doc_at[open_] + length[open_], len(tokens) - 1)], self.tokens[item_at[open_] + length[open_]]
            open_ = open_[(a == b) & (a > 0)]
            length[open_] += 1
        at = place[doc_at]
        row = np.searchsorted(begin, at, "right") - 1
        item = self.owner[item_at]
        item_begin = np.searchsorted(self.owner, item, "left")
        return pd.DataFrame({"row": row, "item": item, "doc_word": at - begin[row], "item_word": item_at - item_begin, "n_words": length})


BITS = 1 << 27
PART = 32 << 20


def word_codes(texts, known: dict):
    """(codes, starts): a 32-bit code of each word of all texts, and where each text begins. ``known`` keeps the codes of words seen."""
    counts, parts = [0], []
    for text in texts:
        words = WORD.findall(text.lower()) if text else ()
        counts.append(len(words))
        for w in words:
            if w not in known:
                if len(known) > 1_000_000:
                    known.clear()
                known[w] = crc32(w.encode("utf-8", "surrogatepass"))
        parts.append(np.fromiter((known.get(w) or crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(counts)


def pair_bits(codes: np.ndarray) -> np.ndarray:
    """The place in the bit map of each pair of neighbouring codes."""
    return (mix64(codes[:-1] * np.uint64(0x9E3779B1) ^ (codes[1:] << np.uint64(31))) % np.uint64(BITS)).astype(np.int64)


def item_blocks(items: DataFrame, words: int, block_words: int) -> DataFrame:
    """``block, part, index, pairs``: the indexes of blocks of items, pickled and cut into parts, and the places of their word pairs in the bit map.

    A block has about ``block_words`` words, or one item if that is longer; items are dealt to blocks by hash.
    """
    total = items.agg(F.sum(F.length("t") / 4 + 1)).first()[0] or 0
    blocks = max(1, int(-(-total // block_words)))

    def build(key, pdf):
        pdf = pdf.sort_values(["i", "t"])
        raw = pickle.dumps(ItemIndex(list(zip(pdf["i"].tolist(), pdf["t"])), words))
        codes, starts = word_codes(pdf["t"], {})
        inside = np.ones(max(len(codes) - 1, 0), bool)
        inside[starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(codes))] - 1] = False
        bits = np.unique(pair_bits(codes)[inside]) if len(codes) > 1 else np.zeros(0, np.int64)
        parts = range(0, len(raw), PART)
        return pd.DataFrame({"block": np.int32(key[0]), "part": np.arange(len(parts), dtype=np.int32), "index": [raw[i : i + PART] for i in parts], "pairs": [bits.astype("<i4").tobytes() if i == 0 else b"" for i in parts]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int"))
    return cut(dealt.groupBy("block").applyInPandas(build, "block int, part int, index binary, pairs binary"))


def stretches(docs: DataFrame, bits, words: int, batch_chars: int) -> DataFrame:
    """``doc_id, version, text, first``: runs of at least ``words`` words of a document whose neighbours may all be neighbours in an item; ``first`` is their place in words."""

    def run(frames):
        on, known = bits.value, {}
        for pdf in batches_of(frames, batch_chars):
            texts = pdf["text"].tolist()
            codes, starts = word_codes(texts, known)
            if len(codes) < words:
                continue
            place = pair_bits(codes)
            linked = (on[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
            ends = starts[1:-1]
            linked[ends[(ends > 0) & (ends < len(codes))] - 1] = False
            edge = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
            first, last = edge[::2], edge[1::2]
            keep = last - first + 1 >= words
            first, last = first[keep], last[keep]
            if not len(first):
                continue
            doc = np.searchsorted(starts, first, "right") - 1
            split = {d: WORD.findall(texts[d].lower()) for d in np.unique(doc)}
            own = first - starts[doc]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[doc], "version": pdf["version"].to_numpy()[doc], "text": [" ".join(split[d][a : a + n]) for d, a, n in zip(doc, own, last - first + 1)], "first": own})

    return docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, version long, text string, first long")


def leaked_passages(docs: DataFrame, items: DataFrame, *, words: int = 12, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", block_words: int = 2_000_000, batch_chars: int = 8_000_000) -> DataFrame:
    """``doc_id, item_id, n_matches, longest_words, doc_word, item_word``: one row per document id and item it leaks.

    ``longest_words`` is the length of the longest verbatim match, ``doc_word`` and ``item_word`` its
    first place in words from 0. A match has at least ``words`` words in a row (two or more), compared in lower case.
    Items may be any number; their index is made in blocks of about ``block_words`` words. Null or short items match nothing; null and empty documents have no row; equal items
    each have their own rows; a document row that is repeated whole has its rows once.
    """
    known = items.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null").distinct()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("version", F.xxhash64("text"))
    doc_kind, item_kind = src.schema["doc_id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, n_matches long, longest_words long, doc_word long, item_word long, version long, first long"
    spark = docs.sparkSession
    shelf = item_blocks(known, words, block_words)
    blocks = sorted(r["block"] for r in shelf.select("block").distinct().collect())  # as many as there are blocks

    def search(index, rows):
        def run(frames):
            own = index.value
            ids = np.array(own.ids, dtype=object)
            for pdf in batches_of(frames, batch_chars):
                hits = own.matches(pdf["text"])
                if hits.empty:
                    continue
                hits["doc_id"], hits["item_id"] = pdf["doc_id"].to_numpy()[hits["row"]], ids[hits["item"]]
                hits["doc_word"] += pdf["first"].to_numpy()[hits["row"]]
                hits = hits.sort_values(["doc_id", "item_id", "row", "n_words", "doc_word", "item_word"], ascending=[True, True, True, False, True, True])
                best = hits.groupby(["doc_id", "item_id", "row"], sort=False).agg(n_matches=("n_words", "size"), longest_words=("n_words", "first"), doc_word=("doc_word", "first"), item_word=("item_word", "first")).reset_index()
                best["item_id"] = best["item_id"].infer_objects()
                best["version"], best["first"] = pdf["version"].to_numpy()[best["row"]], pdf["first"].to_numpy()[best["row"]]
                yield best.drop(columns="row")

        return rows.mapInPandas(run, schema)

    def fetched(block):
        """One block, which is bounded, by way of the driver; its places in the bit map."""
        parts = sorted(shelf.where(F.col("block") == block).collect(), key=lambda r: r["part"])
        return spark.sparkContext.broadcast(pickle.loads(b"".join(r["index"] for r in parts))), np.frombuffer(b"".join(r["pairs"] for r in parts), "<i4")

    if len(blocks) > 1:
        on, indexes = np.zeros(BITS >> 3, np.uint8), []
        for b in blocks:
            index, bits = fetched(b)
            np.bitwise_or.at(on, bits >> 3, np.uint8(1) << (bits & 7).astype(np.uint8))
            indexes.append(index)
        rows = cut(stretches(src, spark.sparkContext.broadcast(on), words, batch_chars))
    else:
        indexes, rows = [fetched(b)[0] for b in blocks], src.withColumn("first", F.lit(0).cast("long"))
    out = spark.createDataFrame([], schema)
    for i, index in enumerate(indexes):
        part = search(index, rows)
        out = part if i == 0 else out.unionByName(part)
    # the stretches of a text add up, its repeats count once, and of several texts of one id the one with most matches counts
    order = F.struct("longest_words", -F.col("doc_word"), -F.col("item_word"))
    best = [F.max("longest_words").alias("longest_words"), F.max_by("doc_word", order).alias("doc_word"), F.max_by("item_word", order).alias("item_word")]
    each = out.dropDuplicates(["doc_id", "item_id", "version", "first"])
    per_text = each.groupBy("doc_id", "item_id", "version").agg(F.sum("n_matches").alias("n_matches"), *best)
    return per_text.groupBy("doc_id", "item_id").agg(F.max("n_matches").alias("n_matches"), *best)


def without_leaks(docs: DataFrame, leaks: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The documents that leak nothing."""
    return docs.join(leaks.select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti")
