"""Items placed into containers of fixed capacity by the sum-of-squares rule.

The rule is sequential, so the corpus is cut into shards of a bounded number of documents, and every
shard and capacity is packed by one task on (id, size) rows alone. A shard leaves only a few bins
partly filled, which is lost in the tens of thousands of documents that it holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.words import batches_of
from querymill.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern of that vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cuts of a text at which no token crosses; \s of Python and of the pattern differ in UNSURE only.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
UNSURE = re.compile(r"[\x1c-\x1f]")


class TokenCounter:
    """Tokens of a text; chunks between blanks recur, so their counts are kept (up to ``keep`` of them)."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, keep: int = 300_000):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.keep, self.known = keep, {}

        class Known(dict):
            def __missing__(known, chunk):  # noqa: N805
                n = len(self.encoding.encode_ordinary(chunk))
                if len(chunk) <= 40 and len(known) < self.keep:
                    known[chunk] = n
                return n

        self.known = Known()

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if UNSURE.search(text):
            return len(self.encoding.encode_ordinary(text.encode("utf-8", "replace").decode()))
        try:
            return sum(map(self.known.__getitem__, CHUNK.findall(text)))
        except UnicodeEncodeError:  # a lone surrogate counts as the replacement character
            return len(self.encoding.encode_ordinary(text.encode("utf-8", "replace").decode()))


def counter(ranks: bytes) -> TokenCounter:
    """One counter per Python worker and vocabulary."""
    kept = sys.modules.setdefault("_querymill_counters", type(sys)("_querymill_counters")).__dict__
    key = hashlib.md5(ranks).hexdigest()
    if key not in kept:
        kept[key] = TokenCounter(ranks)
    return kept[key]


def token_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                batch_chars: int = 8_000_000) -> DataFrame:
    """``doc_id, n_tokens`` by a byte-level vocabulary of ranks; null and empty texts have 0 tokens.

    The vocabulary file (under 1 MB) is read by the driver and sent to each executor once.
    """
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(frames):
        count_ = counter(ranks.value)
        for pdf in batches_of(frames, batch_chars):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n_tokens": [count_(t) for t in pdf["text"]]})

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInPandas(count, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def sum_of_squares(sizes, capacity: int):
    """Bins of items that are no larger than ``capacity``, in the order given: (bin of each item, fill of each bin).

    With N[g] open bins whose gap is g, an item goes where the sum of N[g] squared becomes smallest;
    a full bin isn't counted. Ties go to the fullest bin, then to the one opened last.
    """
    n_open = np.zeros(capacity + 1, np.int64)  # by level; level 0 is a new bin, `capacity` is full
    stacks: dict[int, list[int]] = {}
    fill: list[int] = []
    where = np.empty(len(sizes), np.int64)
    for i, s in enumerate(np.asarray(sizes, np.int64).tolist()):
        # moving a bin from level h to h + s changes the sum by 2 N[h+s] + 1 and -2 N[h] + 1
        gain = 2 * n_open[s : capacity + 1] + 1
        gain[-1] = 0
        have = n_open[: capacity + 1 - s]
        change = np.where(have > 0, gain - 2 * have + 1, np.iinfo(np.int64).max)
        change[0] = gain[0]
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        if level:
            b = stacks[level].pop()
            n_open[level] -= 1
        else:
            b = len(fill)
            fill.append(0)
        fill[b] += s
        where[i] = b
        if level + s < capacity:
            n_open[level + s] += 1
            stacks.setdefault(level + s, []).append(b)
    return where, np.array(fill, np.int64)


def pack_shard(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """``doc, piece, n_tokens, bin, bin_tokens`` of one shard.

    Items beyond the capacity give full pieces, each a bin of its own, and a rest; the rests and all
    other items are packed in descending size, in which the rule leaves few gaps.
    """
    full = np.where(sizes > capacity, sizes // capacity, 0)
    rest = sizes - full * capacity
    cut = np.repeat(np.arange(len(ids)), full)
    piece = np.arange(len(cut)) - np.repeat(np.cumsum(full) - full, full)
    small = np.flatnonzero(rest > 0)
    small = small[np.argsort(-rest[small], kind="stable")]
    where, fill = sum_of_squares(rest[small], capacity)
    return pd.DataFrame({
        "doc": np.concatenate([cut, small]),
        "piece": np.concatenate([piece, full[small]]),
        "n_tokens": np.concatenate([np.full(len(cut), capacity, np.int64), rest[small]]),
        "bin": np.concatenate([np.arange(len(cut)), len(cut) + where]),
        "bin_tokens": np.concatenate([np.full(len(cut), capacity, np.int64), fill[where]]),
    })


def pack(sizes: DataFrame, capacities: dict[int, int], *, shard_docs: int = 50_000) -> DataFrame:
    """``pack_id, capacity_tokens, bin_id, doc_id, piece, n_tokens, bin_tokens``, a row per placed piece.

    ``capacities`` gives the capacity of each pack_id. Documents without tokens take no place and have no
    row. Ids are strings or numbers; rows with the same id and size are packed one by one. The result
    depends on the rows only, not on their order or the number of tasks.
    """
    sizes = cut(sizes)  # sizes may come from a tokenizer, and are used twice
    n = max(1, sizes.count())
    shards = -(-n // shard_docs)
    packs = F.explode(F.array(*[F.struct(F.lit(int(p)).alias("pack_id"), F.lit(int(c)).alias("capacity_tokens")) for p, c in sorted(capacities.items())]))
    kind = sizes.schema["doc_id"].dataType.simpleString()
    rows = sizes.where("n_tokens > 0").select(packs.alias("p"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n_tokens")

    def run(key, pdf):
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        pack_id, capacity, shard = (int(k) for k in key)
        out = pack_shard(pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy(), capacity)
        return pd.DataFrame({"pack_id": np.int32(pack_id), "capacity_tokens": np.int32(capacity), "bin_id": shard * 2**40 + out["bin"], "doc_id": pdf["doc_id"].to_numpy()[out["doc"]], "piece": out["piece"], "n_tokens": out["n_tokens"], "bin_tokens": out["bin_tokens"]})

    return rows.select("p.pack_id", "p.capacity_tokens", "shard", "doc_id", "n_tokens").groupBy("pack_id", "capacity_tokens", "shard").applyInPandas(
        run, f"pack_id int, capacity_tokens int, bin_id long, doc_id {kind}, piece long, n_tokens long, bin_tokens long"
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """``pack_id, capacity_tokens, n_bins, least_bins, n_pieces, n_tokens, fill``: the fill reached for each capacity; no packing needs fewer than ``least_bins`` bins."""
    return (
        packed.groupBy("pack_id", "capacity_tokens")
        # a bin's tokens are shared out over its pieces, so that bins count without a shuffle by bin
        .agg(F.sum(F.when(F.col("piece") >= 0, F.col("n_tokens") / F.col("bin_tokens"))).alias("bins"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
        .select("pack_id", "capacity_tokens", F.round("bins").cast("long").alias("n_bins"), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_bins"), "n_pieces", "n_tokens", F.round(F.col("n_tokens") / (F.round("bins") * F.col("capacity_tokens")), 6).alias("fill"))
    )


def invariants(packed: DataFrame) -> DataFrame:
    """``pack_id, capacity_tokens, n_docs, n_over, n_cut_small, within_bound``: what every packing must hold.

    ``n_docs`` are the documents placed, ``n_over`` the bins with more tokens than the capacity or than they say, ``n_cut_small`` the documents that were cut though they
    fit; ``within_bound`` tells whether at most one bin in fifty is more than the bound needs.
    """
    bins = packed.groupBy("pack_id", "capacity_tokens", "bin_id").agg(F.sum("n_tokens").alias("t"), F.max("bin_tokens").alias("b"))
    over = bins.groupBy("pack_id", "capacity_tokens").agg(F.count_if((F.col("t") > F.col("capacity_tokens")) | (F.col("t") != F.col("b"))).alias("n_over"), F.count("*").alias("n_bins"), F.sum("t").alias("t"))
    docs = packed.groupBy("pack_id", "capacity_tokens", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"))
    cut_ = docs.groupBy("pack_id", "capacity_tokens").agg(F.count("*").alias("n_docs"), F.count_if((F.col("k") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("n_cut_small"))
    bound = F.col("n_bins") <= F.ceil(F.col("t") / F.col("capacity_tokens")) * 1.02 + 1
    return cut_.join(over, ["pack_id", "capacity_tokens"]).select("pack_id", "capacity_tokens", "n_docs", "n_over", "n_cut_small", bound.alias("within_bound"))
