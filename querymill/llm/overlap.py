"""Records of evaluation splits that also stand, exactly or almost, in the training split.

Fingerprints are winnowed from rolling hashes and joined across the splits. Near pairs may have their words in any order, so
a record is read as its distinct words in one common order (by hash); in that order whatever two records share is collinear.
If they share a part t of all their words, a run of neighbours in that order is shared, and its least length
is known from the number of words: at 0.6 it is two words from six words on. Hashes of two neighbouring words are
therefore rolled over the places, and in each window of that run's length the least one is selected (for short records the hashes of single words, too); no
pair is lost. Selected minima are joined together with what both records must agree on (database and constants), the seeds
of a pair are chained and extended by alignment, and the words that the alignment covers decide. Copies are joined once, as a class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.sqltext import constants, letter_words
from querymill.operators.dedupe import latest
from querymill.runtime import cut

def records(examples: DataFrame) -> DataFrame:
    """``id, db_id, side, consts, words, split, source, question, sql`` of examples that can take part.

    Deliveries count once per example_id. A record needs a train, dev or test split, a database, at least one constant in its
    ``sql`` and at least one word in its ``question``; what lacks one of them agrees with nothing.
    """
    one = latest(examples, "example_id", "ingested_at", ["db_id", "split", "source", "question", "sql"])
    side = F.when(F.col("split") == "train", "train").when(F.col("split").isin("dev", "test"), "eval")
    return one.select(
        F.col("example_id").alias("id"), "db_id", side.alias("side"), constants(F.col("sql")).alias("consts"), F.array_sort(letter_words(F.col("question"))).alias("words"),
        "split", "source", "question", "sql",
    ).where("side is not null and db_id is not null and size(consts) > 0 and size(words) > 0")


def classes(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, split, source, side, class) and classes (class, block, hashes, train, eval) of equal records.

    Words are compared by 64-bit hashes from here on, in the order of these; blocks and classes have 128 bits.
    """
    both = lambda *c: F.struct(F.xxhash64(*c).alias("a"), F.xxhash64(F.lit(1), *c).alias("b"))
    hashed = recs.select("id", "split", "source", "side", both(F.col("db_id"), F.col("consts")).alias("block"), both(F.col("db_id"), F.col("consts"), F.col("words")).alias("class"), F.array_sort(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))).alias("hashes"))
    members = hashed.select("id", "split", "source", "side", "class")
    kinds = hashed.groupBy("class").agg(F.first("block").alias("block"), F.first("hashes").alias("hashes"), F.max((F.col("side") == "train").cast("int")).alias("train"), F.max((F.col("side") == "eval").cast("int")).alias("eval"))
    return members, kinds


def shared_run(n: int, threshold: float) -> int:
    """The least length of the longest shared run of a record of ``n`` words and any other with shared / all words >= ``threshold``.

    With u words in all, s = ceil(threshold * u) of them are shared at least, and the u - s others cut them into u - s + 1 runs at most.
    """
    least = n
    for u in range(n, int(n / threshold + 1e-9) + 1):
        s = int(np.ceil(threshold * u - 1e-9))
        if s <= n:
            least = min(least, -(-s // (u - s + 1)))
    return max(least, 1)


def fingerprints(hashes: Column, threshold: float, *, longest: int = 200) -> Column:
    """The selected hashes of a record's words: in each window over its rolled word pairs the least; records whose shared run may be one word give single words, too."""
    runs = [shared_run(n, threshold) for n in range(1, longest + 1)]
    n = F.size(hashes)
    run = F.element_at(F.array(*[F.lit(r) for r in runs]), F.least(n, F.lit(longest)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)))).otherwise(F.array().cast("array<bigint>"))
    if max(runs) > 2:
        width = F.greatest(run - 1, F.lit(1))
        m = F.size(pairs)
        pairs = F.when(m > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(m - width + 1, F.lit(1))), lambda i: F.array_min(F.slice(pairs, i, width))))).otherwise(pairs)
    return F.concat(pairs, F.when(run == 1, hashes).otherwise(F.array().cast("array<bigint>")))


def seeds(kinds: DataFrame, threshold: float) -> DataFrame:
    """``seed, class, n, train, eval``: the fingerprints of classes together with their block, ids only."""
    prints = kinds.select("class", "block", F.size("hashes").alias("n"), "train", "eval", F.explode(fingerprints(F.col("hashes"), threshold)).alias("print"))
    return prints.select(F.xxhash64("block.a", "block.b", "print").alias("seed"), "class", "n", "train", "eval")


def similar_classes(kinds: DataFrame, threshold: float, *, lane: int = 1_024) -> DataFrame:
    """``train_class, eval_class, seeds, shared, all_words`` of classes in one block with shared / all words >= threshold.

    A seed of more than ``lane`` training classes is spread over lanes of that size; nothing is left out.
    """
    # blocks that only one side has can't give a pair; the block key alone decides that
    sides = kinds.groupBy("block").agg(F.max("train").alias("t"), F.max("eval").alias("e")).where("t = 1 and e = 1").select("block")
    kept = cut(kinds.join(sides, "block", "left_semi"))
    found = cut(seeds(kept, threshold))
    t = found.where("train = 1").select("seed", F.col("class").alias("train_class"), F.col("n").alias("nt"))
    e = found.where("eval = 1").select("seed", F.col("class").alias("eval_class"), F.col("n").alias("ne"))
    hot = cut(t.groupBy("seed").agg(F.count("*").alias("k")).where(F.col("k") > lane).select("seed", F.ceil(F.col("k") / lane).cast("int").alias("lanes")))
    if hot.isEmpty():
        both = t.join(e, "seed")
    else:
        t = t.join(hot, "seed", "left").withColumn("lane", F.pmod(F.xxhash64("train_class"), F.coalesce("lanes", F.lit(1))).cast("int")).drop("lanes")
        e = e.join(hot, "seed", "left").withColumn("lane", F.explode(F.sequence(F.lit(0), F.coalesce("lanes", F.lit(1)) - 1))).drop("lanes")
        both = t.join(e, ["seed", "lane"])
    # whole numbers, so that 3 / 5 is not below 0.6
    num, den = round(threshold * 1000), 1000
    near = both.where(F.least("nt", "ne") * den >= F.greatest("nt", "ne") * num).groupBy("train_class", "eval_class").agg(F.count("*").alias("seeds"))
    side = lambda c, x: kept.select(F.col("class").alias(c), F.col("block").alias(f"b{x}"), F.col("hashes").alias(f"h{x}"))
    pairs = near.join(side("train_class", "t"), "train_class").join(side("eval_class", "e"), "eval_class").where("bt = be")
    # both sides stand in one order without repeats, so the alignment that extends the chain over all gaps covers what they share
    shared = F.size(F.array_intersect("ht", "he"))
    joined = pairs.select("train_class", "eval_class", "seeds", shared.alias("shared"), (F.size("ht") + F.size("he") - shared).alias("all_words"))
    return joined.where(F.col("shared") * den >= F.col("all_words") * num)


def matched(examples: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, similar classes) of examples."""
    members, kinds = classes(cut(records(examples).drop("question", "sql")))
    return members, kinds, cut(similar_classes(kinds, threshold))


def cross_split_pairs(examples: DataFrame, *, threshold: float = 0.6) -> DataFrame:
    """``train_id, eval_id, split, train_source, eval_source, jaccard, coverage``: each train row that an evaluation row repeats.

    Both are of one database, with the same constants in ``sql``, and share at least ``threshold`` of all
    words of the two questions; ``coverage`` is the shared part of the evaluation question's words. Rows without split, database, constants or words give no pair; repeated
    deliveries count once.
    """
    members, kinds, found = matched(examples, threshold)
    size = kinds.select(F.col("class").alias("eval_class"), F.size("hashes").alias("n"))
    found = found.join(size, "eval_class").select("train_class", "eval_class", (F.col("shared") / F.col("all_words")).alias("jaccard"), (F.col("shared") / F.col("n")).alias("coverage"))
    t = members.where("side = 'train'").select(F.col("class").alias("train_class"), F.col("id").alias("train_id"), F.col("source").alias("train_source"))
    e = members.where("side = 'eval'").select(F.col("class").alias("eval_class"), F.col("id").alias("eval_id"), "split", F.col("source").alias("eval_source"))
    return found.join(e, "eval_class").join(t, "train_class").select("train_id", "eval_id", "split", "train_source", "eval_source", "jaccard", "coverage")


def covered_rows(examples: DataFrame, *, threshold: float = 0.6) -> DataFrame:
    """``eval_id, split, source, n_words, n_partners, best_coverage, coverage``: one row per evaluation row that repeats training rows.

    ``best_coverage`` is the largest part of its words in one training question, ``coverage`` the part in any of its partners. Pairs of
    copies are counted, not written.
    """
    members, kinds, found = matched(examples, threshold)
    per_class = members.where("side = 'train'").groupBy(F.col("class").alias("train_class")).agg(F.count("*").alias("k"))
    best = found.join(per_class, "train_class").groupBy("eval_class").agg(F.sum("k").alias("n_partners"), F.max("shared").alias("best"))
    side = lambda c, x: kinds.select(F.col("class").alias(c), F.col("hashes").alias(f"h{x}"))
    words = found.select("train_class", "eval_class").join(side("train_class", "t"), "train_class").join(side("eval_class", "e"), "eval_class").select("eval_class", F.explode(F.array_intersect("ht", "he")).alias("w")).distinct()
    covered = words.groupBy("eval_class").agg(F.count("*").alias("covered"))
    rows = members.where("side = 'eval'").select(F.col("class").alias("eval_class"), F.col("id").alias("eval_id"), "split", "source")
    size = kinds.select(F.col("class").alias("eval_class"), F.size("hashes").alias("n_words"))
    return rows.join(best, "eval_class").join(covered, "eval_class").join(size, "eval_class").select(
        "eval_id", "split", "source", "n_words", "n_partners", (F.col("best") / F.col("n_words")).alias("best_coverage"), (F.col("covered") / F.col("n_words")).alias("coverage"))


def overlap_report(covered: DataFrame) -> DataFrame:
    """``split, source, n_pairs, n_eval_rows, mean_coverage``: overlaps per split and plain source of the evaluation row, from :func:`covered_rows`."""
    source = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    return covered.groupBy("split", source.alias("source")).agg(F.sum("n_partners").alias("n_pairs"), F.count("*").alias("n_eval_rows"), F.avg("coverage").alias("mean_coverage"))


def chain(a: list[str], b: list[str]) -> int:
    """Words of ``b`` in the best collinear chain with ``a``: seeds are equal words, the chain is their longest increasing run."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    tails: list[int] = []
    for w in b:
        for i in reversed(places.get(w, ())):
            at = int(np.searchsorted(tails, i))
            tails[at : at + 1] = [i]
    return len(tails)


def alignment(pairs: DataFrame, examples: DataFrame) -> DataFrame:
    """``pairs`` with ``question_coverage`` and ``sql_coverage``: the share of the evaluation row's words (in their own order, with repeats) in the best chain with the training row's."""
    words = lambda c: F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
    one = latest(examples, "example_id", "ingested_at", ["question", "sql"]).select(F.col("example_id").alias("id"), words(F.col("question")).alias("q"), words(F.col("sql")).alias("s"))

    @F.pandas_udf("double")
    def covered(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([chain(list(x), list(y)) / max(len(y), 1) for x, y in zip(a, b)], dtype="float64")

    side = lambda n, x: one.select(F.col("id").alias(n), F.col("q").alias(f"q{x}"), F.col("s").alias(f"s{x}"))
    both = pairs.join(side("train_id", "a"), "train_id").join(side("eval_id", "b"), "eval_id")
    return both.withColumn("question_coverage", covered("qa", "qb")).withColumn("sql_coverage", covered("sa", "sb")).drop("qa", "qb", "sa", "sb")
