"""Co-occurrence, neighbours, mixing and overlaps against brute force and on odd inputs."""

import random
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from querymill.llm import cooccurrence, mixing, neighbours, overlap


def test_association_matches_brute_force_with_huge_baskets(spark):
    rng = random.Random(1)
    baskets = [([f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 12))], [f"t{rng.randrange(5)}" for _ in range(rng.randrange(0, 4))]) for _ in range(300)]
    baskets += [([f"w{i}" for i in range(30)], [f"t{i}" for i in range(5)])] * 3 + [(None, ["t1"]), (["w1", None, "w1"], None), ([], [])]
    df = spark.createDataFrame([(a, b, 1) for a, b in baskets], "l array<string>, r array<string>, left_item int")
    n, nl, nr, nb = len(baskets), Counter(), Counter(), Counter()
    for a, b in baskets:
        a, b = {x for x in a or [] if x}, {x for x in b or [] if x}
        nl.update(a), nr.update(b), nb.update(product(a, b))
    for chunk in (256, 4):  # 4 splits most baskets
        got = {(r["left_item"], r["right_item"]): (r["n_both"], r["n_left"], r["n_right"], r["n"]) for r in cooccurrence.association(df, left="l", right="r", min_count=3, chunk=chunk).collect()}
        assert got == {p: (k, nl[p[0]], nr[p[1]], n) for p, k in nb.items() if k >= 3}
    few = {(r["left_item"], r["right_item"]) for r in cooccurrence.association(df, left="l", right="r", min_count=3, min_lift=1.2).collect()}
    assert few == {p for p, k in nb.items() if k >= 3 and k * n >= 1.2 * nl[p[0]] * nr[p[1]]}
    assert cooccurrence.association(df.limit(0), left="l", right="r").count() == 0


def test_all_pairs_have_the_rare_ones(spark):
    from querymill.llm.queries import QUERIES

    all_, often = ({(r["word"], r["table_name"]): tuple(r)[2:] for r in QUERIES[q](spark, "/root/testdata/sf0.001").collect()} for q in ("p2_all_pairs", "p2_word_tables"))
    assert min(x[0] for x in all_.values()) == 1 and {k: x for k, x in all_.items() if x[0] >= 8} == often


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64)).astype("f4")
    x[n // 2 :] = x[: n - n // 2] + 0.1 * rng.normal(size=(n - n // 2, 64)).astype("f4")
    return x


def test_neighbours_match_brute_force(spark):
    x = vectors(600)
    rows = [(f"n{i:04d}", v.tolist()) for i, v in enumerate(x)]
    odd = [("null", None), ("empty", []), ("zero", [0.0] * 64), ("short", [1.0] * 3), (None, x[0].tolist()), ("nan", [float("nan")] * 64)]
    df = spark.createDataFrame([(a, b, 0.0, "q") for a, b in rows + odd + rows[:5]], "node_id string, embedding array<float>, similarity double, node string")
    got = neighbours.nearest_nodes(df, k=5).toPandas()
    u = neighbours.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.sort(s, 1)[:, -5]
    at = {n: i for i, (n, _) in enumerate(rows)}
    hits = sum(s[at[a], at[b]] >= best[at[a]] - 1e-9 for a, b in zip(got.node, got.neighbour))
    assert set(got.node) == set(at) and hits / (5 * len(rows)) >= 0.9 and (got.groupby("node").size() == 5).all()
    pairs = {(r["node_a"], r["node_b"]) for r in neighbours.similar_pairs(neighbours.nearest_nodes(df, k=5, min_similarity=0.95), min_similarity=0.95).collect()}
    top = np.argsort(-s, 1)[:, :5]
    assert pairs == {tuple(sorted((rows[i][0], rows[j][0]))) for i in range(len(rows)) for j in top[i] if s[i, j] >= 0.95}


def test_copies_and_split_cells(spark):
    x = vectors(40, 3)
    rows = [(f"c{i:04d}", x[0].tolist()) for i in range(300)] + [(f"n{i:02d}", v.tolist()) for i, v in enumerate(x[1:])]
    df = spark.createDataFrame(rows, "node_id string, embedding array<float>")
    got = neighbours.nearest_nodes(df, k=5, block=7).toPandas()
    assert (got.groupby("node").size() == 5).all() and len(got) == 5 * len(rows)
    copies = got[got.node.str.startswith("c")]
    assert copies.neighbour.str.startswith("c").all() and (copies.similarity > 0.999).all() and (copies.node != copies.neighbour).all()
    assert neighbours.nearest_nodes(df.limit(0), k=5).count() == 0 and neighbours.nearest_nodes(df.limit(1), k=5).count() == 0


def test_neighbours_in_a_dense_group(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 64))
    x[:4_000] = x[0] + 0.14 * rng.normal(size=(4_000, 64))  # pairwise cosine about 0.98
    x = x.astype("f4")
    df = spark.createDataFrame([(f"n{i:05d}", v.tolist()) for i, v in enumerate(x)], "node_id string, embedding array<float>")
    s = neighbours.unit(x) @ neighbours.unit(x).T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, 1, kind="stable")[:, :5]
    name = lambda i: f"n{i:05d}"
    got = neighbours.similar_pairs(neighbours.nearest_nodes(df, k=5, min_similarity=0.95), min_similarity=0.95).collect()
    assert {(r["node_a"], r["node_b"]) for r in got} == {tuple(sorted((name(i), name(j)))) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.95}
    some = neighbours.nearest_nodes(df, k=5, query_share=20, block=700, **neighbours.HIGH_RECALL).collect()
    assert len(some) > 2_000 and all(r["neighbour"] == name(top[int(r["node"][1:]), r["rank"] - 1]) for r in some)


def test_heap_goes_in_order_of_distance():
    x = neighbours.unit(vectors(300, 2))
    index = neighbours.MultiIndex(x, 8)
    for c in index.cells(x):
        index.counts[c] += 1
    row, cell = index.visits(x[:5], 300)
    a, b = index.distances(x[:5])
    for r in range(5):
        d = [a[r, c // 8] + b[r, c % 8] for c in cell[row == r]]
        assert d == sorted(d) and set(cell[row == r]) == set(np.flatnonzero(index.counts))


def test_mix_reaches_targets_under_caps(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" A", "a ", "B"]), rng.choice(["x", "Y", None]), rng.randrange(50, 150)) for i in range(6_000)] + [(6_001, None, "x", None)]
    df = spark.createDataFrame(rows, "example_id long, src string, mode string, size int").selectExpr("*", "3 AS uses", "1 AS n")
    targets = spark.createDataFrame([("a", "x", 0.5, 2), ("A", "y", 0.3, 1), ("b", "x", 0.15, 1), ("c", "x", 0.05, 3)], "src string, mode string, target_share double, max_repeats int")
    mix = mixing.Mix(df, targets, dims=["src", "mode"])
    report = {(r["src"], r["mode"]): r for r in mix.report().collect()}
    # the empty cell's share goes to the other cells of its mode, as its source has none
    for src, want in {"a": 0.8, "b": 0.15}.items():
        assert sum(r["reached_share"] for k, r in report.items() if k[0].lower() == src) > want - 0.01 and not any(r["short"] for k, r in report.items() if k[0].lower() == src)
    assert abs(sum(r["reached_share"] for r in report.values()) - 1) < 1e-9
    assert report["c", "x"]["short"] and report["c", "x"]["size"] == 0 and report["c", "x"]["reached_size"] == 0
    caps = {("a", "x"): 2, ("A", "y"): 1, ("b", "x"): 1}
    used = mix.sample().collect()
    assert all(r["uses"] <= caps[r["src"], r["mode"]] for r in used) and len({r["example_id"] for r in used}) == len(used)
    assert sorted(map(tuple, mix.sample().collect())) == sorted(map(tuple, mixing.Mix(df.repartition(9), targets, dims=["src", "mode"]).sample().collect()))
    tables = mixing.Mix(df, targets, dims=["src", "mode"], max_cells=3)
    assert sorted((*r[:-1][:6], round(r["uses"], 9), r["short"]) for r in mix.cells().collect()) == sorted((*r[:-1][:6], round(r["uses"], 9), r["short"]) for r in tables.cells().collect())
    assert sorted(map(tuple, mix.sample().collect())) == sorted(map(tuple, tables.sample().collect()))
    none = mixing.Mix(df.limit(0), targets, dims=["src", "mode"])
    assert none.sample().count() == 0 and none.report().count() == 4


def test_short_cells_are_made_up_for(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "xy"[i // 2 % 2], 10 if (i % 2, i // 2 % 2) != (0, 0) else 1) for i in range(4_000)], "example_id long, src string, mode string, size int")
    targets = spark.createDataFrame([("a", "x", 0.3, 2), ("a", "y", 0.2, 9), ("b", "x", 0.2, 9), ("b", "y", 0.3, 9)], "src string, mode string, target_share double, max_repeats int")
    report = {(r["src"], r["mode"]): r for r in mixing.Mix(df, targets, dims=["src", "mode"]).report().collect()}
    assert [k for k, r in report.items() if r["short"]] == [("a", "x")] and report["a", "x"]["uses"] == 2
    for d, v in product((0, 1), "abxy"):
        part = [r["reached_share"] for k, r in report.items() if k[d] == v]
        assert not part or abs(sum(part) - 0.5) < 0.03  # both sources and both modes reach their halves


def test_rake_meets_marginals():
    cells = [(("a", "x"), 40.0, 25.0, 9.0), (("a", "y"), 60.0, 25.0, 9.0), (("b", "x"), 80.0, 5.0, 0.01), (("b", "y"), 20.0, 45.0, 9.0), (("c", "y"), 0.0, 0.0, 1.0)]
    t = {c[0]: w * c[1] for c, w in zip(cells, mixing.rake(cells, 2))}
    assert abs(t["a", "x"] + t["a", "y"] - 50) < 1e-6 and abs(t["a", "x"] + t["b", "x"] - 30) < 1e-6 and t["b", "x"] <= 0.8 + 1e-12


def slow_pairs(recs, t):
    out = set()
    for a in recs:
        for b in recs:
            if a[2] == "train" and b[2] in ("dev", "test") and a[1] == b[1] and a[3] == b[3] and a[3] and a[4] and b[4]:
                if len(a[4] & b[4]) * 1000 >= round(t * 1000) * len(a[4] | b[4]):
                    out.add((a[0], b[0]))
    return out


def test_overlaps_match_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"]
    rows, recs = [], []
    for i in range(400):
        q, c = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 7))], rng.choice([[], ["7"], ["x y", "7"], ["3.5"]])
        sql = "SELECT a1 FROM t -- 99 'no'\n WHERE " + " AND ".join(f"b = {v}" if v[0].isdigit() else f"c = ' {v.upper()} '" for v in c)
        split = rng.choice(["train", "dev", "test", None])
        rows.append((i, "db", split, "s", " ".join(q).title(), sql, 1))
        recs.append((i, "db", split, frozenset(c), set(q)))
    rows += [(1_000, None, "train", None, "alpha beta gamma", "SELECT 7", 1), (1_001, "db", "dev", None, None, None, 1), (1_002, "db", "dev", "s", "", "", 1)] + rows[:10]
    df = spark.createDataFrame(rows, "example_id long, db_id string, split string, source string, question string, sql string, ingested_at int").selectExpr("*", "0 AS words", "1 AS jaccard")
    got = [(r["train_id"], r["eval_id"]) for r in overlap.cross_split_pairs(df, threshold=0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_pairs(recs, 0.6)
    lanes = overlap.similar_classes(overlap.classes(overlap.records(df))[1], 0.6, lane=3).count()
    assert lanes == overlap.similar_classes(overlap.classes(overlap.records(df))[1], 0.6).count() > 0
    strict = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_pairs(df, threshold=0.8).collect()}
    assert strict == slow_pairs(recs, 0.8)
    cov = overlap.alignment(overlap.cross_split_pairs(df, threshold=0.6), df).collect()
    assert len(cov) == len(got) and all(0 <= r[c] <= 1 for r in cov for c in ("question_coverage", "sql_coverage"))
    rows_ = {r["eval_id"]: r for r in overlap.covered_rows(df, threshold=0.6).collect()}
    words = {r[0]: r[4] for r in recs}
    for e in {b for _, b in got}:
        partners = [words[t] for t, x in set(got) if x == e]
        assert rows_[e]["n_partners"] == len(partners) and abs(rows_[e]["coverage"] - len(words[e] & set().union(*partners)) / len(words[e])) < 1e-12
    assert len(rows_) == len({b for _, b in got})
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0


def test_winnowed_minima_keep_every_near_pair(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(4_000):
        common, a, b = (rng.integers(0, 2**40, rng.integers(*n)) for n in ((1, 40), (0, 9), (0, 9)))
        rows.append((np.unique(np.concatenate([common, a])).tolist(), np.unique(np.concatenate([common, b])).tolist()))
    df = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>")
    for t in (0.6, 0.8, 0.9):
        both = F.size(F.array_intersect("x", "y"))
        near = df.where(both >= t * (F.size("x") + F.size("y") - both))
        fx, fy = overlap.fingerprints(F.col("x"), t), overlap.fingerprints(F.col("y"), t)
        assert near.count() > 100 and near.where(~F.arrays_overlap(fx, fy)).count() == 0
    # wide windows select fewer than all
    long_ = df.where("size(x) > 30")
    assert long_.agg(F.avg(F.size(overlap.fingerprints(F.col("x"), 0.9)) / F.size("x"))).first()[0] < 0.6


def test_chain():
    assert overlap.chain("a b c d".split(), "a x c d".split()) == 3 and overlap.chain([], ["a"]) == 0 and overlap.chain(list("ab"), list("ba")) == 1
