"""A mix of sources with target shares of its size.

Rows fall into cells of a few dimensions (source, mode and the like). The cells' sizes are raked by iterative proportional
fitting under a cap on repeats: first to the target of each cell, which shows the cells that can't reach it, then in turn to the marginals of
each dimension, so that what short cells leave is made up for by other cells of the same source and mode. That gives
each cell the number of times its rows are used on average; a row is then used that often by its own
calibrated probability. Only cells are raked; where there are more than ``max_cells`` of them, the same steps run as
joins and window sums over the table of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.runtime import cut


def plain(c: Column) -> Column:
    """A label without case and outer blanks; null becomes ''."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def first_uses(size: float, want: float, cap: float) -> float:
    """Uses per row that give a cell its own target, or its cap; an empty cell stands at its cap."""
    return min(cap, want / size) if size else cap


def rake(cells: list[tuple], dims: int, *, rounds: int = 50) -> list[float]:
    """Uses per row of (key, size, wanted size, cap) cells, where a key has ``dims`` parts.

    A step fits one dimension: all cells of a key that has too much shrink by one factor, the cells below their cap of one that has too little
    grow by one factor, up to their caps. The number of rounds is fixed, so that the result is the same everywhere.
    """
    uses = [first_uses(s, t, c) for _, s, t, c in cells]
    members = []
    for d in range(dims):
        groups: dict = {}
        for i, (key, *_) in enumerate(cells):
            groups.setdefault(key[d], []).append(i)
        members.append([(g, sum(cells[i][2] for i in g)) for g in groups.values()])
    for _ in range(rounds):
        for groups in members:
            for g, want in groups:
                have = sum(uses[i] * cells[i][1] for i in g)
                free = sum(uses[i] * cells[i][1] for i in g if uses[i] < cells[i][3])
                for i in g:
                    if have > want:
                        uses[i] *= want / have
                    elif free > 0 and uses[i] < cells[i][3]:
                        uses[i] = min(cells[i][3], uses[i] * (want - have + free) / free)
    return uses


def rake_frames(cells: DataFrame, dims: list[str], *, rounds: int = 50, every: int = 10) -> DataFrame:
    """The steps of :func:`rake` for tables of cells of any size: ``cells`` has dims, size, want, cap and gets ``uses``."""
    out = cells.withColumn("uses", F.when(F.col("size") > 0, F.least("cap", F.col("want") / F.nullif("size", F.lit(0)))).otherwise(F.col("cap")))
    step = 0
    for _ in range(rounds):
        for d in dims:
            w, mine = Window.partitionBy(d), F.col("uses") * F.col("size")
            summed = out.select("*", F.sum("want").over(w).alias("_w"), F.sum(mine).over(w).alias("_h"), F.sum(F.when(F.col("uses") < F.col("cap"), mine).otherwise(0.0)).over(w).alias("_f"))
            grown = F.least("cap", F.col("uses") * (F.col("_w") - F.col("_h") + F.col("_f")) / F.nullif("_f", F.lit(0.0)))
            new = F.when(F.col("_h") > F.col("_w"), F.col("uses") * F.col("_w") / F.col("_h")).when((F.col("_f") > 0) & (F.col("uses") < F.col("cap")), grown).otherwise(F.col("uses"))
            out = summed.withColumn("uses", new).drop("_w", "_h", "_f")
            step += 1
            if step % every == 0:
                out = cut(out)
    return out


class Mix:
    """A fitted mix: its ``cells`` (target, size, uses per row) and the rows' number of uses."""

    def __init__(self, rows: DataFrame, targets: DataFrame, *, dims: list[str], size_col: str = "size", id_col: str = "example_id",
                 share_of_rows: float = 0.5, max_cells: int = 10_000, rounds: int = 50):
        """``targets`` has the dimensions, target_share and max_repeats. Dimensions are compared in plain form.

        Repeated target rows of one cell are summed, with the larger cap and the first spelling; null shares count 0, null caps 1.
        Rows outside the target cells take no part. Null sizes count 0. Up to ``max_cells`` cells are raked on the driver,
        more of them as tables; both give the same.
        """
        self.dims, self.id_col = dims, id_col
        self.rows = rows.select(F.col(id_col), *[plain(F.col(d)).alias(f"k_{d}") for d in dims], F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
        self.keys = keys = [f"k_{d}" for d in dims]
        wanted = targets.select(*[plain(F.col(d)).alias(f"k_{d}") for d in dims], *dims, F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("s"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("m"))
        wanted = wanted.groupBy(*keys).agg(F.min(F.struct(*dims)).alias("shown"), F.sum("s").alias("target_share"), F.max("m").alias("max_repeats")).select(*keys, *[F.col(f"shown.{d}").alias(d) for d in dims], "target_share", "max_repeats")
        totals = self.rows.groupBy(*keys).agg(F.sum("size").alias("size"), F.count("*").alias("n_rows"))
        cells = wanted.join(totals, keys, "left").select(*keys, *dims, "target_share", "max_repeats", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("size", F.lit(0)).alias("size"))
        few = cells.take(max_cells + 1)
        self.small = len(few) <= max_cells
        if self.small:
            few = sorted(few, key=lambda r: tuple(r[k] for k in keys))
            total = sum(r["size"] for r in few) * share_of_rows
            uses = rake([(tuple(r[k] for k in keys), float(r["size"]), r["target_share"] * total, float(r["max_repeats"])) for r in few], len(dims), rounds=rounds)
            schema = ", ".join([*[f"`{k}` string" for k in [*keys, *dims]], "target_share double, max_repeats int, n_rows long, size long, uses double, mix_size double"])
            self.cells_ = rows.sparkSession.createDataFrame([(*r, u, total) for r, u in zip(few, uses)], schema)
        else:
            cells = cut(cells)
            cells = cells.join(F.broadcast(cells.agg((F.sum("size") * share_of_rows).alias("mix_size"))))  # one row
            cells = rake_frames(cells.select("*", (F.col("target_share") * F.col("mix_size")).alias("want"), F.col("max_repeats").cast("double").alias("cap")), keys, rounds=rounds)
            self.cells_ = cut(cells.select(*keys, *dims, "target_share", "max_repeats", "n_rows", "size", "uses", "mix_size"))

    def cells(self, *more: str) -> DataFrame:
        """Dimensions, target_share, max_repeats, n_rows, size, mix_size, ``own_uses``, ``uses``, ``short``.

        ``own_uses`` comes of the rake to the cell's own target, ``uses`` of the rake to the marginals after it. ``short`` holds where the former
        stands at the cap and leaves a rest: all rows at their cap stay below the target, size * max_repeats < target_share * mix size.
        """
        want = F.col("target_share") * F.col("mix_size")
        own = F.when(F.col("size") > 0, F.least(F.col("max_repeats").cast("double"), want / F.nullif("size", F.lit(0)))).otherwise(F.col("max_repeats").cast("double"))
        rest = want - F.col("own_uses") * F.col("size")
        short = (F.col("own_uses") == F.col("max_repeats")) & (rest > 0)
        return self.cells_.withColumn("own_uses", own).select(*more, *self.dims, "target_share", "max_repeats", "n_rows", "size", "mix_size", "own_uses", "uses", short.alias("short"))

    def sample(self) -> DataFrame:
        """id, dimensions, size, ``uses``: each row of a target cell that is used at least once.

        A cell with u uses per row takes each row floor(u) times and once more with probability u - floor(u),
        decided by the md5 of the id: no shuffle of rows, and the same choice on every run.
        """
        return self._used().select(self.id_col, *self.dims, "size", "uses")

    def _used(self) -> DataFrame:
        keys = self.keys
        cells = self.cells_.select(*keys, F.col("uses").alias("u"), *self.dims)
        rows = self.rows.join(F.broadcast(cells) if self.small else cells, keys)
        luck = F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), F.col(self.id_col).cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
        uses = F.floor("u") + F.when(luck < F.col("u") - F.floor("u"), 1).otherwise(0)
        return rows.select(self.id_col, *keys, *self.dims, "size", uses.cast("int").alias("uses")).where("uses > 0")

    def report(self) -> DataFrame:
        """The cells with the rows used and the size reached, and ``reached_share`` of the size that all cells reach together: these add up to 1."""
        used = self._used().groupBy(*self.keys).agg(F.sum(F.col("size") * F.col("uses")).alias("reached_size"), F.sum("uses").alias("rows_used"))
        out = self.cells(*self.keys).join(used, self.keys, "left").withColumn("reached_size", F.coalesce("reached_size", F.lit(0)))
        in_all = out.agg(F.sum("reached_size").alias("in_all"))  # one row by construction
        return out.join(F.broadcast(in_all)).select(
            *self.dims, "target_share", "max_repeats", "n_rows", "size", "own_uses", "uses", "reached_size", F.coalesce("rows_used", F.lit(0)).alias("rows_used"),
            (F.col("reached_size") / F.nullif("in_all", F.lit(0))).alias("reached_share"), "short",
        )
