"""Running SQL text: errors as classes, results compared as sets, votes among candidates, retries.

These are the only operators that loop on the driver: each statement is a query of its own, and many are run at once. Rows stay in Spark;
what comes to the driver is a count, a hash or an error class.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUCCESS, SYNTAX, NO_TABLE, NO_COLUMN, WRONG, EMPTY, FAILED = "success", "syntax_error", "no_such_table", "no_such_column", "wrong_result", "empty_result", "execution_error"

#: What a corrector is told to look at after each class of error.
HINTS = {
    SYNTAX: "It can't be parsed: look at brackets, quotes, and the order of the clauses.",
    NO_TABLE: "It reads a table that isn't in the schema above.",
    NO_COLUMN: "It names a column that isn't in the schema above.",
    WRONG: "It runs, but other rows were expected: look at joins, filters and groups.",
    EMPTY: "It finds no rows: a filter may be too strict, or a join may lose all rows.",
    FAILED: "It stops while running: look at types, casts and divisions.",
}


@dataclass
class Outcome:
    sql: str
    kind: str
    message: str = ""
    rows: DataFrame | None = None
    n_rows: int = 0
    #: hash of the result as a set of rows
    digest: str = ""


def message_class(message: Column) -> Column:
    """The class of a logged error message; null for null."""
    low = F.lower(message)
    return F.when(message.isNull(), None).when(low.rlike(r"no such table:\s*\S+"), NO_TABLE).when(low.rlike(r"no such column:\s*\S+"), NO_COLUMN).when(low.rlike("syntax error|incomplete input|unrecognized token|near "), SYNTAX).otherwise(FAILED)


def _class(e: Exception) -> str:
    condition = (getattr(e, "getCondition", lambda: None)() or "").upper()
    if condition.startswith("PARSE_"):
        return SYNTAX
    if condition.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return NO_TABLE
    return NO_COLUMN if condition.startswith("UNRESOLVED_COLUMN") else FAILED


#: Functions that call into the JVM by name (fixed values); a query with one of them isn't run.
CALLS = re.compile(r"\b(?:reflect|try_reflect|java_method)\s*\(", re.I)
STARTS = re.compile(r"(?:\s|\(|--[^\n]*\n|/\*.*?\*/)*(?:select|with|values|from|table)\b", re.I | re.S)
LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether a statement only reads: it starts like a query, its plan holds no command and no insert, wherever it stands, and it calls no JVM method by name.

    Text that can't be parsed raises ParseException.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)  # parses only
    kinds = [spark._jvm.java.lang.Class.forName(LOGICAL + n) for n in ("Command", "ParsedStatement")]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds) or node.nodeName().startswith("ExecuteImmediate"):
            return False
        for below in (node.children(), node.innerChildren()):
            todo += [x for x in (below.apply(i) for i in range(below.size())) if hasattr(x, "innerChildren")]
    return bool(STARTS.match(sql)) and not CALLS.search(sql)


def run(spark: SparkSession, sql: str | None, gold: str | None = None) -> Outcome:
    """Runs one query and never raises. With ``gold``, its result decides between success and wrong result; a gold statement that fails itself counts as met.

    Commands and inserts are refused before anything runs. A result is evaluated once; its number of rows and its hash come of the same pass.
    """
    if not sql or not sql.strip():
        return Outcome(sql or "", SYNTAX, "blank statement")
    try:
        if not is_query(spark, sql):
            return Outcome(sql, FAILED, "not a query")
        out = _evaluated(sql, spark.sql(sql))
    except PySparkException as e:
        return Outcome(sql, _class(e), str(e).split("\n", 1)[0])
    expected = None
    if gold is not None:
        try:
            if not is_query(spark, gold):
                return out
            expected = _evaluated(gold, spark.sql(gold))
        except PySparkException:
            return out
        if out.n_rows == 0 and expected.n_rows == 0:
            return out
    if out.n_rows == 0:
        out.kind, out.message = EMPTY, "no rows"
    elif expected is not None and expected.digest != out.digest:
        out.kind, out.message = WRONG, "rows differ"
    return out


def run_many(spark: SparkSession, statements: list[tuple[str, str | None]], *, at_once: int = 8) -> list[Outcome]:
    """The outcomes of (statement, gold) pairs, several being run at once; equal pairs are run once."""
    different = list(dict.fromkeys(statements))
    with ThreadPoolExecutor(at_once) as pool:
        done = dict(zip(different, pool.map(lambda s: run(spark, *s), different)))
    return [done[s] for s in statements]


def _texts(df: DataFrame) -> DataFrame:
    """Rows as one text each; null differs from every text."""
    names = [f"c{i}" for i in range(len(df.columns))]
    cells = [F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("~")) for n in names]
    return df.toDF(*names).select(F.concat_ws("\x1f", *cells).alias("row"))


def _cells(df: DataFrame) -> DataFrame:
    return _texts(df).distinct()


def result_hash(df: DataFrame) -> DataFrame:
    """``hash, n_rows`` of a result as a set: equal sets have equal hashes, in any order and with any repeats.

    Row hashes are added up, so nothing is sorted or collected.
    """
    return _digest(df).select("hash", F.col("n_different").alias("n_rows"))


def _digest(df: DataFrame) -> DataFrame:
    """``hash, n_different, n_rows`` in one pass; every cell is evaluated, so that an error in any of them shows."""
    r = _texts(df).groupBy("row").agg(F.count("*").alias("k")).select("k", *[F.conv(F.substring(F.md5("row"), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"h{i}") for i in range(2)])
    sums = [F.coalesce(F.sum(f"h{i}"), F.lit(0)).cast("string") for i in range(2)]
    return r.agg(F.md5(F.concat_ws("|", F.lit(len(df.columns)), *sums, F.count("*").cast("string"))).alias("hash"), F.count("*").alias("n_different"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"))


def _evaluated(sql: str, df: DataFrame) -> Outcome:
    r = _digest(df).first()
    return Outcome(sql, SUCCESS, "", df, r["n_rows"], r["hash"])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results are the same set of rows; order, repeats and column names don't count."""
    if len(a.columns) != len(b.columns):
        return False
    x, y = _cells(a), _cells(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def overlap(got: DataFrame, gold: DataFrame) -> float:
    """Half the share of gold rows that were found; 1 for the same set."""
    if len(got.columns) != len(gold.columns):
        return 0.0
    if same_rows(got, gold):
        return 1.0
    g = _cells(gold)
    return 0.5 * _cells(got).intersect(g).count() / max(g.count(), 1)


def vote(spark: SparkSession, candidates: list[str]) -> tuple[int, int]:
    """(chosen place, size of its cluster): the largest cluster of equal results, its shortest statement; failures and empty results don't vote.

    Without a vote the first candidate is chosen with size 0.
    """
    clusters: dict[str, list[int]] = {}
    for i, out in enumerate(run_many(spark, [(c, None) for c in candidates])):
        if out.kind == SUCCESS:
            clusters.setdefault(out.digest, []).append(i)
    if not clusters:
        return 0, 0
    best = max(clusters.values(), key=lambda c: (len(c), -c[0]))
    return min(best, key=lambda i: (len(candidates[i]), i)), len(best)


@dataclass
class Retry:
    """Runs, and asks ``generate(prompt)`` for a correction until it succeeds, repeats itself, or ``limit`` tries are used."""

    spark: SparkSession
    generate: Callable[[str], str | None]
    limit: int = 3
    history: list[Outcome] = field(default_factory=list)

    def prompt(self, question: str, schema: str, last: Outcome) -> str:
        return f"{schema}\n\nQuestion: {question}\n\nFailed SQL:\n{last.sql}\n\nError ({last.kind}): {last.message}\nHint: {HINTS.get(last.kind, '')}"

    def run(self, question: str, schema: str, sql: str, gold: str | None = None) -> Outcome:
        last = run(self.spark, sql, gold)
        self.history = [last]
        for _ in range(self.limit):
            if last.kind == SUCCESS:
                break
            try:
                new = self.generate(self.prompt(question, schema, last))
            except Exception:  # noqa: BLE001 - whatever a generator raises ends the loop
                break
            if not new or not new.strip() or new.strip() == last.sql.strip():
                break
            last = run(self.spark, new, gold)
            self.history.append(last)
        return last
