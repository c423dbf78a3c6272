"""Text functions as DataFrame columns: tokenizers, question heuristics, model output and prompt parsing.

All of them are built-in expressions. Word classes are ASCII where results must not depend on a
regular expression library; null texts give empty lists or null as stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing in a question, in a synonym, and in a question searched for cell values.
QUESTION_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might can could "
    "not and or but if of at by for with about to from in on it its this that these those i you he she we they me "
    "him her us them my your his our their what which who whom how many much each every all both few more most "
    "other some such no than too very just also so there then when where why as"
).split()
SYNONYM_STOPWORDS = (
    "what which who where when how why the are is was were has have had for and not but that this with from all any "
    "can list give show find get its into been will than you they their each also use per out more most"
).split()
VALUE_STOPWORDS = "the and for are was were has have had been with that this from what which who how many all each any".split()
# Tokens so common in identifiers that sharing them means little.
IDENTIFIER_STOPWORDS = (
    "id ids key keys pk fk name names type types code codes value values val num no date time year month day at on "
    "status flag is has desc info data detail details count total amount sum avg"
).split()
# Signs of a question with several parts.
COMPLEX_KEYWORDS = [
    "and", "or", "both", "compare", "comparison", "also", "additionally", "as well as", "along with", "together with",
    "versus", "vs", "difference between", "in addition", "furthermore",
]
RELATIVE = r"\b(?:who|which|that|where|whose|whom)\b"
AGGREGATE = r"\b(?:how many|how much|average|total|sum|count|maximum|minimum|most|least|greatest|smallest|highest|lowest|percentage|ratio|proportion)\b"
# SQL that calls for reasoning.
COMPLEX_SQL = (
    r"(?i)\bJOIN\b|\bLEFT\b|\bRIGHT\b|\bCROSS\b|\bFULL\b|\bSUBQUERY\b|\bEXISTS\b|\bIN\s*\(\s*SELECT|\bWITH\b\s+\w+\s+AS"
    r"|\bOVER\s*\(|\bUNION\b|\bINTERSECT\b|\bEXCEPT\b|\bCASE\b\s+WHEN|\bHAVING\b|\bGROUP\s+BY\b"
)
# Words after a table name that are no alias; words after FROM or JOIN that are no table.
NO_ALIAS = "where on inner left right outer cross join natural full group order having limit union intersect except set and or as select from into values using".split()
NO_TABLE = "where on set inner outer left right cross full natural join select with".split()
# SQL words that the comparison of statements writes in capitals.
SQL_KEYWORDS = (
    "select from where and or not in is null like between join inner left right full outer cross natural on using group by "
    "order having limit offset as distinct union all except intersect exists case when then else end asc desc with count sum avg min max"
).split()


def empty() -> Column:
    return F.array().cast("array<string>")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern``; [] for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), empty())


def without(items: Column, words: list[str]) -> Column:
    return F.filter(items, lambda x: ~x.isin(*words))


def name_tokens(name: Column) -> Column:
    """Lower-case parts of an identifier: cut at a lower-case letter before a capital, at '_' and at white space."""
    parts = F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")), r"[_\s]+")
    return F.coalesce(F.filter(parts, lambda x: x != ""), empty())


def question_tokens(question: Column) -> Column:
    """Distinct tokens of a question, without stop words and single characters, sorted."""
    tokens = matches(F.lower(question), "[a-z_][a-z0-9_]*")
    return F.array_sort(F.array_distinct(without(F.filter(tokens, lambda x: F.length(x) > 1), QUESTION_STOPWORDS)))


def synonym_tokens(text: Column) -> Column:
    tokens = F.split(F.lower(text), "[^a-z0-9_]+")
    return F.coalesce(F.array_sort(F.array_distinct(without(F.filter(tokens, lambda x: F.length(x) >= 3), SYNONYM_STOPWORDS))), empty())


def blank_tokens(text: Column) -> Column:
    """Lower-case parts between white space, repeats kept: the terms of BM25 and of token counts."""
    return F.coalesce(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), empty())


def value_candidates(question: Column) -> Column:
    """What a question may quote from the data: quoted text, then capitalised phrases, then words; no repeats (case aside)."""
    words = without(F.filter(matches(F.lower(question), "[a-z_][a-z0-9_]*"), lambda x: F.length(x) >= 3), VALUE_STOPWORDS)
    all_ = F.concat(matches(question, "[\"']([^\"']{2,})[\"']", 1), matches(question, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", 1), words)
    lowered = F.transform(all_, F.lower)
    return F.filter(all_, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def sql_tables(sql: Column) -> Column:
    """Sorted names after FROM or JOIN by pattern alone, without keywords."""
    return F.array_sort(F.array_distinct(without(matches(F.lower(sql), r"(?:from|join)\s+([a-z0-9_]+)", 1), NO_TABLE)))


def schema_refs(sql: Column) -> Column:
    """Sorted tables (after FROM, JOIN, INTO, UPDATE, quoted or not) and ``t.c`` references with their bare ``t``."""
    low = F.lower(sql)
    tables = matches(low, "\\b(?:from|join|into|update)\\s+[`\"]?([a-z0-9_]+)", 1)
    pair = "[`\"]?([a-z0-9_]+)[`\"]?\\s*\\.\\s*[`\"]?([a-z0-9_]+)"
    t, c = matches(low, pair, 1), matches(low, pair, 2)
    return F.array_sort(F.array_distinct(F.concat(tables, t, F.zip_with(t, c, lambda a, b: F.concat(a, F.lit("."), b)))))


def aliases(sql: Column) -> Column:
    """Distinct ``struct(alias, table)`` in lower case, of 'FROM t AS a' and 'FROM t a'."""
    low = F.lower(sql)
    both = []
    for p in (r"(?:from|join)\s+([a-z0-9_]+)\s+as\s+([a-z0-9_]+)", r"(?:from|join)\s+([a-z0-9_]+)\s+([a-z0-9_]+)"):
        both.append(F.zip_with(matches(low, p, 2), matches(low, p, 1), lambda a, t: F.struct(a.alias("alias"), t.alias("table"))))
    return F.array_distinct(F.filter(F.concat(*both), lambda x: ~x["alias"].isin(*NO_ALIAS)))


def select_part(sql: Column) -> Column:
    """What stands before the first FROM."""
    return F.trim(F.regexp_extract(sql, r"(?is)^(.*?)\bfrom\b", 1))


def predicate_part(sql: Column) -> Column:
    """What follows the first WHERE, else the first HAVING; '' without either."""
    where = F.regexp_extract(sql, r"(?is)^.*?\bwhere\b(.*)$", 1)
    return F.trim(F.when(where != "", where).otherwise(F.regexp_extract(sql, r"(?is)^.*?\bhaving\b(.*)$", 1)))


def is_complex_sql(sql: Column) -> Column:
    return F.coalesce(sql.rlike(COMPLEX_SQL), F.lit(False))


def normal_sql(sql: Column) -> Column:
    """A statement for comparison: no comments, no closing semicolon, single blanks, keywords in capitals.

    Strings and quoted names keep their spelling. Null stays null.
    """
    bare = F.regexp_replace(sql, r"('[^']*'|\"[^\"]*\"|`[^`]*`)|--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/", "$1 ")
    tokens = F.regexp_extract_all(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"[; ]+$", ""), F.lit(r"'[^']*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.lower(t).isin(*SQL_KEYWORDS), F.upper(t)).otherwise(t)), "")


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def sql_of_output(text: Column) -> Column:
    """SQL of a model's output: the first ```sql block, else the last line 'SQL: ...', else from the first SELECT on to a blank line,
    else the last line that isn't blank; '' for null and blank text."""
    ws = r"[ \t\r\n]"
    block = F.regexp_extract(text, rf"(?is)```sql{ws}*(.+?){ws}*```", 1)
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: x != "")
    marked = F.try_element_at(F.filter(lines, lambda x: F.upper(x).startswith("SQL:")), F.lit(-1))
    select = F.regexp_extract(F.regexp_extract(text, rf"(?is)(SELECT{ws}+.+)", 1), r"(?s)^(.*?)(?:\n\n|\n[A-Z]|$)", 1)
    last = F.try_element_at(lines, F.lit(-1))
    return F.coalesce(_filled(block), _filled(F.substring(marked, 5, 1 << 30)), _filled(select), _filled(last), F.lit(""))


def reasoning_of_output(text: Column) -> Column:
    """The first think block, else what stands before 'SQL:', else ''."""
    think = F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)
    before = F.when(text.rlike(r"(?i)\bSQL\s*:"), F.regexp_extract(text, r"(?is)^(.*?)\bSQL\s*:", 1))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.coalesce(F.when(text.rlike(r"(?s)<think>.*?</think>"), strip(think)), strip(before), F.lit(""))


def last_block(text: Column) -> Column:
    """The last fenced block's content (any language tag), '' if there is none."""
    blocks = matches(text, r"(?s)```[a-zA-Z]*\n(.*?)```", 1)
    return F.regexp_replace(F.coalesce(F.try_element_at(blocks, F.lit(-1)), F.lit("")), r"^\s+|\s+$", "")


def before_last_block(text: Column) -> Column:
    """What stands before the last fenced block, without a closing rule or query heading."""
    head = F.regexp_extract(text, r"(?s)^(.*)```[a-zA-Z]*\n.*?```", 1)
    cleaned = F.regexp_replace(F.regexp_replace(head, r"\n---\s*$", ""), r"(?i)###\s*(?:Final\s+)?(?:SQL\s+)?Query:?\s*$", "")
    return F.regexp_replace(cleaned, r"^\s+|\s+$", "")


def complexity(question: Column) -> Column:
    """Score in [0, 1] of how many parts a question has; 0 under 12 words and for null."""
    n = F.size(F.filter(F.split(question, r"\s+"), lambda x: x != ""))
    low = F.lower(question)
    keyword = F.lit(False)
    for k in COMPLEX_KEYWORDS:
        keyword = keyword | low.contains(k)
    relative, aggregate, commas = F.regexp_count(low, F.lit(RELATIVE)), F.regexp_count(low, F.lit(AGGREGATE)), F.regexp_count(low, F.lit(","))
    score = (
        F.least(n / F.lit(40.0), F.lit(0.3)) + F.when(keyword, 0.15).otherwise(0.0) + F.least(relative * F.lit(0.1), F.lit(0.2))
        + F.when(aggregate >= 2, 0.2).when(aggregate == 1, 0.05).otherwise(0.0) + F.least(commas * F.lit(0.05), F.lit(0.15))
    )
    return F.coalesce(F.when(n < 12, F.lit(0.0)).otherwise(F.least(F.round(score, 6), F.lit(1.0))), F.lit(0.0))


def sub_questions(question: Column) -> Column:
    """Parts of a question: of a comparison, else of clauses joined by 'and' or ';', else main and relative clause.

    Parts under four words are left out; where fewer than two parts remain, the question itself is the only part.
    """
    pair = r"(?is)^.*?\b(?:compare|what is the difference between|versus|vs\.?)\b(.*?)\band\b(.*)$"
    a, b = F.trim(F.regexp_extract(question, pair, 1)), F.trim(F.regexp_extract(question, pair, 2))
    compared = F.when((a != "") & (b != ""), F.array(F.concat(F.lit("What is "), a, F.lit("?")), F.concat(F.lit("What is "), b, F.lit("?"))))
    joined = F.filter(F.transform(F.split(F.regexp_replace(question, r"(?i)\s+(?:and|,\s*and|;\s*and|;)\s+([a-z])", "\x01$1"), "\x01"), F.trim), lambda x: x != "")
    rel = r"(?is)^(.*?)(\b(?:who|which|that)\b\s+(?:is|are|was|were|has|have|had|works?|lives?|comes?)\b.*)$"
    main, sub = F.trim(F.regexp_extract(question, rel, 1)), F.trim(F.regexp_extract(question, rel, 2))
    related = F.when((main != "") & (sub != ""), F.array(main, sub))
    parts = F.coalesce(compared, F.when(F.size(joined) >= 2, joined), related, F.array(question))
    long_ = F.filter(parts, lambda x: F.size(F.split(F.trim(x), r"\s+")) >= 4)
    return F.when(F.size(long_) >= 2, long_).otherwise(F.array(question))


def with_hint(question: Column, evidence: Column) -> Column:
    """The question with its evidence as a hint on the next line, where there is any."""
    return F.when(F.trim(evidence) != "", F.concat(question, F.lit("\nHint: "), evidence)).otherwise(question)


def row_key(db_id: Column, question: Column) -> Column:
    """A stable key: database and the first 8 characters of the question's md5."""
    return F.concat(db_id, F.lit("__"), F.substring(F.md5(question), 1, 8))


def repaired_json(text: Column) -> Column:
    """The JSON object inside a model's output: without code fences, from the first '{' to the last '}'; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def chatml(*turns: tuple[str, Column]) -> Column:
    """ChatML of (role, content) turns, open for the assistant's answer."""
    parts = [F.concat(F.lit(f"<|im_start|>{role}\n"), F.coalesce(c, F.lit("")), F.lit("<|im_end|>")) for role, c in turns]
    return F.concat_ws("\n", *parts, F.lit("<|im_start|>assistant"))


def reasoning_from_sql(sql: Column, tables: Column) -> Column:
    """A rule-based trace: tables, then a line for each of JOIN, WHERE, GROUP BY, ORDER BY, HAVING, LIMIT."""
    up = F.upper(sql)
    # The lines of the trace.
    lines = [("JOIN", "Need JOINs to connect tables via foreign keys"), ("WHERE", "Apply WHERE conditions to filter results"), ("GROUP BY", "Group results for aggregation"), ("ORDER BY", "Order the results"), ("HAVING", "Filter aggregated results with HAVING"), ("LIMIT", "Limit output rows")]
    trace = F.concat_ws("\n", F.when(F.size(tables) > 0, F.concat(F.lit("Tables needed: "), F.array_join(tables, ", "))), *[F.when(up.contains(k), t) for k, t in lines])
    return F.when(trace == "", "Direct query, no complex reasoning needed.").otherwise(trace)
