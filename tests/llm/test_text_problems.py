"""Pair defects, packing, leakage and repetition against brute force and on odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from querymill.llm import leakage, packing, pair_defects, repetition
from querymill.llm.words import word_ids

WORD = re.compile(r"[^\W_]+")


def words(text):
    return WORD.findall((text or "").lower())


def slow_repeated(text, n):
    w, seen, hit = words(text), set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            hit |= set(range(i, i + n))
        seen.add(g)
    return len(hit)


def test_repeated_words_match_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    ids, starts = word_ids(texts)
    assert repetition.repeated_words(ids, starts, 3).tolist() == [slow_repeated(t, 3) for t in texts]
    assert repetition.repeated_words(*word_ids([]), 8).tolist() == []


def test_repetition_odd_rows(spark):
    long_ = "alpha beta gamma delta epsilon zeta eta theta " * 20_000
    rows = [(1, None, "a"), (2, "", None), (3, "x " * 50, " A "), (3, "x " * 50, "a"), (4, long_, "b"), (5, "çé_ß 12 ½", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'clash' AS host", "1 AS fails")
    got = {(r["doc_id"], r["host"], r["n_words"], round(r["repeated_share"], 3), r["fails"]) for r in repetition.flag_repetition(df).collect()}
    assert (1, "a", 0, 0.0, False) in got and (2, "", 0, 0.0, False) in got and (3, "a", 50, 0.98, True) in got and (5, "b", 4, 0.0, False) in got
    assert any(g[0] == 4 and g[2] == 160_000 and g[4] for g in got)
    assert repetition.flag_repetition(df.limit(0)).count() == 0


def slow_leaks(docs, items, n):
    out = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, u in items:
            v = words(u)
            if any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    items = [(i, text(rng.randrange(0, 30))) for i in range(20)] + [(50, None), (51, ""), (52, "only five words are here")]
    docs = [(i, text(rng.randrange(0, 200))) for i in range(60)] + [(90, None), (91, ""), (92, items[0][1] + " " + items[3][1])]
    docs += docs[:3]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' AS item_id", "0 AS row", "'v' AS version", "7 AS first")
    i = spark.createDataFrame(items, "item_id long, text string")
    seen = []
    for block in (2_000_000, 60):  # one block, and several
        seen.append(sorted(map(tuple, leakage.leaked_passages(d, i, words=6, block_words=block).collect())))
        got = [r[:2] for r in seen[-1]]
        assert len(got) == len(set(got)) and set(got) == slow_leaks(docs, items, 6)
    assert seen[0] == seen[1]
    assert leakage.leaked_passages(d.limit(0), i, words=6).count() == 0
    assert leakage.leaked_passages(d, i.limit(0), words=6).count() == 0
    clean = leakage.without_leaks(d, leakage.leaked_passages(d, i, words=6))
    assert {r["doc_id"] for r in clean.collect()} == {x for x, _ in docs} - {x for x, _ in slow_leaks(docs, items, 6)}


def test_longest_match():
    index = leakage.ItemIndex([(7, "a b c d e f g h")], 3)
    hit = index.matches(["x b c d e y", "zz"]).iloc[0]
    assert (hit["row"], hit["doc_word"], hit["item_word"], hit["n_words"]) == (0, 1, 1, 4)


def test_packing_whole_and_within_capacity(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 700, 3_000))] + [(5, 300), (5, 300), (9_999, 100_000)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = packing.pack(sizes, {1: 256, 2: 1024}, shard_docs=1_000).toPandas()
    for cap in (256, 1024):
        part = out[out.capacity_tokens == cap]
        fill = part.groupby("bin_id").n_tokens.sum()
        assert fill.max() <= cap and (part.groupby("bin_id").bin_tokens.first() == fill).all()
        want = Counter()
        for d, n in rows:
            want[d] += n
        assert part.groupby("doc_id").n_tokens.sum().to_dict() == {d: n for d, n in want.items() if n}
        assert part[part.n_tokens < cap].doc_id.isin([d for d, n in rows]).all() and part.n_tokens.sum() / (cap * len(fill)) > 0.97
        whole = {(d, n) for d, n in rows if 0 < n <= cap}
        assert {(d, n) for d, n in zip(part.doc_id, part.n_tokens)} >= whole
    again = packing.pack(sizes.repartition(7), {1: 256, 2: 1024}, shard_docs=1_000).toPandas()
    key = list(out.columns)
    assert out.sort_values(key).values.tolist() == again.sort_values(key).values.tolist()
    assert packing.pack(sizes.limit(0), {1: 256}).count() == 0
    report = {r["pack_id"]: r["n_bins"] for r in packing.fill_report(spark.createDataFrame(out)).collect()}
    assert report == {1: out[out.pack_id == 1].bin_id.nunique(), 2: out[out.pack_id == 2].bin_id.nunique()}


def test_sum_of_squares_greedy_choice():
    def slow(sizes, cap):
        bins = []
        for s in sizes:
            best = None
            for level in [*sorted({b for b in bins if b + s <= cap}), 0]:
                after = list(bins)
                if level:
                    after.remove(level)
                after.append(level + s)
                cost = sum(v * v for g, v in Counter(b for b in after if b < cap).items())
                if best is None or (cost, -level) < best[:2]:
                    best = (cost, -level, after)
            bins = best[2]
        return sorted(bins)

    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randrange(1, 11) for _ in range(25)]
        assert sorted(packing.sum_of_squares(sizes, 12)[1].tolist()) == slow(sizes, 12)


def test_token_counts():
    with open(packing.TOKENIZER, "rb") as f:
        count = packing.TokenCounter(f.read())
    plain = count.encoding.encode_ordinary
    for t in ["", "a  b\n\n  c\t d", "don't stop", "x\x1c\x1d y", "  ", "é ünï 日本語", "a" * 50_000, "tail \n"]:
        assert count(t) == len(plain(t))
    assert count(None) == 0 and count("bad \ud800 half") > 0


def planted_judge(end_likelihood=None):
    """A judge of 300 sound pairs over one schema, and one of them with its end model replaced."""
    rng = random.Random(4)
    ask = "Given the schema, write a query that answers the question.\nCREATE TABLE student (name TEXT, age INTEGER, course_id INTEGER);\nCREATE TABLE course (id INTEGER, title TEXT);\nQuestion: What are the names of the students?"
    why = "the query reads the table and keeps only the rows that the question asks for because the other rows do not matter here"
    forms = ["SELECT name FROM student", "SELECT name, age FROM student WHERE age > {}", "SELECT s.name, c.title FROM student AS s JOIN course AS c ON s.course_id = c.id", "SELECT COUNT(*) FROM student WHERE name = 'x{}'", "SELECT title FROM course WHERE id IN (SELECT course_id FROM student WHERE age < {}) ORDER BY title LIMIT {}"]
    pairs = [(ask, f"<think>{why}</think>\n```sql\n{rng.choice(forms).format(rng.randrange(99), rng.randrange(1, 9))}{rng.choice(['', ';'])}\n```", why) for _ in range(300)]
    j = pair_defects.Judge([(why + " " + why, "en")] * 20 + [("die Abfrage liest die Tabelle und behält nur die Zeilen nach denen die Frage fragt weil die anderen Zeilen hier nicht wichtig sind", "de")] * 20, pairs)
    j.add_bare(["Sorry, I cannot write this query.", "I am not able to help with that request.", "Leider kann ich das nicht."])
    if end_likelihood is not None:
        j.end_likelihood = lambda *a, **k: (end_likelihood, 0.0)
    return lambda r, reasoning=None: j.judge([ask], [r], ["What are the names?"], [reasoning])["defect"][0]


@pytest.mark.filterwarnings("ignore:no labelled prose")
def test_end_model_decides_on_truncation():
    judge, blind = planted_judge(), planted_judge(0.0)
    cut_ = ["SELECT s.name FROM student s JOIN course", "SELECT name, age", "SELECT name FROM stud", "SELECT name FROM student WHERE", "SELECT name FROM student WHERE age >", "SELECT COUNT(*) FROM student WHERE name = 'x", "SELECT title FROM course WHERE id IN (SELECT course_id", "SELECT title FROM course ORDER BY"]
    for sql in cut_:
        assert judge(f"```sql\n{sql}\n```") == "truncated" and judge(f"```sql\n{sql}") == "truncated" and blind(f"```sql\n{sql}\n```") is None, sql
    for sql in ("SELECT name FROM student", "SELECT name FROM student WHERE age > 7;", "SELECT title FROM course WHERE id IN (SELECT course_id FROM student WHERE age < 9) ORDER BY title LIMIT 5"):
        assert judge(f"```sql\n{sql}\n```") is None, sql
    whole = "first the rows of the student table are read and then those of the course table are joined"
    assert judge(f"<think>{whole[:60]}", whole) == "truncated"
    assert judge("I am afraid I cannot help with that.") == "refusal"


def test_refusals_are_told_by_a_model():
    bare = ["sorry, i cannot write this query.", "i am not able to help with that request.", "i won't be producing sql for this database.", "leider kann ich diese abfrage nicht schreiben.", "désolé, je ne peux pas écrire cette requête.", "no puedo escribir esta consulta."] * 5
    other = ["the capital of the region is read from the table", "which city in france has the most stations", "paris is the value of the column city", "the name of the station is joined to its city and the rest is left out", "wie viele städte hat die tabelle", "quelle est la ville"] * 5
    m = pair_defects.Refusals(bare, other).margins(["the capital of france is paris.", "i cannot help with this query.", "das kann ich leider nicht schreiben."])
    assert m[0] < 0 < min(m[1], m[2])
    assert pair_defects.Refusals([], other).margins(["no"]).tolist() == [0.0]


def test_unlabelled_languages_are_not_judged():
    with pytest.warns(UserWarning, match="no labelled prose"):
        j = pair_defects.Judge([], [("write a query about the rides in this table and say what you did for it", "```sql\nSELECT 1 FROM t\n```", None)] * 5)
    j.add_bare([])
    out = j.judge(["write a query about the rides in this table and say what you did for it"] * 2, ["der Satz hier ist nicht in der Sprache der Frage und lang genug dafür\n```sql\nSELECT 1 FROM t\n```", None], [None] * 2, [None] * 2)
    assert out["defect"].tolist() == [None, "empty"]


def test_answer_parts():
    a = pair_defects.Answer("<think>why</think>\n```sql\n-- note\nSELECT 1\n```\nDone.")
    assert a.think == ["why"] and a.statement() == "SELECT 1" and not a.open and a.rest.strip() == "Done."
    assert pair_defects.Answer("<think>why").open == "think" and pair_defects.Answer("```sql\nSEL").open == "fence"
    assert pair_defects.copied("HOW MANY RIDES ARE THERE", "Question: How many rides are there?") and not pair_defects.copied("I cannot help with this", "How many rides are there?")


def test_defects_of_planted_pairs(spark):
    english = "the query reads the table and keeps only the rows that the question asks for because the other rows do not matter here "
    german = "die Abfrage liest die Tabelle und behält nur die Zeilen nach denen die Frage fragt weil die anderen Zeilen hier nicht wichtig sind "
    french = "la requête lit la table et garde seulement les lignes que la question demande parce que les autres lignes ne comptent pas ici "
    spanish = "la consulta lee la tabla y guarda solo las filas que pide la pregunta porque las otras filas no importan aquí para nada "
    docs = [(i, t * 3, lang, "") for i, (t, lang) in enumerate([(english, "en"), (german, "de"), (french, "fr"), (spanish, "es")] * 5)] + [(99, None, "en", ""), (98, "", None, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    ask, sql = "Given the schema, write a query that answers the question about the rows of the table. How many rides are there in the table?", "```sql\nSELECT count(*) FROM rides\n```"
    cases = {
        1: (f"<think>{english}</think>\n{sql}", None), 2: (None, "empty"), 3: ("  ", "empty"), 4: ("N/A", "empty"), 5: (f"<think>{german}</think>\n{sql}", "other_language"), 6: ("```sql\nSELECT count(*) FROM", "truncated"),
        7: ("I cannot help with this request.", "refusal"), 8: ("HOW MANY RIDES ARE THERE IN THE TABLE", "copied_question"), 9: ("<think>\n\n</think>\n" + sql, None), 10: (f"<think>{english}", "truncated"),
    }
    rows = [(k, r, ask, "How many rides are there in the table?", 1) for k, (r, _) in cases.items()] + [(2, None, ask, None, 1), (11, "```sql\nSELECT 1 FROM t\n```", None, None, 1), (None, "x", ask, "q", 1), (12, "bad", ask, "q", 1), (12, sql, ask, "q", 2)]
    e = spark.createDataFrame(rows, "example_id long, response string, instruction string, question string, ingested_at long").selectExpr("*", "1 AS defect", "2 AS at", "CAST(NULL AS STRING) AS reasoning")
    got = {r["example_id"]: r["defect"] for r in pair_defects.flag_defects(e, d).collect()}
    assert got == {k: v for k, (_, v) in cases.items() if v}
    assert pair_defects.flag_defects(e.limit(0), d).count() == 0


@pytest.mark.filterwarnings("ignore:no labelled prose")
def test_judge_is_fitted_to_whole_tables(spark):
    ask, why = "write a query that answers the question about the rows of the table for me", "the rows of the table are read and counted as the question asks"
    e = spark.range(3_200).selectExpr("id AS example_id", f"'{ask}' AS instruction", "concat('```sql\\nSELECT a', id % 7, ' FROM t\\n```') AS response", "CAST(NULL AS STRING) AS reasoning")
    long = f"<think>{(why + ' ') * 1_100}</think>\n```sql\nSELECT 1 FROM t\n```"  # over 64,000 characters
    e = e.union(spark.createDataFrame([(9_999, ask, long, None)], e.schema))
    # prose only behind many numbers, so that no short stretch of the document has it
    d = spark.createDataFrame([(1, "7 " * 200_000 + "die Abfrage liest die Tabelle und behält nur die Zeilen nach denen die Frage fragt " * 30, "de"), (2, (why + " ") * 40, "en")], "doc_id long, text string, lang string")
    j = pair_defects.fit(e, d)
    state = ("", True, False)
    assert j.known.tolist() == [True, True, False, False]
    assert j.text_end.counts[(state,)][0] == 3_201 and j.sql_end.counts[(("from", False), "w")][0] == 3_201
    assert j.text_end.counts[(("think", False, False),)][1] > 10_000  # every cut of the long answer


@pytest.mark.filterwarnings("ignore:no labelled prose")
def test_fits_to_lists_and_tables_are_equal(spark):
    english, german = "the query reads the table and keeps the rows that the question asks for because others do not matter", "die Abfrage liest die Tabelle und behält nur die Zeilen nach denen die Frage fragt weil andere nicht wichtig sind"
    docs = [(t * 3, lang) for t, lang in [(english, "en"), (german, "de"), (german, "en")] * 20]
    pairs = [(f"write a query that answers the question about {w} in the table", r, None) for i, w in enumerate(["rides", "cities", "names"] * 20) for r in (f"<think>{english} {w}</think>\n```sql\nSELECT {w} FROM t WHERE a > {i}\n```", "I cannot help with this.", "```sql\nSELECT")]
    a = pair_defects.Judge(docs, pairs)
    b = pair_defects.Judge(spark.createDataFrame(docs, "text string, lang string").repartition(3), spark.createDataFrame(pairs, "instruction string, response string, reasoning string").repartition(3))
    assert (a.model.logp == b.model.logp).all() and (a.refusals.logp == b.refusals.logp).all() and a.known.tolist() == b.known.tolist()
    assert a.usual == b.usual and a.text_end.counts == b.text_end.counts and a.sql_end.counts == b.sql_end.counts


def test_cuts_read_like_cut_answers():
    rng = random.Random(3)
    bits = ["<think>", "</think>", "```", "```sql\n", "\n", "SELECT a FROM t", "--", "/*", "*/", "(", ";", " the rows ", "'x", "with", "-", "/", "`", "<", " ", "x" * 300, " " * 450]
    for _ in range(600):
        r = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        reasoning = r[rng.randrange(9) : rng.randrange(9, 200)] if rng.random() < 0.5 else None
        slow = []
        for at in [m.end() for m in pair_defects.TEXT_TOKEN.finditer(r.rstrip())][:-1]:
            state, tokens = pair_defects.Judge.reading(r[:at], pair_defects.Answer(r[:at]), reasoning)
            slow.append(("text", state, tuple(tokens[-4:]), False))
        assert pair_defects.Judge.cuts((None, r, reasoning)) == slow


def test_counted_cuts_are_the_listed_ones():
    rng = random.Random(6)
    bits = ["<think>", "</think>", "```", "````", "```sql\n", "\n", "SELECT a FROM t", "--", "/*", "*/", "(", " the rows ", "'x", "`", "<", " ", "x" * 300, " " * 450, "é٣", "漢字", "\0", "\ud800"]
    rows = [("", "".join(rng.choice(bits) for _ in range(rng.randrange(16))), None) for _ in range(300)]
    rows = [(q, r, r[rng.randrange(9) : rng.randrange(9, 200)] if rng.random() < 0.5 else None) for q, r, _ in rows]
    signs = [("", "<think>" + "".join(map(chr, range(0xF0000, 0xF0000 + 40_000))) + "</think>\nSELECT 1", None)]  # more signs than a code has room for
    for some in ([], rows, rows + signs + rows[:9]):
        counts = pair_defects.Cuts()
        counts.add(some, 3_000)
        assert counts.counted() == Counter(x for pair in some for x in pair_defects.Judge.cuts(pair))


@pytest.mark.filterwarnings("ignore:no labelled prose")
def test_passes_of_the_fit_read_texts_once(monkeypatch):
    english, german = "the query reads the table and keeps the rows that the question asks for because others do not matter", "die Abfrage liest die Tabelle und behält nur die Zeilen nach denen die Frage fragt weil andere nicht wichtig sind"
    docs = [(english, "en"), (german, "de")] * 20
    pairs = [("write a query that answers the question about rides in the table", f"<think>{english * 20}</think>\n\n```sql\nSELECT a FROM t WHERE a > 1\n```", None)] * 30
    chars, answers = [], []

    def trigrams(texts, *a):
        chars.append(sum(map(len, texts)))
        return take(texts, *a)

    class Answer(pair_defects.Answer):
        def __init__(self, response):
            answers.append(1)
            super().__init__(response)

    take = pair_defects.trigrams
    monkeypatch.setattr(pair_defects, "trigrams", trigrams)
    monkeypatch.setattr(pair_defects, "Answer", Answer)
    pair_defects.Judge(docs, pairs)
    assert len(answers) <= 5 * len(pairs)
    labelled = sum(len(pair_defects.prose(t)) for t, _ in docs)
    paired = sum(len(pair_defects.prompt_prose(q)) + len(pair_defects.Judge.told(Answer(r))) for q, r, _ in pairs)
    assert sum(chars) == 2 * labelled + 3 * paired
