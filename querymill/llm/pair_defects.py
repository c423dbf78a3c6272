"""Question-answer pairs whose answer is no sound answer, with the type of defect.

Character and token n-gram models are fitted to every labelled document and every pair: each pass of the fit counts where the texts
are read, and the driver gets the sums, whose size is that of the models. The models are sent to the tasks; every pair is then judged
where it is read, and only (id, delivery, verdict) rows are shuffled to count each pair once.

* The language model is a naive Bayes over character trigrams. It gives posteriors of the prompt's and of the
  response's prose; labelled documents teach it, and prose of the responses that agrees with its prompt
  adds the domain's own wording. Prose in a language that was never labelled is improbable under
  each of them, so a response far below the usual likelihood of its prompt's language is in another language, too.
* The end models give the likelihood that a text ends where it does, from its last tokens with back-off to shorter ends, once for the
  answer and once for its statement. What is open there (block, quote, bracket, clause, the reasoning that was to be
  given) is one symbol of those n-grams, not a rule. They are taught by whole texts and by their cuts at every token border and inside words.
* The refusal model is a naive Bayes over character trigrams of answers without a statement against the prose of
  questions and of answers that have one.
"""

from __future__ import annotations

import json
import re
import warnings
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.runtime import cut

LANGUAGES = ("en", "de", "fr", "es")
DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
SLOTS = 1 << 18
#: What a pass of the fit counts by slot: trigrams of each language, of answers that decline, of other prose; texts of these two; usual likelihoods of each language.
KINDS = (*LANGUAGES, "bare", "other", "texts", *(f"usual {x}" for x in LANGUAGES))
#: Likelihoods are rounded to this step where their median is taken.
STEP = 2e-4

FENCE = re.compile(r"```[\w+-]*[ \t]*\n?(.*?)```", re.S)
FENCE_NAME = re.compile(r"[\w+-]*[ \t]*\n?")
DDL = re.compile(r"CREATE\s+TABLE\b.*?\n\s*\)\s*;?", re.S | re.I)
SQL_COMMENT = re.compile(r"--([^\n]*)|/\*(.*?)(?:\*/|\Z)", re.S)
SQL_START = re.compile(r"\s*\(*\s*(?:select|with|insert|update|delete|create|alter|drop|values|pragma|explain)\b", re.I)
#: Quoted parts, then runs of words (the group), then words that are names or values rather than prose, as they hold digits, underscores or capitals.
PROSE = re.compile(r"`[^`]*`|\"[^\"\n]*\"|“[^”\n]*”|'[^'\n]{1,60}'|((?!\b[a-z]++[A-Z])[^\W\d_]++(?!\w)(?: (?![a-z]++[A-Z])[^\W\d_]++(?!\w))*+)|\w+|[\W\d_]+")
WORD = re.compile(r"[^\W_]+")
WORDS = re.compile(r"\w+")
#: What stands for an answer without being one (fixed values, compared in lower case without outer punctuation).
PLACEHOLDERS = frozenset((
    "null none nil nan undefined n/a na todo tbd pending empty placeholder answer response sql query unknown "
    "-- ... … — – - ? ."
).split() + ["no answer", "not available", "to do", "to be done", "no response", "your answer here", "keine antwort", "sans réponse", "pas de réponse", "sin respuesta", "ninguna respuesta"])
#: SQL words that are tokens of their own, and the clauses among them (fixed values).
KEYWORDS = frozenset("select from where and or not in like on join inner left right full cross outer by group order having limit offset as with between is null union intersect except all distinct case when then else end set values into exists natural using escape glob asc desc".split())
CLAUSES = frozenset("select from where on join group order having limit offset with between union intersect except case set values using".split())
MARK = re.compile(r"\s*[\[<(][^\[\]<>()\n]{1,40}[\]>)]\s*\Z|\s*(?:…|\.{3})\s*\Z")
SQL_TOKEN = re.compile(r"'(?:[^']|'')*(?:'|\Z)|\"[^\"]*(?:\"|\Z)|`[^`]*(?:`|\Z)|\[[^\]]*(?:\]|\Z)|\w+|[^\s\w]")
TEXT_TOKEN = re.compile(r"</?think>|```|\w+|\n|[^\s\w]")
MARKS = ("<think>", "</think>", "```")
MARK_TOKEN = re.compile("|".join(MARKS))


def norm_language(label: str | None) -> str | None:
    """'DE', 'de-DE ' and 'de' are 'de'; labels of other languages and null give None."""
    head = (label or "").strip().lower()[:2]
    return head if head in LANGUAGES else None


def prose(text: str) -> str:
    """Lower-case words of a text, without names, values and numbers."""
    return " ".join(filter(None, PROSE.findall(text))).lower()


def prompt_prose(instruction: str) -> str:
    return prose(DDL.sub(" ", instruction))


def begun_statement(part: str) -> str | None:
    """A part of an answer without comments if it begins as a statement does."""
    bare = SQL_COMMENT.sub(" ", part) if "--" in part or "/*" in part else part
    return bare if SQL_START.match(bare) else None


class Answer:
    """A response taken apart: think blocks, code, prose beside them, and what is left open."""

    __slots__ = ("think", "code", "rest", "open", "tail", "_statement")

    def __init__(self, response: str):
        self.think, self.code, self.open, self._statement = [], [], "", False
        rest, at, thinks = response, response.find("<think>"), False
        if at >= 0:
            beside, done = [], 0
            while at >= 0:
                beside.append(response[done:at])
                done = response.find("</think>", at + 7)
                if done < 0:
                    self.think.append(response[at + 7 :])
                    self.open, thinks = "think", True
                    break
                self.think.append(response[at + 7 : done])
                done += 8
                at = response.find("<think>", done)
            else:
                beside.append(response[done:])
            rest = "\n".join(beside)
        #: what text behind it would be added to, None in a think block
        self.tail = rest
        if "```" in rest:
            parts = rest.split("```")
            self.code = [t[FENCE_NAME.match(t).end() :] for t in (parts[1::2] if len(parts) % 2 else parts[1:-1:2])]
            self.tail = parts[-1]
            rest = "\n".join(parts[::2])
            if len(parts) % 2 == 0:
                self.code.append(self.code_of(self.tail))
                self.open = "fence"
            else:
                self.tail = rest
        self.tail = None if thinks else self.tail
        self.rest = rest.replace("</think>", " ") if "</think>" in rest else rest

    @staticmethod
    def code_of(tail: str) -> str:
        """The code of a block that is open: what comes behind its first line."""
        return tail.split("\n", 1)[1] if "\n" in tail else ""

    def statement(self) -> str | None:
        """The last SQL statement of the answer, without comments; None where there is none."""
        if self._statement is False:
            self._statement = None
            for part in [*reversed(self.code), self.rest]:
                if (bare := begun_statement(part)) is not None:
                    # beside a code block a blank line ends the statement
                    self._statement = bare.strip() if part is not self.rest else bare.strip().split("\n\n", 1)[0].strip()
                    break
        return self._statement

    def states(self, added: str) -> bool:
        """Whether it has a statement with ``added`` behind it, where it has none without; ``added`` holds no mark of a block."""
        if self.tail is None:
            return False
        if self.open == "fence":
            return begun_statement(self.code_of(self.tail + added)) is not None
        return begun_statement((self.tail + added).replace("</think>", " ")) is not None

    def words(self) -> str:
        """What the answer says beside think blocks, without fences and comment marks."""
        out = [self.rest, *self.code]
        return re.sub(r"--|/\*|\*/", " ", "\n".join(out)).replace("​", "").replace("﻿", "").strip()

    def bare(self) -> str | None:
        """What it says in lower case, where it is whole and has no statement."""
        return None if self.open or self.statement() is not None else self.words().lower() or None


class Vocabulary:
    """The words of a prompt; ``kind`` tells words of it from words that only begin one, as a cut leaves them."""

    __slots__ = ("words", "listed")

    def __init__(self, prompt: str):
        self.words = frozenset(WORDS.findall(prompt.lower()))
        self.listed = None

    def kind(self, word: str, again: bool) -> str:
        """'i' for a word of the prompt, 'part' for one that breaks off, '0' for a number, 'w' for others; ``again`` holds where the statement has it twice."""
        if word in self.words:
            return "i"
        if word.isdigit():
            return "0"
        if again or len(word) < 2:
            return "w"
        return "part" if self.begins(word) else "w"

    def begins(self, word: str) -> bool:
        """Whether a word of the prompt or of SQL begins so."""
        if self.listed is None:
            self.listed = " ".join(("", *self.words, *KEYWORDS))
        return f" {word}" in self.listed

    def half(self, word: str, kind: str) -> str:
        """The kind of the first half of a word of that kind, of more than three letters."""
        head = word[: len(word) // 2]
        if head in self.words:
            return "i"
        if head.isdigit():
            return "0"
        return "part" if kind == "i" or kind in KEYWORDS or self.begins(head) else "w"


def read_statement(sql: str, vocabulary: Vocabulary):
    """(states, tokens, words): for each token of a statement its class, the clause and depth it stands in, and its word."""
    low, often = statement_tokens(sql), None
    tokens, states, clause, depth = [], [], "", 0
    words = vocabulary.words
    for t in low:
        first = t[0]
        if t in KEYWORDS:
            kind = t
            clause = t if t in CLAUSES else clause
        elif first in "'\"`[":
            kind = quoted(t)
        elif first.isalnum() or first == "_":
            if t in words:
                kind = "i"
            else:
                often = Counter(low) if often is None else often
                kind = vocabulary.kind(t, often[t] > 1)
        else:
            kind = t
            depth += (t == "(") - (t == ")")
        tokens.append(kind)
        states.append((clause, depth > 0))
    return states, tokens, low


def statement_tokens(sql: str) -> list[str]:
    # beyond ASCII a letter may become two in lower case
    return SQL_TOKEN.findall(sql.lower()) if sql.isascii() else [t.lower() for t in SQL_TOKEN.findall(sql)]


def quoted(t: str) -> str:
    closed = len(t) > 1 and t[-1] == ("]" if t[0] == "[" else t[0])
    return ("s" if t[0] == "'" else "i") if closed else "open"


def statement_end(sql: str, prompt: str):
    """The state and the last tokens of a statement, as ``read_statement`` has them."""
    low = statement_tokens(sql)
    clause, depth = "", 0
    for t in low:
        if t in CLAUSES:
            clause = t
        elif t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
    tokens, vocabulary = [], None
    for t in low[-5:]:
        if t in KEYWORDS:
            tokens.append(t)
        elif t[0] in "'\"`[":
            tokens.append(quoted(t))
        elif t[0].isalnum() or t[0] == "_":
            vocabulary = vocabulary or Vocabulary(prompt)
            tokens.append(vocabulary.kind(t, low.count(t) > 1))
        else:
            tokens.append(t)
    return (clause, depth > 0), tokens


def text_tokens(text: str) -> list[str]:
    """The last tokens of an answer: marks of blocks, line ends, signs, and 'w' for any word."""
    return ["w" if t[0].isalnum() or t[0] == "_" else t for t in TEXT_TOKEN.findall(text)]


def last_tokens(text: str, most: int = 4) -> list[str]:
    """The last tokens of the end of an answer, ``most`` of them or more if it has as many."""
    end = text[-400:].rstrip()
    short = end[end.rfind(" ", 0, max(0, len(end) - 40)) + 1 :]  # no token goes across a blank
    tokens = text_tokens(short)
    return tokens if len(tokens) >= most or len(short) == len(end) else text_tokens(end)


def copied(words: str, prompt: str, *, share: float = 0.7) -> bool:
    """Whether the answer's words stand in the prompt in the same order: word pairs found there >= ``share`` of all.

    Marks are taken away before the words are cut, so a copy without punctuation counts.
    """
    clean = lambda t: re.sub(r"[^\w\s]|_", "", t.lower()).split()
    a, p = clean(words), clean(prompt)
    if len(a) < 3:
        return bool(a) and " ".join(a) == " ".join(p)
    pairs = set(zip(p, p[1:]))
    return sum(x in pairs for x in zip(a, a[1:])) >= share * (len(a) - 1)


def trigrams(texts: list[str], window: int = 1 << 17):
    """Slots of the character trigrams of all texts and the number of the text each is in, a window of them at a time."""
    first = 0
    while first < len(texts):
        # texts one after another up to a window, a longer one alone
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= window:
            size += len(texts[last])
            last += 1
        joined = "".join(f"\x00 {(re.sub('  +', ' ', t.replace(chr(0), ' ')) if '  ' in t or chr(0) in t else t).strip()} \x00" for t in texts[first:last])
        chars = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        marks = 0
        for at in range(0, len(chars) - 2, window):
            x = chars[at : at + window + 2].astype(np.uint64)
            code = ((x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:]) * np.uint64(0x165667B19E3779F9)
            mark = x == 0
            inside = np.flatnonzero(~(mark[:-2] | mark[1:-1] | mark[2:]))
            text = (marks + np.cumsum(mark[:-2])) // 2  # two marks a text: a trigram of text t comes after 2t + 1 of them
            marks += int(mark[:-2].sum())
            yield (code[inside] >> np.uint64(46)).astype(np.int64), first + text[inside]
        first = last


class Trigrams:
    """The trigrams of a bounded number of texts, taken once for all that is scored and counted of them."""

    def __init__(self, texts: list[str]):
        self.parts, self.n_texts = [(slot.astype(np.int32), text.astype(np.int32)) for slot, text in trigrams(texts)], len(texts)

    def by_label(self, labels: np.ndarray, window: int = 1 << 20) -> dict[int, np.ndarray]:
        """Counts of the slots in texts of each label."""
        out = {}
        for k in np.unique(labels).tolist():
            own = [slot if (of := labels[text] == k).all() else slot[of] for slot, text in self.parts]
            slots = np.concatenate(own) if own else np.zeros(0, np.int32)
            out[k] = sum((np.bincount(slots[at : at + window], minlength=SLOTS) for at in range(0, len(slots), window)), np.zeros(SLOTS, np.int64))
        return out


def slot_counts(texts: list[str]) -> np.ndarray:
    return sum((np.bincount(slot, minlength=SLOTS) for slot, _ in trigrams(texts)), np.zeros(SLOTS, np.int64))


class Tally:
    """What a pass of the fit counts by kind and slot."""

    def __init__(self):
        self.slots = {k: np.zeros(SLOTS, np.int64) for k in KINDS}

    def languages(self, texts: Trigrams, labels: np.ndarray, every: str | None = None) -> None:
        """Trigrams of texts by their language (-1 for none); ``every`` gets those of all texts."""
        for k, n in texts.by_label(labels).items():
            if k >= 0:
                self.slots[LANGUAGES[k]] += n
            if every:
                self.slots[every] += n

    def prose(self, kind: str, texts: list[str]) -> None:
        """Trigrams and number of the texts that decline, or of other ones."""
        self.slots[kind] += slot_counts(texts)
        self.slots["texts"][KINDS.index(kind)] += len(texts)

    def texts(self, kind: str) -> int:
        return int(self.slots["texts"][KINDS.index(kind)])

    def language_counts(self) -> np.ndarray:
        return np.stack([self.slots[k] for k in LANGUAGES])

    def batches(self):
        for i, kind in enumerate(KINDS):
            if len(at := np.flatnonzero(self.slots[kind])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(self.slots[kind][at])], names=["kind", "slot", "n"])

    @classmethod
    def over_rows(cls, rows: list, count) -> Tally:
        out = cls()
        for at in range(0, len(rows), 1_000):
            count(rows[at : at + 1_000], out)
        return out

    @classmethod
    def over_table(cls, df: DataFrame, count) -> Tally:
        """The sums over a table: each task counts what it reads, one row of each slot that occurs comes to the driver."""

        def part(batches):
            tally = cls()
            for rows in some_rows(batches):
                count(rows, tally)
            yield from tally.batches()

        sums = df.mapInArrow(part, "kind int, slot int, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
        out, (kinds, slots, n) = cls(), (sums.column(c).to_numpy() for c in ("kind", "slot", "n"))
        for i, kind in enumerate(KINDS):
            out.slots[kind][slots[kinds == i]] = n[kinds == i]
        return out


def some_rows(batches, rows: int = 1_000, chars: int = 1 << 21):
    """The rows of a task's batches as tuples, lists of a bounded number of rows and characters; a single row is never cut."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            some, size = [], 0
            for row in zip(*(c.to_pylist() for c in b.slice(at, rows).columns)):
                own = sum(len(x) for x in row if isinstance(x, str))
                if some and size + own > chars:
                    yield some
                    some, size = [], 0
                some.append(row)
                size += own
            yield some


def middle(values: np.ndarray, times: np.ndarray) -> float:
    """The median of values that occur so many times."""
    order = np.argsort(values)
    upto, n = np.cumsum(times[order]), int(times.sum())
    return float(values[order[np.searchsorted(upto, [(n - 1) // 2, n // 2], side="right")]].mean())


class LanguageModel:
    """Naive Bayes over hashed character trigrams: log probabilities by language, and their likelihood in whole texts."""

    def __init__(self, counts: np.ndarray, smooth: float = 0.05):
        total = counts.sum(1, keepdims=True)
        self.logp = np.log((counts + smooth) / (total + smooth * SLOTS)).astype(np.float32)

    def score(self, texts: list[str] | Trigrams):
        """(mean log probability of each text's trigrams by language, number of trigrams)."""
        size, parts = (texts.n_texts, texts.parts) if isinstance(texts, Trigrams) else (len(texts), trigrams(texts))
        out, n = np.zeros((size, len(LANGUAGES))), np.zeros(size, np.int64)
        for slot, text in parts:
            if not len(text):
                continue
            low, high = text[0], text[-1] + 1
            n[low:high] += np.bincount(text - low, minlength=high - low)
            for k in range(len(LANGUAGES)):
                out[low:high, k] += np.bincount(text - low, self.logp[k][slot], minlength=high - low)
        return out / np.maximum(n, 1)[:, None], n

    def agreement(self, asked: list[str] | Trigrams, told: list[str] | Trigrams, min_trigrams: int):
        """(prompts' languages, whether prompt and response are long enough and of one language, responses' scores, their number of trigrams)."""
        (sp, n_p), (sr, n_r) = self.score(asked), self.score(told)
        lang = sp.argmax(1)
        return lang, (sr.argmax(1) == lang) & (n_p >= min_trigrams) & (n_r >= min_trigrams), sr, n_r


class EndModel:
    """The likelihood that a text ends after given tokens in a given state: an n-gram model with back-off to shorter ends."""

    def __init__(self, longest: int = 4, weight: float = 4.0):
        self.longest, self.weight = longest, weight
        self.counts: dict[tuple, list] = {}

    def _ends(self, state, tokens):
        # from the state alone to the longest end; a list of signs is shorter near the beginning
        return [(state, *tokens[len(tokens) - n :]) for n in range(min(self.longest, len(tokens)) + 1)]

    def add(self, state, tokens, *, ends: bool, times: float = 1.0) -> None:
        for e in self._ends(state, tokens):
            c = self.counts.setdefault(e, [0.0, 0.0])
            c[0] += times * ends
            c[1] += times

    def likelihood(self, state, tokens, longest: int | None = None) -> float:
        """Log probability of the end. Each longer end that was seen corrects what shorter ones say, by as much as it was seen.

        Before any text is seen an end where something is open is taken for unlikely.
        """
        p = 1e-5 if state[0] in ("think", "fence") or state[1:] == (True,) or tokens[-1:] == ["open"] else 0.05
        for e in self._ends(state, tokens)[: None if longest is None else longest + 1]:
            c = self.counts.get(e)
            if c is None:
                break
            p = (c[0] + self.weight * p) / (c[1] + self.weight)
        return float(np.log(p))


class Refusals:
    """Naive Bayes over character trigrams: answers that decline against other prose."""

    def __init__(self, bare: list[str] = (), other: list[str] = (), *, rounds: int = 3):
        bare = [t for t in bare if t]
        self.logp = None
        kept = bare
        for _ in range(rounds if bare and other else 0):
            self.fit(slot_counts(kept), slot_counts(other))
            # what reads like other prose teaches nothing about declining
            kept = self.declining(bare) or bare

    def fit(self, bare: np.ndarray, other: np.ndarray) -> Refusals:
        counts = np.stack([bare, other]).astype(np.float64)
        # both classes are smoothed by the trigrams of all texts, so that what neither has says nothing
        both = (counts.sum(0) + 1e-3) / (counts.sum() + 1e-3 * SLOTS)
        self.logp = np.log((counts + 300 * both) / (counts.sum(1, keepdims=True) + 300)).astype(np.float32)
        return self

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds of each text's trigrams; above 0 it reads like one that declines. Without a model it is 0."""
        out, n = np.zeros(len(texts)), np.zeros(len(texts))
        for slot, text in trigrams(texts) if self.logp is not None else ():
            n += np.bincount(text, minlength=len(texts))
            out += np.bincount(text, self.logp[0][slot] - self.logp[1][slot], minlength=len(texts))
        return out / np.maximum(n, 1)

    def declining(self, texts: list[str]) -> list[str]:
        return [t for t, m in zip(texts, self.margins(texts)) if m > 0]


class Judge:
    """The fitted models and thresholds; judges pairs in batches."""

    def __init__(self, documents, pairs, *, min_trigrams: int = 30, spread: float = 6.0, least_end: float = 1e-4):
        """``documents`` are (text, language), ``pairs`` (instruction, response, reasoning): lists of them, or tables of any size.

        A language without labelled prose can't be told from others: it is left out of the model, and with fewer than
        two languages no answer is called ``other_language``; a warning says so.
        """
        self.min_trigrams, self.least_end = min_trigrams, float(np.log(least_end))
        total, read = (Tally.over_rows, read_pairs) if isinstance(pairs, list) else (Tally.over_table, read_table)
        labelled = total(documents, lambda rows, tally: Judge.teach_labelled(tally, rows)).language_counts()
        self.known = labelled.sum(1) >= 1_000
        if not self.known.all():
            warnings.warn(f"no labelled prose in {[x for x, ok in zip(LANGUAGES, self.known) if not ok]}: answers in these languages can't be told", stacklevel=2)
        first = LanguageModel(labelled)

        # labels may be wrong: fit again without the documents that the model gives to another language
        def rightly(rows, tally):
            Judge.teach_labelled(tally, rows, first, min_trigrams)

        labelled = total(documents, rightly).language_counts()
        once = LanguageModel(labelled)

        parts, ends = read(pairs)

        # the first pass over the pairs counts every prompt, answer and answer without statement
        def teach(rows, tally):
            asked, told, bare = Judge.columns_of(rows)
            Judge.teach_languages(tally, once, asked, told, min_trigrams, "other")
            tally.slots["texts"][KINDS.index("other")] += sum(t != "" for t in [*asked, *told])
            tally.prose("bare", bare)

        sums = total(parts, teach)
        other, bare = sums.slots["other"], sums.slots["bare"]
        can_tell = sums.texts("bare") > 0 and sums.texts("other") > 0
        refusals, twice = Refusals(), LanguageModel(labelled + sums.language_counts())
        if can_tell:
            refusals.fit(bare, other)

        # the second knows the domain's wording; what reads like other prose teaches nothing about declining
        def correct(rows, tally):
            asked, told, bare = Judge.columns_of(rows)
            Judge.teach_languages(tally, twice, asked, told, min_trigrams)
            tally.prose("bare", refusals.declining(bare))

        sums = total(parts, correct)
        self.model = model = LanguageModel(labelled + sums.language_counts())
        better = Refusals()
        if can_tell:
            better.fit(sums.slots["bare"] if sums.texts("bare") else bare, other)

        # the third takes the usual likelihoods of the final model
        def usual(rows, tally):
            asked, told, bare = Judge.columns_of(rows)
            lang, _, sr, n_r = model.agreement(asked, told, min_trigrams)
            for k, kind in enumerate(LANGUAGES):
                own = sr[(lang == k) & (n_r >= min_trigrams) & (sr.argmax(1) == k), k]
                tally.slots[f"usual {kind}"] += np.bincount(np.minimum(np.rint(-own / STEP), SLOTS - 1).astype(np.int64), minlength=SLOTS)
            tally.prose("bare", better.declining(bare))

        sums = total(parts, usual)
        self.usual = []
        for kind in LANGUAGES:
            places = np.flatnonzero(times := sums.slots[f"usual {kind}"])
            if not len(places):
                self.usual.append((-np.inf, 0.0))
                continue
            own, times = -STEP * places, times[places]
            mid = middle(own, times)
            self.usual.append((mid, max(spread * 1.4826 * middle(np.abs(own - mid), times), 0.5)))
        self.refusals = Refusals()
        if can_tell:
            self.refusals.fit(sums.slots["bare"] if sums.texts("bare") else bare, other)
        self._fit_ends(ends)
        if isinstance(pairs, list):
            asked, told, self.bare = self.columns_of(parts)
            self.other = [t for t in [*asked, *told] if t]

    def add_bare(self, responses: list[str]) -> None:
        """Teaches the refusal model of a judge fitted to lists more answers without code block; they are rare among all pairs."""
        self.bare += [t for r in responses if (t := Answer(r).bare())]
        self.refusals = Refusals(self.bare, self.other)

    @staticmethod
    def teach_labelled(tally: Tally, rows, model: LanguageModel | None = None, min_trigrams: int = 0) -> None:
        """Counts labelled texts, with a model only those whose label it agrees with."""
        texts = Trigrams([prose(t) for t, _ in rows])
        labels = np.array([LANGUAGES.index(norm_language(lang)) for _, lang in rows], np.int64)
        if model:
            score, n = model.score(texts)
            labels = np.where((score.argmax(1) == labels) & (n >= min_trigrams), labels, -1)
        tally.languages(texts, labels)

    @staticmethod
    def columns_of(rows):
        """(prose of the prompts, prose of the answers, answers without a statement) of pairs that were read."""
        return [a for a, _, _ in rows], [t for _, t, _ in rows], [b for _, _, b in rows if b]

    @staticmethod
    def teach_languages(tally: Tally, model: LanguageModel, asked: list[str], told: list[str], min_trigrams: int, every: str | None = None) -> None:
        asked, told = Trigrams(asked), Trigrams(told)
        lang, agree, _, _ = model.agreement(asked, told, min_trigrams)
        labels = np.where(agree, lang, -1)
        tally.languages(asked, labels, every)
        tally.languages(told, labels, every)

    def _fit_ends(self, ends: dict[tuple, Counter]) -> None:
        """Teaches both end models; the second round knows the answers that break off and doesn't take them for whole ones."""
        whole = dict.fromkeys(ends, True)
        for round_ in range(2):
            self.text_end, self.sql_end = EndModel(), EndModel()
            for look, shown in ends.items():
                for (model, state, tokens, stops), times in shown.items() if whole[look] else ():
                    (self.text_end if model == "text" else self.sql_end).add(state, tokens, ends=stops, times=times)
            if round_ == 0:
                for look in ends:
                    if look[0] == "open":
                        whole[look] = False
                    elif look[0] == "end":
                        # a doubtful one is better left out of what is taught than kept
                        _, text, sql = look
                        likely = self.text_end.likelihood(text[0], list(text[1:]), longest=1) + (self.sql_end.likelihood(sql[0], list(sql[1:]), longest=1) if sql else 0.0)
                        whole[look] = likely >= np.log(0.01)

    @staticmethod
    def cuts(pair) -> list[tuple]:
        """What an answer shows where it is cut, for each border of its tokens.

        Between two marks of blocks the same is open in each cut, and once a cut has a statement longer ones have it, too: a few looks tell for all.
        """
        _, response, reasoning = pair
        found = [(m.group(), m.end()) for m in TEXT_TOKEN.finditer(response.rstrip())]
        raw, ends = [t for t, _ in found], [end for _, end in found][:-1]
        tokens = ["w" if t[0].isalnum() or t[0] == "_" else t for t in raw]
        begun, done = Judge.reasoning_at(response, reasoning)
        out, last = [], -1
        add = out.append
        for low, high, open_, there in Judge.stretches(response, [i for i, t in enumerate(raw) if t in MARKS], ends):
            for i in range(low, high):
                at = ends[i]
                if raw[i] != "\n":  # line ends at the end of an answer aren't read
                    last = i
                since = last - 3 if last > 3 else 0
                while at - ends[since] >= 400 and since <= last:  # an answer's end is read from so many characters
                    since += 1
                add(("text", (open_, i >= there, begun <= at < done), tuple(tokens[since : last + 1]), False))
        return out

    @staticmethod
    def reasoning_at(response: str, reasoning: str | None) -> tuple[int, int]:
        """Where a cut leaves the given reasoning begun, and from where on it has the whole."""
        given = (reasoning or "").strip()
        never = len(response) + 1
        begun = response.find(given[:40]) if len(given) > 40 else -1
        if begun < 0:
            return never, never
        done = response.find(given, begun)
        return begun + 40, done + len(given) if done >= 0 else never

    @staticmethod
    def stretches(response: str, marks: list[int], ends: list[int]):
        """(low, high, what is open, from where on there is a statement) for the cuts between two marks of blocks; a cut is after each token but the last."""
        borders = [0, *(i for i in marks if 0 < i < len(ends)), len(ends)]
        for low, high in zip(borders, borders[1:]):
            if low == high:
                continue
            start = Answer(response[: ends[low]])
            has = lambda i: start.states(response[ends[low] : ends[i]])  # noqa: E731, B023
            there, after, until = low if start.statement() is not None else high, low + 1, high - 1
            if there == high and start.open != "think" and until > low:
                if until > low + 4 and has(low + 4):  # most begin at once
                    until = low + 4
                if until < high - 1 or has(until):
                    there = bisect_left(range(after, until), True, key=has) + after
            yield low, high, start.open, there

    @staticmethod
    def shown(pair, a: Answer) -> tuple[tuple, list[tuple]]:
        """How an answer ends, and what it shows if it is whole: its end, and the end and the cuts of its statement."""
        instruction, _, reasoning = pair
        state, tokens = Judge.reading(pair[1], a, reasoning)
        out, text, sql = [("text", state, tuple(tokens[-4:]), True)], (state, *tokens[-1:]), None
        if statement := a.statement():
            vocabulary = Vocabulary(instruction)
            states, tokens, words = read_statement(statement, vocabulary)
            sql = (states[-1], tokens[-1])
            for i, (state, word) in enumerate(zip(states, words)):
                last = tuple(tokens[max(0, i - 3) : i + 1])
                out.append(("sql", state, last, i == len(tokens) - 1))
                if len(word) > 3 and word[0] not in "0123456789":  # a cut inside the word or string
                    out.append(("sql", state, (*last[:-1], "open" if word[0] in "'\"`[" else vocabulary.half(word, tokens[i])), False))
        return ("open",) if a.open else ("end", text, sql), out

    @staticmethod
    def reading(response: str, answer: Answer, reasoning: str | None):
        """(state, tokens) of an answer's end: what is open, whether a statement is there, whether the reasoning was begun and not finished."""
        given = (reasoning or "").strip()
        behind = len(given) > 40 and given[:40] in response and given not in response
        return (answer.open, answer.statement() is not None, behind), last_tokens(response)

    def end_likelihood(self, pair, answer: Answer, longest: int | None = None) -> tuple[float, float]:
        """The log likelihoods that the answer, and that its statement, ends where it does; 0 without a statement."""
        instruction, response, reasoning = pair
        state, tokens = self.reading(response, answer, reasoning)
        text = self.text_end.likelihood(state, tokens, longest)
        if answer.open and (mark := MARK.search(response)):
            # a mark that says where generation stopped isn't the end of what it stopped
            text = min(text, self.text_end.likelihood(state, last_tokens(response[: mark.start()]), longest))
        sql = answer.statement()
        if not sql:
            return text, 0.0
        return text, self.sql_end.likelihood(*statement_end(sql, instruction or ""), longest)

    @staticmethod
    def told(answer: Answer) -> str:
        text = " ".join([*answer.think, answer.rest])
        return prose(FENCE.sub(" ", text) if "```" in text else text)

    def breaks_off(self, text: float, statement: float) -> bool:
        return text + statement < self.least_end

    def judge(self, instructions, responses, questions, reasonings) -> pd.DataFrame:
        """defect (or None), prompt_lang, response_lang, margin, end_likelihood of each pair.

        A pair whose instruction and question are null can't be compared: its response may still be empty, truncated or a refusal.
        """
        n = len(responses)
        defect: list[str | None] = [None] * n
        asked, told, ends, bare = [""] * n, [""] * n, np.zeros(n), {}
        for i, (instruction, response, question, reasoning) in enumerate(zip(instructions, responses, questions, reasonings)):
            if not response or response.isspace():
                defect[i] = "empty"
                continue
            a = Answer(response)
            words = None
            if a.statement() is None:
                words = a.words()
                low = words.lower()
                placeholder = not WORD.search(words) or low.strip(" \t\n.,;:!*_()[]<>\"'") in PLACEHOLDERS or low in PLACEHOLDERS
                if placeholder and not a.open and not any(WORD.search(t) for t in a.think):
                    defect[i] = "empty"
                    continue
            if words is not None and not a.open and not placeholder and copied(words, f"{instruction or ''}\n{question or ''}"):
                defect[i] = "copied_question"
                continue
            likely = self.end_likelihood((instruction or question, response, reasoning), a)
            ends[i] = sum(likely)
            if self.breaks_off(*likely):
                defect[i] = "truncated"
            elif words is None:
                asked[i], told[i] = prompt_prose(instruction or question or ""), self.told(a)
            elif placeholder:
                defect[i] = "empty"
            else:
                bare[i] = words.lower()
        for i, m in zip(bare, self.refusals.margins(list(bare.values()))):
            defect[i] = "refusal" if m > 0 else None
            # an answer in prose that doesn't decline may be in another language
            asked[i], told[i] = (prompt_prose(instructions[i] or questions[i] or ""), prose(bare[i])) if m <= 0 else ("", "")
        todo = [i for i in range(n) if defect[i] is None]
        lang_p, lang_r, margin = [None] * n, [None] * n, np.zeros(n)
        if todo and self.known.sum() > 1:
            (sp, n_p), (sr, n_r) = self.model.score([asked[i] for i in todo]), self.model.score([told[i] for i in todo])
            for j, i in enumerate(todo):
                if n_p[j] < self.min_trigrams or n_r[j] < self.min_trigrams:
                    continue
                p, r = int(sp[j].argmax()), int(sr[j].argmax())
                lang_p[i], lang_r[i] = LANGUAGES[p], LANGUAGES[r]
                margin[i] = sr[j, p] - sr[j, r]
                # short texts vary more; what fits neither the prompt's nor another known language is unknown
                usual = lambda k: sr[j, k] >= self.usual[k][0] - self.usual[k][1] * max(1.0, (120 / n_r[j]) ** 0.5)  # noqa: E731, B023
                if not usual(p) and not usual(r):
                    lang_r[i] = "unknown"
                # posteriors: the mean difference times the number of trigrams is the log odds of the two languages
                if not usual(p) or -margin[i] * n_r[j] > 20:
                    defect[i] = "other_language"
        return pd.DataFrame({"defect": defect, "prompt_lang": lang_p, "response_lang": lang_r, "margin": margin, "end_likelihood": ends})


class Cuts:
    """Counts what the cuts of many answers show (``Judge.cuts``), the answers of a batch at a time, with tokens as integers."""

    #: Of each character: -1 before it is seen, 0 between tokens, 1 in words, else its token; bits of a token in a code of four.
    BITS, OPEN = 15, ("", "think", "fence")

    def __init__(self):
        self.tokens = ["", "w", "\n", *MARKS]
        self.kinds = np.full(0x110000, -1, np.int32)
        self.kinds[ord("\n")] = 2
        self.codes: Counter = Counter()
        self.rare: Counter = Counter()

    def learn(self, chars: np.ndarray) -> None:
        for c in np.unique(chars[self.kinds[chars] < 0]).tolist():
            kind = TEXT_TOKEN.fullmatch(t := chr(c)) and (1 if WORDS.fullmatch(t) else len(self.tokens))
            self.kinds[c] = kind or 0
            if kind and kind > 1:
                self.tokens.append(t)

    def add(self, rows: list, most: int = 1 << 19) -> None:
        """``rows`` are (instruction, response, reasoning)."""
        first, size = 0, 0
        for i, (_, response, _) in enumerate(rows):
            if size and size + len(response) > most:
                self._add(rows[first:i])
                first, size = i, 0
            size += len(response) + 1
        self._add(rows[first:])

    def _add(self, rows: list) -> None:
        responses = [r.rstrip() for _, r, _ in rows]
        joined = "\n".join([*responses, ""])
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[chars]
        if len(kind) and kind.min() < 0:
            self.learn(chars)
            kind = self.kinds[chars]
        if len(self.tokens) > 1 << self.BITS:
            for pair in rows:
                self.rare.update(Judge.cuts(pair))
            return
        offsets = np.cumsum([0, *(len(r) + 1 for r in responses)])
        kind[offsets[1:] - 1] = 0
        found = [(m.start(), m.end(), m.group()) for m in MARK_TOKEN.finditer(joined)]
        for start, end, mark in found:
            kind[start:end] = 0
            kind[start] = self.tokens.index(mark)
        word = kind == 1
        last_char = kind > 1
        last_char[:-1] |= word[:-1] & ~word[1:]
        ends = np.flatnonzero(last_char)
        token = kind[ends].astype(np.uint64)
        at = np.searchsorted(ends, [start for start, _, _ in found])
        ends += 1
        ends[at] = [end for _, end, _ in found]
        bounds = np.searchsorted(ends, offsets, side="right")  # the first token of each answer
        first = np.repeat(bounds[:-1], np.diff(bounds))
        state = np.zeros(len(ends), np.uint64)
        is_cut = np.ones(len(ends), bool)
        is_cut[(bounds[1:] - 1)[np.diff(bounds) > 0]] = False
        marks, places, done = at.tolist(), bounds.tolist(), 0
        for (_, response, reasoning), offset, low, high in zip(rows, offsets.tolist(), places, places[1:]):
            upto = bisect_left(marks, high, done)
            own, done = [i - low for i in marks[done:upto]], upto
            if high - low < 2:
                continue
            own_ends = (ends[low : high - 1] - offset).tolist()
            for a, b, open_, there in Judge.stretches(response, own, own_ends):
                state[low + a : low + b] = self.OPEN.index(open_)
                state[low + there : low + b] |= np.uint64(4)
            begun, whole = Judge.reasoning_at(response, reasoning)
            state[low + bisect_left(own_ends, begun) : low + bisect_left(own_ends, whole)] |= np.uint64(8)
        code = state << np.uint64(4 * self.BITS)
        # line ends at the end of an answer aren't read, and of it only so many characters
        last = np.maximum.accumulate(np.where(token == 2, -1, np.arange(len(ends)))) if len(ends) else ends
        for n in range(4):
            i = last - n
            ok = i >= first
            i = np.maximum(i, 0)
            ok &= ends - ends[i] < 400
            code |= np.where(ok, token[i], np.uint64(0)) << np.uint64(n * self.BITS)
        codes, times = np.unique(code[is_cut], return_counts=True)
        for c, n in zip(codes.tolist(), times.tolist()):
            self.codes[c] += n

    def counted(self) -> Counter:
        out, low = Counter(self.rare), (1 << self.BITS) - 1
        for code, n in self.codes.items():
            state = code >> 4 * self.BITS
            four = [self.tokens[t] for k in (3, 2, 1, 0) if (t := code >> k * self.BITS & low)]
            out["text", (self.OPEN[state & 3], state & 4 > 0, state & 8 > 0), tuple(four), False] += n
        return out


def read_pairs(rows: list, ends: dict[tuple, Counter] | None = None, cuts: Cuts | None = None):
    """(prompt's prose, answer's prose, answer without statement or None) of each pair, and by how answers end what they and their cuts show.

    With ``cuts`` the cuts are counted there only.
    """
    ends, parts = {} if ends is None else ends, []
    counted = cuts or Cuts()
    counted.add(rows)
    if cuts is None:
        ends.setdefault(("cut",), Counter()).update(counted.counted())
    for pair in rows:
        a = Answer(pair[1])
        look, shown = Judge.shown(pair, a)
        seen = ends.get(look)
        if seen is None:
            seen = ends[look] = Counter()
        for x in shown:
            seen[x] += 1
        parts.append((prompt_prose(pair[0]), Judge.told(a), a.bare()))
    return parts, ends


def read_table(pairs: DataFrame) -> tuple[DataFrame, dict[tuple, Counter]]:
    """``read_pairs`` of a table: texts are taken apart once, what the passes of the fit need of them is kept in the checkpoint folder."""

    names = ["asked", "told", "bare", "end", "n"]

    def batch(*columns):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n == "n" else pa.string()) for n, c in zip(names, columns)], names=names)

    def part(batches):
        ends, cuts = {}, Cuts()
        for rows in some_rows(batches):
            yield batch(*zip(*read_pairs(rows, ends, cuts)[0]), [None] * len(rows), [0] * len(rows))
        ends["cut",] = cuts.counted()
        for look, shown in ends.items():
            nothing = [None] * len(shown)
            yield batch(nothing, nothing, nothing, [json.dumps([look, *x]) for x in shown], shown.values())

    read = cut(pairs.mapInArrow(part, "asked string, told string, bare string, end string, n long"))
    tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
    ends: dict[tuple, Counter] = {}
    sums = read.where("end is not null").groupBy("end").agg(F.sum("n").alias("n")).toArrow()
    for text, n in zip(sums.column("end").to_pylist(), sums.column("n").to_pylist()):
        look, *x = tuples(json.loads(text))
        ends.setdefault(look, Counter())[tuple(x)] = n
    return read.where("end is null").select("asked", "told", "bare"), ends


def fit(examples: DataFrame, documents: DataFrame) -> Judge:
    """A judge fitted to the whole text of every labelled document and to every pair that has an instruction and a response."""
    named = F.col("text").isNotNull() & F.lower(F.trim(F.col("lang"))).substr(1, 2).isin(*LANGUAGES)
    usable = F.col("instruction").isNotNull() & F.col("response").isNotNull()
    return Judge(documents.where(named).select("text", "lang"), examples.where(usable).select("instruction", "response", "reasoning"))


def flag_defects(examples: DataFrame, documents: DataFrame) -> DataFrame:
    """``example_id, defect, prompt_lang, response_lang, margin, end_likelihood``: one row per defective example.

    Each example counts once, as it was delivered last. A null or blank response is ``empty``. Rows without
    example_id have no name and no row; an empty table gives no rows.
    """
    judge = examples.sparkSession.sparkContext.broadcast(fit(examples, documents))

    def run(frames):
        for pdf in frames:
            out = judge.value.judge(pdf["instruction"], pdf["response"], pdf["question"], pdf["reasoning"])
            out.insert(0, "example_id", pdf["example_id"].to_numpy())
            out.insert(1, "at", pdf["ingested_at"].to_numpy())
            yield out

    src = examples.where(F.col("example_id").isNotNull()).select("example_id", F.col("ingested_at"), "instruction", "response", "question", "reasoning")
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    judged = src.mapInPandas(run, f"example_id {kinds['example_id']}, at {kinds['ingested_at']}, defect string, prompt_lang string, response_lang string, margin double, end_likelihood double")
    last = judged.groupBy("example_id").agg(F.max(F.struct("at", "defect", "prompt_lang", "response_lang", "margin", "end_likelihood")).alias("m"))
    return last.where("m.defect is not null").select("example_id", "m.defect", "m.prompt_lang", "m.response_lang", "m.margin", "m.end_likelihood")
