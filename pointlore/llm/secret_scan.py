"""Secrets: patterns propose spans, a guess-cost dynamic programme confirms values in credential context.

Three base kinds come from patterns alone. Values that stand behind a credential word and a separator
(``:``, ``=``, " is ", " was ", or the blank after "bearer") are cut, at minimum cost, into dictionary
words, dates, repeats, keyboard walks and brute-force stretches; a value whose cheapest cut needs at
least 10**``min_log10`` guesses is a span of the kind ``guess``. Values are tried from the shortest
length that can reach it (8 characters for 10), whatever their length.

The dictionary holds the commonest words of the corpus itself, counted over the distinct texts that
hold them outside credential context; a word's rank is its cost. ``max_words`` (20,000) bounds it, as it goes to every executor. Keyboard walks and
the number of repeats have no bound; a repeated unit has at most ``UNIT`` (64) characters.

Patterns run in the JVM; only the proposed values go to Python, in Arrow batches.

A null text counts as empty; empty texts and tables give no span; repeated rows are scanned each for
itself; extra columns are ignored.
"""

import math
import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spans_of, stage, table

WORDS_BEFORE = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"(?:{WORDS_BEFORE})[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
ASSIGN_VALUE = rf"^(?:{WORDS_BEFORE})[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Wider than the base: a credential word, a separator, then one value.
CONTEXT_WORDS = r"pass(?:word|wd|phrase|code)?|pwd|credentials?|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|login"
SEPARATOR = r"[\"']?(?:\x20(?:key|code|value)){0,2}(?:\x20*+[:=]|\x20++(?:is|was)(?:\x20*+[:=]|(?=\x20)))"


def guess_pattern(least: int) -> str:
    """Values of at least that many characters behind a credential word."""
    return rf"(?i)(?<![A-Za-z])(?:(?:{CONTEXT_WORDS}){SEPARATOR}|bearer(?=\x20))\x20*+[\"']?([A-Za-z0-9+/_.=!@#$%^&*~-]{{{least},}}+)"


GUESS = guess_pattern(8)
#: Whatever stands behind a credential word: no word of a text, but perhaps somebody's secret.
PROPOSED = f"{ASSIGN}|(?:{guess_pattern(1)})|{ACCESS}|{HEX}"

KINDS = ("assign", "access", "hex", "guess")
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
KEY_AT = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
NEXT_KEYS = {a + b for a, p in KEY_AT.items() for b, q in KEY_AT.items() if abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)?\d\d)", re.ASCII)
LEET = str.maketrans("@4301!5$7", "aaeolisst")
UNIT = 64
LETTER = math.log10(26)
BRUTE = 1.0 + math.log10(2.6)  # a character that no part covers


def common_words(docs: DataFrame, text_col: str = "text", max_words: int = 20_000, min_texts: int = 3) -> list[str]:
    """The commonest words of 3 to 24 letters (A-Z, case ignored) of all documents, commonest first.

    A word counts once for each distinct text that holds it outside of what a pattern proposes as a secret, and is left out where fewer
    than ``min_texts`` do. So a secret is no word, however often it has leaked, and copies of a text count for nothing.
    """
    text = F.col(text_col).cast("string")
    found = F.filter(F.array_distinct(F.split(F.lower(F.regexp_replace(text, PROPOSED, " ")), "[^a-z]++")), lambda w: F.length(w).between(3, 24))
    # One row for each distinct text, with its words as one string.
    texts = docs.select(F.xxhash64(text).alias("h"), F.array_join(found, " ").alias("words")).dropDuplicates(["h"])
    words = texts.select(F.explode(F.split("words", " ")).alias("w")).filter("w <> ''")
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_texts)
    counted = stage(counted, "secret-words")
    # A level of counts that enough words reach, from a sixteenth of an octave a row; what reaches it is put in order in a few tasks,
    # so that the driver is sent a few times ``max_words`` rows whatever the corpus.
    levels = counted.groupBy(F.floor(F.log2("n") * 16).alias("level")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n"))
    least, so_far = 1, 0
    for r in sorted(levels.collect(), key=lambda r: -r["level"]):  # a thousand rows at most
        least, so_far = r["n"], so_far + r["words"]
        if so_far >= max_words:
            break
    top = counted.filter(F.col("n") >= least).repartition(4).orderBy(F.desc("n"), "w").limit(max_words)
    return [r["w"] for r in top.collect()]


class Guesser:
    """Guess costs with a dictionary, commonest word first. The automaton finds all its words in one pass."""

    def __init__(self, words: list[str]):
        self.rank = {w: i + 1 for i, w in enumerate(words)}
        self.automaton = ahocorasick.Automaton()
        for w, i in self.rank.items():
            self.automaton.add_word(w, (len(w), math.log10(i + 1)))
        if words:
            self.automaton.make_automaton()

    def parts(self, value: str) -> dict[int, list[tuple[int, float]]]:
        """Words and dates of a value: by end, (start, cost)."""
        low, found = value.lower(), defaultdict(list)
        plain = low.translate(LEET)
        for last, (size, cost) in self.automaton.iter(plain) if self.rank else ():
            a, b = last + 1 - size, last + 1
            found[b].append((a, cost + (low[a:b] != plain[a:b]) * 0.5 + (low[a:b] != value[a:b]) * 0.3))
        digit = [c in "0123456789" for c in low]
        for a in range(len(low) - 3):
            if digit[a] and (digit[a + 1] or digit[a + 2]):
                for b in range(a + 4, min(a + 10, len(low)) + 1):
                    if digit[b - 1] and DATE.fullmatch(low, a, b):
                        found[b].append((a, math.log10(365 * 120) if b - a > 4 else math.log10(120)))
        return found

    def cost(self, value: str) -> float:
        """log10 of the guesses that the cheapest segmentation of ``value`` needs; its parts multiply.

        The time is linear in the length, as ``Leads`` keep the few starts of walks and repeats that can still win.
        """
        n, low = len(value), value.lower()
        found, runs = self.parts(value), repeats(low)
        best, walk, since, next_run, live_runs = [0.0] * (n + 1), Leads(), 0, 0, []
        for end in range(1, n + 1):
            c = value[end - 1]
            cost = best[end - 1] + (1.0 if "0" <= c <= "9" else BRUTE)  # brute force: ten guesses a digit
            for start, price in found.get(end, ()):
                cost = min(cost, best[start] + price)
            if end > 1 and low[end - 2 : end] not in NEXT_KEYS:
                walk, since = Leads(), end - 1
            if end - since >= 3:
                walk.add(end - 3, best)
                cost = min(cost, walk.least(end, best) + math.log10(len(KEY_AT) * 4))
            while next_run < len(runs) and runs[next_run][0] < end:
                live_runs.append((*runs[next_run], defaultdict(Leads)))
                next_run += 1
            if live_runs:
                live_runs = [r for r in live_runs if r[1] >= end]
                for a, _, unit, leads in live_runs:
                    start = end - unit * (3 if unit == 1 else 2)
                    if start >= a:
                        lead = leads[end % unit]
                        lead.add(start, best)
                        cost = min(cost, lead.least(end, best) + unit * LETTER - math.log10(unit))
            best[end] = cost
        return best[n]


class Leads:
    """Starts s that may give the least best[s] + log10(end - s) at this or a later end.

    The lead of a later start only shrinks as the end moves on: what is behind an earlier one stays
    behind, and an earlier one without a lead is done. So few stay.
    """

    def __init__(self):
        self.starts: list[int] = []

    def add(self, start: int, best: list[float]) -> None:
        while self.starts and best[self.starts[-1]] >= best[start]:
            self.starts.pop()
        self.starts.append(start)

    def least(self, end: int, best: list[float]) -> float:
        kept, low = [], math.inf
        for s in self.starts:
            now = best[s] + math.log10(end - s)
            if now < low:
                kept.append(s)
                low = now
        self.starts = kept
        return low


def repeats(low: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of every longest stretch that repeats a unit of at most UNIT characters: 3 times if of one, else twice."""
    x, out = np.frombuffer(low.encode("utf-32-le"), np.uint32), []
    for unit in range(1, min(UNIT, len(x) // 2) + 1):
        same = np.diff(np.concatenate(([False], x[unit:] == x[:-unit], [False])).view(np.int8))
        first, last = np.flatnonzero(same == 1), np.flatnonzero(same == -1)
        for a, b in zip(first, last + unit):
            if b - a >= max(3, 2 * unit):
                # A stretch whose unit itself repeats is cheaper by the shorter unit.
                if not any(unit % d == 0 and (x[a + d : b] == x[a : b - d]).all() for d in range(1, unit // 2 + 1)):
                    out.append((int(a), int(b), unit))
    return sorted(out)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = 10.0, words: list[str] | None = None) -> DataFrame:
    """One row per document: its id and an array of spans (start, rank, end, kind, value, log10_guesses), by start and kind.

    ``words``: a dictionary, commonest first, instead of the commonest words of ``docs``. A row's spans depend on its own text and on the
    dictionary, that is on which words stand outside credential context in how many distinct texts; copies of the row change nothing.
    """
    pattern = guess_pattern(max(1, math.ceil(min_log10 / BRUTE)))
    shared = docs.sparkSession.sparkContext.broadcast(common_words(docs, text_col) if words is None else words)
    made: list[Guesser] = []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(
        F.col(id_col).alias(id_col),
        spans_of(text, ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN_VALUE, 1)) >= 6).alias("assign"),
        F.when(F.instr(text, "AKIA") > 0, spans_of(text, ACCESS)).alias("access"),
        spans_of(text, HEX).alias("hex"),
        spans_of(text, pattern).alias("guess"),
    )
    value = lambda s, pattern: F.regexp_extract(s["v"], pattern, 1)
    asked = found.select(
        id_col, "access", "hex",
        F.transform("assign", lambda s: F.struct(s["s"], s["e"], value(s, ASSIGN_VALUE).alias("v"))).alias("assign"),
        F.transform("guess", lambda s: F.struct((s["e"] - F.length(value(s, f"{pattern}$"))).alias("s"), s["e"], value(s, f"{pattern}$").alias("v"))).alias("guess"),
    )

    @F.pandas_udf("array<double>")
    def costs(values: pd.Series) -> pd.Series:
        if not made:
            made.append(Guesser(shared.value))
        return values.map(lambda vs: [made[0].cost(v) for v in vs] if vs is not None and len(vs) else [])

    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string,log10_guesses:double>>)")
    span = lambda s, kind, cost: F.struct(s["s"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["e"].alias("end"), F.lit(kind).alias("kind"), s["v"].alias("value"), cost.alias("log10_guesses"))
    costed = asked.withColumn("assign_cost", costs(F.transform("assign", lambda s: s["v"]))).withColumn("guess_cost", costs(F.transform("guess", lambda s: s["v"])))
    nothing = F.lit(None).cast("double")
    every = F.concat(
        F.zip_with("assign", "assign_cost", lambda s, c: span(s, "assign", c)),
        F.coalesce(F.transform("access", lambda s: span(s, "access", nothing)), none),
        F.transform("hex", lambda s: span(s, "hex", nothing)),
        F.filter(F.zip_with("guess", "guess_cost", lambda s, c: span(s, "guess", c)), lambda s: s["log10_guesses"] >= min_log10),
    )
    return costed.select(id_col, F.array_sort(every).alias("spans"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract columns of ``find_secrets`` over all documents, n_guess, and the largest cost found."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    mark = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id",
        *[n(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, mark), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", mark), ",").alias("spans"),
        F.array_max(F.transform("spans", lambda s: F.round(s["log10_guesses"], 6))).alias("max_log10_guesses"),
    )
