"""Benchmark decontamination with one Aho-Corasick automaton over normalised word windows.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and non-ASCII characters. Every window of ten
words of a benchmark item, or the whole of a shorter item, is a pattern; the automaton reads each
document once, word by word, and word places map back to code points of the original text. A benchmark
too large for one automaton of bounded size is matched by several, in a pass each.

Null texts have no words; items without words have no windows; windows of an item with a null id count
as hits, but name no item; empty tables give no hits; repeated rows and repeated items count each for
itself (an item id once). Extra columns are ignored.
"""

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

#: A-Z to a-z, other ASCII but letters and digits to space.
NORMAL = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SPAN = "struct<a:int,b:int,start:int,end:int>"
RESULT = f"n_words long, n_hit long, items array<string>, spans array<{SPAN}>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def windows_of(text: str | None, size: int) -> list[bytes]:
    """The item's windows: ``size`` words each, blanks between; the whole of a shorter item."""
    words = words_of(text)
    return [b" ".join(words[i : i + size]) for i in range(max(0, len(words) - size) + 1 if words else 0)]


class Matcher:
    """The automaton of some windows, each with the items that hold it. Windows are sequences of word numbers; 0 is any other word."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in windows:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.split())
            self.automaton.add_word(ids, (len(ids), tuple(items)))
        self.empty = not windows
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, int, list[str], list[tuple[int, int, int, int]]]:
        """Words, hit words, items found, hit stretches in words and in code points."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), 0, [], []
        number = self.number.get
        runs, items = [], set()
        for end, (size, owners) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            items.update(owners)
            start = end - size + 1
            while runs and runs[-1][0] >= start:  # a longer match can end later and start before
                runs.pop()
            if runs and runs[-1][1] >= start:
                runs[-1][1] = end + 1
            else:
                runs.append([start, end + 1])
        if not runs:
            return len(words), 0, [], []
        at = [m.span() for m in WORD.finditer(text)]
        return len(words), sum(b - a for a, b in runs), sorted(items), [(a, b, at[a][0], at[b - 1][1]) for a, b in runs]


def joined(found: list[tuple]) -> tuple[int, int, list[str], list[tuple[int, int, int, int]]]:
    """What several automata found in one text."""
    runs = []
    for a, b, start, end in sorted(tuple(s) for f in found for s in f[3]):
        if runs and runs[-1][1] >= a:
            runs[-1][1], runs[-1][3] = max(runs[-1][1], b), max(runs[-1][3], end)
        else:
            runs.append([a, b, start, end])
    return found[0][0], sum(r[1] - r[0] for r in runs), sorted({i for f in found for i in f[2]}), [tuple(r) for r in runs]


def benchmark_matchers(items: DataFrame, window: int = 10, part_windows: int = 200_000, part_bytes: int = 32 << 20, columns: tuple[str, str] = ("item_id", "text")):
    """Functions from a text column to a struct of RESULT; together they cover the benchmark.

    There is one, a single automaton, as long as the benchmark's windows number ``part_windows`` and take
    ``part_bytes`` at most, which bounds what a worker builds and what is broadcast. Beyond that the
    windows are dealt by their hash to as many automata as needed; each is used in a pass of its own.
    """
    item, text = (F.col(c) for c in columns)
    plain = items.select(item.cast("string").alias("item"), text.cast("string").alias("text"))

    def cut(batches):
        for pdf in batches:
            rows = [(w, None if pd.isna(i) else i) for i, t in zip(pdf["item"], pdf["text"]) for w in windows_of(t, window)]
            yield pd.DataFrame(rows, columns=["window", "item"])

    # Equal windows of many items are one row; a null id is no item, but its windows count as hits.
    every = plain.mapInPandas(cut, "window binary, item string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    every = stage(every, "benchmark-windows")
    size = every.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("window") + F.aggregate("items", F.lit(0).cast("long"), lambda n, i: n + F.octet_length(i) + 8)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // part_windows), -(-(size["bytes"] or 0) // part_bytes))

    def matcher(part: int):
        mine = every.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        shared = every.sparkSession.sparkContext.broadcast([(bytes(r["window"]), list(r["items"])) for r in mine.collect()])
        made: list[Matcher] = []

        @F.pandas_udf(RESULT)
        def match(texts: pd.Series) -> pd.DataFrame:
            if not made:
                made.append(Matcher(shared.value))
            return pd.DataFrame([made[0].scan(t) for t in texts], columns=["n_words", "n_hit", "items", "spans"])

        return match

    return [lambda text, part=part: matcher(part)(text) for part in range(parts)]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (ids as strings, sorted), spans (words a to b, code points start to end) of the hit stretches."""
    matchers = benchmark_matchers(items, **how)
    read = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    if len(matchers) == 1:
        found = read.select(id_col, matchers[0](F.col("text")).alias("_m"))
        return found.select(id_col, "_m.n_words", "_m.n_hit", "_m.items", "_m.spans")
    @F.pandas_udf(RESULT)
    def join_found(found: pd.Series) -> pd.DataFrame:
        plain = [[(f["n_words"], f["n_hit"], f["items"], [(s["a"], s["b"], s["start"], s["end"]) for s in f["spans"]]) for f in fs] for fs in found]
        return pd.DataFrame([joined(fs) for fs in plain], columns=["n_words", "n_hit", "items", "spans"])

    # One pass for each automaton over rows with a key; only hits are kept of each and meet at their row.
    rows = stage(read.withColumn("_row", F.monotonically_increasing_id()), "contamination-rows")
    first = stage(rows.select("_row", id_col, matchers[0](F.col("text")).alias("_m")), "contamination-0")
    hits = [first.filter("_m.n_hit > 0").select("_row", "_m")]
    for no, match in enumerate(matchers[1:], 1):
        hits.append(stage(rows.select("_row", match(F.col("text")).alias("_m")).filter("_m.n_hit > 0"), f"contamination-{no}"))
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    merged = every.groupBy("_row").agg(F.collect_list("_m").alias("_f")).select("_row", join_found("_f").alias("_j"))  # one entry an automaton at most
    out = first.select("_row", id_col, F.col("_m.n_words").alias("n_words")).join(merged, "_row", "left")
    none = F.expr(f"named_struct('n_words', 0L, 'n_hit', 0L, 'items', cast(array() as array<string>), 'spans', cast(array() as array<{SPAN}>))")
    return out.withColumn("_j", F.coalesce("_j", none)).select(id_col, "n_words", "_j.n_hit", "_j.items", "_j.spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """Rows of ``docs`` without a hit word, one pass for each automaton."""
    for match in benchmark_matchers(items, **how):
        docs = docs.filter(match(F.col(text_col).cast("string"))["n_hit"] == 0)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win), grams AS (SELECT DISTINCT n, g FROM win)
, docgrams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT doc_id, n, i, g FROM docgrams SEMI JOIN grams USING (n, g))
, words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id)
, items AS (
  SELECT doc_id, count(item) AS n_items, sha256(coalesce(string_agg(item, ',' ORDER BY item), '')) AS items_sha256, list(item ORDER BY item) AS l
  FROM (SELECT DISTINCT doc_id, item FROM hits JOIN win USING (n, g)) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
