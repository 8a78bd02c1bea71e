"""Name operators at table scale: dictionary transliteration (TXT-16), exact
edit-distance matching (OPT-02) and the distinct-character ratio (OPT-05)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = "一-鿿"


#: Entries of a dictionary, and code points between its least and greatest first character, that an expression may hold.
MOST_READINGS = 65_536


class Readings:
    """A dictionary (characters -> reading) as one column expression: a longest-match automaton over code points.

    Entries stand in an array by the code point of their first character, so a lookup is one index; entries of several
    characters (a character's reading inside a phrase) stand in a small map at their first one.  The dictionary is bounded and its size
    checked; text is never a join key, and nothing is shuffled."""

    def __init__(self, reading: DataFrame, char_class: str = HAN, most: int = MOST_READINGS):
        inside = re.compile(f"[{char_class}]+").fullmatch
        rows = [(r["ch"], r["reading"]) for r in reading.select("ch", "reading").limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"a dictionary of more than {most} entries")
        rows = sorted((c, r) for c, r in rows if c and r is not None and inside(c))
        codes = [ord(c[0]) for c, _ in rows]
        self.char_class, self.base = char_class, min(codes, default=0)
        self.span = max(codes, default=-1) - self.base + 1
        if self.span > most:
            raise ValueError(f"first characters over a range of {self.span} code points")
        self.longest = max((len(c) for c, _ in rows), default=0)
        table = [{"r": None, "p": {}} for _ in range(self.span)]
        for c, r in rows:
            at = table[ord(c[0]) - self.base]
            if len(c) == 1:
                at["r"] = r
            else:
                at["p"][c] = r
        self.table = F.from_json(F.lit(json.dumps(table)), "array<struct<r:string,p:map<string,string>>>")

    def _entry(self, ch: Column) -> Column:
        at = F.ascii(ch) - self.base + 1
        return F.when((at >= 1) & (at <= self.span), F.get(self.table, at - 1))

    def _run(self, run: Column) -> Column:
        """Items of a run of the class's characters: the longest entry at each place, else the character itself."""
        def step(acc: Column, at: Column) -> Column:
            ch = F.substring(run, at, F.lit(1))
            e = self._entry(ch)
            found = [F.when(at + n - 1 <= F.length(run), F.struct(
                F.lit(n).alias("n"), F.try_element_at(e["p"], F.substring(run, at, F.lit(n))).alias("r")))
                for n in range(self.longest, 1, -1)]
            one = F.struct(F.lit(1).alias("n"), F.coalesce(e["r"], ch).alias("r"))
            best = F.coalesce(*[F.when(f["r"].isNotNull(), f) for f in found], one)
            return F.when(at < acc["next"], acc).otherwise(F.struct(
                (at + best["n"]).alias("next"), F.concat(acc["items"], F.array(best["r"])).alias("items")))

        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("items"))
        return F.aggregate(F.sequence(F.lit(1), F.length(run)), start, step, lambda acc: acc["items"])

    def items(self, col) -> Column:
        """Readings, and runs of other characters as one item each."""
        c = F.col(col) if isinstance(col, str) else col
        k = self.char_class
        if not self.span:
            return F.regexp_extract_all(c, F.lit(f"[{k}]|[^{k}]+"), 0)
        if self.longest == 1:
            return F.transform(F.regexp_extract_all(c, F.lit(f"[{k}]|[^{k}]+"), 0),
                               lambda x: F.coalesce(F.when(F.length(x) == 1, self._entry(x)["r"]), x))
        runs = F.regexp_extract_all(c, F.lit(f"[{k}]+|[^{k}]+"), 0)
        return F.flatten(F.transform(runs, lambda x: F.when(x.rlike(f"^[{k}]"), self._run(x)).otherwise(F.array(x))))

    def text(self, col) -> Column:
        """The items joined by one space; null for a null text."""
        return F.array_join(self.items(col), " ")


def transliterate(df: DataFrame, col: str, reading: DataFrame, char_class: str = HAN,
                  out: str = "translit", most: int = MOST_READINGS) -> DataFrame:
    """TXT-16: every character of ``char_class`` becomes its reading from the
    (ch, reading) table, the longest entry first; a run of other characters stays one item; items are
    joined by one space."""
    return df.withColumn(out, Readings(reading, char_class, most).text(col))


def char_ratio(strings: Column) -> Column:
    """OPT-05: distinct characters / total characters of a list of strings; 0 if empty."""
    s = F.array_join(strings, "")
    n = F.length(s)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(F.split(s, ""))) / n)


def edit_distance_pairs(left: DataFrame, right: DataFrame, k: int = 1, a: str = "a",
                        b: str = "b") -> DataFrame:
    """OPT-02: all (a, b) with levenshtein(a, b) <= k, exactly, without
    comparing every pair.  Two strings within k edits share a string that each
    becomes by losing at most k characters, so the strings left by every such
    loss are the join keys; candidates are then verified.  Keys are long and
    mostly a string's own, however many strings share a beginning."""
    def losses(df, name):
        keys = F.array(F.col(name))
        for _ in range(k):
            shorter = F.flatten(F.transform(keys, lambda x: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))),
                lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))))
            keys = F.array_distinct(F.concat(keys, shorter))
        return df.select(name, F.explode(keys).alias("key"))

    ka = losses(left.select(F.col(a).alias("a")).distinct(), "a")
    kb = losses(right.select(F.col(b).alias("b")).distinct(), "b")
    cand = ka.join(kb, "key").select("a", "b").distinct()
    return cand.withColumn("dist", F.levenshtein("a", "b")).filter(F.col("dist") <= k)
