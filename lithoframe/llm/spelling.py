"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by PartEnum signatures.

1. Words of the same letters are one class. A class is a binary vector with a dimension for each letter and each of its
   occurrences. One replaced letter moves two dimensions, one inserted letter moves one.
2. The dimensions are dealt into parts. Vectors that differ in at most k dimensions agree on all but k parts, so a class
   emits a signature for each choice of k parts left out, and near classes share one. k is 2 between classes of the same
   length and 1 between neighbouring lengths.
3. Classes that share a signature are equi-joined and verified on their letters. A pair is taken from the first choice
   of parts that holds its differences, so it comes once.
4. The words of the classes of verified pairs are joined on what is left of them without the letter in question at its
   place, so a class of many words costs a row per word and letter, never all pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut

#: A word: a maximal run of Latin letters.
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    parts: int = 7          # of the dimensions
    least: int = 7          # letters of a word
    least_count: int = 2    # occurrences of a word
    ratio: int = 10         # how many times as frequent a form is


def runs(docs: DataFrame, text: str, least: int) -> DataFrame:
    """docs with _run exploded: runs of at least ``least`` letters, A to Z in lower case."""
    long = RUN[:-1] + f"{{{least},}}"
    return docs.withColumn("_run", F.explode(F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(long), F.lit(0))))


def without(word: Column, at: Column) -> Column:
    """The word without its letter ``at`` (from 1)."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))


def dimension(letter: str, k: int) -> int:
    """64 random bits of the k-th occurrence of a letter."""
    x = (ord(letter) * 0x1000193 + k * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def part_sums(letters: list[str], parts: int) -> np.ndarray:
    """For each class the sum, modulo 2^64, of its dimensions in each part."""
    table: dict = {}
    sums = np.zeros((len(letters), parts), np.uint64)
    rows, values = [], []
    for i, word in enumerate(letters):
        last, k = "", 0
        for c in word:              # letters are sorted
            k = k + 1 if c == last else 0
            last = c
            d = table.get((c, k))
            if d is None:
                d = table[c, k] = dimension(c, k)
            rows.append(i * parts + d % parts)
            values.append(d)
    np.add.at(sums.ravel(), np.array(rows, np.int64), np.array(values, np.uint64))
    return sums


def choices(s: Settings) -> list[tuple[int, ...]]:
    """Parts left out: two at a time for classes of the same length, one at a time for neighbouring lengths."""
    return [*combinations(range(s.parts), 2), *[(p,) for p in range(s.parts)]]


def signatures(classes: DataFrame, s: Settings) -> DataFrame:
    """(signature, choice, longer, letters): of each class one per choice, as the shorter and as the longer one where lengths differ."""
    rows = [(j, c, longer) for j, c in enumerate(choices(s)) for longer in ((False,) if len(c) == 2 else (False, True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            sums = part_sums(words, s.parts)
            whole = sums.sum(axis=1, dtype=np.uint64)
            length = np.array([len(w) for w in words], np.uint64)
            made = np.empty((len(words), len(rows)), np.uint64)
            for k, (j, left_out, longer) in enumerate(rows):
                kept = whole - sums[:, list(left_out)].sum(axis=1, dtype=np.uint64)
                key = kept + (length - np.uint64(longer)) * np.uint64(dimension(" ", 0)) + np.uint64(dimension("!", j))
                made[:, k] = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield pa.RecordBatch.from_arrays(
                [pa.array(made.ravel().view(np.int64)), pa.array(np.tile(np.array([r[0] for r in rows], np.int32), len(words))),
                 pa.array(np.tile(np.array([r[2] for r in rows]), len(words))),
                 batch.column(0).take(pa.array(np.repeat(np.arange(len(words)), len(rows))))],
                ["signature", "choice", "longer", "letters"])

    return classes.select("letters").mapInArrow(run, "signature long, choice int, longer boolean, letters string")


def verified(pairs: DataFrame, s: Settings) -> DataFrame:
    """Of pairs (a, b, choice) those whose letters differ by one, once each: a, b, gone (only in a) and come (only in b)."""
    made = choices(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}

        def part(c: str, k: int) -> int:
            if (c, k) not in parts:
                parts[c, k] = dimension(c, k) % s.parts
            return parts[c, k]

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for a, b, choice in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                had, has = Counter(a), Counter(b)
                gone, come, left_out = had - has, has - had, made[choice]
                if come.total() != 1 or gone.total() != len(left_out) - 1:
                    continue
                moved = {part(c, max(has[c], had[c]) - 1) for c in (*come, *gone)}
                if left_out == next(c for c in made if len(c) == len(left_out) and moved <= set(c)):
                    for column, x in zip(out, (a, b, "".join(gone), "".join(come))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["a", "b", "gone", "come"])

    return pairs.mapInArrow(run, "a string, b string, gone string, come string")


def near_classes(classes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b, gone, come) of classes (letters, sorted) one letter apart; a is the shorter, or the smaller of the same length."""
    s = settings
    made = signatures(classes, s)   # both sides are the same rows, so they are made and shuffled once
    one, two = made.alias("one").hint("merge"), made.alias("two")
    same = F.col("one.choice") < s.parts * (s.parts - 1) // 2
    pairs = one.join(two, (F.col("one.signature") == F.col("two.signature")) & (F.col("one.choice") == F.col("two.choice")) & F.when(
        same, F.col("one.letters") < F.col("two.letters")).otherwise(~F.col("one.longer") & F.col("two.longer")))
    a, b = F.col("one.letters"), F.col("two.letters")
    close = pairs.filter(F.levenshtein(a, b, 2) >= 0)   # sorted letters that differ by one are at most two edits apart
    return verified(close.select(a.alias("a"), b.alias("b"), F.col("one.choice").alias("choice")), s)


def near_words(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(x, y) for every two words (column word) that differ by one inserted, deleted or replaced letter, both ways round."""
    lettered = cut(words.select("word", F.array_join(F.array_sort(F.split("word", "")), "").alias("letters")))
    pairs = near_classes(lettered.select("letters").distinct(), settings)
    # all classes that are alike but for one letter share what is left, so a class needs each of its letters in question once
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("letters"), F.col("gone").alias("letter"), F.lit(False).alias("more")),
        F.struct(F.col("b").alias("letters"), F.col("come").alias("letter"), (F.col("gone") == "").alias("more")))).alias("_s")).select("_s.*")
    sides = cut(sides.filter(F.col("letter") != "").distinct())
    spread = lettered.join(sides, "letters")
    is_letter = F.transform(F.split("word", ""), lambda c: c == F.col("letter"))
    # of equal letters side by side any may be the inserted one: the first stands for all
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.element_at(F.col("_is"), i) & (
        ~F.col("more") | (i == 1) | ~F.element_at(F.col("_is"), F.greatest(i - 1, F.lit(1)))))
    spread = spread.withColumn("_is", is_letter).select("word", "more", F.explode(places).alias("at"))
    rest = cut(spread.select("word", F.when(~F.col("more"), F.col("at")).alias("at"), without(F.col("word"), F.col("at")).alias("rest")))
    replaced, other = rest.filter(F.col("at").isNotNull()), rest.select(F.col("word").alias("y"), F.col("at").alias("_at"), F.col("rest").alias("_rest"))
    swapped = replaced.join(other, (F.col("at") == F.col("_at")) & (F.col("rest") == F.col("_rest")) & (F.col("word") != F.col("y")))
    inserted = cut(rest.filter(F.col("at").isNull()).join(words.select(F.col("word").alias("y")), F.col("rest") == F.col("y")).select("word", "y"))
    return swapped.select(F.col("word").alias("x"), "y").unionByName(inserted.withColumnRenamed("word", "x")).unionByName(
        inserted.select(F.col("y").alias("x"), F.col("word").alias("y")))


def counted(runs_: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n) of the runs in column _run that are long and frequent enough."""
    counts = runs_.groupBy(F.col("_run").alias("word")).agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= settings.least_count) & (F.length("word") >= settings.least))


def group(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """word, form, root, n, n_near and form_n of words (word, n; each word once).

    form: the near word of largest n, ties to the smallest, if its n is at least ``ratio`` times the word's. root: where
    following forms ends. Counts grow by the ratio with every step, so doubling the way a few times reaches every end. No words give
    no rows; words without a near one are their own root.
    """
    words = cut(words.select("word", "n"))
    pairs = near_words(words, settings)
    sized = pairs.join(words.select(F.col("word").alias("y"), F.col("n").alias("_n")), "y")
    best = sized.groupBy("x").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("y").alias("word"))).alias("_best"))
    own = cut(words.join(best.withColumnRenamed("x", "word"), "word", "left").withColumn(
        "_is", F.coalesce(-F.col("_best.n") >= settings.ratio * F.col("n"), F.lit(False))).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_is"), F.col("_best.word")).alias("form"),
        F.when(F.col("_is"), -F.col("_best.n")).alias("form_n")))
    ways = own.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most, steps = words.agg(F.max("n")).first()[0] or 1, 1
    while settings.ratio ** steps <= most:
        ahead = ways.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        ways = cut(ways.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")))
        steps *= 2
    return own.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The words of all texts, grouped. Null and empty texts have none, repeated rows count as often as they come; other columns of
    docs don't matter."""
    return group(counted(runs(docs.select(F.col(text).alias("_text")), "_text", settings.least), settings), settings)
