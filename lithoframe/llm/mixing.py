"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. Its documents get an expected number of copies by their inclusion merit; the whole
copies in it are certain, and the rest is an inclusion probability p. A document's rank is (u / (1 - u)) / (p / (1 - p)) with u
from a hash of its id and text, and a source takes its documents in the order of rank until its words are reached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut
from lithoframe.llm.common import WORD, in_order


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # of the sources in the order of their names, over and over
    share: float = 1.0      # of all sizes that the mix has
    most: int = 3           # times that a source, and a document, may be taken
    length_merit: float = 0.1   # by how much each doubling of the size raises a document's expected copies
    seed: str = "mix"


OFFERS = 32     # documents of a doubling of the size that are tried at once to fill what a source has left


def n_words(text: Column) -> Column:
    """Words of a text, 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, text: str, doc_id: str, s: Settings) -> DataFrame:
    """docs with _size (words) and _u (a number above 0 and below 1 from a hash of id and text)."""
    h = F.xxhash64(F.lit(s.seed), F.col(doc_id).cast("string"), F.col(text))
    return docs.withColumn("_size", n_words(F.col(text))).withColumn(
        "_u", (F.pmod(h, F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52)))


def targets(sizes: DataFrame, source: str, s: Settings) -> DataFrame:
    """(_source, source_size, target) from rows with ``source`` and _size.

    Sources are ranked by code point, null last. In ascending order of the level (words per weight) that fills them, the
    full sources come first, so running sums tell the level of the others. A source without words has target 0.
    """
    sums = sizes.groupBy(F.col(source).alias("_source")).agg(F.sum("_size").cast("long").alias("source_size"))
    ranked = in_order(sums.select("*", F.col("_source").isNull().alias("_last"), F.lit(1).cast("long").alias("_one")),
                      ["_last", "_source"], {"_one": "_rank"})
    weight = F.element_at(F.array(*map(F.lit, s.weights)), (F.col("_rank") % len(s.weights) + 1).cast("int"))
    room = ranked.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * s.most).cast("double"))
    room = cut(room.withColumn("_ratio", F.col("_cap") / F.col("_w")))
    some = room.filter(F.col("source_size") > 0)
    total, weights = some.agg(F.sum("source_size"), F.sum("_w")).first()
    if not total:
        return room.select("_source", "source_size", F.lit(0.0).alias("target"))
    run = in_order(some.select("_ratio", "_rank", "_cap", "_w"), ["_ratio", "_rank"], {"_cap": "_full", "_w": "_gone"})
    at = run.withColumn("_level", (F.lit(float(total)) * s.share - F.col("_full")) / (F.lit(float(weights)) - F.col("_gone")))
    level = at.filter(F.col("_level") <= F.col("_ratio") * (1 + 1e-9)).agg(
        F.min_by("_level", F.struct("_ratio", "_rank"))).first()[0]
    open_ = F.lit(level) * F.col("_w") if level is not None else F.col("_cap")
    return room.select("_source", "source_size", F.least("_cap", open_).alias("target"))


def _merit(s: Settings) -> Column:
    return F.lit(1.0) + F.lit(s.length_merit) * F.floor(F.log2(F.col("_size") + 1))


def allocated(rows: DataFrame, source: str, s: Settings) -> DataFrame:
    """For each source its size, target, _c (copies per merit), _passes, the [left, first, out] of each pass, and _filled.

    Together they take, in the order of rank, what fits. A pass takes what is from the rank ``first`` and before ``out`` (null:
    without end) and not above ``left`` words; it ends at the first document that does not fit. What is left then is less than
    that one document, and _filled gets the ranks behind it that still fit. Where that stops early, another pass goes on.
    """
    goal = cut(targets(rows, source, s))
    merits = rows.filter(F.col("_size") > 0).groupBy(F.col(source).alias("_source"), _merit(s).alias("_x")).agg(
        F.sum("_size").alias("_words"))
    higher = Window.partitionBy("_source").orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("_source").orderBy(F.desc("_x")).rowsBetween(0, Window.unboundedFollowing)
    solved = (_beside(merits, goal.select("_source", "target")).withColumn(
        "_c", (F.col("target") - s.most * F.coalesce(F.sum("_words").over(higher), F.lit(0)))
        / F.sum(F.col("_words") * F.col("_x")).over(rest))
        .filter(F.col("_c") * F.col("_x") <= s.most * (1 + 1e-9))
        .groupBy("_source").agg(F.max_by("_c", "_x").alias("_c")))
    known = cut(_beside(goal, solved, "left").withColumn("_c", F.coalesce("_c", F.lit(0.0))))

    pool = _beside(rows.filter(F.col("_size") > 0).select(F.col(source).alias("_source"), "_size", "_u"), known)
    pool = cut(_expected(pool, s).select("_source", "_size", "_whole", "_rank", "target"))
    left = pool.groupBy("_source").agg((F.first("target") - F.sum(F.col("_whole") * F.col("_size"))).alias("_left"))
    passes = cut(left.withColumn("_passes", F.array().cast("array<struct<left: double, first: double, out: double>>"))
                 .withColumn("_stop", F.lit(None).cast("double")).withColumn("_filled", F.array().cast("array<double>")))
    fits = F.col("_size") <= F.col("_left")
    pool = _beside(pool.filter(F.col("_rank").isNotNull()).select("_source", "_size", "_rank"),
                   passes.select("_source", "_left")).filter(fits)
    while True:
        run = in_order(pool, ["_source", "_rank"], {"_size": "_before"}, within=["_source"])
        over = F.col("_before") + F.col("_size") > F.col("_left")
        inside = F.col("_out").isNull() | (F.col("_rank") < F.col("_out"))
        ends = cut(run.groupBy("_source").agg(F.min(F.when(over, F.col("_rank"))).alias("_out")))
        used = _beside(run, ends).filter(inside).groupBy("_source").agg(F.sum("_size").alias("_used"))
        step = F.struct(F.col("_left").alias("left"), F.col("_stop").alias("first"), F.col("_out").alias("out"))
        passes = cut(_beside(_beside(passes, ends, "left"), used, "left").select(
            "_source", (F.col("_left") - F.coalesce("_used", F.lit(0))).alias("_left"), "_filled", "_out",
            F.concat("_passes", F.array(step)).alias("_passes")))
        behind = _beside(run.drop("_left"), passes.select("_source", "_left", "_out")).filter(
            (F.col("_rank") > F.col("_out")) & fits).select("_source", "_size", "_rank")
        passes = cut(_filled(passes, behind))
        if passes.filter(F.col("_stop").isNotNull()).isEmpty():
            return cut(_beside(known, passes.drop("_left", "_stop"), "left"))
        pool = _beside(behind, passes.select("_source", "_left", "_stop")).filter(
            (F.col("_rank") >= F.col("_stop")) & fits).drop("_stop")


def _filled(passes: DataFrame, behind: DataFrame) -> DataFrame:
    """passes with what fits of ``behind`` in _filled and taken from _left, and _stop, the rank from which it isn't decided yet.

    Each doubling of the size offers its first OFFERS documents by rank; the next one is its horizon. Offers are tried in the order
    of rank. Beyond the horizon of a doubling whose documents might still fit, nothing is decided. A source's row holds some hundred
    offers at most. Documents of one rank (rows of the same id and text) go together.
    """
    together = behind.groupBy("_source", "_rank").agg(F.sum("_size").alias("_size"), F.min("_size").alias("_low"))
    doubling = F.floor(F.log2("_low")).cast("int")
    nth = F.row_number().over(Window.partitionBy("_source", doubling).orderBy("_rank"))
    offer = F.struct(F.col("_rank").alias("rank"), F.col("_size").cast("double").alias("size"),
                     (F.col("_nth") > OFFERS).alias("last"), F.pow(F.lit(2.0), doubling).alias("low"))
    offers = together.withColumn("_nth", nth).filter(F.col("_nth") <= OFFERS + 1).groupBy("_source").agg(
        F.sort_array(F.collect_list(offer)).alias("_offers"))

    def state(left: Column, ranks: Column, stop: Column) -> Column:
        return F.struct(left.alias("left"), ranks.alias("ranks"), stop.alias("stop"))

    def tried(so_far: Column, one: Column) -> Column:
        left, ranks, stop = so_far["left"], so_far["ranks"], so_far["stop"]
        ends = one["last"] & (one["low"] <= left)
        takes = ~one["last"] & (one["size"] <= left)
        return (F.when(stop.isNotNull(), so_far).when(ends, state(left, ranks, one["rank"]))
                .when(takes, state(left - one["size"], F.concat(ranks, F.array(one["rank"])), stop)).otherwise(so_far))

    none = F.array().cast("array<struct<rank: double, size: double, last: boolean, low: double>>")
    start = state(F.col("_left").cast("double"), F.col("_filled"), F.lit(None).cast("double"))
    done = _beside(passes, offers, "left").withColumn("_done", F.aggregate(F.coalesce("_offers", none), start, tried))
    return done.select("_source", "_passes", F.col("_done.left").alias("_left"), F.col("_done.ranks").alias("_filled"),
                       F.col("_done.stop").alias("_stop"))


def _beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on _source in which null equals null; the small side's size is known from its files."""
    right = right.withColumnRenamed("_source", "_other")
    return left.join(right, F.col("_source").eqNullSafe(F.col("_other")), how).drop("_other")


def _expected(rows: DataFrame, s: Settings) -> DataFrame:
    """rows with _whole, the certain copies, and _rank, null where nothing is left to chance."""
    copies = F.least(F.lit(float(s.most)), F.col("_c") * _merit(s))
    p, u = F.col("_copies") - F.col("_whole"), F.col("_u")
    return (rows.withColumn("_copies", F.when(F.col("_size") > 0, copies).otherwise(0.0))
            .withColumn("_whole", F.floor(F.col("_copies") + 1e-9))
            .withColumn("_rank", F.when(p > 1e-9, (u / (1 - u)) / (p / (1 - p)))))


def applied(rows: DataFrame, source: str, plan: DataFrame, s: Settings, prefix: str = "") -> DataFrame:
    """rows (with _size and _u) with size, source_size, target and copies."""
    def chosen(so_far: Column, step: Column) -> Column:
        takes = (F.col("_size") <= step["left"]) & (step["out"].isNull() | (F.col("_rank") < step["out"])) & (
            step["first"].isNull() | (F.col("_rank") >= step["first"]))
        return so_far | F.coalesce(takes, F.lit(False))

    new = {f"{prefix}{c}" for c in ("size", "source_size", "target", "copies")}
    names = [c for c in rows.columns if c not in new | {"_size", "_u"}]
    plan = plan.withColumnsRenamed({"source_size": "_all", "target": "_goal"})
    by = _beside(rows.drop(*new).withColumn("_source", F.col(source)), plan, "left")
    taken = F.aggregate("_passes", F.lit(False), chosen) | F.array_contains("_filled", F.col("_rank"))
    drawn = F.col("_rank").isNotNull() & F.coalesce(taken, F.lit(False))
    return _expected(by, s).select(*names, F.col("_size").alias(f"{prefix}size"), F.col("_all").alias(f"{prefix}source_size"),
                                   F.col("_goal").alias(f"{prefix}target"),
                                   (F.col("_whole") + drawn.cast("int")).cast("int").alias(f"{prefix}copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        settings: Settings = Settings(), prefix: str = "") -> DataFrame:
    """docs with size (words), source_size, target (both of its source) and copies (0 to ``most``).

    The words that a source takes fall short of its target by less than its smallest passed-over document with its
    copies. Null is a source of its own, the last. A text that is null or has no word has size 0 and no copy.
    Rows of the same id and text share their fate. An empty table stays empty. New names begin with ``prefix``; input columns of
    these names are replaced, all others stay as they are, whatever their names.
    """
    s = settings
    new = {f"{prefix}{c}".lower() for c in ("size", "source_size", "target", "copies")}
    # the caller's columns go along in one, so their names meet none of those made here
    held = docs.select(F.struct(*[c for c in docs.columns if c.lower() not in new] or [F.lit(None)]).alias("_doc"),
                       F.col(text).alias("_text"), F.col(source).alias("_from"), F.col(doc_id).alias("_id"))
    rows = measured(held, "_text", "_id", s).drop("_text", "_id")
    plan = allocated(cut(rows.select("_from", "_size", "_u")), "_from", s)
    done = applied(rows, "_from", plan, s, "_new_")
    return done.select("_doc.*", *[F.col(f"_new_{c}").alias(f"{prefix}{c}") for c in ("size", "source_size", "target", "copies")])
