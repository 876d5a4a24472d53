"""Mixing sources to target weights by entropy balancing.

The rates of documents are as close as possible to one (in relative entropy),
at most two, and such that the words each source contributes equal its
target. The dual of that problem is concave and has one multiplier a source;
its solution tilts the rates exponentially with the document's size,

    rate = min(2, exp(multiplier * size / scale)),

and is found by safeguarded Newton steps. Rates depend on source and size
alone, so the steps run over the counts of documents by source and size, and
the state of the iteration is a table with a row a source.

Rates become copies in two steps. Each (source, size) group gets a whole number
of copies by dithered rounding; a shift of the dither that is common to the
source is searched so that the source's words meet its target from below, and
what is then missing is filled up by single groups. Within a group the copies
are dealt by rank of the id's hash. Large groups are ranked in parts of about
`PART` rows, so that no task sorts a whole hot group.

All of it is DataFrame operations. Tables that hold one row a source are the
only ones that a single task handles.

Defined results: a null text has size 0; documents of size 0 are never taken
more than once and count no words; a null source is a source of its own, last
in order; rows with equal ids are documents each for itself; sums are exact
decimals, so reruns agree; an empty table gives no rows; only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: What the mix holds, as a share of all words, and the most a source or document may be repeated.
SHARE, MOST = 1.5, 2
#: Newton steps at most, and the relative error at which they stop.
STEPS, TOLERANCE = 40, 1e-7
#: Shifts tried at once, and rounds, in the search for the common shift.
SHIFTS, ROUNDS = 32, 3
#: Rounds that fill up what is missing.
FILLS = 4
PART = 512


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target: `share` of all words by weight, stopping at `most` times the source's own.

    Sources in order of saturation: the first j are at their limit if what is
    left for the others by weight, then, exceeds the limit of none of them.
    """
    # one row a source: these windows are small
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", "k")
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * most
    s = sources.withColumn("weight", w).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(everything) * share
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    level = F.min(F.when(F.col("fits"), F.struct("ratio", "k", "level"))).over(everything)["level"]
    return s.withColumn("target", F.least(F.col("limit"), F.coalesce(level, F.col("ratio")) * F.col("weight"))).drop("ratio", "level", "fits")


def _rate(multiplier: Column, scale: Column, size: Column, most: float = MOST) -> Column:
    return F.exp(F.least(multiplier * size / scale, F.log(F.lit(float(most)))))


def balance(hist: DataFrame, state: DataFrame, scratch: Scratch, most: float = MOST) -> DataFrame:
    """The multipliers: Newton steps on the dual, kept within a bracket of the root."""
    state = state.withColumns({"multiplier": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "error": F.lit(None).cast("double")})
    state = scratch.save(state)
    m, low, high = F.col("multiplier"), F.col("low"), F.col("high")
    keep = ["k", "source", "source_size", "scale", "weight", "limit", "target"]
    for _ in range(STEPS):
        words = F.col("n") * F.col("size") * F.col("rate")
        sums = (
            hist.join(state, "k").withColumn("rate", _rate(m, F.col("scale"), F.col("size"), most))
            .groupBy(*keep, "multiplier", "low", "high")
            .agg(exact(words).alias("has"), exact(F.when(F.col("rate") < most, words * F.col("size") / F.col("scale"))).alias("slope"))
        )
        gap = F.col("target") - F.col("has")
        below = gap > 0
        step = (
            sums.withColumn("error", F.when((F.col("target") >= F.col("limit")) | (F.col("target") <= 0), 0.0).otherwise(F.abs(gap) / F.col("target")))
            .withColumns({"low": F.when(below, m).otherwise(low), "high": F.when(below, high).otherwise(m), "newton": m + gap / F.when(F.col("slope") > 0, F.col("slope"))})
        )
        inside = F.col("newton").isNotNull() & (low.isNull() | (F.col("newton") > low)) & (high.isNull() | (F.col("newton") < high)) & (F.abs(F.col("newton") - m) <= 4 * (1 + F.abs(m)))
        other = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(high.isNull(), F.when(m > 0, m * 2).otherwise(m / 2 + 1)).otherwise(F.when(m < 0, m * 2).otherwise(m / 2 - 1))
        moved = step.withColumn("multiplier", F.when(F.col("error") <= TOLERANCE, m).when(inside, F.col("newton")).otherwise(other))
        new = scratch.save(moved.select(*keep, "multiplier", "low", "high", "error"))
        scratch.drop(state)
        state = new
        if (state.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state


def round_groups(hist: DataFrame, state: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """Whole copies of each (source, size) group: k, size, n, rate, copies."""
    full = F.col("target") >= F.col("limit")
    rate = F.when(full, F.lit(float(most))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.round(_rate(F.col("multiplier"), F.col("scale"), F.col("size"), most), 9))
    dither = F.pmod(F.xxhash64("k", "size"), F.lit(1 << 20)) / float(1 << 20)
    groups = scratch.save(hist.join(state, "k").select("k", "size", "n", rate.alias("rate"), dither.alias("dither"), F.when(full | (F.col("target") <= 0), 0.0).otherwise(1.0).alias("free")))

    def whole(shift: Column) -> Column:
        return F.least(F.greatest(F.floor(F.col("n") * F.col("rate") + (F.col("dither") + shift) * F.col("free")), F.lit(0)), F.col("n") * most).cast("long")

    goal = state.select("k", "target")
    shifts = scratch.save(goal.select("k", "target", F.lit(-1.0).alias("shift"), F.lit(2.0 / SHIFTS).alias("width")))
    for _ in range(ROUNDS):
        tried = (
            groups.join(shifts, "k").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SHIFTS))))
            .withColumn("at", F.col("shift") + F.col("i") * F.col("width"))
            .groupBy("k", "target", "width", "at").agg(F.sum(whole(F.col("at")) * F.col("size")).alias("words"))
        )
        best = tried.groupBy("k", "target", "width").agg(F.max(F.when(F.col("words") <= F.col("target"), F.col("at"))).alias("shift"))
        new = scratch.save(best.select("k", "target", F.coalesce("shift", F.lit(-1.0)).alias("shift"), (F.col("width") / SHIFTS).alias("width")))
        scratch.drop(shifts)
        shifts = new
    out = scratch.save(groups.join(shifts, "k").select("k", "size", "n", "rate", "free", whole(F.col("shift")).alias("copies")))
    for _ in range(FILLS):
        missing = out.groupBy("k").agg(F.sum(F.col("copies") * F.col("size")).alias("words")).join(goal, "k").select("k", F.floor(F.col("target") - F.col("words")).alias("missing"))
        room = F.when((F.col("size") > 0) & (F.col("free") > 0), F.least(F.col("n") * most - F.col("copies"), F.floor(F.col("missing") / F.col("size"))))
        chosen = (
            out.join(missing, "k").withColumn("add", room).where(F.col("add") > 0)
            .groupBy("k").agg(F.max(F.struct((F.col("add") * F.col("size")).alias("words"), "size", "add")).alias("best"))
            .select("k", F.col("best.size").alias("size"), F.col("best.add").alias("add"))
        )
        new = scratch.save(out.join(chosen, ["k", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("add", F.lit(0))).drop("add"))
        scratch.drop(out)
        out = new
    return out


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, row_col: str | None = None) -> DataFrame:
    """How often the mix takes each document.

    Returns `id_col`, source, size long, source_size long, target double, rate
    double, copies long, taken long, and `row_col`, a number of the row, if it is
    given; it decides between rows of equal ids.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    slim = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    slim = scratch.save(slim.withColumn("k", key))
    hist = scratch.save(slim.groupBy("k", "source", "size").agg(F.count("*").alias("n")))
    words, squares = F.sum(F.col("n") * F.col("size")), exact(F.col("n") * F.col("size") * F.col("size").cast("double"))
    sources = hist.groupBy("k", "source").agg(words.alias("source_size"), squares.alias("squares"))
    sources = sources.withColumn("scale", F.coalesce(F.col("squares") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(1.0))).drop("squares")
    hist = hist.drop("source")
    state = balance(hist, targets(sources, weights, share, most), scratch, most)
    groups = round_groups(hist, state, scratch, most)
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = groups.select("k", "size", "n", "rate", "copies", parts.alias("parts"), F.expr("copies div greatest(n, 1)").alias("each")).withColumn("extra", F.col("copies") - F.col("each") * F.col("n"))
    rows = slim.join(dealt, ["k", "size"]).withColumn("hash", F.xxhash64(F.lit(11), "id")).withColumn("part", F.pmod(F.xxhash64(F.lit(12), "id"), F.col("parts")))
    phase = F.when(F.col("parts") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("k", "size", "part"), F.col("n"))).cast("long")
    rank = F.row_number().over(Window.partitionBy("k", "size", "part").orderBy("hash", "id", "row"))
    rows = rows.withColumn("phase", phase).withColumn("rank", rank.cast("long"))
    more = F.expr("(rank * extra + phase) div n - ((rank - 1) * extra + phase) div n")
    rows = rows.withColumn("take", F.col("each") + more)
    return rows.join(state.select("k", "source_size", "target"), "k").select(
        F.col("id").alias(id_col), "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", F.col("take").alias("copies"), (F.col("take") * F.col("size")).alias("taken"), *([F.col("row").alias(row_col)] if row_col else [])
    )


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs`, all columns, as often as it is taken; rows that share an id each for itself."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    rows = Scratch(docs.sparkSession, "repeat").save(docs.withColumn(name, F.monotonically_increasing_id()))
    taken = mix(rows, **options, row_col=name).where("copies > 0").select(F.col(name).alias("row"), "copies")
    joined = rows.alias("d").join(taken.alias("_mix").hint("shuffle_hash"), F.col(f"d.{name}") == F.col("_mix.row"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix.copies")))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], again.alias(name)).drop(name)
