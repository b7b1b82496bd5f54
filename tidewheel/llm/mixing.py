"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, salted, word_count

#: Documents rounded together; each block of a source is one row of an aggregate, about 256 small structs.
BLOCK_DOCS = 256
#: Newton steps at most; about ten are needed. Without convergence an error is raised.
MAX_STEPS = 60


def token_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), total_share: float = 1.0, max_copies: int = 3) -> DataFrame:
    """Targets by source: ``source, source_size, weight, target``.

    Sources by code point, null last, get ``weights`` in turn and share ``total_share`` of all words.
    A target stops at ``max_copies`` times its source's size; what is over is shared by weight among
    the others, again and again until none is above.  That is one sort by the level at which a source
    fills up and running sums, over the table of sources.

    The sort and sums run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_copies))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(every) * float(total_share)
    capped = F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("weight").over(fills.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # a source's level if it were the first that isn't full: the true level is the first that keeps within the cap
    tried = per.withColumn("level", (total - capped) / open_w).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap")).withColumn("place", F.row_number().over(fills))
    level = F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(every)["level"]
    return tried.withColumn("at", level).select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("at") * F.col("weight")), F.col("cap")).alias("target"))


def _sum(x: Column) -> Column:
    """A sum in billionths, which is the same in any order, so that reruns agree to the last bit."""
    return F.sum((x * 1e9).cast("decimal(38,0)")).cast("double") / 1e9


def document_rates(sizes: DataFrame, targets: DataFrame, max_copies: int = 3, tolerance: float = 1e-7) -> DataFrame:
    """``targets`` with ``tilt``: a document of size z gets the rate :func:`rate` gives for it, by entropy balancing.

    The rates r of the documents minimise their divergence from one copy each, sum r ln r - r + 1, with r at most
    ``max_copies``, so that every source's tokens, sum size * r, meet its target. The dual is convex with one multiplier t for each
    constraint, and the optimum is the exponential tilt r_d = min(max_copies, exp(t size_d)), so long documents are tilted more
    than short ones. Each Newton step sums gradient and Hessian over all documents (``sizes``: source, size, count n,
    one row for each size of a source) in a distributed aggregate, and moves the multipliers of all sources side by side. A step that leaves the
    bracket of a multiplier found so far halves the bracket instead, so the iteration can't run away. It ends when all sources are within
    ``tolerance`` of their targets, and raises an error if ``MAX_STEPS`` steps don't get there. A target of ``max_copies`` times its source is the limit
    of t to infinity and a target of 0 that to minus infinity; both are set.
    """
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    sums = sizes.where("size > 0").groupBy("source").agg(_sum(size * n).alias("s1"), _sum(size * size * n).alias("s2"))
    state = targets.join(sums.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    inf = F.lit(float("inf"))
    goal = F.col("target")
    fixed = F.when(F.col("s1").isNull() | (goal <= 0), -inf).when(goal >= F.col("s1") * (max_copies * (1 - 1e-12)), inf)
    # the start: the multiplier at which a document of the mean size of a token's document has the source's mean rate
    start = F.coalesce(fixed, F.ln(goal / F.col("s1")) * F.col("s1") / F.col("s2"))
    state = state.select("source", "source_size", "weight", "target", start.alias("tilt"), (-inf).alias("lo"), inf.alias("hi"), fixed.isNotNull().alias("done"))
    state = materialize(state, "tilts")
    for _ in range(MAX_STEPS):
        if state.where("not done").isEmpty():
            return state.select("source", "source_size", "weight", "target", "tilt")
        # the tilts of all sources, of which there are few beside documents; Spark broadcasts or shuffles them by their size
        t = state.where("not done").select(F.col("source").alias("_s"), "tilt")
        r = F.exp(F.col("tilt") * size)
        free = r < max_copies
        got = sizes.where("size > 0").join(t, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(
            _sum(F.least(r, F.lit(float(max_copies))) * size * n).alias("mass"), _sum(F.when(free, r * size * size * n).otherwise(0.0)).alias("slope")
        )
        now = state.join(got, F.col("source").eqNullSafe(F.col("_s")), "left")
        gap = F.col("mass") - goal
        lo, hi = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        now = now.withColumn("met", F.abs(gap) <= goal * tolerance).withColumn("lo2", lo).withColumn("hi2", hi)
        newton = F.col("tilt") - gap / F.col("slope")
        half = F.when((F.col("lo2") > -inf) & (F.col("hi2") < inf), (F.col("lo2") + F.col("hi2")) / 2).otherwise(F.col("tilt") * 2 + F.when(gap < 0, 1e-6).otherwise(-1e-6))
        step = F.when((F.col("slope") > 0) & (newton > F.col("lo2")) & (newton < F.col("hi2")), newton).otherwise(half)
        done = F.col("done") | F.coalesce("met", F.lit(False))
        state = materialize(now.select("source", "source_size", "weight", "target", F.when(done, F.col("tilt")).otherwise(step).alias("tilt"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), done.alias("done")), "tilts")
    raise ArithmeticError(f"the multipliers did not converge in {MAX_STEPS} steps")


def rate(tilt: Column, size: Column, max_copies: int) -> Column:
    """min(``max_copies``, exp(tilt * size)); of a document without words 1, or 0 where the source takes nothing."""
    power = F.when(size > 0, tilt * size).when(tilt == F.lit(float("-inf")), tilt).otherwise(0.0)
    return F.least(F.exp(power), F.lit(float(max_copies)))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    total_share: float = 1.0,
    max_copies: int = 3,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Copies of every document in the mix: ``id_col, source, size, source_size, target, rate, copies, taken``.

    ``size`` is the number of words of the text (null: 0), ``rate`` what :func:`document_rates` finds, ``copies`` the whole number, 0 to ``max_copies``,
    to which it is rounded, ``taken`` = copies * size.  Rounding carries its error on: a source's documents
    are dealt by hash into blocks of about ``BLOCK_DOCS`` and within a block, from the longest
    to the shortest, each takes the whole number of copies nearest to its rate plus what is owed, so a block
    ends within about half its shortest document of its share.  Nothing is drawn: reruns agree.

    Rows alike in id, source and size are decided together and get the same copies, one output row for
    each of them.  Null ids, sources and texts are values like any other; an empty table gives no rows.
    A document of size 0 takes one copy unless its source takes nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    unit = materialize(rows.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "mix")
    sums = unit.select("source", (F.col("size") * F.col("n")).alias("size"))
    histogram = materialize(unit.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix")
    rates = document_rates(histogram, token_targets(sums, weights, total_share, max_copies), max_copies)
    blocks = unit.groupBy("source").agg(F.count("*").alias("units"))
    per = rates.join(blocks.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    per = materialize(per.withColumn("blocks", F.ceil(F.col("units") / BLOCK_DOCS)), "mix")
    dealt = unit.join(per.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    dealt = dealt.withColumn("block", salted(F.col("blocks"), F.col("id"), F.col("size")))
    # the id's own order breaks ties, so that the order of arrival doesn't matter
    item = F.struct((-F.col("size") * F.col("n")).alias("long_first"), F.xxhash64("id").alias("tie"), "id", "size", "n")
    block = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("tilt").alias("tilt"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))

    own = lambda x: rate(F.col("tilt"), x["size"].cast("double"), max_copies)

    def take(state: Column, x: Column) -> Column:
        words = x["size"] * x["n"]
        due = state["owed"] + own(x) * words
        n = F.when(words > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(max_copies)), F.round(due / words)))).otherwise(own(x))
        return F.struct((due - n * words).alias("owed"), F.concat(state["copies"], F.array(n.cast("int"))).alias("copies"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("copies"))
    done = block.withColumn("copies", F.aggregate("items", start, take, lambda s: s["copies"]))
    one = done.select("source", "source_size", "target", "tilt", F.explode(F.arrays_zip("items", "copies")).alias("x"))
    flat = one.select(F.col("x.items.id").alias(id_col), "source", F.col("x.items.size").alias("size"), "source_size", "target", own(F.col("x.items")).alias("rate"), F.col("x.copies").alias("copies"), (F.col("x.copies") * F.col("x.items.size")).cast("long").alias("taken"), F.col("x.items.n").alias("n"))
    return flat.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as :func:`mix_sources` decides (0 copies: the row goes)."""
    id_col, source, text = options.get("id_col", "doc_id"), options.get("source", "source"), options.get("text", "text")
    plan = mix_sources(docs, **options).where("copies > 0")
    plan = plan.select(F.col(id_col).alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies")).distinct()
    on = F.col(id_col).eqNullSafe(F.col("_mix_id")) & F.col(source).eqNullSafe(F.col("_mix_source")) & (word_count(F.col(text)) == F.col("_mix_size"))
    return docs.join(plan, on).withColumn("_mix_copies", F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies")))).select(*docs.columns)


