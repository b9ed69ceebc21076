"""Exact, linearly interpolated quantiles without gathering a group in one task.

``percentile``/``median`` keep every distinct value of a group in one
aggregation buffer, which does not survive a group holding a large share of
100 TB. Here each requested rank of each group has a bracket [lo, hi] that
starts at the group's extremes and is narrowed by counting passes:

1. a pass cuts the inside of every bracket at ``SPLITS`` approximately even
   ranks (``percentile_approx``) and keeps the stretch around the wanted rank;
2. the next pass counts exactly the rows below, at, between and above the new ends,
   which also shows whether the stretch holds the rank (else the bracket stays);
3. passes repeat until no more than ``bound`` rows lie strictly inside any bracket. An inside
   shrinks about SPLITS / 4 times a pass, so 10^12 rows take five passes. Ties
   don't matter: copies of an end value are counted, not kept;
4. only the (value, count) pairs inside the brackets are grouped, and the order
   statistics at ranks floor(h) and floor(h) + 1, h = q(n - 1), are interpolated.

The result equals ``percentile``/``quantile_cont``. Brackets are one small row a
group and quantile; the driver sees one number a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewscope.session import materialize

BOUND = 1 << 18             # rows strictly inside a bracket once passes end
SPLITS = 256
MAX_BROADCAST_GROUPS = 100_000
_SALTS = 64                 # copies of a bracket when there are too many groups to broadcast


def _tagged(base: DataFrame, state: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """Rows with the brackets of their group (``_br``, an array over the quantiles)."""
    packed = state.groupBy(*keys).agg(F.collect_list(F.struct("qi", "lo", "hi", "rank", "n")).alias("_br"))
    if groups <= MAX_BROADCAST_GROUPS:
        return base.join(F.broadcast(packed), keys)
    # many groups: a group's rows are dealt over salted copies of its brackets, so a hot group is many tasks
    copies = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = base.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_SALTS)).cast("int"))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def _per_bracket(tagged: DataFrame, keys: list[str]) -> DataFrame:
    return tagged.select(*keys, "_x", F.explode("_br").alias("_b")).select(*keys, "_x", "_b.*")


def _counted(base: DataFrame, state: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """Brackets with exact counts (below, at_lo, inside, at_hi) and the cuts of their inside."""
    x, lo, hi = F.col("_x"), F.col("lo"), F.col("hi")
    inner = (x > lo) & (x < hi)
    rows = _per_bracket(_tagged(base, state, keys, groups), keys)
    cuts = [i / SPLITS for i in range(SPLITS + 1)]
    return rows.groupBy(*keys, "qi").agg(
        F.count_if(x < lo).alias("below"), F.count_if(x == lo).alias("at_lo"), F.count_if(inner).alias("inside"),
        F.count_if((x == hi) & (hi > lo)).alias("at_hi"),
        F.percentile_approx(F.when(inner, x), cuts, 20 * SPLITS).alias("cuts"))


def _narrowed(state: DataFrame, bound: int) -> DataFrame:
    """The stretch between cuts around each rank, one cut wider on both sides; small brackets stay."""
    r = F.col("rank") - F.col("below") - F.col("at_lo")        # position among the inside values, may lie outside
    inside, small = F.greatest(F.col("inside"), F.lit(1)), F.col("inside") <= bound
    first = F.least(F.floor(r / inside * SPLITS).cast("int") - 1, F.lit(SPLITS))     # ranks may lie at the ends
    last = F.greatest(F.ceil((r + 2) / inside * SPLITS).cast("int") + 1, F.lit(0))
    lo = F.when(small | (r < 0) | (first < 0), F.col("lo")).otherwise(F.get("cuts", first))
    hi = F.when(small | (r + 1 >= inside) | (last > SPLITS), F.col("hi")).otherwise(F.get("cuts", last))
    return state.select(*[c for c in state.columns if c not in ("lo", "hi", "cuts")],
                        F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"), lo.alias("lo"), hi.alias("hi"))


def quantile_brackets(base: DataFrame, keys: list[str], qs: list[float], bound: int) -> tuple[DataFrame, int]:
    """(brackets with at most ``bound`` rows strictly inside, number of groups)."""
    sizes = materialize(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"),
                                                F.max("_x").alias("hi")), "quantile-groups")
    groups, largest = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    want = F.explode(F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)]))
    state = (sizes.select(*keys, "n", "lo", "hi", want.alias("_w"))
             .select(*keys, "n", "lo", "hi", "_w.qi", F.floor(F.col("_w.q") * (F.col("n") - 1)).alias("rank")))
    if (largest or 0) <= bound:
        return state, groups

    def recount(new: DataFrame) -> DataFrame:
        counts = _counted(base, new, keys, groups)
        return materialize(new.join(counts, [*keys, "qi"]), "quantile-brackets")

    state, widest = recount(state), None
    while True:
        inside = state.agg(F.max("inside")).first()[0]
        if inside <= bound or inside == widest:      # an unchanged widest bracket can't be cut further
            return state, groups
        widest = inside
        moved = materialize(_narrowed(state, bound), "quantile-brackets")
        new = recount(moved.drop("below", "at_lo", "inside", "at_hi"))
        # a stretch that misses its rank is not taken: the approximate cuts then erred by more than they may
        upto = F.col("below") + F.col("at_lo") + F.col("inside") + F.col("at_hi")
        holds = (F.col("rank") >= F.col("below")) & (F.least(F.col("rank") + 1, F.col("n") - 1) < upto)
        missed = new.where(~holds).limit(1).count()
        if missed:
            back = new.withColumns({"lo": F.when(holds, F.col("lo")).otherwise(F.col("old_lo")),
                                    "hi": F.when(holds, F.col("hi")).otherwise(F.col("old_hi"))})
            new = recount(back.drop("below", "at_lo", "inside", "at_hi", "cuts"))
        state = new.drop("old_lo", "old_hi")


def _statistic(k: Column) -> Column:
    start = F.col("_start")
    return F.max(F.when((start <= k) & (k < start + F.col("_c")), F.col("_v")))


def exact_quantiles(df: DataFrame, col: str, qs: list[float], keys: list[str] | tuple = (),
                    bound: int = BOUND, prefix: str = "q") -> DataFrame:
    """One row per group of ``keys`` with columns ``{prefix}0..`` holding the quantiles of ``col``.

    Nulls are left out; without keys an empty input gives one row of nulls. ``df`` is scanned twice, and once more a
    narrowing pass.
    """
    keys = list(keys)
    global_group = not keys
    if global_group:
        df = df.withColumn("_g", F.lit(0))
        keys = ["_g"]
    base = df.select(*keys, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    state, groups = quantile_brackets(base, keys, list(qs), bound)

    inside = (_per_bracket(_tagged(base, state, keys, groups), keys).where(F.col("_x") <= F.col("hi"))
              # rows below the bracket collapse into one NULL-valued pair
              .withColumn("_v", F.when(F.col("_x") >= F.col("lo"), F.col("_x"))))
    pairs = inside.groupBy(*keys, "qi", "rank", "n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    # at most bound + 3 pairs a bracket
    w = (Window.partitionBy(*keys, "qi", "rank", "n").orderBy(F.col("_v").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, -1))
    ranked = pairs.withColumn("_start", F.coalesce(F.sum("_c").over(w), F.lit(0))).where(F.col("_v").isNotNull())
    values = ranked.groupBy(*keys, "qi", F.col("n").alias("_n")).agg(
        _statistic(F.col("rank")).alias("_v0"), _statistic(F.col("rank") + 1).alias("_v1"))
    aggs = []
    for i, q in enumerate(qs):
        h = F.lit(float(q)) * (F.col("_n") - 1)
        frac = h - F.floor(h)
        value = F.when(F.col("_v1").isNull() | (frac == 0), F.col("_v0")).otherwise(
            F.col("_v0") + (F.col("_v1") - F.col("_v0")) * frac)
        aggs.append(F.max(F.when(F.col("qi") == i, value)).alias(f"{prefix}{i}"))
    # a global aggregate yields one row (NULLs) even for an empty input
    return values.agg(*aggs) if global_group else values.groupBy(*keys).agg(*aggs)
