"""Building blocks that keep ordered, per-call work distributed when one call is huge.

A call may hold a third of all rows, so nothing here partitions by the call
alone.  Rows carry a *chunk* (a monotone slice of the call's order); windows run
inside ``(call, chunk)`` and a table with one row per chunk carries state from
chunk to chunk.  Only that summary table, smaller by the chunk size, is ever
ordered per call.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_ROWS = 65_536
BROADCAST_MAX_ROWS = 100_000


def chunk_rows(spark: SparkSession) -> int:
    """Rows per chunk; ``parleo.chunk.rows`` overrides the default."""
    return int(spark.conf.get("parleo.chunk.rows", str(DEFAULT_CHUNK_ROWS)))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    specs: Mapping[str, tuple[str, Column, bool]],
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``last`` (non-null) per key without one task per key.

    ``specs`` maps an output column to ``(kind, value, inclusive)``; the kinds
    ``all_sum`` and ``all_max`` give every row the figure of its whole key.  ``order``
    must be total inside a key and ``chunk`` must not decrease along it.
    """
    parts = [*keys, chunk]
    vals = {f"_v_{o}": v for o, (_, v, _) in specs.items()}
    base = df.withColumns(vals)

    def local(kind: str, col: str, inclusive: bool) -> Column:
        w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1)
        return {"sum": F.sum(col), "max": F.max(col), "last": F.last(col, ignorenulls=True)}[kind].over(w)

    whole = Window.partitionBy(*keys)

    def total(kind: str, col: str) -> Column:
        if kind == "last":
            return F.max_by(col, F.when(F.col(col).isNotNull(), F.struct(*order)))
        return F.sum(col) if kind in ("sum", "all_sum") else F.max(col)

    totals = base.groupBy(*parts).agg(*[total(k, f"_v_{o}").alias(f"_t_{o}") for o, (k, _, _) in specs.items()])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carries = {
        "sum": lambda c: F.sum(c).over(before),
        "max": lambda c: F.max(c).over(before),
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
        "all_sum": lambda c: F.sum(c).over(whole),
        "all_max": lambda c: F.max(c).over(whole),
    }
    carry = totals.select(*parts, *[carries[k](f"_t_{o}").alias(f"_c_{o}") for o, (k, _, _) in specs.items()])
    running = {o: local(k, f"_v_{o}", i) for o, (k, _, i) in specs.items() if not k.startswith("all_")}
    out = (base.withColumns(running) if running else base).join(carry, parts)
    merged = {}
    for o, (k, _, _) in specs.items():
        if k == "sum":
            merged[o] = F.coalesce(F.col(o), F.lit(0)) + F.coalesce(F.col(f"_c_{o}"), F.lit(0))
        elif k == "max":
            merged[o] = F.greatest(F.col(o), F.col(f"_c_{o}"))
        elif k.startswith("all_"):
            merged[o] = F.col(f"_c_{o}")
        else:
            merged[o] = F.coalesce(F.col(o), F.col(f"_c_{o}"))
    drop = [*vals, *[f"_c_{o}" for o in specs]]
    return out.withColumns(merged).drop(*drop)


def islands(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: Column, out: str = "island",
) -> DataFrame:
    """Number maximal runs of equal ``value`` per key, counting from 0.

    Each chunk reports its first value, last value and inner changes; the
    running total over chunks gives the number its first row starts from.
    """
    parts = [*keys, chunk]
    w = Window.partitionBy(*parts).orderBy(*order)
    base = df.withColumn("_iv", value)
    changed = F.coalesce((~F.col("_iv").eqNullSafe(F.lag("_iv").over(w))).cast("int"), F.lit(0))
    first_row = F.row_number().over(w) == 1
    marked = base.withColumn("_chg", F.when(first_row, F.lit(0)).otherwise(changed))
    o = F.struct(*order)
    heads = marked.groupBy(*parts).agg(
        F.min_by("_iv", o).alias("_first"), F.max_by("_iv", o).alias("_last"), F.sum("_chg").alias("_n"))
    wc = Window.partitionBy(*keys).orderBy(chunk)
    edge = F.when(F.lag("_n").over(wc).isNotNull() & ~F.col("_first").eqNullSafe(F.lag("_last").over(wc)), 1).otherwise(0)
    heads = heads.withColumn("_edge", edge)
    up_to = wc.rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.select(*parts, (F.sum(F.col("_n") + F.col("_edge")).over(up_to) - F.col("_n")).alias("_base"))
    numbered = marked.withColumn(out, F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.join(heads, parts).withColumn(out, F.col(out) + F.col("_base")).drop("_base", "_chg", "_iv")


def with_halo(df: DataFrame, keys: Sequence[str], pos: str, reach: int, size: int) -> DataFrame:
    """Cut dense positions into ``_b`` blocks and repeat the ``reach`` rows next to every edge.

    Windows over ``(keys, _b)`` then see ``reach`` neighbours on both sides;
    keep only rows with ``_own`` afterwards.  Repeated rows are 2*reach/size.
    """
    if reach > size:
        raise ValueError("reach must not exceed the block size")
    b = F.floor(F.col(pos) / size)
    off = F.col(pos) % size
    blocks = F.array_compact(F.array(
        b, F.when((off < reach) & (b > 0), b - 1), F.when(off >= size - reach, b + 1)))
    return (df.withColumn("_home", b).withColumn("_b", F.explode(blocks))
            .withColumn("_own", F.col("_home") == F.col("_b")).drop("_home"))


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], chunk: str, how: str = "inner") -> DataFrame:
    """Join one-row-per-key facts to rows through the list of chunks.

    The facts are first spread over the key's chunks (a small join); the big
    join runs on ``(keys, chunk)``, so a huge key is spread over many tasks.
    """
    parts = [*keys, chunk]
    spread = rows.select(*parts).distinct().join(per_key, list(keys), how)
    return rows.join(spread, parts)


LEAST = 2.0 ** -24  # measures below 1 (scores, loudness) have as many bins as those above


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, out: str, fine: int = 64,
) -> DataFrame:
    """Exact linear-interpolated quantile per key for non-negative values, safe for huge keys.

    Equal values collapse first; a logarithmic histogram finds the bins that
    hold the two target ranks; only those bins are ordered.
    """
    keys = list(keys)
    vc = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
          .withColumn("_bin", F.floor(F.log2(F.col("_v") + LEAST) * fine)))
    hist = vc.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_hc"))
    wk = Window.partitionBy(*keys)
    hist = hist.withColumns({
        "_cum": F.sum("_hc").over(wk.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)),
        "_n": F.sum("_hc").over(wk),
    }).withColumn("_lo", F.floor((F.col("_n") - 1) * p)).withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
    lo_edge = F.col("_cum") - F.col("_hc")

    def holds(rank: str) -> Column:
        return (F.col(rank) >= lo_edge) & (F.col(rank) < F.col("_cum"))

    wanted = hist.where(holds("_lo") | holds("_hi")).select(*keys, "_bin", lo_edge.alias("_edge"), "_n", "_lo", "_hi")
    wb = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cand = vc.join(wanted, [*keys, "_bin"]).withColumn("_upto", F.sum("_c").over(wb) + F.col("_edge"))

    def at(rank: str) -> Column:
        inside = (F.col(rank) < F.col("_upto")) & (F.col(rank) >= F.col("_upto") - F.col("_c"))
        return F.max(F.when(inside, F.col("_v")))

    got = cand.groupBy(*keys).agg(at("_lo").alias("_a"), at("_hi").alias("_z"),
                                  F.max((F.col("_n") - 1) * p - F.col("_lo")).alias("_f"))
    return got.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias(out))


def lookahead(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], text: str, reach: int, out: str,
) -> DataFrame:
    """Append to each text the next ``reach`` words of the following rows of the key.

    A phrase of at most ``reach`` words that starts in a row is then wholly
    inside ``out`` even if the speaker's next turns finish it.  Words are split
    on single spaces; a cut text ends in a marker that no phrase contains.
    """
    parts = [*keys, chunk]
    words = F.split(F.col("_lt"), " ")
    head = F.when(F.size(words) > reach, F.concat(F.array_join(F.slice(words, 1, reach), " "), F.lit(" \u0001"))) \
        .otherwise(F.col("_lt"))
    base = df.withColumn("_lt", F.coalesce(F.col(text), F.lit(""))).where(F.col("_lt") != "").withColumn("_head", head)
    w = Window.partitionBy(*parts).orderBy(*order)
    ahead = F.collect_list("_head").over(w.rowsBetween(1, reach))
    first = (base.select(*parts, *order, "_head").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= reach)
             .groupBy(*parts).agg(F.sort_array(F.collect_list(F.struct("_rn", "_head"))).alias("_hs")))
    wc = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(1, reach)
    nxt = F.flatten(F.collect_list(F.transform("_hs", lambda s: s["_head"])).over(wc))
    carry = first.select(*parts, F.array_join(nxt, " ").alias("_carry"))
    # parts that are missing must be null: an empty string would add a second blank between the texts
    full = F.concat_ws(" ", F.col("_lt"), F.when(F.size("_ahead") > 0, F.array_join("_ahead", " ")),
                       F.when(F.size("_ahead") >= reach, F.lit("\u0001")), F.when(F.col("_carry") != "", F.col("_carry")))
    return (base.withColumn("_ahead", ahead).join(carry, parts)
            .withColumn(out, F.trim(full)).drop("_lt", "_head", "_ahead", "_carry"))


def dim(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, bool]:
    """Broadcast a dimension only after counting that it is small; the flag says which."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], salts: int = 16,
                how: str = "inner") -> DataFrame:
    """Equi-join that splits every key of ``big`` over ``salts`` tasks by the ``spread`` columns.

    Size estimates do not see that ``small`` is repeated ``salts`` times, so the
    plan would broadcast it through the driver; the hint keeps it a shuffled join.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")
