"""Exact k-nearest-neighbour estimation.

Rows are first collapsed: of one feature point at most ``k`` rows can ever be chosen, the ones with
the lowest ids. The search works by grouped aggregates and equi-joins on a grid whose cell widths
are powers of two:

1. every row is counted into its narrowest cell, with the bounding box of the cell; wider cells are
   added up from narrower ones;
2. a query looks up its own cell at every width, or outside the extent of its group the cell of the nearest point inside. Each cell
   that holds ``k`` rows gives an upper bound on the k-th distance (the farthest corner of the box), and so does the whole
   group; the least wins;
3. the query visits the cells that the ball of that radius touches inside the extent, at the narrowest width not
   below half of what is left of the radius there: at most five cells per dimension, for a query far outside too.
   An equi-join fetches their rows, and the exact distances are ranked.

No pair outside the visited cells is formed, and the ball always
holds the k nearest rows, so the result equals brute force. Ties go to the lower row id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayframe import schemas as S
from assayframe.functions import numeric as N, text as X
from assayframe.session import materialize, spread

#: Share of the rows left out at either end when the bulk of a dimension is measured.
TAIL = 0.05
#: Squared distance between two categories, as after a one-hot encoding.
OTHER_CATEGORY = 2.0
#: Widths between the bulk of the data and its whole extent.
OUTER_LEVELS = 6


def _sum(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _square(c: Column) -> Column:
    return c * c


def lowest(rows: DataFrame, keys: Sequence[str], row_id: str, k: int) -> DataFrame:
    """The ``k`` lowest-id rows of each key. Spark limits each task's groups before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(row_id)
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def cell_levels(queries: DataFrame, rows: DataFrame, dims: Sequence[str]) -> list[int]:
    """Exponents of the cell widths, ascending: one aggregate, one row back.

    The narrow ones follow the bulk of the data, so that a far outlier does not widen them; a few wide ones lead up
    to the whole extent. They steer the work only, never the result.
    """
    spans = queries.select(*dims).union(rows.select(*dims)).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims],
        *[F.percentile_approx(d, [TAIL, 1 - TAIL]).alias(f"bulk_{d}") for d in dims],
    ).first()
    ends = [(spans[f"lo_{d}"] or 0.0, spans[f"hi_{d}"] or 0.0) for d in dims]
    extent = max(hi - lo for lo, hi in ends)
    bulk = max(b[1] - b[0] if (b := spans[f"bulk_{d}"]) else 0.0 for d in dims) or extent
    # The widest cells must be wider than any ball inside the extent.
    above = lambda size: math.ceil(math.log2(max(size * math.sqrt(len(dims)), 1.0))) + 1
    top, middle = above(extent), above(bulk)
    bottom = middle - max(6, math.ceil(math.log2(spans["n"] + 1)))
    # Cell numbers must fit 64 bits, however far the data lie from zero.
    bottom = max(bottom, math.ceil(math.log2(max(max(abs(lo), abs(hi), 1.0) for lo, hi in ends))) - 56)
    step = max(2, -(-(top - middle) // OUTER_LEVELS))
    return sorted({*range(bottom, middle, 2), *range(middle, top, step), top})


def _cells(dims: Sequence[str], width: Column) -> list[Column]:
    return [F.floor(F.col(d) / width).cast("bigint").alias(f"_c{i}") for i, d in enumerate(dims)]


def candidates(queries: DataFrame, rows: DataFrame, *, by: Sequence[str], dims: Sequence[str], k: int,
               levels: Sequence[int], query_id: str, carry: Sequence[str], narrowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every row that can be among the ``k`` nearest of a query inside its ``by`` group.

    Returns query_id, by, d2 and the ``carry`` columns; the k nearest are always among them. ``narrowed`` may drop queries or lessen their
    bounds (``_far2``, the squared distance; ``_in_cell``, null where no ``k`` rows are known to lie within it) before rows are fetched.
    """
    widths = [F.struct(F.lit(i).alias("level"), F.lit(2.0 ** i).alias("width")) for i in levels]
    cells = [f"_c{i}" for i in range(len(dims))]
    edges = [f"_{end}_{d}" for d in dims for end in ("lo", "hi")]
    far2 = lambda lo, hi: _sum([F.greatest(_square(F.col(d) - F.col(f"{lo}_{d}")), _square(F.col(d) - F.col(f"{hi}_{d}"))) for d in dims])

    # (1) cell summaries, and the extent of each whole group.
    narrowest = F.lit(2.0 ** levels[0])
    box = [a for d in dims for a in (F.min(d).alias(f"_lo_{d}"), F.max(d).alias(f"_hi_{d}"))]
    again = [(F.min if e.startswith("_lo_") else F.max)(e).alias(e) for e in edges]
    finest = rows.select(*by, *dims, *_cells(dims, narrowest)).groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("_rows"), *box)
    wider = finest.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in levels]))).withColumns({
        c: F.expr(f"shiftright({c}, _level - ({levels[0]}))") for c in cells})
    summary = wider.groupBy(*by, "_level", *cells).agg(F.sum("_rows").alias("_rows"), *again).where(F.col("_rows") >= k)
    whole = finest.groupBy(*by).agg(*again)

    # (2) the least upper bound over all widths. A query outside the extent looks up the cell of the nearest point inside.
    in_cell = summary.select(*by, "_level", *cells, *[F.col(e).alias(f"_in{e}") for e in edges])
    asked = queries.select(query_id, *by, *dims).join(whole, [*by]).withColumns(
        {f"_at_{d}": F.greatest(f"_lo_{d}", F.least(d, f"_hi_{d}")) for d in dims})
    looked_up = asked.withColumn("_w", F.explode(F.array(*widths))).select(
        query_id, *by, *dims, *edges, F.col("_w.level").alias("_level"),
        *[F.floor(F.col(f"_at_{d}") / F.col("_w.width")).cast("bigint").alias(c) for d, c in zip(dims, cells)]).join(
        in_cell, [*by, "_level", *cells], "left")
    least = looked_up.groupBy(query_id, *by, *dims, *edges).agg(F.min(far2("_in_lo", "_in_hi")).alias("_in_cell"))
    bounded = least.withColumn("_far2", F.least("_in_cell", far2("_lo", "_hi")) + 1e-6)
    bounded = narrowed(bounded) if narrowed else bounded

    # (3) visit the touched cells at the narrowest width that is not below half the reach. The part of the distance that a query has
    # to the extent is spent before any row is met, so the reach inside, and with it the cells, stay small for far queries too.
    outside = {d: F.greatest(F.col(f"_lo_{d}") - F.col(d), F.col(d) - F.col(f"_hi_{d}"), F.lit(0.0)) for d in dims}
    spent = bounded.withColumns({f"_out_{d}": gap for d, gap in outside.items()}).withColumn("_spent2", _sum([_square(F.col(f"_out_{d}")) for d in dims]))
    reach = F.sqrt(F.greatest(F.col("_far2") - F.col("_spent2"), F.lit(1e-6)))
    fitting = F.ceil(F.log2(reach)).cast("int") - 1
    wide_enough = F.filter(F.array(*[F.lit(i) for i in levels]), lambda i: i >= fitting)
    visits = spent.withColumn("_level", F.coalesce(F.array_min(wide_enough), F.lit(levels[-1])))
    visits = visits.withColumn("_width", F.pow(F.lit(2.0), F.col("_level")))
    cell_of = lambda x: F.floor(x / F.col("_width")).cast("bigint")
    for d, cell in zip(dims, cells):
        along = F.sqrt(F.greatest(F.col("_far2") - F.col("_spent2") + _square(F.col(f"_out_{d}")), F.lit(0.0)))
        first = F.greatest(F.col(d) - along, F.col(f"_lo_{d}"))
        last = F.least(F.col(d) + along, F.col(f"_hi_{d}"))
        gap = F.greatest(F.col(cell) * F.col("_width") - F.col(d), F.col(d) - (F.col(cell) + 1) * F.col("_width"), F.lit(0.0))
        visits = visits.where(first <= last).withColumn(cell, F.explode(F.sequence(cell_of(first), cell_of(last)))).withColumn(f"_gap_{d}", gap)
    # Corner cells outside the ball are left out.
    touched = visits.where(_sum([_square(F.col(f"_gap_{d}")) for d in dims]) <= F.col("_far2"))
    visits = materialize(spread(touched.select(query_id, *by, *dims, "_far2", "_level", *cells), *by, "_level", *cells))
    # Rows are placed at the widths that some query visits: a few numbers, one for each width.
    used = sorted(r[0] for r in visits.select("_level").distinct().collect())
    placed = rows.withColumn("_w", F.explode(F.array(*[w for w, i in zip(widths, levels) if i in used] or widths[:1]))).select(
        *by, F.col("_w.level").alias("_level"), *_cells(dims, F.col("_w.width")),
        *[F.col(d).alias(f"_p_{d}") for d in dims], *carry)
    d2 = _sum([_square(F.col(d) - F.col(f"_p_{d}")) for d in dims])
    return (
        visits.join(placed, [*by, "_level", *cells])
        .withColumn("d2", F.round(d2, 9)).where(F.col("d2") <= F.col("_far2"))
        .select(query_id, *by, "d2", *carry)
    )


def estimate(queries: DataFrame, rows: DataFrame, *, by: Sequence[str], dims: Sequence[str], category: str,
             value: str, row_id: str, k: int, query_id: str = "query_id") -> DataFrame:
    """Mean ``value`` of the ``k`` rows nearest to each query, with a category in the distance.

    The squared distance is Euclidean over ``dims`` plus 0 for the same category and 2 for another
    one, as after a one-hot encoding. (A category that no row has is 1 from every row; a constant
    does not change which rows are nearest.) Rows and queries without a position (a null in ``dims``)
    take no part.

    The k nearest rows are always among the k nearest of the same category and the k nearest of any
    category, so each query asks for just those two lists. A row of another category is 2 farther: where the query's own category
    has ``k`` rows within a bound, the second list reaches only as far as the bound less 2, and mostly not at all.
    """
    queries, rows = queries.dropna(subset=list(dims)), rows.dropna(subset=list(dims))
    group = [*by, "_any", "_pool"]
    pools = lambda own: F.explode(F.array(
        F.struct(F.lit(False).alias("any"), F.col(own).alias("pool")), F.struct(F.lit(True).alias("any"), F.lit("").alias("pool"))))
    pooled = lambda df, own: df.withColumn("_in", pools(own)).withColumns({"_any": F.col("_in.any"), "_pool": F.col("_in.pool")}).drop("_in")
    points = lowest(pooled(rows, category), [*group, *dims], row_id, k)
    asks = pooled(queries.select(query_id, *by, *dims, F.col(category).alias("_own")), "_own")
    def narrowed(bounded: DataFrame) -> DataFrame:
        own = F.min(F.when(~F.col("_any") & F.col("_in_cell").isNotNull(), F.col("_far2"))).over(Window.partitionBy("_ask", *by))
        reach = F.when(F.col("_any") & F.col("_own2").isNotNull(), F.least("_far2", F.col("_own2") - OTHER_CATEGORY + 1e-6)).otherwise(F.col("_far2"))
        return bounded.withColumn("_own2", own).withColumn("_far2", reach).where("_far2 >= 0").drop("_own2")

    near = candidates(
        asks.withColumn("_ask", F.struct(query_id, "_own")).select("_ask", *group, *dims), points, by=group, dims=dims,
        k=k, levels=cell_levels(queries, rows, dims), query_id="_ask", carry=[row_id, category, value], narrowed=narrowed)
    same = F.col(category) == F.col("_ask._own")
    # In the list over any category, rows of the query's own one are repeats.
    scored = near.where(~F.col("_any") | ~same).select(
        F.col(f"_ask.{query_id}").alias(query_id), row_id, F.col(value).alias("_value"),
        F.round(F.col("d2") + F.when(same, 0.0).otherwise(OTHER_CATEGORY), 9).alias("d2"))
    order = Window.partitionBy(query_id).orderBy("d2", row_id)
    return (
        scored.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
        .groupBy(query_id)
        .agg(F.avg("_value").alias("estimate"), F.count(F.lit(1)).cast("int").alias("n_neighbors"))
    )


def _point_id(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


def knn_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Carbon count, temperature, additive category (null is a level) and raw concentration."""
    return df.select(
        *keep,
        X.count_char(F.col(S.SUBJECT)).cast("double").alias("carbons"),
        N.finite_or(F.col(S.TEMPERATURE), None).alias("temp"),
        F.coalesce(F.col(S.ADDITIVE), F.lit("")).alias("additive"),
        N.finite_or(F.col(S.CONCENTRATION), None).alias("conc"),
    )


def collapse_rows(train: DataFrame, *, row_id: str, target: str, by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Training rows that can ever be chosen: of those with a target, the ``k`` lowest ids of each distinct feature point."""
    base = knn_features(train.where(N.finite_or(F.col(target), None).isNotNull()), [F.col(row_id).alias("row_id"), *by, F.col(target).alias("y")])
    return lowest(base, [*by, "carbons", "temp", "additive", "conc"], "row_id", k)


def impute_concentration(rows: DataFrame, points: DataFrame, *, by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """For each distinct (carbons, temp, additive) of ``points`` without concentration: the mean
    concentration of the k nearest training rows that have one, rounded to six places, since it
    enters later distances. 0 where no training row has one."""
    keys = [*by, "carbons", "temp", "additive"]
    gaps = points.where(F.col("conc").isNull()).select(*keys).distinct().withColumn("query_id", _point_id(keys))
    filled = estimate(gaps, rows.where(F.col("conc").isNotNull()), by=by, dims=["carbons", "temp"],
                      category="additive", value="conc", row_id="row_id", k=k)
    return gaps.join(filled, "query_id", "left").select(
        *keys, F.coalesce(F.round("estimate", 6), F.lit(0.0)).alias("_filled"))


def _with_imputed(df: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(lookup, list(keys), "left").withColumn("conc", F.coalesce("conc", "_filled")).drop("_filled")


def knn_predict(train: DataFrame, queries: DataFrame, *, row_id: str = "sample_id", target: str = S.TARGET,
                keep: Sequence[str] = (), by: Sequence[str] = (), k: int = 5,
                prediction: str = "predicted_pcmc") -> DataFrame:
    """Uniform k-nearest-neighbour regression; ``by`` columns (a fold, say) keep searches apart.

    Returns the ``keep`` and ``by`` columns of every query row with its prediction. The search works
    on two small written tables: choosable training rows and distinct query points.
    """
    keys = [*by, "carbons", "temp", "additive"]
    rows = materialize(spread(collapse_rows(train, row_id=row_id, target=target, by=by, k=k), "row_id"))
    asked = knn_features(queries, [*keep, *by]).withColumn(
        "point_id", _point_id([*keys, "conc"]))
    points = materialize(spread(asked.select("point_id", *keys, "conc").distinct(), "point_id"))
    lookup = materialize(impute_concentration(
        rows, rows.select(*keys, "conc").unionByName(points.select(*keys, "conc")), by=by, k=k))
    scored = estimate(_with_imputed(points, lookup, keys), _with_imputed(rows, lookup, keys), by=by,
                      dims=["carbons", "temp", "conc"], category="additive", value="y", row_id="row_id", k=k,
                      query_id="point_id")
    answers = scored.select("point_id", F.col("estimate").alias(prediction))
    return asked.join(answers, "point_id", "left").select(*keep, *by, prediction)
