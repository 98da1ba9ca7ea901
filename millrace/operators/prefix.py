"""Ordered computations that stay distributed when one key holds much of the data.

A plain window puts every row of a key into one task. Here the ordered key space is
cut into ranges first: each range is summed, the small table of range totals gets the
running offsets, and rows are ordered only inside their own range. Range edges come
from a sketch, so they steer balance only; results never depend on them. There is one form
for all sizes, and a null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import split_count

_BUCKET = "__range"
_SUB = "__subrange"
TREE_EDGES = 64


Edge = float | str


def _comparable(column: Column, kind: T.DataType) -> Column:
    """The column as its edges are given: text as it is, everything else as a number."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp").cast("double")
    return column.cast("double")


def _splittable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType))


def range_edges(
    df: DataFrame, columns: Sequence[str], splits: int | None = None
) -> dict[str, list[Edge]]:
    """Approximate quantile edges per column, at most ``splits`` each.

    Numbers and times come from one sketch pass; text from the ten values per split that come first
    by hash.
    """
    spark = df.sparkSession
    splits = splits or split_count(spark)
    usable = [c for c in columns if _splittable(df.schema[c].dataType)]
    if not usable:
        return {}
    fractions = [i / splits for i in range(1, splits)]
    text = [c for c in usable if isinstance(df.schema[c].dataType, T.StringType)]
    numbers = [c for c in usable if c not in text]
    found: dict[str, list[Edge]] = {}
    if numbers:
        sketch = lambda c: F.percentile_approx(_comparable(F.col(c), df.schema[c].dataType), fractions, max(1000, splits * 10))
        row = df.agg(*[sketch(c).alias(c) for c in numbers]).first()
        found |= {c: sorted(set(row[c] or [])) for c in numbers}
    for c in text:
        sample = df.select(c).where(F.col(c).isNotNull()).orderBy(F.xxhash64(c), c).limit(10 * splits).collect()
        values = sorted(r[0] for r in sample)
        found[c] = sorted({values[int(f * len(values))] for f in fractions} if values else set())
    return found


def _range_tree(value: Column, edges: Sequence[Edge], first: int) -> Column:
    """The search as nested conditions, which compile; ``edges`` start at number ``first``."""
    if not edges:
        return F.lit(2 * first)
    at = len(edges) // 2
    edge = F.lit(edges[at])
    low, high = _range_tree(value, edges[:at], first), _range_tree(value, edges[at + 1 :], first + at + 1)
    return F.when(value < edge, low).when(value == edge, 2 * (first + at) + 1).otherwise(high)


def range_of(value: Column, edges: Sequence[Edge]) -> Column:
    """Monotone range number of ``value``; a value equal to an edge has a range of its own.

    The edges are a constant of the plan and are searched by halving: by conditions, or beyond
    ``TREE_EDGES`` in an array.
    """
    if not edges:
        return F.lit(0)
    if len(edges) <= TREE_EDGES:
        return F.when(value.isNull(), 0).otherwise(_range_tree(value, [e if isinstance(e, str) else float(e) for e in edges], 0))
    constant = F.array(*[F.lit(e if isinstance(e, str) else float(e)) for e in edges])
    steps = []
    step = 1
    while step <= len(edges):
        steps.append(step)
        step *= 2
    below = F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda found, s: found
        + F.when(F.get(constant, found + s - 1) < value, s).otherwise(F.lit(0)),
    )
    return F.aggregate(
        F.array(below),
        F.lit(0),
        lambda _, at: at * 2 + F.when(F.get(constant, at) == value, 1).otherwise(0),
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the keys appear once, as they are on the left."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"__right_{k}"])
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def with_ranges(
    df: DataFrame, order: Sequence[str], edges: Mapping[str, Sequence[Edge]]
) -> DataFrame:
    """Tag rows with a range pair that sorts like ``order``.

    The second number cuts up a single first-column value (a hot day, a hot score) by
    the second order column.
    """
    first = order[0]
    kind = df.schema[first].dataType
    primary = (
        range_of(_comparable(F.col(first), kind), edges[first]) if edges.get(first) else F.lit(0)
    )
    out = df.withColumn(_BUCKET, primary)
    if len(order) > 1 and edges.get(order[1]):
        second = order[1]
        sub = range_of(_comparable(F.col(second), df.schema[second].dataType), edges[second])
        return out.withColumn(_SUB, F.when(F.col(_BUCKET) % 2 == 1, sub).otherwise(F.lit(0)))
    return out.withColumn(_SUB, F.lit(0))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    *,
    inclusive: bool = False,
    totals: bool = False,
    edges: Mapping[str, Sequence[Edge]] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Per key and row, the sums over earlier rows (``inclusive`` adds the row itself).

    ``totals`` adds ``<name>_total`` over the whole key.
    ``source`` holds the same rows before any earlier running step; the range totals are
    taken from it, so that a chain of steps does not evaluate its own past twice over.
    """
    keys = list(keys)
    source = df if source is None else source
    if edges is None:
        edges = range_edges(source, list(order)[:2])
    tagged = with_ranges(df, order, edges)
    summed = tagged if source is df else with_ranges(source, order, edges)
    spot = [*keys, _BUCKET, _SUB]
    across = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = across.orderBy(_BUCKET, _SUB).rowsBetween(Window.unboundedPreceding, -1)
    range_sums = summed.groupBy(*spot).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = range_sums.select(
        *spot,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__off_{n}") for n in sums],
        *([F.sum(n).over(across).alias(f"{n}_total") for n in sums] if totals else []),
    )
    inside = (
        Window.partitionBy(*spot)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    ran = tagged.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__run_{n}") for n, c in sums.items()]
    )
    joined = null_safe_join(ran, offsets, spot)
    extra = [f"{n}_total" for n in sums] if totals else []
    return joined.select(
        *df.columns,
        *[(F.col(f"__off_{n}") + F.col(f"__run_{n}")).alias(n) for n in sums],
        *extra,
    )


def key_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    chunk_rows: int,
    *,
    edges: Mapping[str, Sequence[Edge]] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Rows with the chunk of their key that holds them: ``__chunk``, ``__size`` rows in it, and per sum ``__off_<name>`` over the chunks before.

    Keys of up to ``chunk_rows`` rows are one chunk; of the others, consecutive ranges are taken together
    until they hold about so many rows, and rows equal in the first two order columns are never parted.
    The rows do not move: the chunks are no more than one per ``chunk_rows`` rows and half of them, so
    they are sent to the tasks. ``source`` holds the same rows before any earlier running step.
    """
    keys = list(keys)
    source = df if source is None else source
    if edges is None:
        edges = range_edges(source, list(order)[:2])
    spot = [*keys, _BUCKET, _SUB]
    large = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk_rows).drop("__n")
    cut = null_safe_join(source, F.broadcast(large), keys) if keys else source
    cells = with_ranges(cut, order, edges).groupBy(*spot).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_BUCKET, _SUB).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda n: F.coalesce(F.sum(n).over(before), F.lit(0))
    offsets = [f"__off_{n}" for n in sums]
    chunks = (
        cells.select(*spot, "__n", F.floor(so_far("__n") / chunk_rows).cast("long").alias("__chunk"), *[so_far(n).alias(o) for n, o in zip(sums, offsets)])
        .groupBy(*keys, "__chunk")
        .agg(F.min(F.struct(_BUCKET, _SUB, *offsets)).alias("__first"), F.sum("__n").alias("__size"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct(F.col(f"__first.{_BUCKET}").alias("r"), F.col(f"__first.{_SUB}").alias("s"), "__chunk", "__size", *[f"__first.{o}" for o in offsets])).alias("__chunks"))
    )
    tagged = with_ranges(df, order, edges)
    found = null_safe_join(tagged, F.broadcast(chunks), keys, "left")
    reached = lambda c: (c["r"] < F.col(_BUCKET)) | ((c["r"] == F.col(_BUCKET)) & (c["s"] <= F.col(_SUB)))
    return found.withColumn("__own", F.array_max(F.filter("__chunks", reached))).select(
        *df.columns,
        F.coalesce("__own.__chunk", F.lit(0)).alias("__chunk"),
        F.col("__own.__size").alias("__size"),
        *[F.coalesce(f"__own.{o}", F.lit(0)).alias(o) for o in offsets],
    )


def _row_count(weight: Column | None) -> Column:
    if weight is None:
        return F.count("__v")
    return F.sum(F.when(F.col("__v").isNotNull(), weight).otherwise(F.lit(0)))


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    sums: Mapping[str, Column] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, plus the non-null count ``n``.

    Equal values are counted first, so only distinct values are ordered, and the
    ordering of a large key is spread over ranges. ``sums`` adds plain sums per key
    from the same pass; rows with a null value count there only. With ``weight`` a row
    stands for so many rows of its value, as in a table of counts.
    """
    keys, sums = list(keys), dict(sums or {})
    rows = df.withColumn("__v", F.col(value))
    edges = range_edges(rows, ["__v"])
    counts = rows.groupBy(*keys, "__v").agg(
        _row_count(weight).alias("__c"), *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()]
    )
    ranked = running_totals(
        counts, keys, ["__v"], {"__before": F.col("__c")}, totals=True, edges=edges
    )
    picks = []
    for name, fraction in fractions.items():
        place = F.lit(fraction) * (F.col("__before_total") - 1)
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__c"))
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"{name}_{end}"))
    found = ranked.groupBy(*keys).agg(
        F.max("__before_total").alias("n"),
        *[F.sum(f"__s_{name}").alias(name) for name in sums],
        *picks,
    )

    def between(name: str, fraction: float) -> Column:
        place = F.lit(fraction) * (F.col("n") - 1)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (low.cast("double") + (high - low).cast("double") * (place - F.floor(place))).alias(name)

    return found.select(*keys, "n", *sums, *[between(n, f) for n, f in fractions.items()])


# The sketch's rank error is one part in SKETCH; a bracket reaches MARGIN such parts to either side.
SKETCH = 1000
MARGIN = 2
# Values inside the brackets of a column that one window orders; more are ordered in ranges.
WINDOW_VALUES = 1_000_000


def _interpolated(name: str, fraction: float) -> Column:
    place = F.lit(fraction) * (F.col("n") - 1)
    low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    return (low + (high - low) * (place - F.floor(place))).alias(name)


def _column_brackets(df: DataFrame, values: Sequence[Column], fractions: Sequence[float], margin: float) -> list[tuple[int, list[tuple[float | None, float | None]]]]:
    """Per column the number of its values and a bracket around each rank; None is an open end."""
    ends = [min(max(f + side * margin / SKETCH, 0.0), 1.0) for f in fractions for side in (-1, 1)]
    row = df.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
        *[F.percentile_approx(v, ends, SKETCH).alias(f"q{i}") for i, v in enumerate(values)],
    ).first()
    found = []
    for i in range(len(values)):
        q = row[f"q{i}"] or [None] * len(ends)
        pairs = [
            (q[2 * j] if f - margin / SKETCH > 0 else None, q[2 * j + 1] if f + margin / SKETCH < 1 else None)
            for j, f in enumerate(fractions)
        ]
        found.append((row[f"n{i}"], pairs))
    return found


def column_quantiles(df: DataFrame, columns: Sequence[str], fractions: Mapping[str, float], label: str = "column") -> DataFrame:
    """(label, n, quantiles): exact linear-interpolation quantiles of some numeric columns, nulls left out.

    All columns share each of three scans: mergeable sketches put a bracket around every rank, a
    count says how many values lie below and inside, and the values inside, a few in a thousand,
    are counted and ordered. Should a rank lie outside its bracket, which the error of a sketch
    rules out, wider brackets are taken, at last open ones.
    """
    spark = df.sparkSession
    values = [F.col(c).cast("double") for c in columns]
    asked = list(fractions.values())
    for margin in (MARGIN, 10 * MARGIN, SKETCH):
        brackets = _column_brackets(df, values, asked, margin)
        entries, counted = [], []
        for i, (column, v, (_, pairs)) in enumerate(zip(columns, values, brackets)):
            held = [(F.lit(True) if a is None else v >= a) & (F.lit(True) if b is None else v <= b) for a, b in pairs]
            kept = F.lit(False)
            for one in held:
                kept = kept | one
            entries.append(F.when(kept & v.isNotNull(), F.struct(F.lit(column).alias(label), v.alias("__v"))))
            counted.append(F.count_if(kept & v.isNotNull()).alias(f"in{i}"))
            for j, ((a, _), one) in enumerate(zip(pairs, held)):
                below = F.lit(False) if a is None else v < a
                # Below the bracket, in all and in none of the others; and inside it.
                counted += [F.count_if(below).alias(f"b{i}_{j}"), F.count_if(below & ~kept).alias(f"g{i}_{j}"), F.count_if(one).alias(f"h{i}_{j}")]
        row = df.agg(*counted).first()
        missed = False
        for i, (n, pairs) in enumerate(brackets):
            for j, f in enumerate(asked):
                start, place = row[f"b{i}_{j}"], f * (n - 1)
                missed = missed or (n > 0 and not (start <= int(place) and -(-place // 1) < start + row[f"h{i}_{j}"]))
        if not missed:
            break
    inside = df.select(F.inline(F.array_compact(F.array(*entries)))).groupBy(label, "__v").agg(F.count(F.lit(1)).alias("__c"))
    if max(row[f"in{i}"] for i in range(len(columns))) > WINDOW_VALUES:
        ranked = running_totals(inside, [label], ["__v"], {"__before": F.col("__c")})
    else:
        order = Window.partitionBy(label).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
        ranked = inside.withColumn("__before", F.coalesce(F.sum("__c").over(order), F.lit(0)))
    of = lambda make: F.element_at(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), make(i))]), F.col(label))
    picks = []
    for j, (name, f) in enumerate(fractions.items()):
        low, high = (of(lambda i, e=e: F.lit(brackets[i][1][j][e]).cast("double")) for e in (0, 1))
        start = F.col("__before") + of(lambda i: F.lit(row[f"g{i}_{j}"]))
        held = (low.isNull() | (F.col("__v") >= low)) & (high.isNull() | (F.col("__v") <= high))
        place = F.lit(f) * (of(lambda i: F.lit(brackets[i][0])) - 1)
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when(held & (start <= rank) & (rank < start + F.col("__c")), F.col("__v"))).alias(f"{name}_{end}"))
    known = spark.createDataFrame([(c, n) for c, (n, _) in zip(columns, brackets)], f"`{label}` string, n bigint")
    found = known.join(ranked.groupBy(label).agg(*picks), label, "left")
    return found.select(label, "n", *[_interpolated(n, f) for n, f in fractions.items()])
