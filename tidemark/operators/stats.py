"""Column statistics, exact quantiles, histograms and profiles.

All columns are handled in one pass per step; only per-column results reach the driver.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..types import value_type

BINS = 20
MAX_FLOAT = sys.float_info.max

# Values a quantile bracket may hold before one aggregate buffer orders them.
BRACKET_ROWS = 100_000
_ACCURACY = 2_000

# Values of a bracket an estimate looks at.  A wrong estimate is found by the exact counts
# that follow and tried again, so this never changes a result.
_SAMPLE = 1_000_000


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: UTC epoch seconds for times, 0/1 for booleans, no NaN."""
    data_type = df.schema[name].dataType
    column = F.col(name)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")) / 1e6
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("double") * 86400
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("double")
    number = column.cast("double")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), number)
    return number


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probabilities: list[float],
    limit: int = BRACKET_ROWS,
    base: dict[str, tuple] | None = None,
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles without ordering a whole column in one task.

    Each round brackets every wanted rank around an approximate quantile and counts exactly
    what lies below and inside, until a confirmed bracket holds at most ``limit`` different
    values.  Those are then ordered exactly, each with its number, so ties take no room: a
    column of few values needs no round at all.  A round is one job over all columns.  ``base``
    gives (count, min, max, estimated different values) per column if they are known already.
    """
    values = df.select(*[c.alias(n) for n, c in columns.items()])
    if base is None:
        row = values.agg(
            *[
                F.struct(F.count(c), F.min(c), F.max(c), F.approx_count_distinct(c)).alias(f"b{i}")
                for i, c in enumerate(F.col(f"`{n}`") for n in columns)
            ]
        ).first()
        base = {n: tuple(row[f"b{i}"]) for i, n in enumerate(columns)}
    found: dict[tuple[str, int], float | None] = {}
    # (column, probability index) -> (low, high, values below low, values inside, rank,
    # different values inside)
    open_: dict[tuple[str, int], tuple] = {}
    for name in columns:
        n, lo, hi, different = base[name]
        for j, p in enumerate(probabilities):
            if n == 0 or lo == hi:
                found[name, j] = lo
            else:
                open_[name, j] = (lo, hi, 0, n, p * (n - 1), _most(different, n))
    attempt = 0
    while wide := {k: v for k, v in open_.items() if v[5] > limit}:
        open_ |= _narrow(values, wide, found, attempt)
        open_ = {k: v for k, v in open_.items() if k not in found}
        attempt += 1
    if open_:
        groups = _by_bracket(open_)
        aggs = []
        for i, ((name, lo, hi), keys) in enumerate(groups.items()):
            shares = [_share(open_[key]) for key in keys]
            aggs.append(F.percentile(_inside(name, lo, hi), shares).alias(f"q{i}"))
        row = values.agg(*aggs).first()
        for i, keys in enumerate(groups.values()):
            found |= dict(zip(keys, row[f"q{i}"]))
    return {n: [found[n, j] for j in range(len(probabilities))] for n in columns}


def _most(different: int, inside: int) -> int:
    """Bound of the different values behind an estimate of them (five standard errors)."""
    return min(inside, math.ceil(different * 1.25) + 1)


def _inside(name: str, lo, hi) -> Column:
    column = F.col(f"`{name}`")
    return F.when(column.between(lo, hi), column)


def _share(bracket: tuple) -> float:
    """Wanted rank as a share of the values inside the bracket."""
    _, _, below, inside, rank, _ = bracket
    return 0.0 if inside == 1 else min(max((rank - below) / (inside - 1), 0.0), 1.0)


def _by_bracket(brackets: dict) -> dict[tuple, list]:
    """(column, low, high) -> keys: ranks that share a bracket share one aggregate."""
    groups: dict[tuple, list] = {}
    for key, (lo, hi, *_) in brackets.items():
        groups.setdefault((key[0], lo, hi), []).append(key)
    return groups


def _narrow(values: DataFrame, brackets: dict, found: dict, seed: int) -> dict:
    """Replace each bracket by a narrower one that provably still holds its rank."""
    groups = _by_bracket(brackets)
    aggs = []
    for i, ((name, lo, hi), keys) in enumerate(groups.items()):
        around = []
        rate = min(1.0, _SAMPLE / brackets[keys[0]][3])
        # Rank error of the sketch, and five standard errors of a sampled quantile.
        margin = 2.0 / _ACCURACY + (2.5 / math.sqrt(_SAMPLE) if rate < 1 else 0.0)
        for key in keys:
            share = _share(brackets[key])
            around += [max(share - margin, 0.0), min(share + margin, 1.0)]
        looked_at = F.when(F.col("__u") < rate, _inside(name, lo, hi))
        aggs.append(F.percentile_approx(looked_at, around, _ACCURACY).alias(f"a{i}"))
    row = values.withColumn("__u", F.rand(seed)).agg(*aggs).first()
    guess = {}
    for i, keys in enumerate(groups.values()):
        for j, key in enumerate(keys):
            if row[f"a{i}"] is not None:
                guess[key] = tuple(row[f"a{i}"][2 * j : 2 * j + 2])
    counts = []
    for i, ((name, _), (lo, hi)) in enumerate(guess.items()):
        column = F.col(f"`{name}`")
        counts.append(F.count_if(column < lo).alias(f"b{i}"))
        counts.append(F.count_if(column.between(lo, hi)).alias(f"c{i}"))
        counts.append(F.approx_count_distinct(_inside(name, lo, hi)).alias(f"d{i}"))
        counts.append(F.count_if(column == lo).alias(f"l{i}"))
        counts.append(F.count_if(column == hi).alias(f"h{i}"))
    if not counts:
        return brackets
    counted = values.agg(*counts).first()
    narrowed = dict(brackets)
    for i, (key, (lo, hi)) in enumerate(guess.items()):
        old, below, inside = brackets[key], counted[f"b{i}"], counted[f"c{i}"]
        rank = old[4]
        low_end, high_begin = below + counted[f"l{i}"], below + inside - counted[f"h{i}"]
        if not (below <= math.floor(rank) and math.ceil(rank) < below + inside):
            narrowed[key] = old
        elif math.ceil(rank) < low_end:
            # The rank lies in the ties of an edge.
            found[key] = lo
        elif math.floor(rank) >= high_begin:
            found[key] = hi
        else:
            narrowed[key] = (lo, hi, below, inside, rank, _most(counted[f"d{i}"], inside))
    return narrowed


_PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe_groups(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """(groups, column, count, mean, stddev, min, max) in one map-side aggregation.

    Rows are not unpivoted: every group is one row of moments before it becomes one per column.
    """
    number = {c: as_number(df, c) for c in columns}
    aggs = [
        F.struct(
            F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"),
            F.min(x).alias("min"), F.max(x).alias("max"),
        ).alias(f"__{i}")
        for i, (c, x) in enumerate(number.items())
    ]
    wide = df.groupBy(*groups).agg(*aggs)
    return wide.select(*groups, F.inline(F.array(*[f"__{i}" for i in range(len(columns))])))


def describe_numeric(
    df: DataFrame, columns: list[str] | None = None, approximate: bool = False
) -> DataFrame:
    """One row per column: count, mean, std, min, p25, p50, p75, max."""
    columns = columns or numeric_columns(df)
    exprs = {n: as_number(df, n) for n in columns}
    values = df.select(*[c.alias(f"c{i}") for i, c in enumerate(exprs.values())])
    aggs = []
    for i in range(len(columns)):
        c = F.col(f"c{i}")
        aggs.append(
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                *([] if approximate else [F.approx_count_distinct(c).alias("different")]),
            ).alias(f"s{i}")
        )
        if approximate:
            aggs.append(F.percentile_approx(c, list(_PERCENTILES.values()), 10_000).alias(f"q{i}"))
    if approximate:
        row = values.agg(*aggs)
    else:
        return _describe_exact(df, exprs, values.agg(*aggs).first())
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                *[F.col(f"s{i}.{f}").alias(f) for f in ("count", "mean", "std", "min")],
                *[F.col(f"q{i}")[j].alias(q) for j, q in enumerate(_PERCENTILES)],
                F.col(f"s{i}.max").alias("max"),
            )
            for i, name in enumerate(columns)
        ]
    )
    return row.select(F.inline(rows))


def _describe_exact(df: DataFrame, exprs: dict[str, Column], row) -> DataFrame:
    """Statistics table from the collected aggregates, one row per column."""
    base = {n: tuple(row[f"s{i}"][f] for f in ("count", "min", "max", "different")) for i, n in enumerate(exprs)}
    quantiles = exact_quantiles(df, exprs, list(_PERCENTILES.values()), base=base)
    rows = []
    for i, name in enumerate(exprs):
        s = row[f"s{i}"]
        rows.append((name, s["count"], s["mean"], s["std"], s["min"], *quantiles[name], s["max"]))
    numbers = ", ".join(f"{f} double" for f in ("mean", "std", "min", *_PERCENTILES, "max"))
    return df.sparkSession.createDataFrame(rows, f"column string, count long, {numbers}")


def _long(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """(column, value) rows of several columns."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("column"), c.alias("value")) for n, c in exprs.items()]
    )
    return df.select(F.inline(pairs))


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, unique, top and freq per column; ties go to the smallest value."""
    counted = (
        _long(df, {c: F.col(c).cast("string") for c in columns})
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("v")))
    return (
        counted.groupBy("column")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b"))
        .select("column", "count", "unique", F.col("b.v").alias("top"), (-F.col("b.n")).alias("freq"))
    )


def value_edges(df: DataFrame, columns: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """(column, edges): equal-width edges between min and max; a constant gets +-0.5."""
    columns = columns or numeric_columns(df)
    values = df.select(*[as_number(df, n).alias(f"c{i}") for i, n in enumerate(columns)])
    row = values.agg(
        *[f(F.col(f"c{i}")).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("lo", F.min), ("hi", F.max))]
    )

    def edges(i: int) -> Column:
        flat = F.col(f"lo{i}") == F.col(f"hi{i}")
        lo = F.when(flat, F.col(f"lo{i}") - 0.5).otherwise(F.col(f"lo{i}"))
        hi = F.when(flat, F.col(f"hi{i}") + 0.5).otherwise(F.col(f"hi{i}"))
        steps = F.sequence(F.lit(0), F.lit(bins))
        return F.transform(
            steps, lambda k: F.when(k == bins, hi).otherwise(lo + (hi - lo) * k / bins)
        )

    rows = F.array(
        *[F.struct(F.lit(n).alias("column"), edges(i).alias("edges")) for i, n in enumerate(columns)]
    )
    return row.select(F.inline(rows)).where(F.col("edges")[0].isNotNull())


def edges_by_group(
    df: DataFrame, groups: list[str], columns: list[str], bins: int = BINS, padded: bool = False
) -> DataFrame:
    """(groups, column, edges): ``value_edges`` per group, in one aggregate."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), as_number(df, c).alias("x")) for c in columns]
    )
    bounds = (
        df.select(*groups, F.inline(cells))
        .where(F.col("x").isNotNull())
        .groupBy(*groups, "column")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    low, high = F.col("lo") - half, F.col("hi") + half
    edges = F.transform(
        F.sequence(F.lit(0), F.lit(bins)),
        lambda k: F.when(k == bins, high).otherwise(low + (high - low) * k / bins),
    )
    return bounds.select(*groups, "column", (pad_edges(edges) if padded else edges).alias("edges"))


def collect_edges(edges: DataFrame) -> dict[str, list[float]]:
    """Edges on the driver: one short list per column."""
    return {r["column"]: list(r["edges"]) for r in edges.select("column", "edges").collect()}


def histogram_on_edges(
    df: DataFrame,
    edges: dict[str, list[float]],
    groups: list[str] | None = None,
) -> DataFrame:
    """Counts per (groups, column, bin) on given edges; the last bin includes its right end.

    Columns without edges are dropped, null, NaN and outside values are not counted, and
    every bin of every group appears.  The shuffle carries at most one row per bin, column
    and group from each map task.
    """
    groups = groups or []
    known = [n for n in edges if n in df.columns]
    if not known:
        raise SpecError("no column of the data has reference edges")
    layouts = {n: Layout(edges[n]) for n in known}
    rows = df.select(*groups, *[as_number(df, n).alias(f"__x{i}") for i, n in enumerate(known)])
    # Two steps, so that each estimate is evaluated once per row.
    rows = rows.select("*", *[layouts[n].estimate(F.col(f"__x{i}")).alias(f"__p{i}") for i, n in enumerate(known)])
    cells = [
        F.struct(F.lit(n).alias("column"), layouts[n].settle(F.col(f"__x{i}"), F.col(f"__p{i}")).alias("bin"))
        for i, n in enumerate(known)
    ]
    counted = (
        rows.select(*groups, F.inline(F.array(*cells)))
        .where(F.col("bin").isNotNull())
        .groupBy(*groups, "column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    wide = counted.groupBy(*groups, "column").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")
    )
    shape = F.create_map(*[x for n in known for x in (F.lit(n), F.array(*[F.lit(float(e)) for e in edges[n]]))])
    bounds = shape[F.col("column")]
    cells = F.transform(
        F.sequence(F.lit(0), F.size(bounds) - 2),
        lambda b: F.struct(
            b.alias("bin"),
            F.get(bounds, b).alias("lo"),
            F.get(bounds, b + 1).alias("hi"),
            F.coalesce(F.element_at(F.col("m"), b), F.lit(0)).cast("long").alias("n"),
        ),
    )
    return wide.select(*groups, "column", F.inline(cells))


class Layout:
    """Bins of one column: equal-width inner edges need no search, others a short chain."""

    def __init__(self, edges: list[float]):
        self.edges = [float(e) for e in edges]
        self.padded = len(edges) > 3 and edges[0] == -MAX_FLOAT and edges[-1] == MAX_FLOAT
        self.first = 1 if self.padded else 0
        self.inner = self.edges[1:-1] if self.padded else self.edges
        self.bins = len(self.inner) - 1
        self.low, self.high = self.inner[0], self.inner[-1]
        self.width = (self.high - self.low) / self.bins
        self.uniform = all(
            math.isclose(e, self.low + self.width * i, rel_tol=1e-12, abs_tol=self.width * 1e-9)
            for i, e in enumerate(self.inner)
        )

    def estimate(self, value: Column) -> Column:
        """Inner bin of a value, possibly one off at an edge."""
        if self.uniform:
            near = F.floor((value - self.low) / self.width).cast("int")
            return F.when(value.between(self.low, self.high), near)
        chain = F.when(value.isNull(), F.lit(None).cast("int"))
        for i in range(self.bins - 1):
            chain = chain.when(value < self.inner[i + 1], F.lit(i))
        return chain.otherwise(F.lit(self.bins - 1))

    def settle(self, value: Column, estimate: Column) -> Column:
        """Final bin: compared with the edges themselves, the last one closed on the right."""
        bounds = F.array(*[F.lit(e) for e in self.inner])
        return settled_bin(
            value, estimate, bounds, F.lit(self.bins), F.lit(self.low), F.lit(self.high),
            F.lit(self.padded), F.lit(self.first),
        )


def settled_bin(
    value: Column, estimate: Column, bounds: Column, bins: Column, low: Column, high: Column,
    padded: Column, first: Column,
) -> Column:
    """Bin index from an estimate that may be one off; null outside unpadded edges."""
    shift = F.when(value < F.get(bounds, estimate), -1).when(
        (estimate < bins - 1) & (value >= F.get(bounds, estimate + 1)), 1
    ).otherwise(0)
    return (
        F.when(value.between(low, high), F.least(estimate + shift, bins - 1) + first)
        .when(padded & (value < low), F.lit(0))
        .when(padded & (value > high), bins + 1)
    )


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """(column, bin, lo, hi, n) with ``bins`` equal bins between min and max."""
    return histogram_on_edges(df, collect_edges(value_edges(df, columns, bins)))


def pad_edges(edges: Column) -> Column:
    """Open the outer ends with one bin each; already padded edges stay."""
    padded = F.concat(F.array(F.lit(-MAX_FLOAT)), edges, F.array(F.lit(MAX_FLOAT)))
    done = (F.element_at(edges, 1) == -MAX_FLOAT) & (F.element_at(edges, -1) == MAX_FLOAT)
    return F.when(done, edges).otherwise(padded)


def pad_histogram(hist: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Add empty outer bins to a (column, bin, lo, hi, n) histogram."""
    groups = groups or []
    per = hist.groupBy(*groups, "column").agg(
        F.sort_array(F.collect_list(F.struct("bin", "lo", "hi", "n"))).alias("h")
    )
    first, last = F.element_at("h", 1), F.element_at("h", -1)
    before = F.struct(
        (first["bin"] - 1).alias("bin"), F.lit(-MAX_FLOAT).alias("lo"), first["lo"].alias("hi"),
        F.lit(0).cast("long").alias("n"),
    )
    after = F.struct(
        (last["bin"] + 1).alias("bin"), last["hi"].alias("lo"), F.lit(MAX_FLOAT).alias("hi"),
        F.lit(0).cast("long").alias("n"),
    )
    done = (first["lo"] == -MAX_FLOAT) & (last["hi"] == MAX_FLOAT)
    padded = F.when(done, F.col("h")).otherwise(F.concat(F.array(before), F.col("h"), F.array(after)))
    numbered = F.transform(
        padded,
        lambda c, i: F.struct(i.alias("bin"), c["lo"].alias("lo"), c["hi"].alias("hi"), c["n"].alias("n")),
    )
    return per.select(*groups, "column", F.inline(numbered))


def infer_schema(df: DataFrame, entities: list[str], timestamp_key: str | None = None) -> list[dict]:
    """Role and value type of every column."""
    return [
        {
            "name": f.name,
            "role": "entity" if f.name in entities else "timestamp" if f.name == timestamp_key else "feature",
            "value_type": value_type(f.dataType),
        }
        for f in df.schema
    ]


def schema_table(df: DataFrame, entities: list[str], timestamp_key: str | None = None) -> DataFrame:
    """``infer_schema`` with the count of non-null values of each column."""
    fields = infer_schema(df, entities, timestamp_key)
    row = df.agg(*[F.count(F.col(f["name"])).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = F.array(
        *[
            F.struct(
                F.lit(f["name"]).alias("name"),
                F.lit(f["role"]).alias("role"),
                F.lit(f["value_type"]).alias("value_type"),
                F.col(f"n{i}").alias("non_null"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return row.select(F.inline(rows))


def vector_stats(tables: dict[str, DataFrame], fields: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Statistics of a vector's features, taken from its sets under their aliases."""
    parts = []
    for owner, pairs in fields.items():
        alias = F.create_map(*[x for n, a in pairs for x in (F.lit(n), F.lit(a or n))])
        table = tables[owner]
        parts.append(
            table.where(F.col("column").isin([n for n, _ in pairs])).withColumn("column", alias[F.col("column")])
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def preview(df: DataFrame, rows: int = 20, max_columns: int | None = None, order: list[str] | None = None) -> DataFrame:
    """First rows and columns of a frame."""
    df = df.select(*df.columns[:max_columns]) if max_columns else df
    return (df.orderBy(*order) if order else df).limit(rows)


def sample_by_hash(df: DataFrame, keys: list[str], fraction: float, seed: str = "") -> DataFrame:
    """Rows whose hashed keys fall into the fraction: the same rows in every run and table."""
    if not 0 <= fraction <= 1:
        raise SpecError("fraction must lie in [0, 1]")
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.where(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < int(fraction * 2**32))


def sample_rows(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def profile(df: DataFrame, rows: int = 20, stats: bool = True) -> dict:
    """Header, schema, length, preview and statistics of a dataset."""
    found = {
        "header": df.columns,
        "schema": infer_schema(df, []),
        "length": df.count(),
        "preview": preview(df, rows),
    }
    if stats:
        found["stats"] = describe_numeric(df)
    return found
