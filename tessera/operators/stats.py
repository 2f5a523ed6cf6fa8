"""Fused column statistics.

* ``numeric_summary``: one grouped aggregate over the unpivoted numeric columns
  for counts, min, max, mean, population variance and a ``percentile_approx``
  bracket around the median (a bounded sketch per column).
* ``exact_order_stats`` / ``exact_medians``: exact order statistics by distributed
  selection. ``median``/``percentile`` aggregate every distinct value into one map
  in a single final task, which does not hold at scale. The sketch bracket is
  checked and refined: each pass counts the values below it and builds an
  equal-width histogram inside the current bracket (partial aggregation, so only
  ``bins`` rows per partition are shuffled), keeps the bin holding the wanted rank
  and narrows the bracket to that bin's observed min/max. Once a bin is small
  enough, its distinct values are counted and the rank is read off exactly.
* ``category_stats``: unpivot -> ``groupBy(column, value).count()`` (map-side
  combine, so a hot value costs one row per partition) -> mode with the
  smallest-value tie rule and the sorted category dictionary, on the driver up to
  ``DRIVER_LEVELS`` levels and as a DataFrame beyond.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import as_text, num_value
from tessera.operators.dictionary import ranked

HIST_BINS = 1024
EXACT_LIMIT = 50_000     # distinct values that a pass may bring to the driver, over all columns together
BLOCK_COLUMNS = 100      # columns of one grouped sketch: the aggregate keeps to its hash map up to 128 groups
WIDTH_PASSES = 3         # passes with equal-width bins before brackets are cut by rank
MAX_PASSES = 64
DRIVER_LEVELS = 100_000  # levels of all category dictionaries together that are held on the driver
SKETCH_ACCURACY = 2000   # percentile_approx relative rank error 1/2000: a bounded sketch per column
SKETCH_SLACK = 3.0       # bracket = sketch quantiles at p -/+ SKETCH_SLACK / accuracy


def _c(name: str):
    return F.col(f"`{name}`")


def long_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot to ``(ci, v)``: one row per (input row, numeric column), nulls kept.

    Grouping this by ``ci`` keeps the plan the same size for 2 or 2,000 columns
    (a wide ``agg`` with 5 expressions per column costs seconds of codegen), and
    partial aggregation shuffles only ``len(cols)`` rows per partition.
    """
    items = [F.struct(F.lit(i).alias("ci"), num_value(_c(c)).alias("v")) for i, c in enumerate(cols)]
    return df.select(F.explode(F.array(*items)).alias("s")).select("s.ci", "s.v")


@dataclass
class NumericSummary:
    rows: int
    count: dict[str, int]
    min: dict[str, float | None]
    max: dict[str, float | None]
    mean: dict[str, float | None]
    var_pop: dict[str, float | None]
    bracket: dict[str, tuple[float, float]] = field(default_factory=dict)


def numeric_summary(df: DataFrame, cols: list[str], median_bracket: bool = True) -> NumericSummary:
    """One pass: row count and per-column count/min/max/mean/var_pop, plus a
    sketch bracket around the median (``percentile_approx``, bounded memory)."""
    if not cols:
        return NumericSummary(int(df.count()), {}, {}, {}, {}, {})
    aggs = [F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.min("v").alias("lo"),
            F.max("v").alias("hi"), F.avg("v").alias("mu"), F.var_pop("v").alias("var")]
    eps = SKETCH_SLACK / SKETCH_ACCURACY
    if median_bracket:
        aggs.append(F.percentile_approx("v", [max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)], SKETCH_ACCURACY)
                    .alias("q"))
    by: dict[int, tuple] = {}
    for at in range(0, len(cols), BLOCK_COLUMNS):
        part = long_numeric(df, cols[at:at + BLOCK_COLUMNS]).groupBy("ci").agg(*aggs).toPandas()
        by.update({at + int(r.ci): r for r in part.itertuples(index=False)})
    out = NumericSummary(max((int(r.rows) for r in by.values()), default=0), {}, {}, {}, {}, {})

    def val(x):
        return None if x is None or x != x else float(x)

    for i, c in enumerate(cols):
        r = by.get(i)
        if r is None:  # no rows at all
            out.count[c], out.min[c], out.max[c], out.mean[c], out.var_pop[c] = 0, None, None, None, None
            continue
        out.count[c] = int(r.n)
        out.min[c], out.max[c], out.mean[c], out.var_pop[c] = val(r.lo), val(r.hi), val(r.mu), val(r.var)
        if median_bracket and r.q is not None and len(r.q) == 2 and r.n > 0:
            out.bracket[c] = (float(r.q[0]), float(r.q[1]))
    return out


@dataclass
class _Target:
    col: str
    rank: int            # 0-based rank among the non-null values
    lo: float
    hi: float
    below: int | None = 0  # number of values < lo (None: count it in the next pass)
    exact: bool = False    # next pass counts distinct values instead of bins
    inside: int = 0        # number of values in lo..hi, where known
    value: float | None = None
    done: bool = False


def exact_order_stats(df: DataFrame, wanted: dict[str, list[int]], summary: NumericSummary | None = None,
                      bins: int = HIST_BINS, exact_limit: int = EXACT_LIMIT,
                      brackets: dict[str, tuple[float, float]] | None = None) -> dict[tuple[str, int], float]:
    """Exact k-th smallest non-null value for each ``(column, k)``.

    Each pass unpivots the numeric columns to ``(ci, v)`` and joins the small
    probe table ``(ci, probe, lo, hi, mode)``, so the plan has the same size for
    any number of columns; values below a probe's bracket are counted, values
    inside it are binned (or kept exact when few), everything else is dropped
    before the shuffle.

    ``brackets`` (e.g. sketch quantiles) seed the search; a bracket that turns
    out not to contain the rank is widened to the full range, so the answer
    never depends on the sketch being right.
    """
    cols = list(wanted)
    summary = summary or numeric_summary(df, cols, median_bracket=False)
    brackets = brackets or {}
    exact_limit = max(1, exact_limit // max(1, sum(map(len, wanted.values()))))
    targets: list[_Target] = []
    for c, ranks in wanted.items():
        for k in ranks:
            if not 0 <= k < summary.count[c]:
                raise ValueError(f"rank {k} out of range for column {c}")
            t = _Target(c, k, float(summary.min[c]), float(summary.max[c]))
            if c in brackets and brackets[c][0] <= brackets[c][1]:
                t.lo, t.hi, t.below = brackets[c][0], brackets[c][1], None
                # a sketch bracket holds about 4 * SKETCH_SLACK / accuracy of the values
                t.exact = summary.count[c] * 4 * SKETCH_SLACK / SKETCH_ACCURACY <= exact_limit
            if t.lo == t.hi and t.below == 0:
                t.value, t.done = t.lo, True
            elif summary.count[c] <= exact_limit:
                t.exact = True
            targets.append(t)

    for n_pass in range(MAX_PASSES):
        active = [t for t in targets if not t.done]
        if not active:
            break
        if n_pass >= WIDTH_PASSES:
            _cut_by_rank(df, cols, [t for t in active if not t.exact and t.inside])
        probes: dict[tuple, int] = {}
        for t in active:
            probes.setdefault((t.col, t.lo, t.hi, t.exact, t.below is None), len(probes))
        # one row per probe (at most 2 per numeric column): a bounded broadcast side
        ci = {c: i for i, c in enumerate(cols)}
        probe_df = df.sparkSession.createDataFrame(
            [(ci[c], pid, lo, hi, exact, below) for (c, lo, hi, exact, below), pid in probes.items()],
            "ci int, p int, lo double, hi double, exact boolean, count_below boolean")
        used = sorted({c for (c, *_rest) in probes})
        long = long_numeric(df, cols).where(F.col("ci").isin([ci[c] for c in used]) & F.col("v").isNotNull())
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        binned = F.least(F.floor((v - lo) * F.lit(float(bins)) / (hi - lo)), F.lit(float(bins - 1)))
        key = (F.when(v < lo, F.lit(float("-inf")))
               .when(F.col("exact"), v)
               .when(hi > lo, binned)
               .otherwise(F.lit(0.0)))
        hist = (long.join(F.broadcast(probe_df), "ci")
                .where(v.between(lo, hi) | (F.col("count_below") & (v < lo)))
                .select("p", key.alias("b"), F.when(v >= lo, v).alias("v"))
                .groupBy("p", "b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                .toPandas().sort_values(["p", "b"]))
        by_probe = {int(p): g for p, g in hist.groupby("p")}
        for t in active:
            key = (t.col, t.lo, t.hi, t.exact, t.below is None)
            rows = by_probe.get(probes[key])
            rows = [] if rows is None else list(rows.itertuples(index=False))
            if t.below is None:
                t.below = int(sum(r.n for r in rows if r.b == float("-inf")))
                rows = [r for r in rows if r.b != float("-inf")]
                inside = sum(r.n for r in rows)
                if not (t.below <= t.rank < t.below + inside):
                    # the sketch bracket missed: fall back to the full range
                    t.lo, t.hi, t.below, t.inside = float(summary.min[t.col]), float(summary.max[t.col]), 0, summary.count[t.col]
                    t.exact = summary.count[t.col] <= exact_limit
                    continue
            seen = t.below
            for r in rows:
                if seen + r.n > t.rank:
                    if t.exact or r.mn == r.mx:
                        t.value, t.done = float(r.mn), True
                    else:
                        t.lo, t.hi, t.below, t.inside = float(r.mn), float(r.mx), seen, int(r.n)
                        t.exact = r.n <= exact_limit
                    break
                seen += int(r.n)
            else:
                raise RuntimeError(f"selection lost rank {t.rank} of {t.col}")
    if any(not t.done for t in targets):
        raise RuntimeError("exact selection did not converge")
    return {(t.col, t.rank): t.value for t in targets}


def _cut_by_rank(df: DataFrame, cols: list[str], targets: list[_Target]) -> None:
    """Narrow each target's bracket to a few of 256 sketched quantiles of the values inside it.

    Equal-width bins gain little where values spread over many exponents; quantiles cut the number of
    values whatever their spread. The next pass counts below the new bracket, so the sketch need not be right."""
    if not targets:
        return
    ci = {c: i for i, c in enumerate(cols)}
    probes = df.sparkSession.createDataFrame([(ci[t.col], k, t.lo, t.hi) for k, t in enumerate(targets)], "ci int, p int, lo double, hi double")
    grid = [i / 256 for i in range(257)]
    rows = (long_numeric(df, cols).join(F.broadcast(probes), "ci").where(F.col("v").between(F.col("lo"), F.col("hi")))
            .groupBy("p").agg(F.percentile_approx("v", grid, SKETCH_ACCURACY).alias("q")).collect())
    for r in rows:
        t = targets[r["p"]]
        at = int((t.rank - t.below) / t.inside * 256)
        lo, hi = r["q"][max(0, at - 1)], r["q"][min(256, at + 2)]
        if (lo, hi) != (t.lo, t.hi):
            t.lo, t.hi, t.below = lo, hi, None


def exact_medians(df: DataFrame, cols: list[str], summary: NumericSummary | None = None) -> dict[str, float | None]:
    """Exact interpolated median (mean of the two middle values) per column."""
    summary = summary or numeric_summary(df, cols)
    wanted = {}
    for c in cols:
        m = summary.count[c]
        if m > 0:
            wanted[c] = sorted({(m - 1) // 2, m // 2})
    found = exact_order_stats(df, wanted, summary, brackets=summary.bracket) if wanted else {}
    out: dict[str, float | None] = {}
    for c in cols:
        m = summary.count[c]
        if m == 0:
            out[c] = None
        else:
            out[c] = (found[(c, (m - 1) // 2)] + found[(c, m // 2)]) / 2.0
    return out


def imputed_moments(summary: NumericSummary, medians: dict[str, float | None]) -> tuple[dict, dict]:
    """Mean and population std of each column *after* median filling.

    The m filled rows all sit at the median M, so the moments follow from the
    non-null ones with the parallel-variance rule, without another pass.
    """
    means, stds = {}, {}
    n = summary.rows
    for c, med in medians.items():
        k = summary.count[c]
        if med is None or n == 0:
            continue
        m = n - k
        mu1, var1 = summary.mean[c], summary.var_pop[c] or 0.0
        mean = (k * mu1 + m * med) / n
        m2 = k * var1 + (mu1 - med) ** 2 * k * m / n
        means[c] = mean
        stds[c] = max(m2 / n, 0.0) ** 0.5
    return means, stds


@dataclass
class CategoryStats:
    n_distinct: dict[str, int]
    mode: dict[str, str | None]
    categories: dict[str, list[str]] = field(default_factory=dict)       # of the columns held on the driver
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    dictionary: DataFrame | None = None                                  # (position, column, value, idx) of the other ones
    positions: dict[str, int] = field(default_factory=dict)              # their numbers in it
    filled: dict[str, tuple[int, int, int]] = field(default_factory=dict)  # their (values, mode's count, sum of squared counts)


def value_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(position, column, value, n)`` for every non-null value of every column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    items = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                      as_text(_c(c), types[c]).alias("value")) for i, c in enumerate(cols)]
    long = (df.select(F.explode(F.array(*items)).alias("s")).select("s.*")
            .where(F.col("value").isNotNull()))
    return long.groupBy("position", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def modes_frame(vc: DataFrame) -> DataFrame:
    """``(position, column, n_distinct, mode, mode_count)``; ties go to the smallest value.

    In two steps: the greatest count of each column (numbers only, a hash aggregate), then the smallest
    text among the values that reach it, so no aggregate carries texts through all distinct values."""
    top = vc.groupBy("position", "column").agg(F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("mode_count"))
    # one row per column: broadcast
    ties = vc.join(F.broadcast(top), ["position", "column"]).where(F.col("n") == F.col("mode_count"))
    return ties.groupBy("position", "column", "n_distinct", "mode_count").agg(F.min("value").alias("mode")).select(
        "position", "column", "n_distinct", "mode", "mode_count")


def category_stats(df: DataFrame, cols: list[str], with_categories: bool = True, driver_levels: int | None = None) -> CategoryStats:
    """Modes and dictionaries. Dictionaries are held on the driver as long as all of them together have at most
    ``driver_levels`` levels; beyond that, smallest columns first, the other columns' stay a DataFrame
    (``dictionary``). ``with_categories=False`` wants none."""
    limit = DRIVER_LEVELS if driver_levels is None else driver_levels
    if not cols:
        return CategoryStats({}, {}, {})
    vc = value_counts_long(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_distinct = {c: 0 for c in cols}
        mode: dict[str, str | None] = {c: None for c in cols}
        held = list(cols)
        out = CategoryStats(n_distinct, mode)
        if not with_categories or vc.count() > limit:
            for r in modes_frame(vc).collect():
                n_distinct[r["column"]], mode[r["column"]] = int(r["n_distinct"]), r["mode"]
            if not with_categories:
                return out
            held = []
            for c in sorted(cols, key=n_distinct.get):
                if sum(n_distinct[h] for h in held) + n_distinct[c] <= limit:
                    held.append(c)
            joined = [c for c in cols if c not in held]
            wide = vc.where(F.col("column").isin(joined))
            squares = wide.groupBy("column").agg(F.sum("n").alias("s"), F.max("n").alias("m"), F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).alias("q"))
            out.filled = {r["column"]: (int(r["s"]), int(r["m"]), int(r["q"])) for r in squares.collect()}
            out.dictionary = ranked(wide)
            out.positions = {c: cols.index(c) for c in joined}
        if held:
            out.counts = {c: {} for c in held}
            own = vc if len(held) == len(cols) else vc.where(F.col("column").isin(held))
            for r in own.select("column", "value", "n").toPandas().itertuples(index=False):
                out.counts[r.column][r.value] = int(r.n)
            for c, values in out.counts.items():
                n_distinct[c] = len(values)
                mode[c] = min(values, key=lambda v: (-values[v], v)) if values else None
            out.categories = {c: sorted(v) for c, v in out.counts.items()}
        return out
    finally:
        vc.unpersist()
