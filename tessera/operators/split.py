"""Row keys and the exact, deterministic train/test split.

``row_key``: the user's key column(s) as text, or the md5 of every column (with
null markers) when there is none. Exact copies share a content key; that is fine
because the split only needs them to be interchangeable.

``exact_split`` shuffles by ``h = md5(row_key | seed)`` and puts the
``ceil(test_size * n)`` smallest hashes in the test set, like a seeded shuffle
followed by a cut. The cut is found by one aggregate, never by a sort of the data:
hashes are even, so the cut lies within a few standard deviations of the quantile,
and the hashes there (some ``sqrt(n)``) are counted one by one, those away from it by
their first three hex digits. Only if keys repeat so much that the cut falls outside
and between several hashes is its bucket searched again. Rows below the cut are test,
rows above are train. If the cut falls
inside a group of rows with one key, the group is cut again by a hash of the full
row; rows that are equal even there are exact copies, of which the right number
goes to either side (numbered by per-partition offsets, no single task).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import key_text
from tessera.session import ensure_checkpoint_dir

EXACT_LIMIT = 100_000
PREFIX_STEP = 3  # 4,096 buckets per histogram level
NEAR = 6.0  # standard deviations around the quantile within which hashes are counted one by one


HASH = "__split_hash"


def with_row_key(df: DataFrame, key_cols: list[str] | None = None, name: str = "row_key") -> DataFrame:
    """Append ``name``: text of the key column(s), else md5 of all columns."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"The table has a column named '{name}' already; choose another name for the row key.")
    return df.withColumn(name, key_text(key_cols) if key_cols else F.md5(key_text(df.columns)))


def split_hash(key: str = "row_key", seed: int = 42):
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def n_test_rows(n: int, test_size: float) -> int:
    """``ceil(test_size * n)`` in plain IEEE doubles, unrounded (0.07*100 -> 8)."""
    if isinstance(test_size, float) and 0.0 < test_size < 1.0:
        return int(math.ceil(test_size * n))
    if isinstance(test_size, int) and 0 < test_size < n:
        return test_size
    raise ValueError(f"test_size={test_size!r} should be a float in (0, 1) or an int in (0, {n})")


def _prefix_hist(hashed: DataFrame, prefix: str, width: int, weight: str | None = None) -> list:
    """``[(bucket, n, least, greatest)]`` sorted, for hashes starting with ``prefix`` (Arrow transfer);
    ``weight`` names a column with the rows that a hash stands for."""
    h = F.col(HASH)
    sub = hashed if not prefix else hashed.where(h.startswith(prefix))
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return _rows(sub.groupBy(F.substring(h, 1, width).alias("b")).agg(n.alias("n"), F.min(h).alias("lo"), F.max(h).alias("hi")))


def _rows(hist: DataFrame) -> list:
    pdf = hist.toPandas().sort_values("b")
    return list(zip(pdf["b"].tolist(), pdf["n"].astype("int64").tolist(), pdf["lo"].tolist(), pdf["hi"].tolist()))


def find_cut(hashed: DataFrame, k: int, weight: str | None = None) -> tuple[str, int, int]:
    """Smallest ``t`` with ``count(h <= t) >= k`` (k >= 1); returns ``(t, below, at)``.

    ``below`` = rows with ``h < t``, ``at`` = rows with ``h == t``. A bucket of a
    single hash, however many rows share it, ends the search.
    """
    prefix, below, width = "", 0, PREFIX_STEP
    while True:
        seen = below
        for b, n, lo, hi in _prefix_hist(hashed, prefix, width, weight):
            if seen + n >= k:
                if lo == hi:
                    return lo, seen, n
                prefix, below = b, seen
                width = 32 if n <= EXACT_LIMIT else min(32, width + PREFIX_STEP)
                break
            seen += n
        else:
            raise RuntimeError("split cut not found")


def _hex(x: float) -> str:
    """The fraction ``x`` of the hash range as the first digits of a hash; beyond it ``g`` (above all)."""
    return "" if x <= 0 else "g" if x >= 1 else f"{int(x * 16 ** 12):012x}"


def find_cut_near(hashed: DataFrame, n: int, k: int) -> tuple[str, int, int]:
    """``find_cut`` for hashes of which ``n`` are known to be there, in one pass over them."""
    at = k / n
    reach = NEAR * math.sqrt(at * (1 - at) / n) + NEAR / n
    h = F.col(HASH)
    side = F.when(h < _hex(at - reach), "0").when(h < _hex(at + reach), "1").otherwise("2")
    groups = (hashed.groupBy(F.concat(side, F.when(side == "1", h).otherwise(F.substring(h, 1, PREFIX_STEP))).alias("b"))
              .agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("lo"), F.max(h).alias("hi")))
    many = 2 * reach * n > EXACT_LIMIT
    if many:  # the near hashes, as many as the square root of the rows, stay distributed
        groups = groups.persist(StorageLevel.MEMORY_AND_DISK)
        hist = groups.groupBy(F.when(F.col("b").startswith("1"), "1").otherwise(F.col("b")).alias("b")).agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    else:
        hist = groups
    try:
        below = 0
        for b, rows, lo, hi in _rows(hist):
            if below + rows >= k:
                break
            below += rows
        else:
            raise RuntimeError("split cut not found")
        if lo == hi:
            return lo, below, rows
        if b == "1":
            t, under, equal = find_cut(groups.where(F.col("b").startswith("1")).withColumnRenamed("lo", HASH), k - below, "n")
        else:
            t, under, equal = find_cut(hashed.where(h.between(lo, hi)), k - below)
        return t, below + under, equal
    finally:
        if many:
            groups.unpersist()


def exact_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "row_key",
                flag: str = "is_test") -> DataFrame:
    """``df`` plus a boolean ``flag``; exactly ``ceil(test_size*n)`` test rows."""
    _check_free(df, flag)
    return _split(df.withColumn(HASH, split_hash(key, seed)), test_size, flag, seed)


def exact_split_cached(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "row_key",
                       flag: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """Like ``exact_split``, for inputs that are read many times (model fitting).

    The input with its hash is cached once (``MEMORY_AND_DISK``), so the cut
    passes and every later pass read the cache: the input is scanned and hashed
    once instead of once per pass, and the flag is a comparison on the cached
    hash. Returns ``(split, cached)``; unpersist ``cached`` when done.
    """
    _check_free(df, flag)
    hashed = df.withColumn(HASH, split_hash(key, seed)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _split(hashed, test_size, flag, seed), hashed
    except Exception:
        hashed.unpersist()
        raise


def _check_free(df: DataFrame, flag: str) -> None:
    taken = {c.lower() for c in df.columns} & {flag.lower(), HASH}
    if taken:
        raise ValueError(f"The table has a column named '{taken.pop()}' already; choose another flag column.")


def _split(hashed: DataFrame, test_size: float, flag: str, seed: int) -> DataFrame:
    n = hashed.count()  # reads no column that is not filtered on
    if n == 0:
        raise ValueError("Dataset is empty.")
    k = n_test_rows(n, test_size)
    if k >= n:
        raise ValueError(f"With n_samples={n}, test_size={test_size} the resulting train set will be empty.")
    return _take(hashed, k, flag, seed, n, by_row=False).drop(HASH)


def _take(hashed: DataFrame, k: int, flag: str, seed: int, n: int, by_row: bool) -> DataFrame:
    """``hashed``, which has ``n`` rows, with ``flag`` true on exactly the ``k`` rows of the smallest hashes."""
    t, below, at = find_cut_near(hashed, n, k)
    need = k - below  # rows of the cut hash that are taken, 1..at
    h = F.col(HASH)
    if need >= at:
        return hashed.withColumn(flag, h <= F.lit(t))
    rest = hashed.where(h != F.lit(t)).withColumn(flag, h < F.lit(t))
    group = hashed.where(h == F.lit(t))
    if not by_row:
        # one key, several rows: the full row decides, wherever it lies
        own = [c for c in hashed.columns if c != HASH]
        group = _take(group.withColumn(HASH, F.md5(F.concat_ws("|", key_text(own), F.lit(str(seed))))), need, flag, seed, at, by_row=True)
        return rest.unionByName(group)
    # exact copies: any of them may be taken, so their number is all that counts
    ensure_checkpoint_dir(hashed.sparkSession)
    group = group.checkpoint(eager=True)
    pid = F.spark_partition_id()
    counts = group.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.select("__pid", (F.sum("__c").over(Window.orderBy("__pid")) - F.col("__c")).alias("__off"))
    numbered = (group.withColumn("__pid", pid)
                .withColumn("__pos", F.row_number().over(Window.partitionBy("__pid").orderBy(F.lit(0))) - 1)
                .join(F.broadcast(offsets), "__pid")
                .withColumn(flag, (F.col("__off") + F.col("__pos")) < F.lit(need))
                .drop("__pid", "__pos", "__off"))
    return rest.unionByName(numbered)
