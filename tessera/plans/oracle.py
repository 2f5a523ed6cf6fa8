"""DuckDB oracle SQL for the registered queries (same column names, same rounding).

Ridge and logistic regression are solved in SQL too (normal equations and
Newton steps by Gauss-Jordan elimination in recursive CTEs). Queries whose
results come from randomised fits (forests, k-means, isolation forest) have no
entry: the driver then checks rows only, and pytest checks their properties.
"""

from __future__ import annotations

from tessera.plans.views import with_views

#: The oracle's own reading of whole numbers, numbers and booleans (not the engine's patterns).
_WHOLE = "^[ \\t]*[-+]?[0-9]{1,}[ \\t]*$"
_NUMBER = "(?i)^[ \\t]*[-+]?(([0-9]{1,}[.]?[0-9]*|[.][0-9]{1,})(e[-+]?[0-9]{1,})?|inf|infinity)[ \\t]*$"
_BOOLEAN = ["True", "TRUE", "true", "False", "FALSE", "false"]

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(values: list[str]) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _infer(table: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        v = f"CAST({c} AS VARCHAR)"
        parts.append(f"""
        SELECT {i} AS position, {_q(c)} AS "column",
               CASE WHEN count({v}) = 0 THEN 'double'
                    WHEN count_if(regexp_matches({v}, {_q(_WHOLE)}) AND TRY_CAST(trim({v}) AS BIGINT) IS NOT NULL)
                         = count({v}) THEN 'bigint'
                    WHEN count_if(regexp_matches({v}, {_q(_NUMBER)})) = count({v}) THEN 'double'
                    WHEN count_if({v} IN {_in_list(_BOOLEAN)}) = count({v}) THEN 'boolean'
                    ELSE 'string' END AS inferred_type
        FROM {table}""")
    return "\nUNION ALL".join(parts)


_DTYPE = """CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int'
                 WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type = 'VARCHAR' THEN 'string'
                 WHEN data_type = 'BOOLEAN' THEN 'boolean'
                 WHEN data_type = 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp'
                 WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz'
                 ELSE lower(data_type) END"""


def _dtypes(table: str) -> str:
    return f"""
        SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS "column", {_DTYPE} AS dtype,
               CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT')
                         OR data_type LIKE 'DECIMAL%' THEN 'numeric'
                    WHEN data_type IN ('VARCHAR', 'BOOLEAN') THEN 'categorical' ELSE 'excluded' END AS role
        FROM information_schema.columns WHERE table_name = {_q(table)}"""


def _missing(table: str, cols: list[str]) -> str:
    return "\nUNION ALL".join(
        f"\n        SELECT {i} AS position, {_q(c)} AS \"column\", count(*) - count({c}) AS n_missing FROM {table}"
        for i, c in enumerate(cols))


def _text_cols(cols: list[str]) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)


def _csv_field(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return (f"coalesce(CASE WHEN regexp_matches({v}, '[,\"\\r\\n]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"' "
            f"ELSE {v} END, '')")


def _head_csv(table: str, cols: list[str], key: str, n: int) -> str:
    return f"""
        SELECT 0 AS line_no, {_q(','.join(cols))} AS line
        UNION ALL
        SELECT CAST(row_number() OVER (ORDER BY {key}) AS INTEGER) AS line_no,
               concat_ws(',', {', '.join(_csv_field(c) for c in cols)}) AS line
        FROM (SELECT * FROM {table} ORDER BY {key} LIMIT {n})"""


def _mode_cte(table: str, col: str, name: str) -> str:
    return (f"{name} AS (SELECT {col} AS v FROM {table} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} ASC LIMIT 1)")


def _modes(table: str, cols: list[str]) -> str:
    vc = "\nUNION ALL ".join(
        f"SELECT {_q(c)} AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)
    return f"""
        WITH vc AS ({vc}),
        r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC) AS rn,
                     count(*) OVER (PARTITION BY "column") AS nd, max(n) OVER (PARTITION BY "column") AS mc FROM vc)
        SELECT "column", nd AS n_distinct, value AS mode, mc AS mode_count FROM r WHERE rn = 1"""


_CLS_CTE = """
    c AS (SELECT y_true, y_pred, count(*) AS n FROM labels_pred GROUP BY y_true, y_pred),
    lab AS (SELECT y_true AS l FROM c UNION SELECT y_pred FROM c),
    per AS (SELECT l,
                   coalesce((SELECT sum(n) FROM c WHERE c.y_true = lab.l), 0) AS support,
                   coalesce((SELECT sum(n) FROM c WHERE c.y_pred = lab.l), 0) AS predicted,
                   coalesce((SELECT sum(n) FROM c WHERE c.y_true = lab.l AND c.y_pred = lab.l), 0) AS tp
            FROM lab),
    m AS (SELECT CAST(sum(support) AS BIGINT) AS n,
                 CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy,
                 sum(CAST(support AS DOUBLE) * CASE WHEN support + predicted = 0 THEN 0.0
                     ELSE 2.0::DOUBLE * tp / CAST(support + predicted AS DOUBLE) END) / CAST(sum(support) AS DOUBLE)
                     AS f1_weighted
          FROM per)"""


def _bin(v: str, mn: str, mx: str, bins: int) -> str:
    lo = f"(CASE WHEN {mn} = {mx} THEN {mn} - 0.5 ELSE {mn} END)"
    hi = f"(CASE WHEN {mn} = {mx} THEN {mx} + 0.5 ELSE {mx} END)"
    return f"LEAST(CAST(floor(({v} - {lo}) * {float(bins)} / ({hi} - {lo})) AS INTEGER), {bins - 1})"


_LINE_KEY = "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)"

def _newton_logreg(steps: int = 12) -> str:
    """Newton iterations for min 0.5*w^2 + sum(logloss) (C = 1, free intercept) on one z-scored feature."""
    ctes = ["it0 AS (SELECT 0.0::DOUBLE AS w, 0.0::DOUBLE AS b)"]
    for i in range(1, steps + 1):
        ctes.append(f"""
        g{i} AS (SELECT it{i - 1}.w AS w, it{i - 1}.b AS b,
                        it{i - 1}.w + sum((p - y) * z) AS gw, sum(p - y) AS gb,
                        1 + sum(p * (1 - p) * z * z) AS hww, sum(p * (1 - p) * z) AS hwb, sum(p * (1 - p)) AS hbb
                 FROM (SELECT z, y, 1 / (1 + exp(-(it{i - 1}.w * z + it{i - 1}.b))) AS p FROM train, it{i - 1}) t, it{i - 1}
                 GROUP BY it{i - 1}.w, it{i - 1}.b),
        it{i} AS (SELECT w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb) AS w,
                         b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) AS b FROM g{i})""")
    return ",".join(ctes)


_LOGREG_SQL = f"""
        WITH base AS (SELECT {{key}} AS row_key, l_extendedprice AS x, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS y
                      FROM lineitem),
        ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', row_key, '42'))) AS rn,
                          count(*) OVER () AS n FROM base),
        flag AS (SELECT *, rn <= CEIL(0.2::DOUBLE * n) AS is_test FROM ranked),
        med AS (SELECT median(x) AS m FROM flag WHERE NOT is_test),
        mom AS (SELECT avg(coalesce(x, m)) AS mu, stddev_pop(coalesce(x, m)) AS sd FROM flag, med WHERE NOT is_test),
        zs AS (SELECT flag.*, (coalesce(x, m) - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM flag, med, mom),
        train AS (SELECT z, y FROM zs WHERE NOT is_test),
        {_newton_logreg()}
        SELECT CASE WHEN y = 1 THEN 'True' ELSE 'False' END AS y_true,
               CASE WHEN w * z + b > 0 THEN 'True' ELSE 'False' END AS y_pred, count(*) AS n
        FROM zs, it12 WHERE is_test GROUP BY 1, 2"""

def _design(key: str, table: str, num: list[str], cat: str, target: str) -> str:
    """CTEs shared by the model oracles: the exact split, median fill, z-scores and one-hot levels of the train rows.

    ``feats`` is long-form ``(rn, is_test, y, fid, v)``, ``rn`` being the split rank (unique even where keys
    repeat); fids ``0..len(num)-1`` are the z-scores, then one per train level of ``cat`` in sorted order."""
    p_num = len(num)
    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(num))
    meds = ", ".join(f"median(x{i}) AS m{i}" for i in range(p_num))
    unpiv = "\n            UNION ALL ".join(
        f"SELECT rn, is_test, y, {i} AS fid, coalesce(x{i}, m{i}) AS v FROM flag, med" for i in range(p_num))
    return f"""
        base AS (SELECT {key} AS row_key, {xs}, CAST({cat} AS VARCHAR) AS c,
                        CAST(({target}) AS DOUBLE) AS y FROM {table} WHERE ({target}) IS NOT NULL),
        ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', row_key, '42'))) AS rn,
                          count(*) OVER () AS n FROM base),
        flag AS (SELECT *, rn <= CEIL(0.2::DOUBLE * n) AS is_test FROM ranked),
        med AS (SELECT {meds} FROM flag WHERE NOT is_test),
        cmode AS (SELECT c AS mode FROM flag WHERE NOT is_test AND c IS NOT NULL
                  GROUP BY c ORDER BY count(*) DESC, c LIMIT 1),
        levels AS (SELECT DISTINCT coalesce(c, mode) AS lv FROM flag, cmode WHERE NOT is_test),
        lvl AS (SELECT lv, {p_num} - 1 + row_number() OVER (ORDER BY lv) AS fid FROM levels),
        raw AS ({unpiv}),
        mom AS (SELECT fid, avg(v) AS mu, stddev_pop(v) AS sd FROM raw WHERE NOT is_test GROUP BY fid),
        feats AS (SELECT raw.rn, raw.is_test, raw.y, raw.fid,
                         (raw.v - mom.mu) / CASE WHEN mom.sd = 0 THEN 1 ELSE mom.sd END AS v
                  FROM raw JOIN mom ON raw.fid = mom.fid
                  UNION ALL
                  SELECT flag.rn, flag.is_test, flag.y, lvl.fid,
                         CASE WHEN coalesce(flag.c, cmode.mode) = lvl.lv THEN 1.0 ELSE 0.0 END
                  FROM flag, cmode, lvl),
        nfeat AS (SELECT count(DISTINCT fid) AS p FROM feats)"""


def _gauss_jordan(name: str, aug: str, size: str) -> str:
    """Recursive CTE ``name(k, i, j, v)``: Gauss-Jordan elimination of the augmented matrix ``aug(i, j, v)``
    (rows ``0..size-1``, right-hand side in column ``size``), one pivot per step; the solution is column ``size``
    at ``k = size``. The matrices here are symmetric positive definite, so no pivoting is needed."""
    return f"""
        {name}(k, i, j, v) AS (
            SELECT 0, i, j, v FROM {aug}
            UNION ALL
            SELECT k + 1, i, j, CASE WHEN i = k THEN v / pkk ELSE v - pik * pkj / pkk END
            FROM (SELECT k, i, j, v,
                         max(CASE WHEN i = k AND j = k THEN v END) OVER () AS pkk,
                         max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS pkj,
                         max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS pik
                  FROM {name} WHERE k < {size}) t)"""


def _ridge_report(key: str, table: str, num: list[str], cat: str, target: str, alpha: float = 1.0) -> str:
    """Ridge (alpha, free intercept) on the design of ``_design``, solved in SQL: the centred normal equations
    (X'X + alpha*I) w = X'y by Gauss-Jordan elimination. The result is the report's rmse and r2 (3 decimals)."""
    return f"""
        WITH RECURSIVE {_design(key, table, num, cat, target)},
        xbar AS (SELECT fid, avg(v) AS xb FROM feats WHERE NOT is_test GROUP BY fid),
        ybar AS (SELECT avg(y) AS yb FROM flag WHERE NOT is_test),
        cx AS (SELECT f.rn, f.y - ybar.yb AS yc, f.fid, f.v - xbar.xb AS vc
               FROM feats f JOIN xbar ON f.fid = xbar.fid, ybar WHERE NOT f.is_test),
        aug AS (SELECT a.fid AS i, b.fid AS j,
                       sum(a.vc * b.vc) + CASE WHEN a.fid = b.fid THEN {float(alpha)} ELSE 0.0 END AS v
                FROM cx a JOIN cx b ON a.rn = b.rn GROUP BY a.fid, b.fid
                UNION ALL
                SELECT fid, (SELECT p FROM nfeat), sum(vc * yc) FROM cx GROUP BY fid),
        {_gauss_jordan("gj", "aug", "(SELECT p FROM nfeat)")},
        w AS (SELECT i AS fid, v AS w FROM gj WHERE k = (SELECT p FROM nfeat) AND j = (SELECT p FROM nfeat)),
        b0 AS (SELECT max(ybar.yb) - sum(w.w * xbar.xb) AS b FROM w JOIN xbar ON w.fid = xbar.fid, ybar),
        pred AS (SELECT f.rn, max(f.y) AS y_true, max(b0.b) + sum(w.w * f.v) AS y_pred
                 FROM feats f JOIN w ON f.fid = w.fid, b0 WHERE f.is_test GROUP BY f.rn),
        m AS (SELECT sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
                     1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) AS r2 FROM pred)
        SELECT 'rmse' AS metric, round(rmse, 3) AS value FROM m
        UNION ALL SELECT 'r2', round(r2, 3) FROM m"""


def _logreg_results(key: str, table: str, num: list[str], cat: str, target: str, steps: int = 12) -> str:
    """Binary logistic regression, 0.5*|w|^2 + sum(logloss) (C = 1, free intercept), by Newton's method in SQL.

    Each step forms the gradient and the Hessian over the train rows and solves for the Newton step by
    Gauss-Jordan elimination. The result is ``(row_key, y_true, y_pred)`` for every test row."""
    p = "(SELECT p FROM nfeat)"
    ctes = [f"""
        xi AS (SELECT rn, is_test, fid, v FROM feats UNION ALL SELECT rn, is_test, {p}, 1.0 FROM flag),
        xt AS (SELECT x.rn, x.fid, x.v, f.y FROM xi x JOIN flag f ON x.rn = f.rn WHERE NOT x.is_test),
        w0 AS (SELECT DISTINCT fid, 0.0::DOUBLE AS w FROM xi)"""]
    for t in range(1, steps + 1):
        ctes.append(f"""
        e{t} AS (SELECT x.rn, 1 / (1 + exp(-sum(x.v * w.w))) AS pr FROM xt x JOIN w{t - 1} w ON x.fid = w.fid
                 GROUP BY x.rn),
        a{t} AS (SELECT a.fid AS i, b.fid AS j,
                        sum(e.pr * (1 - e.pr) * a.v * b.v) + CASE WHEN a.fid = b.fid AND a.fid < {p} THEN 1.0
                                                              ELSE 0.0 END AS v
                 FROM xt a JOIN xt b ON a.rn = b.rn JOIN e{t} e ON e.rn = a.rn GROUP BY a.fid, b.fid
                 UNION ALL
                 SELECT x.fid, {p} + 1, sum((e.pr - x.y) * x.v) + CASE WHEN x.fid < {p} THEN max(w.w) ELSE 0.0 END
                 FROM xt x JOIN e{t} e ON x.rn = e.rn JOIN w{t - 1} w ON w.fid = x.fid GROUP BY x.fid),
        {_gauss_jordan(f"gj{t}", f"a{t}", f"{p} + 1")},
        w{t} AS (SELECT w.fid, w.w - g.v AS w FROM w{t - 1} w JOIN gj{t} g ON g.i = w.fid
                 WHERE g.k = {p} + 1 AND g.j = {p} + 1)""")
    return f"""
        WITH RECURSIVE {_design(key, table, num, cat, target)},{",".join(ctes)},
        eta AS (SELECT x.rn, sum(x.v * w.w) AS eta FROM xi x JOIN w{steps} w ON x.fid = w.fid WHERE x.is_test
                GROUP BY x.rn)
        SELECT f.row_key, CASE WHEN f.y = 1 THEN 'True' ELSE 'False' END AS y_true,
               CASE WHEN eta.eta > 0 THEN 'True' ELSE 'False' END AS y_pred
        FROM flag f JOIN eta ON f.rn = eta.rn"""


_TOP_MISSING_ORDERS = f"SELECT * FROM ({_missing('orders_nulls', ORDERS_COLS)}) ORDER BY n_missing DESC, position LIMIT 10"

ORACLE_SQL: dict[str, str] = {
    "s2_infer_lineitem": _infer("lineitem", LINEITEM_COLS),
    "s5_dtypes_orders": _dtypes("orders"),
    "k1_csv_roundtrip_orders": with_views(
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, "
        "o_orderpriority FROM orders_nulls", "orders_nulls"),
    "a1_shape_orders": """
        SELECT count(*) AS n_rows,
               CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = 'orders') AS INTEGER) AS n_cols
        FROM orders""",
    "a2_missing_lineitem_nulls": with_views(_missing("lineitem_nulls", LINEITEM_COLS), "lineitem_nulls"),
    "t2_top_missing_lineitem_nulls": with_views(
        f"SELECT * FROM ({_missing('lineitem_nulls', LINEITEM_COLS)}) ORDER BY n_missing DESC, position LIMIT 10",
        "lineitem_nulls"),
    "t1_preview_orders": with_views(
        f"SELECT {_text_cols(ORDERS_COLS)} FROM (SELECT * FROM orders_nulls ORDER BY o_orderkey LIMIT 30)",
        "orders_nulls"),
    "t4_head_csv_orders": with_views(_head_csv("orders_nulls", ORDERS_COLS, "o_orderkey", 12), "orders_nulls"),
    "a3_median_lineitem_nulls": with_views("\nUNION ALL ".join(
        f"SELECT {_q(c)} AS \"column\", round(median({c}), 6) AS median FROM lineitem_nulls"
        for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "lineitem_nulls"),
    "a4_mode_part": _modes("part", ["p_name", "p_brand", "p_type"]),
    "a4_mode_lineitem_nulls": with_views(_modes("lineitem_nulls", ["l_returnflag", "l_linestatus"]), "lineitem_nulls"),
    "a5_mean_std_orders_nulls": with_views("""
        , med AS (SELECT median(o_custkey) AS mc, median(o_totalprice) AS mt FROM orders_nulls)
        SELECT 'o_custkey' AS "column", round(max(mc), 6) AS median, round(avg(coalesce(o_custkey, mc)), 4) AS mean,
               round(stddev_pop(coalesce(o_custkey, mc)), 4) AS std FROM orders_nulls, med
        UNION ALL
        SELECT 'o_totalprice', round(max(mt), 6), round(avg(coalesce(o_totalprice, mt)), 4),
               round(stddev_pop(coalesce(o_totalprice, mt)), 4) FROM orders_nulls, med""", "orders_nulls"),
    "a6_categories_part": "\nUNION ALL ".join(
        f"SELECT {_q(c)} AS \"column\", CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS idx, {c} AS value "
        f"FROM (SELECT DISTINCT {c} FROM part WHERE {c} IS NOT NULL)" for c in ["p_brand", "p_type"]),
    "a7_class_labels_orders": "SELECT DISTINCT o_orderstatus AS label FROM orders WHERE o_orderstatus IS NOT NULL",
    "f1_f2_fill_orders_nulls": with_views(f"""
        , med AS (SELECT median(o_totalprice) AS m FROM orders_nulls),
        {_mode_cte('orders_nulls', 'o_orderpriority', 'mo')}
        SELECT o_orderkey, round(coalesce(o_totalprice, med.m), 4) AS o_totalprice, coalesce(o_orderpriority, mo.v) AS o_orderpriority
        FROM orders_nulls, med, mo""", "orders_nulls"),
    "f3_zscore_orders_nulls": with_views("""
        , med AS (SELECT median(o_custkey) AS mc, median(o_totalprice) AS mt FROM orders_nulls),
        f AS (SELECT o_orderkey, coalesce(o_custkey, mc) AS c, coalesce(o_totalprice, mt) AS t FROM orders_nulls, med),
        mom AS (SELECT avg(c) AS mu_c, stddev_pop(c) AS sd_c, avg(t) AS mu_t, stddev_pop(t) AS sd_t FROM f)
        SELECT o_orderkey,
               round((c - mu_c) / CASE WHEN sd_c = 0 THEN 1 ELSE sd_c END, 6) AS z_custkey,
               round((t - mu_t) / CASE WHEN sd_t = 0 THEN 1 ELSE sd_t END, 6) AS z_totalprice
        FROM f, mom""", "orders_nulls"),
    "f4_onehot_orders_nulls": with_views(f"""
        , {_mode_cte('orders_nulls', 'o_orderstatus', 'ms')},
        {_mode_cte('orders_nulls', 'o_orderpriority', 'mp')}
        SELECT o_orderkey, 'o_orderstatus_' || coalesce(o_orderstatus, ms.v) AS feature FROM orders_nulls, ms
        UNION ALL
        SELECT o_orderkey, 'o_orderpriority_' || coalesce(o_orderpriority, mp.v) AS feature FROM orders_nulls, mp""",
        "orders_nulls"),
    "p1_dropna_orders_nulls": with_views(
        "SELECT o_orderkey, o_totalprice FROM orders_nulls WHERE o_totalprice IS NOT NULL", "orders_nulls"),
    "r1_split_orders": """
        SELECT o_orderkey, rn <= CEIL(0.2::DOUBLE * n) AS is_test
        FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42')) AS rn,
                     count(*) OVER () AS n FROM orders)""",
    "r1_split_lineitem": f"""
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, rn <= CEIL(0.07::DOUBLE * n) AS is_test
        FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
                     row_number() OVER (ORDER BY md5(concat_ws('|', {_LINE_KEY}, '42'))) AS rn,
                     count(*) OVER () AS n FROM lineitem)""",
    "a10_confusion_labels": with_views(
        "SELECT y_true, y_pred, count(*) AS n FROM labels_pred GROUP BY y_true, y_pred", "labels_pred"),
    "a11_a12_classification_metrics_labels": with_views(
        f", {_CLS_CTE}\nSELECT n, round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted FROM m",
        "labels_pred"),
    "a13_a14_regression_metrics_lineitem": with_views("""
        SELECT count(*) AS n, round(avg((y_true - y_pred) * (y_true - y_pred)), 4) AS mse,
               round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse,
               round(CASE WHEN var_pop(y_true) * count(y_true) = 0
                          THEN CASE WHEN sum((y_true - y_pred) * (y_true - y_pred)) = 0 THEN 1.0 ELSE 0.0 END
                          ELSE 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(y_true))
                     END, 6) AS r2
        FROM lineitem_pred""", "lineitem_pred"),
    "a15_histogram_events": f"""
        WITH r AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
        e AS (SELECT mn, mx, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
                     CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM r),
        c AS (SELECT {_bin('value', 'mn', 'mx', 30)} AS bin, count(*) AS n
              FROM events, e WHERE value IS NOT NULL GROUP BY 1),
        g AS (SELECT CAST(i AS INTEGER) AS bin FROM range(30) t(i))
        SELECT g.bin, round(lo + g.bin * ((hi - lo) / 30), 6) AS lo, round(lo + (g.bin + 1) * ((hi - lo) / 30), 6) AS hi,
               coalesce(c.n, 0) AS n
        FROM g LEFT JOIN c ON g.bin = c.bin, e""",
    "a16_axis_range_lineitem": with_views(
        "SELECT round(least(min(y_true), min(y_pred)), 6) AS lo, round(greatest(max(y_true), max(y_pred)), 6) AS hi "
        "FROM lineitem_pred", "lineitem_pred"),
    "a17_scatter_lineitem": f"""
        WITH r AS (SELECT min(l_quantity) AS xmn, max(l_quantity) AS xmx,
                          min(l_extendedprice) AS ymn, max(l_extendedprice) AS ymx FROM lineitem),
        p AS (SELECT l_returnflag AS "group", {_bin('l_quantity', 'xmn', 'xmx', 50)} AS bx,
                     {_bin('l_extendedprice', 'ymn', 'ymx', 50)} AS by, CAST(l_quantity AS DOUBLE) AS x,
                     CAST(l_extendedprice AS DOUBLE) AS y, md5(concat_ws('|', {_LINE_KEY}, '42')) AS h
              FROM lineitem, r WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)
        SELECT "group", bx, "by", x, y FROM (
            SELECT *, row_number() OVER (PARTITION BY "group", bx, "by" ORDER BY h, x, y) AS pos FROM p) WHERE pos <= 5""",
    "a10_confusion_sparse_orders": """
        WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS y_true,
                          CAST(o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS y_pred FROM orders),
        l AS (SELECT y_true AS label FROM p UNION SELECT y_pred FROM p),
        r AS (SELECT label, row_number() OVER (ORDER BY CAST(label AS DOUBLE), label) - 1 AS idx FROM l)
        SELECT t.idx AS i, q.idx AS j, y_true, y_pred, count(*) AS n
        FROM p JOIN r t ON t.label = y_true JOIN r q ON q.label = y_pred GROUP BY 1, 2, 3, 4""",
    "a17_grid_lineitem": f"""
        WITH r AS (SELECT min(l_quantity) AS xmn, max(l_quantity) AS xmx,
                          min(l_extendedprice) AS ymn, max(l_extendedprice) AS ymx FROM lineitem)
        SELECT l_returnflag AS "group", {_bin('l_quantity', 'xmn', 'xmx', 50)} AS bx,
               {_bin('l_extendedprice', 'ymn', 'ymx', 50)} AS by, count(*) AS n
        FROM lineitem, r WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
        GROUP BY 1, 2, 3""",
    "a8_cluster_sizes_embeddings": "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label",
    "a9_anomaly_count_events": "SELECT count_if(100.0 - value < 0) AS anomalies FROM events",
    "a18_metrics_summary_labels": with_views(
        f", {_CLS_CTE}\nSELECT 'accuracy' AS metric, round(accuracy, 3) AS value FROM m "
        "UNION ALL SELECT 'f1_weighted', round(f1_weighted, 3) FROM m", "labels_pred"),
    "a19_profile_orders_nulls": with_views(f"""
        SELECT 'source' AS section, 'csv_name' AS name, 'orders.parquet' AS value
        UNION ALL SELECT 'shape', 'rows', CAST(count(*) AS VARCHAR) FROM orders_nulls
        UNION ALL SELECT 'shape', 'cols', '{len(ORDERS_COLS)}'
        UNION ALL SELECT 'dtype', "column", dtype FROM ({_dtypes('orders')})
        UNION ALL SELECT 'missing', "column", CAST(n_missing AS VARCHAR) FROM ({_TOP_MISSING_ORDERS})
        UNION ALL SELECT 'preview', CAST(line_no AS VARCHAR), line FROM ({_head_csv('orders_nulls', ORDERS_COLS, 'o_orderkey', 12)})
        UNION ALL SELECT 'report', 'json', '{{}}'""", "orders_nulls"),
    "m3_ridge_lineitem": f"""
        WITH base AS (SELECT {_LINE_KEY} AS row_key,
                             CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS x,
                             l_extendedprice * (1 - l_discount) AS y FROM lineitem),
        ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', row_key, '42'))) AS rn,
                          count(*) OVER () AS n FROM base),
        flag AS (SELECT *, rn <= CEIL(0.2::DOUBLE * n) AS is_test FROM ranked),
        med AS (SELECT median(x) AS m FROM flag WHERE NOT is_test),
        filled AS (SELECT flag.*, coalesce(x, med.m) AS xf FROM flag, med),
        mom AS (SELECT avg(xf) AS mu, stddev_pop(xf) AS sd FROM filled WHERE NOT is_test),
        z AS (SELECT filled.*, (xf - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM filled, mom),
        cen AS (SELECT avg(z) AS zb, avg(y) AS yb FROM z WHERE NOT is_test),
        coef AS (SELECT sum((z - zb) * (y - yb)) / (sum((z - zb) * (z - zb)) + 1.0) AS w, max(zb) AS zb, max(yb) AS yb
                 FROM z, cen WHERE NOT is_test),
        pred AS (SELECT y AS y_true, yb + w * (z - zb) AS y_pred FROM z, coef WHERE is_test)
        SELECT count(*) AS n, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 4) AS rmse,
               round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)), 6) AS r2
        FROM pred""",
    "m7_pca_scores_part": """
        WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2,
                          stddev_pop(p_retailprice) AS s2, corr(p_size, p_retailprice) AS r FROM part),
        z AS (SELECT p_partkey, (p_size - m1) / s1 AS z1, (p_retailprice - m2) / s2 AS z2, r FROM part, s)
        SELECT p_partkey, round((z1 + sign(r) * z2) / sqrt(2), 6) AS pc1,
               round((z1 - sign(r) * z2) / sqrt(2), 6) AS pc2 FROM z""",
    "m1_logreg_closed_form_lineitem": _LOGREG_SQL.replace("{key}", _LINE_KEY),
    "k2_report_roundtrip_labels": with_views(
        f", {_CLS_CTE}\nSELECT 'accuracy' AS metric, round(accuracy, 3) AS value FROM m "
        "UNION ALL SELECT 'f1_weighted', round(f1_weighted, 3) FROM m", "labels_pred"),
    "m7_pca_evr_part": """
        WITH s AS (SELECT corr(p_size, p_retailprice) AS r FROM part)
        SELECT 1 AS component, round((1 + abs(r)) / 2, 6) AS ratio FROM s
        UNION ALL SELECT 2, round((1 - abs(r)) / 2, 6) FROM s""",
}
# the file has its rows in the order of the key
ORACLE_SQL["t1_first_rows_orders"] = ORACLE_SQL["t1_preview_orders"]
ORACLE_SQL["t4_first_lines_orders"] = ORACLE_SQL["t4_head_csv_orders"]
ORACLE_SQL["m7_pca_blocks_scores_part"] = ORACLE_SQL["m7_pca_scores_part"]
ORACLE_SQL["m7_pca_blocks_evr_part"] = ORACLE_SQL["m7_pca_evr_part"]
ORACLE_SQL["k3_model_roundtrip_part"] = ORACLE_SQL["m7_pca_scores_part"]
ORACLE_SQL["m9_report_regression_lineitem"] = _ridge_report(
    _LINE_KEY, "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag",
    "l_extendedprice * (1 - l_discount)")
ORACLE_SQL["m1_logreg_lineitem"] = _logreg_results(
    _LINE_KEY, "lineitem", ["l_extendedprice", "l_discount", "l_tax"], "l_returnflag", "l_quantity > 25")

#: Expected types, stated independently of the engine's rules.
ORACLE_SQL["s2_infer_orders_text"] = """
    SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, "column", inferred_type
    FROM (VALUES ('whole', 'bigint'), ('whole_na', 'bigint'), ('flag', 'boolean'), ('flag_na', 'boolean'), ('nothing', 'double'),
                 ('number', 'double'), ('nearly', 'string'), ('huge', 'double'), ('mixed', 'string'), ('price', 'double'))
         AS t("column", inferred_type)"""
ORACLE_SQL["k1_csv_roundtrip_documents"] = "SELECT * FROM documents"
ORACLE_SQL["k1_csv_roundtrip_conversations"] = "SELECT * FROM conversations"
ORACLE_SQL["f4_onehot_customer"] = "SELECT c_custkey, 'c_name_' || c_name AS feature FROM customer"
ORACLE_SQL["r1_split_lineitem_suppkey"] = """
    SELECT l_suppkey, count(*) AS n, count_if(rn <= CEIL(0.2::DOUBLE * total)) AS n_test
    FROM (SELECT l_suppkey, row_number() OVER (ORDER BY md5(CAST(l_suppkey AS VARCHAR) || '|42')) AS rn, count(*) OVER () AS total
          FROM lineitem) GROUP BY l_suppkey"""
ORACLE_SQL["a2_missing_nan_lineitem"] = "\nUNION ALL ".join(
    f"SELECT {i} AS position, {_q(c)} AS \"column\", {n} AS n_missing FROM lineitem" for i, (c, n) in enumerate([
        *[(c, "count(*) - count(*)") for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]],
        ("l_quantity", "count_if(l_orderkey % 9 = 0 OR l_orderkey % 10 = 0)"), ("l_tax", "count_if(l_partkey % 4 = 0)"),
        ("l_returnflag", "count(*) - count(*)")]))
ORACLE_SQL["a15_histogram_nan_events"] = ORACLE_SQL["a15_histogram_events"].replace(
    "FROM events", "FROM (SELECT * FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0) AS events")
ORACLE_SQL["m3_ridge_clashing_names"] = ORACLE_SQL["m9_report_regression_lineitem"]
# one categorical column: the normal equations are diagonal but for the free intercept
ORACLE_SQL["m3_ridge_wide_orders"] = """
    WITH ranked AS (SELECT o_totalprice AS y, 'k' || CAST(o_orderkey % 6000 AS VARCHAR) AS c,
                           row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42')) AS rn, count(*) OVER () AS n FROM orders),
    flag AS (SELECT *, rn <= CEIL(0.2::DOUBLE * n) AS is_test FROM ranked),
    level AS (SELECT c, count(*) AS k, avg(y) AS m FROM flag WHERE NOT is_test GROUP BY c),
    base AS (SELECT sum(k * m / (k + 1)) / sum(k / (k + 1)) AS b FROM level),
    pred AS (SELECT y, b + coalesce(k * (m - b) / (k + 1), 0) AS p FROM flag LEFT JOIN level USING (c), base WHERE is_test)
    SELECT count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 1) AS rmse,
           round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2 FROM pred"""
_STEP_TEST = f"""
    WITH ranked AS (SELECT l_linenumber AS k, row_number() OVER (ORDER BY md5(concat_ws('|', {_LINE_KEY}, '42'))) AS rn, count(*) OVER () AS n
                    FROM lineitem),
    test AS (SELECT k FROM ranked WHERE rn <= CEIL(0.2::DOUBLE * n))"""
ORACLE_SQL["m2_rf_classifier_steps"] = _STEP_TEST + """
    SELECT c AS y_true, c AS y_pred, count(*) AS n
    FROM (SELECT CASE WHEN k <= 2 THEN 'low' WHEN k <= 4 THEN 'middle' ELSE 'high' END AS c FROM test) GROUP BY c"""
ORACLE_SQL["m4_rf_regressor_steps"] = _STEP_TEST + """
    SELECT CAST(k * k AS DOUBLE) AS y_true, CAST(k * k AS DOUBLE) AS y_pred, count(*) AS n FROM test GROUP BY k"""
_GROUPS = """
    WITH g AS (SELECT l_linenumber % 3 AS grp, count(*) AS n FROM lineitem GROUP BY 1),
    c AS (SELECT grp, n, CAST(row_number() OVER (ORDER BY n DESC) - 1 AS INTEGER) AS cluster FROM g)"""
ORACLE_SQL["m5_kmeans_groups"] = _GROUPS + " SELECT grp, cluster, n FROM c"
ORACLE_SQL["m8_cluster_view_groups"] = _GROUPS + " SELECT CAST(cluster AS VARCHAR) AS cluster, n, 1 AS clusters_in_a_cell FROM c"
ORACLE_SQL["a18_summary_clusters"] = _GROUPS + " SELECT 'cluster ' || cluster AS metric, CAST(n AS DOUBLE) AS value FROM c"
# every tree splits once, at depth 1: s = 2^(-(1 + c(rows on the side)) / c(all rows))
_NATION = """
    WITH s AS (SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey = 0) AS side, count(*) OVER () AS n FROM nation),
    e AS (SELECT n_nationkey, CASE WHEN side > 2 THEN 2 * (ln(side - 1) + 0.5772156649015329) - 2 * (side - 1) / side::DOUBLE
                                   WHEN side = 2 THEN 1 ELSE 0 END AS c_side,
                 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n::DOUBLE AS c_all FROM s),
    f AS (SELECT n_nationkey, 0.5 - power(2.0::DOUBLE, -(1 + c_side) / c_all) AS score FROM e)"""
ORACLE_SQL["m6_iforest_nation"] = _NATION + " SELECT n_nationkey, score < 0 AS is_anomaly, round(score, 6) AS anomaly_score FROM f"
ORACLE_SQL["a18_summary_anomalies_nation"] = _NATION + " SELECT 'anomalies' AS metric, CAST(count_if(score < 0) AS DOUBLE) AS value FROM f"
ORACLE_SQL["a18_summary_pca_part"] = """
    WITH s AS (SELECT corr(p_size, p_retailprice) AS r FROM part)
    SELECT 'pc1' AS metric, round((1 + abs(r)) / 2, 3) AS value FROM s UNION ALL SELECT 'pc2', round((1 - abs(r)) / 2, 3) FROM s"""
