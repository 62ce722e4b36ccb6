"""DuckDB SQL with the results the queries must have, written over the raw tables."""

from __future__ import annotations

from checks.queries import BEFORE_LAST, FOLDS, HALF_YEARS, LAST, MONTH, PATIENCE, PREVIOUS, ROUNDS, ROW, SNAPSHOTS, STAGES, places_of
from spendcast.plans.profiles import PROFILES, SEARCH_SPACE
from spendcast.schema import (
    DISTINCT_COLUMNS,
    LOG_ORDER,
    MEASURES,
    RUNNING_KEYS,
    SEED,
    VALUES,
    feature_column,
    running_column,
)

TX = """
tx AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, o_custkey AS customer_id, n_name AS country,
    o_orderdate AS order_date, sign * l_quantity AS quantity,
    CAST(round(CAST(l_extendedprice / l_quantity AS DECIMAL(18,6)), 4) AS DOUBLE) AS price,
    round(sign * l_extendedprice * (1 - l_discount), 4) AS total,
    l_linenumber AS line_no, l_suppkey AS supplier_id,
    strftime(o_orderdate, '%Y-%m') AS order_date_year_month, strftime(o_orderdate, '%Y') AS order_date_year,
    strftime(o_orderdate, '%H') AS order_date_hour
  FROM (SELECT *, CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DOUBLE) AS sign FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)"""


def fixed_sum(c: str, over: str = "") -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,4))) {over} AS DOUBLE)"


def ordered_mean(c: str) -> str:
    return f"list_sum(list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL))) / count({c})"


def cutoff(month: str) -> str:
    return f"TIMESTAMP '{month}-01 00:00:00'"


def after(month: str) -> str:
    return f"({cutoff(month)} + INTERVAL 1 MONTH)"


def snapshots(months) -> str:
    values = ", ".join(f"('{m}', {cutoff(m)})" for m in months)
    return f"snaps(year_month, cutoff) AS (VALUES {values})"


def labels(name: str, month: str, limit: str | None = None) -> str:
    return f"""{name} AS (
  SELECT customer_id, '{month}' AS year_month,
    coalesce({fixed_sum(f"CASE WHEN order_date >= {cutoff(month)} THEN total END")}, 0.0) AS total,
    CAST(coalesce({fixed_sum(f"CASE WHEN order_date >= {cutoff(month)} THEN total END")}, 0.0) > 300 AS INTEGER) AS label
  FROM tx WHERE order_date < {after(month)} GROUP BY customer_id
  HAVING min(order_date) < {limit or after(month)}
)"""


def baseline(name: str, month: str, previous: str) -> str:
    return f"""{labels(f"{name}_now", month)}, {labels(f"{name}_then", previous)}, {name} AS (
  SELECT n.customer_id, n.label, coalesce(p.total, 0.0) AS previous_total,
    greatest(0.0, least(1.0, coalesce(p.total, 0.0) / 300.0::DOUBLE))::DOUBLE AS probability
  FROM {name}_now n LEFT JOIN {name}_then p ON n.customer_id = p.customer_id
)"""


BASE = baseline("base", MONTH, PREVIOUS)


def search_space_sql(seed: int = SEED) -> str:
    rows = ", ".join(
        f"('{p}', '{n}', '{kind}', {float(low)!r}, {float(high)!r})"
        for p, space in SEARCH_SPACE.items()
        for n, (kind, low, high) in space.items()
    )
    u = f"('0x' || substr(md5('{seed}/' || name || '/' || trial), 1, 13))::BIGINT / 16.0::DOUBLE ^ 13"
    return f"""WITH space(profile, name, kind, low, high) AS (VALUES {rows}),
trials AS (SELECT (row_number() OVER () - 1)::INTEGER AS trial FROM nation),
drawn AS (SELECT *, low::DOUBLE AS l, high::DOUBLE AS h, {u} AS u FROM space, trials)
SELECT profile, trial, name, round(CASE kind WHEN 'log' THEN exp(ln(l) + u * (ln(h) - ln(l)))
  WHEN 'int' THEN floor(l + u * (h - l + 1)) ELSE l + u * (h - l) END, 9) AS value FROM drawn"""


def auc(source: str, score: str = "probability", by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys} sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (
    SELECT {keys} pos, neg,
      coalesce(sum(neg) OVER ({part} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below
    FROM (SELECT {keys} {score}, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) - sum(label) AS DOUBLE) AS neg
          FROM {source} GROUP BY {keys} {score})) {group}"""


def rates(source: str) -> str:
    return f"""SELECT coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM (
    SELECT CAST(count(*) FILTER (WHERE probability > 0.5 AND label = 1) AS DOUBLE) AS tp,
      CAST(count(*) FILTER (WHERE probability > 0.5 AND label = 0) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (WHERE NOT probability > 0.5 AND label = 1) AS DOUBLE) AS fn FROM {source})"""


def report(source: str) -> str:
    return f"""SELECT 'precision' AS metric, precision AS value FROM ({rates(source)})
    UNION ALL SELECT 'recall', recall FROM ({rates(source)})
    UNION ALL SELECT 'f1', f1 FROM ({rates(source)})
    UNION ALL SELECT 'roc_auc', auc FROM ({auc(source)})"""


def running(keys=tuple(RUNNING_KEYS), source: str = "tx") -> str:
    columns = []
    for k in keys:
        over = (
            f"OVER (PARTITION BY {k} ORDER BY {', '.join(LOG_ORDER)} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        )
        columns += [f"{fixed_sum(v, over)} AS {running_column(v, k)}" for v in VALUES]
    return f"run AS (SELECT *, {', '.join(columns)} FROM {source})"


def expression(column: str, stat: str, mean: str) -> str:
    """One statistic; deviations are taken from ``mean``, so no large powers cancel."""
    if stat == "mean":
        return f"{fixed_sum(column)} / nullif(count({column}), 0)"
    if stat == "sum":
        return f"coalesce({fixed_sum(column)}, 0.0)"
    if stat in ("max", "min", "count"):
        return f"{stat}({column})"
    m2 = f"sum(({column} - {mean}) ** 2)"
    n = f"count({column})"
    if stat == "std":
        return f"CASE WHEN {n} > 1 THEN sqrt({m2} / ({n} - 1)) END"
    m3 = f"sum(({column} - {mean}) ** 3)"
    g1 = f"({m3} / {n}) / nullif(({m2} / {n}) ** 1.5, 0)"
    return f"CASE WHEN {n} >= 3 THEN coalesce({g1} * sqrt({n} * ({n} - 1.0)) / ({n} - 2), 0.0) END"


def shown(column: str) -> str:
    places = places_of(column)
    return column if places is None else f"round({column}, {places}) AS {column}"


def statistics(source: str, columns, stats, keys: str, name: str = "stats") -> str:
    """CTEs for the statistics of ``columns`` by ``keys``; ``name`` holds them unrounded."""
    means = ", ".join(f"{fixed_sum(c)} / nullif(count({c}), 0) AS m_{c}" for c in columns)
    values = ", ".join(
        f"{expression(c, s, f'm_{c}')} AS {feature_column(c, s)}" for c in columns for s in stats
    )
    return f"""{name}_means AS (SELECT {keys}, {means} FROM {source} WHERE customer_id IS NOT NULL GROUP BY {keys}),
{name} AS (SELECT {keys}, {values} FROM {source} JOIN {name}_means USING ({keys}) GROUP BY {keys})"""


def names_of(columns, stats) -> list[str]:
    return [feature_column(c, s) for c in columns for s in stats]


DISTINCTS = ", ".join(f"count(DISTINCT {c}) AS {feature_column(c, 'nunique')}" for c in DISTINCT_COLUMNS)
STATS = ("mean", "max", "min", "sum", "count", "std", "skew")
ALL_FEATURES = names_of(MEASURES, STATS) + [feature_column(c, "nunique") for c in DISTINCT_COLUMNS]


def snapshot_rows(months, source: str, name: str = "snap_rows") -> str:
    return f"""{snapshots(months)}, {name} AS (
  SELECT {source}.*, year_month FROM {source} JOIN snaps ON order_date < cutoff)"""


def features(months) -> str:
    return f"""{TX}, {running()}, {snapshot_rows(months, "run")},
{statistics("snap_rows", MEASURES, STATS, "customer_id, year_month")},
distincts AS (SELECT customer_id, year_month, {DISTINCTS} FROM snap_rows GROUP BY customer_id, year_month),
feats AS (SELECT * FROM stats JOIN distincts USING (customer_id, year_month))"""


def matrix(features_cte: str, months, columns) -> str:
    both = " UNION ALL ".join(f"SELECT customer_id, year_month, label FROM l{i}" for i in range(len(months)))
    label_ctes = ", ".join(labels(f"l{i}", m) for i, m in enumerate(months))
    listed = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"""{features_cte}, {label_ctes}, labels_all AS ({both}), matrix AS (
  SELECT customer_id, year_month, label, {listed}
  FROM labels_all LEFT JOIN feats USING (customer_id, year_month))"""


def middle(c: str) -> str:
    values = f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL))"
    return f"({values}[(count({c}) + 1) // 2] + {values}[count({c}) // 2 + 1]) / 2.0::DOUBLE"


def imputed(features_cte: str, train: str, test: str, columns) -> str:
    medians = ", ".join(f"{middle(c)} AS d_{c}" for c in columns)
    filled = []
    for c in columns:
        value = f"coalesce({c}, d_{c})"
        places = places_of(c)
        filled.append(f"{value} AS {c}" if places is None else f"round({value}, {places}) AS {c}")
    return f"""WITH {matrix(features_cte, [train, test], columns)},
medians AS (SELECT {medians} FROM matrix WHERE year_month = '{train}')
SELECT customer_id, year_month, label, {', '.join(filled)} FROM matrix, medians"""


SMALL_COLUMNS = names_of(VALUES, STATS)


def small(name: str, months=(PREVIOUS, MONTH)) -> str:
    return f"""{TX}, {snapshot_rows(months, "tx")},
{statistics("snap_rows", VALUES, STATS, "customer_id, year_month", name)}"""


SMALL = small("feats")
SMALL_LAST = small("feats", [BEFORE_LAST, LAST])


def preprocessed() -> str:
    """The small matrix with a country: encoded over both months, then filled like any feature."""
    coded = f"""{small("plain", [BEFORE_LAST, LAST])},
homes AS (SELECT customer_id, year_month, max(country) AS country FROM snap_rows GROUP BY 1, 2),
codes AS (SELECT country, dense_rank() OVER (ORDER BY country) - 1 AS code FROM (SELECT DISTINCT country FROM homes)),
feats AS (SELECT plain.*, code AS country FROM plain JOIN homes USING (customer_id, year_month)
  JOIN codes ON homes.country = codes.country)"""
    return imputed(coded, BEFORE_LAST, LAST, [*SMALL_COLUMNS, "country"])


def gaps_marked() -> str:
    """Gaps filled below the least value in train; missing means, deviations and skews are the three sets of rows."""
    lows = ", ".join(f"min({c}) AS low_{c}" for c in SMALL_COLUMNS)
    filled = []
    for c in SMALL_COLUMNS:
        value = f"coalesce({c}, low_{c} - greatest(1.0::DOUBLE, abs(low_{c})))"
        places = places_of(c)
        filled.append(f"{value} AS {c}" if places is None else f"round({value}, {places}) AS {c}")
    marks = [f"CAST({c} IS NULL AS DOUBLE) AS {c}__missing" for c in (feature_column(VALUES[0], s) for s in ("mean", "std", "skew"))]
    return f"""WITH {matrix(SMALL, [PREVIOUS, MONTH], SMALL_COLUMNS)},
lows AS (SELECT {lows} FROM matrix WHERE year_month = '{PREVIOUS}')
SELECT customer_id, year_month, label, {', '.join(filled + marks)} FROM matrix, lows"""


def modes(months, columns) -> str:
    """CTEs with the commonest value of each column per customer and snapshot."""
    each = [
        f"""m_{c} AS (SELECT customer_id, year_month, {c} AS {feature_column(c, "mode")} FROM snap_rows WHERE {c} IS NOT NULL
  GROUP BY customer_id, year_month, {c}
  QUALIFY row_number() OVER (PARTITION BY customer_id, year_month ORDER BY count(*) DESC, {c}) = 1)"""
        for c in columns
    ]
    joined = " FULL JOIN ".join([f"m_{columns[0]}"] + [f"m_{c} USING (customer_id, year_month)" for c in columns[1:]])
    return f"{TX}, {snapshot_rows(months, 'tx')}, {', '.join(each)}, modes AS (SELECT * FROM {joined})"


def nominal() -> str:
    both = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(2))
    return f"""WITH {modes([PREVIOUS, MONTH], ["country"])}, {labels("l0", PREVIOUS)}, {labels("l1", MONTH)},
homes AS (SELECT customer_id, year_month, label, country__mode AS home FROM ({both}) LEFT JOIN modes USING (customer_id, year_month)),
codes AS (SELECT home, row_number() OVER (ORDER BY home) - 1 AS code FROM (SELECT DISTINCT home FROM homes WHERE home IS NOT NULL)),
size AS (SELECT count(*) AS n FROM codes)
SELECT customer_id, year_month, label, CAST(coalesce(code, n) AS DOUBLE) AS country__mode, CAST(n + 1 AS INTEGER) AS n_categories
FROM homes LEFT JOIN codes USING (home), size"""


def base_only(months, stats) -> str:
    columns = ", ".join(names_of(VALUES, stats))
    return f"""WITH {TX}, {snapshot_rows(months, "tx")},
{statistics("snap_rows", VALUES, stats, "customer_id, year_month")}
SELECT customer_id, year_month, {columns} FROM stats"""


def by_customer(*stats: str) -> str:
    columns = ", ".join(shown(c) for c in names_of(VALUES, stats))
    return f"WITH {TX}, {statistics('tx', VALUES, stats, 'customer_id')} SELECT customer_id, {columns} FROM stats"


def patience_stop() -> str:
    """AUC of every stage and fold, and the best round before patience is used up."""
    return f"""WITH {TX}, {labels("l", BEFORE_LAST)},
ago AS (SELECT customer_id, datediff('month', order_date, {cutoff(LAST)}) AS ago, count(*) AS n FROM tx
  WHERE order_date < {cutoff(LAST)} GROUP BY ALL),
staged AS (SELECT CAST(l.customer_id % {FOLDS} AS INTEGER) AS fold, rounds, l.label, CAST(coalesce(sum(n), 0) AS DOUBLE) AS margin
  FROM l JOIN range(1, {STAGES} + 1) r(rounds) ON true
  LEFT JOIN ago ON ago.customer_id = l.customer_id AND ago.ago <= rounds GROUP BY l.customer_id, rounds, l.label),
curve AS (SELECT fold, CAST(rounds AS INTEGER) AS rounds, auc FROM ({auc("staged", "margin", "fold, rounds")})),
known AS (SELECT *, coalesce(auc, -1) AS a FROM curve),
gains AS (SELECT *, coalesce(a > max(a) OVER (PARTITION BY fold ORDER BY rounds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS gain FROM known),
best AS (SELECT *, max(CASE WHEN gain THEN rounds END) OVER (PARTITION BY fold ORDER BY rounds) AS best FROM gains),
ends AS (SELECT fold, min(CASE WHEN rounds - best >= {PATIENCE} THEN rounds END) AS stop, max(rounds) AS final FROM best GROUP BY fold)
SELECT ends.fold, best.best AS rounds, known.auc, coalesce(stop, final) AS last, stop IS NOT NULL AS stopped
FROM ends JOIN best ON best.fold = ends.fold AND best.rounds = coalesce(stop, final)
JOIN known ON known.fold = ends.fold AND known.rounds = best.best"""


def month_before(month: str) -> str:
    year, m = map(int, month.split("-"))
    return f"{year - (m == 1)}-{(m - 2) % 12 + 1:02d}"


def fold_predictions() -> str:
    months = (MONTH, "1998-01", "2001-07")
    ctes = ", ".join(baseline(f"b{i}", m, month_before(m)) for i, m in enumerate(months))
    union = " UNION ALL ".join(
        f"SELECT *, {i} AS month, CAST(customer_id % {FOLDS} AS INTEGER) AS fold FROM b{i}" for i in range(len(months))
    )
    return f"{TX}, {ctes}, preds AS ({union})"


IMPORTANCES = f"""{TX}, imp AS (
  SELECT CAST(product_id AS VARCHAR) AS feature, customer_id % {FOLDS} AS fold, CAST(count(*) AS DOUBLE) AS importance
  FROM tx WHERE quantity >= 25 GROUP BY 1, 2)"""

ROWS = ", ".join(ROW)


def running_query(key: str) -> str:
    columns = ", ".join(running_column(v, key) for v in VALUES)
    return f"WITH {TX}, {running([key])} SELECT {ROWS}, quantity, total, {columns} FROM run"


def models() -> dict[str, str]:
    """Keys, folds, labels and bounds of what is fitted; the fitted numbers themselves have no SQL."""
    scored = f"""WITH {TX}, {labels("l", LAST)}
        SELECT customer_id, year_month, CAST(label AS DOUBLE) AS label, true AS in_range FROM l"""
    names = ", ".join(f"('{c}')" for c in SMALL_COLUMNS)
    profiles = ", ".join(f"('{p}')" for p in PROFILES)
    return {
        "gbt_fit_predict": scored,
        "gbt_oof_early_stop": scored,
        "gbt_oof": f"""WITH {TX}, {labels("l", BEFORE_LAST)} SELECT customer_id, year_month, CAST(label AS DOUBLE) AS label,
            CAST((row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}-' || CAST(customer_id AS VARCHAR)), customer_id) - 1)
              % 3 AS INTEGER) AS fold, true AS in_range FROM l""",
        "early_stop": f"""SELECT CAST(fold AS INTEGER) AS fold, CAST(rounds AS INTEGER) AS rounds, true AS in_range
            FROM range(3) f(fold), range(1, {ROUNDS + 1}) r(rounds)""",
        "feature_importance": f"""SELECT feature, 0 AS fold, true AS sums_to_one, true AS in_range FROM (VALUES {names}) v(feature)""",
        "split_importance": f"""SELECT feature, true AS any_used, true AS fits_trees, true AS whole FROM (VALUES {names}) v(feature)""",
        "param_profiles": f"SELECT profile, true AS in_range FROM (VALUES {profiles}) v(profile)",
        "tune": "SELECT CAST(trial AS INTEGER) AS trial, true AS in_range FROM range(2) t(trial)",
        "best_trial": "SELECT CAST(1 AS BIGINT) AS n_best, CAST(0 AS BIGINT) AS n_better",
        "validate": "SELECT metric, true AS in_range FROM (VALUES ('precision'), ('recall'), ('f1'), ('roc_auc')) v(metric)",
        "predict": f"WITH {TX} SELECT DISTINCT customer_id, true AS in_range FROM tx WHERE order_date < {after(MONTH)}",
    }


def oracle_sql() -> dict[str, str]:
    month_label = labels("l", MONTH)
    tx_columns = "order_id, product_id, customer_id, country, order_date, quantity, price, total"
    sql = {
        "read_transactions": f"WITH {TX} SELECT {tx_columns} FROM tx",
        "transactions": f"WITH {TX} SELECT {ROWS}, quantity, price, total FROM tx",
        "search_space": search_space_sql(),
        "read_submission_template": f"WITH {TX} SELECT DISTINCT customer_id, 0.0::DOUBLE AS probability FROM tx",
        "write_submission": f"WITH {TX}, {BASE} SELECT customer_id, probability FROM base",
        "log_metrics": f"""WITH {TX}, {BASE}, {baseline("prev", PREVIOUS, month_before(PREVIOUS))}
            SELECT 'baseline-{MONTH}' AS run_id, metric AS name, value FROM ({report("base")})
            UNION ALL SELECT 'baseline-{PREVIOUS}', metric, value FROM ({report("prev")})""",
        "dataset_profile": f"""WITH {TX} SELECT count(*) AS n_rows, CAST(8 AS INTEGER) AS n_columns,
            'country' AS categorical_columns FROM tx""",
        "observed_profile": f"""WITH {TX} SELECT count(*) AS n_rows, CAST(8 AS INTEGER) AS n_columns,
            'country' AS categorical_columns, CAST({' + '.join(f"count(*) FILTER (WHERE {c} IS NULL)"
            for c in tx_columns.split(", "))} AS BIGINT) AS n_missing FROM tx""",
        "derive_time_keys": f"""WITH {TX} SELECT {ROWS}, order_date_year_month, order_date_year, order_date_hour FROM tx""",
        "month_offset": f"""WITH {TX} SELECT DISTINCT order_date_year_month AS ym,
            {', '.join(f"strftime(CAST(order_date_year_month || '-01' AS DATE) - INTERVAL {n} MONTH, '%Y-%m') AS minus_{n}"
                       for n in (1, 2, 13))} FROM tx""",
        "filter_through_month": f"WITH {TX} SELECT {ROWS}, total FROM tx WHERE order_date_year_month <= '{MONTH}'",
        "filter_month": f"WITH {TX} SELECT {ROWS}, total FROM tx WHERE order_date_year_month = '{MONTH}'",
        "filter_before_snapshot": f"WITH {TX} SELECT {ROWS}, total FROM tx WHERE order_date < {cutoff(MONTH)}",
        "select_features": f"WITH {TX}, {month_label} SELECT total FROM l",
        "rename_previous_total": f"""WITH {TX}, {labels("l", PREVIOUS)}
            SELECT customer_id, year_month, total AS previous_total, label FROM l""",
        "name_aggregates": f"""WITH {TX} SELECT customer_id,
            {', '.join(f'{s}({v}) AS "{v}-{s}"' for v in VALUES for s in ("max", "count"))} FROM tx GROUP BY customer_id""",
        "tag_snapshot": f"WITH {TX} SELECT {ROWS}, '{LAST}' AS year_month FROM tx WHERE order_date < {cutoff(LAST)}",
        "threshold_label": f"""WITH {TX} SELECT customer_id, order_date_year_month AS year_month, {fixed_sum("total")} AS total,
            CAST({fixed_sum("total")} > 300 AS INTEGER) AS label FROM tx GROUP BY 1, 2""",
        "fill_missing_zero": f"WITH {TX}, {month_label} SELECT customer_id, total FROM l",
        "clip_probability": f"""WITH {TX} SELECT customer_id, order_date_year_month AS year_month, {fixed_sum("total")} AS total,
            CAST(greatest(0.0, least(1.0, {fixed_sum("total")} / 300.0::DOUBLE)) AS DOUBLE) AS probability
            FROM tx GROUP BY 1, 2""",
        "binarize": f"WITH {TX}, {BASE} SELECT *, CAST(probability > 0.5 AS INTEGER) AS predicted FROM base",
        "label_universe_join": f"""WITH {TX}, u AS (SELECT DISTINCT customer_id FROM tx WHERE order_date < {after(MONTH)}),
            t AS (SELECT customer_id, {fixed_sum("total")} AS total FROM tx WHERE order_date_year_month = '{MONTH}' GROUP BY 1)
            SELECT u.customer_id, '{MONTH}' AS year_month, t.total FROM u LEFT JOIN t ON u.customer_id = t.customer_id""",
        "train_matrix_join": f"""WITH {matrix(SMALL, [PREVIOUS, MONTH], names_of(VALUES, ("sum", "count")))}
            SELECT * FROM matrix""",
        "test_matrix_join": f"""WITH {matrix(SMALL, [PREVIOUS, MONTH], names_of(VALUES, ("sum", "count")))}
            SELECT * FROM matrix WHERE year_month = '{MONTH}'""",
        "snapshot_range_join": base_only(SNAPSHOTS, ("sum", "count", "min", "max")),
        "union_snapshots": base_only(SNAPSHOTS, ("sum", "count", "min", "max")),
        "previous_month_join": f"""WITH {TX}, {month_label}, {labels("p", PREVIOUS)}
            SELECT l.customer_id, l.year_month, l.total, l.label, p.total AS previous_total
            FROM l LEFT JOIN p ON l.customer_id = p.customer_id""",
        "attach_predictions": f"""WITH {TX}, {BASE}, u AS (SELECT DISTINCT customer_id FROM tx)
            SELECT u.customer_id, probability FROM u LEFT JOIN base ON u.customer_id = base.customer_id""",
        "importance_fold_join": f"""WITH {IMPORTANCES} SELECT feature, {ordered_mean("importance")} AS importance FROM imp
            GROUP BY feature HAVING count(*) = {FOLDS}""",
        "mean_importance": f"WITH {IMPORTANCES} SELECT feature, {ordered_mean("importance")} AS importance FROM imp GROUP BY feature",
        "monthly_customer_total": f"""WITH {TX} SELECT customer_id, order_date_year_month AS year_month,
            {fixed_sum("total")} AS total FROM tx GROUP BY 1, 2""",
        "feat_mean": by_customer("mean"),
        "feat_max_min": by_customer("max", "min"),
        "feat_sum": by_customer("sum"),
        "feat_count": by_customer("count"),
        "feat_std": by_customer("std"),
        "feat_skew": by_customer("skew"),
        "feat_nunique": f"""WITH {TX}, {snapshot_rows(SNAPSHOTS, "tx")}
            SELECT customer_id, year_month, {DISTINCTS} FROM snap_rows GROUP BY 1, 2""",
        "feat_mode": f"""WITH {TX}, c AS (SELECT customer_id, product_id, count(*) AS n FROM tx GROUP BY 1, 2)
            SELECT customer_id, product_id AS product_id__mode FROM c
            QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, product_id) = 1""",
        "snapshot_modes": f"WITH {modes(HALF_YEARS, ['product_id', 'supplier_id', 'country'])} SELECT * FROM modes",
        "approx_distinct_counts": f"""WITH {TX}, {snapshot_rows(HALF_YEARS, "tx")} SELECT customer_id, year_month,
            {', '.join(f"count(DISTINCT {c}) AS {feature_column(c, 'nunique')}" for c in ("product_id", "country", "order_date_year"))}
            FROM snap_rows GROUP BY 1, 2""",
        "customer_snapshot_features": f"""WITH {features(SNAPSHOTS)}
            SELECT customer_id, year_month, {', '.join(shown(c) for c in ALL_FEATURES)} FROM feats""",
        "snapshot_states": f"""WITH {TX}, {snapshot_rows(HALF_YEARS, "tx")}, {statistics("snap_rows", VALUES, STATS, "customer_id, year_month")}
            SELECT customer_id, year_month, {', '.join(shown(c) for c in names_of(VALUES, STATS))} FROM stats""",
        "patience_stop": patience_stop(),
        "mean_fold_auc": f"WITH {fold_predictions()} SELECT {ordered_mean("auc")} AS auc FROM ({auc('preds', by='fold')})",
        "blend_folds": f"""WITH {fold_predictions()} SELECT customer_id, {ordered_mean("probability")} AS probability
            FROM preds GROUP BY customer_id""",
        "customer_universe": f"WITH {TX} SELECT DISTINCT customer_id FROM tx WHERE order_date < {after(MONTH)}",
        "snapshot_months": f"""WITH {TX}, {snapshots(SNAPSHOTS)} SELECT DISTINCT s.year_month FROM snaps s
            JOIN tx ON tx.order_date < s.cutoff + INTERVAL 1 MONTH""",
        "label_sorted": f"WITH {TX}, {month_label} SELECT * FROM l ORDER BY customer_id NULLS LAST",
        "union_vocabulary": f"WITH {TX} SELECT DISTINCT country FROM tx",
        "label_encode": f"""WITH {TX}, codes AS (SELECT country AS name, CAST(dense_rank() OVER (ORDER BY country) - 1 AS BIGINT)
              AS code FROM (SELECT DISTINCT country FROM tx)),
            coded AS (SELECT order_id, line_no, product_id, supplier_id, customer_id, code AS country, order_date
              FROM tx JOIN codes ON tx.country = codes.name)
            SELECT *, 'train' AS part FROM coded WHERE order_date < {cutoff("1998-01")}
            UNION ALL SELECT *, 'test' FROM coded""",
        "median_fit": f"""WITH {matrix(SMALL_LAST, [BEFORE_LAST, LAST], SMALL_COLUMNS)}, one AS (
              SELECT {', '.join(f"round({middle(c)}, 4) AS {c}" for c in SMALL_COLUMNS)}
              FROM matrix WHERE year_month = '{BEFORE_LAST}')
            UNPIVOT one ON {', '.join(SMALL_COLUMNS)} INTO NAME feature VALUE median""",
        "median_impute": imputed(SMALL_LAST, BEFORE_LAST, LAST, SMALL_COLUMNS),
        "detect_categoricals": f"""WITH {TX} {' UNION ALL '.join(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_values FROM tx"
            for c in ("country", "order_date_year_month", "order_date_year", "order_date_hour"))}""",
        "preprocess": preprocessed(),
        "mark_gaps": gaps_marked(),
        "nominal_codes": nominal(),
        "snapshot_matrix": f"""WITH {matrix(features([BEFORE_LAST, LAST]), [BEFORE_LAST, LAST], ALL_FEATURES)}
            SELECT customer_id, year_month, label, {', '.join(shown(c) for c in ALL_FEATURES)} FROM matrix""",
        "feature_engineering": imputed(features([PREVIOUS, MONTH]), PREVIOUS, MONTH, ALL_FEATURES),
        "feature_engineering_whole_log": imputed(
            features([month_before(LAST), LAST]), month_before(LAST), LAST, ALL_FEATURES
        ),
        "generate_label": f"WITH {TX}, {month_label} SELECT * FROM l",
        "generate_label_before": f"WITH {TX}, {labels('l', MONTH, cutoff(MONTH))} SELECT * FROM l",
        "generate_labels": f"""WITH {TX}, {', '.join(labels(f'l{i}', m) for i, m in enumerate(SNAPSHOTS))}
            {' UNION ALL '.join(f'SELECT * FROM l{i}' for i in range(len(SNAPSHOTS)))}""",
        "baseline_no_ml": f"WITH {TX}, {BASE} SELECT * FROM base",
        "threshold_scores": f"WITH {TX}, {BASE} {rates('base')}",
        "roc_auc": f"WITH {TX}, {BASE} {auc('base')}",
        "auc_per_fold": f"WITH {fold_predictions()} {auc('preds', by='fold')}",
        "auc_oof": f"WITH {fold_predictions()} {auc('preds')}",
        "classification_report": f"WITH {TX}, {BASE} {report('base')}",
        "stratified_folds": f"""WITH {TX}, {month_label} SELECT customer_id, label,
            CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42-' || CAST(customer_id AS VARCHAR)), customer_id) - 1)
              % 10 AS INTEGER) AS fold FROM l""",
        "fold_split": f"""WITH {TX}, {month_label}, f AS (SELECT label,
            (row_number() OVER (PARTITION BY label ORDER BY md5('42-' || CAST(customer_id AS VARCHAR)), customer_id) - 1)
              % 10 AS fold FROM l) SELECT fold = 3 AS is_val, label, count(*) AS n FROM f GROUP BY 1, 2""",
        "cumsum_by_hour_events": f"""WITH ev AS (SELECT event_id, strftime(ts, '%H') AS order_date_hour, ts,
              round(value, 4) AS value, event_type, user_id FROM events)
            SELECT event_id, order_date_hour, {fixed_sum("value", "OVER (PARTITION BY order_date_hour ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")}
              AS cumsum_total_by_hour FROM ev""",
    }
    names = {"customer_id": "cust", "product_id": "prod", "order_id": "order"}
    for key in RUNNING_KEYS:
        sql[f"cumsum_by_{names.get(key, key.removeprefix('order_date_'))}"] = running_query(key)
    return sql | models()
