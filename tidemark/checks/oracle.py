"""The named queries' results as plain SQL over the given tables.

Written independently of the DataFrame code: ranks come from direct windows,
areas from self-contained running sums, the Student probability from numerical
integration. Shared steps are common table expressions.
"""

from __future__ import annotations

# Multiplier of the public 32-bit integer finaliser, the 32-bit mask, and the
# two start values of the draws for seed 42.
MULTIPLIER = 73244475
MASK32 = 4294967295
START_A, START_B = 3530462282, 2284289255

ORACLES: dict[str, str] = {}

FEATURES = "tx_amount, tx_time_seconds, tx_time_days, tx_hour, tx_day_of_week, tx_month, is_weekend"
NINE = (
    "transaction_id, tx_datetime, customer_id, terminal_id, tx_amount, "
    "tx_time_seconds, tx_time_days, tx_fraud, tx_fraud_scenario"
)

# --- shared steps: name -> (steps it needs, SQL) ----------------------------

STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "tx": (
        (),
        """
        SELECT event_id AS transaction_id, ts AS tx_datetime, user_id AS customer_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS terminal_id,
               value AS tx_amount,
               CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS tx_time_seconds,
               CAST((CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 86400 AS INTEGER) AS tx_time_days,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS tx_fraud,
               0 AS tx_fraud_scenario
        FROM events""",
    ),
    "feat": (
        ("tx",),
        """
        SELECT *, CAST(hour(tx_datetime) AS INTEGER) AS tx_hour,
               CAST(dayofweek(tx_datetime) + 1 AS INTEGER) AS tx_day_of_week,
               CAST(month(tx_datetime) AS INTEGER) AS tx_month,
               CASE WHEN dayofweek(tx_datetime) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
        FROM tx""",
    ),
    "txt": (
        ("tx",),
        """
        SELECT CAST(transaction_id AS VARCHAR) AS transaction_id,
               strftime(tx_datetime, '%Y-%m-%d %H:%M:%S') AS tx_datetime,
               CAST(customer_id AS VARCHAR) AS customer_id, CAST(terminal_id AS VARCHAR) AS terminal_id,
               CAST(tx_amount AS VARCHAR) AS tx_amount, CAST(tx_time_seconds AS VARCHAR) AS tx_time_seconds,
               CAST(tx_time_days AS VARCHAR) AS tx_time_days, CAST(tx_fraud AS VARCHAR) AS tx_fraud,
               CAST(tx_fraud_scenario AS VARCHAR) AS tx_fraud_scenario
        FROM tx""",
    ),
    "trimmed": (
        ("tx", "txt"),
        """
        SELECT * REPLACE (
               CASE WHEN CAST(terminal_id AS INTEGER) < 10 THEN 'abc' ELSE tx_amount END AS tx_amount,
               CASE WHEN substr(tx_datetime, 12, 2) = '03' THEN 'bad' ELSE tx_datetime END AS tx_datetime,
               CASE WHEN CAST(terminal_id AS INTEGER) > 95 THEN '' ELSE tx_time_days END AS tx_time_days,
               CASE WHEN substr(tx_datetime, 12, 2) = '23' THEN NULL ELSE tx_fraud END AS tx_fraud)
        FROM txt""",
    ),
    "typed": (
        ("tx", "txt", "trimmed"),
        """
        SELECT TRY_CAST(transaction_id AS BIGINT) AS transaction_id,
               try_strptime(tx_datetime, '%Y-%m-%d %H:%M:%S') AS tx_datetime,
               TRY_CAST(customer_id AS BIGINT) AS customer_id, TRY_CAST(terminal_id AS BIGINT) AS terminal_id,
               TRY_CAST(tx_amount AS DOUBLE) AS tx_amount, TRY_CAST(tx_time_seconds AS BIGINT) AS tx_time_seconds,
               TRY_CAST(tx_time_days AS INTEGER) AS tx_time_days, TRY_CAST(tx_fraud AS INTEGER) AS tx_fraud,
               TRY_CAST(tx_fraud_scenario AS INTEGER) AS tx_fraud_scenario
        FROM trimmed""",
    ),
    # what the messages say once parsed: broken payloads by terminal
    "msg": (
        ("tx",),
        """
        SELECT CAST(transaction_id AS VARCHAR) AS message_key, tx_datetime AS kafka_timestamp,
               CASE WHEN terminal_id >= 10 THEN transaction_id END AS transaction_id,
               CASE WHEN terminal_id >= 5 THEN strftime(tx_datetime, '%Y-%m-%d %H:%M:%S') END AS tx_datetime,
               CASE WHEN terminal_id >= 5 THEN customer_id END AS customer_id,
               CASE WHEN terminal_id >= 5 THEN terminal_id END AS terminal_id,
               CASE WHEN terminal_id >= 20 OR terminal_id BETWEEN 5 AND 9 THEN tx_amount END AS tx_amount,
               CASE WHEN terminal_id >= 5 THEN tx_time_seconds END AS tx_time_seconds,
               CASE WHEN terminal_id >= 5 THEN tx_time_days END AS tx_time_days,
               CASE WHEN terminal_id >= 5 THEN tx_fraud END AS tx_fraud,
               CASE WHEN terminal_id >= 5 THEN tx_fraud_scenario END AS tx_fraud_scenario
        FROM tx""",
    ),
    "msgfeat": (
        ("tx", "msg"),
        """
        SELECT * REPLACE (coalesce(tx_amount, 0.0) AS tx_amount, coalesce(tx_time_seconds, 0) AS tx_time_seconds,
                          coalesce(tx_time_days, 0) AS tx_time_days),
               CAST(tx_datetime AS TIMESTAMP) AS tx_timestamp,
               CAST(coalesce(hour(CAST(tx_datetime AS TIMESTAMP)), 0) AS INTEGER) AS tx_hour,
               CAST(coalesce(dayofweek(CAST(tx_datetime AS TIMESTAMP)) + 1, 0) AS INTEGER) AS tx_day_of_week,
               CAST(coalesce(month(CAST(tx_datetime AS TIMESTAMP)), 0) AS INTEGER) AS tx_month,
               CASE WHEN dayofweek(CAST(tx_datetime AS TIMESTAMP)) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
        FROM msg""",
    ),
    "ranked": (
        ("tx", "feat"),
        """
        SELECT *, row_number() OVER (PARTITION BY tx_fraud ORDER BY md5(concat_ws('|', 42, transaction_id)), transaction_id) AS rn,
               count(*) OVER (PARTITION BY tx_fraud) AS class_rows
        FROM feat""",
    ),
    "sides": (
        ("tx", "feat", "ranked"),
        """
        SELECT *, CASE WHEN rn <= least(greatest(CAST(floor(class_rows * CAST(0.8 AS DOUBLE)) AS BIGINT), 1), class_rows - 1)
                       THEN 'train' ELSE 'test' END AS split
        FROM ranked""",
    ),
    "scored_a": (
        ("tx", "feat", "ranked", "sides"),
        """
        SELECT transaction_id, tx_fraud, tx_amount / CAST(100 AS DOUBLE) AS score,
               CASE WHEN tx_amount / CAST(100 AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS prediction
        FROM sides WHERE split = 'test'""",
    ),
    "scored_b": (
        ("tx", "feat", "ranked", "sides"),
        """
        SELECT transaction_id, tx_fraud, tx_hour / CAST(24 AS DOUBLE) AS score,
               CASE WHEN tx_hour / CAST(24 AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS prediction
        FROM sides WHERE split = 'test'""",
    ),
}


def _cells(name: str) -> str:
    return f"""
        SELECT count(*) FILTER (tx_fraud = 1 AND prediction = 1) AS tp,
               count(*) FILTER (tx_fraud = 0 AND prediction = 1) AS fp,
               count(*) FILTER (tx_fraud = 0 AND prediction = 0) AS tn,
               count(*) FILTER (tx_fraud = 1 AND prediction = 0) AS fn
        FROM scored_{name}"""


def _rates(name: str) -> str:
    return f"""
        SELECT *, CASE WHEN p + r > 0 THEN CAST(2 AS DOUBLE) * p * r / (p + r) ELSE CAST(0 AS DOUBLE) END AS f
        FROM (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p,
                     CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r
              FROM cells_{name})"""


def _classes(name: str) -> str:
    """Accuracy and weighted F1 by joining true and predicted classes."""
    return f"""
        SELECT (SELECT avg(CASE WHEN tx_fraud = prediction THEN 1.0 ELSE 0.0 END) FROM scored_{name}) AS accuracy,
               sum(n * CASE WHEN n + m > 0 THEN CAST(2 * hit AS DOUBLE) / (n + m) ELSE 0 END) / sum(n) AS weighted_f1
        FROM (SELECT c.tx_fraud, count(*) AS n,
                     (SELECT count(*) FROM scored_{name} x WHERE x.prediction = c.tx_fraud) AS m,
                     count(*) FILTER (c.prediction = c.tx_fraud) AS hit
              FROM scored_{name} c GROUP BY c.tx_fraud)"""


def _areas(name: str) -> str:
    """Both areas as trapezoids over the cumulative curve points."""
    return f"""
        SELECT sum((x - coalesce(lx, 0)) * (y + coalesce(ly, 0)) / 2) AS auc,
               sum((y - coalesce(ly, 0)) * (prec + coalesce(lprec, prec)) / 2) AS pr_auc
        FROM (SELECT *, lag(x) OVER (ORDER BY score DESC) AS lx, lag(y) OVER (ORDER BY score DESC) AS ly,
                     lag(prec) OVER (ORDER BY score DESC) AS lprec
              FROM (SELECT score,
                           CAST(sum(neg) OVER w AS DOUBLE) / sum(neg) OVER () AS x,
                           CAST(sum(pos) OVER w AS DOUBLE) / sum(pos) OVER () AS y,
                           CAST(sum(pos) OVER w AS DOUBLE) / sum(pos + neg) OVER w AS prec
                    FROM (SELECT score, count(*) FILTER (tx_fraud = 1) AS pos, count(*) FILTER (tx_fraud = 0) AS neg
                          FROM scored_{name} GROUP BY score)
                    WINDOW w AS (ORDER BY score DESC)))"""


def _draws(rows: str, iterations: int = 100) -> str:
    """(iter_id, row_id) by the keyed integer mix, one subquery per step."""

    def mixed(sql: str) -> str:
        for _ in range(2):
            step = "(xor({0}, {0} >> 16) * %d) & %d AS {0}" % (MULTIPLIER, MASK32)
            sql = f"SELECT i, lo, hi, {step.format('a')}, {step.format('b')} FROM ({sql})"
        return f"SELECT i, lo, hi, xor(a, a >> 16) AS a, xor(b, b >> 16) AS b FROM ({sql})"

    base = f"SELECT unnest(range({iterations} * (SELECT count(*) FROM {rows}))) AS i"
    words = f"SELECT i, i & {MASK32} AS lo, (i >> 32) & {MASK32} AS hi FROM ({base})"
    first = mixed(f"SELECT *, xor(hi, {START_A}) AS a, xor(lo, {START_B}) AS b FROM ({words})")
    second = mixed(f"SELECT i, lo, hi, xor(a, lo) AS a, xor(b, hi) AS b FROM ({first})")
    size = f"(SELECT count(*) FROM {rows})"
    return f"SELECT i // {size} AS iter_id, (((a >> 2) << 30) + (b >> 2)) % {size} AS row_id FROM ({second})"


def _replicates(name: str) -> str:
    return f"""
        SELECT iter_id, count(*) FILTER (row_id < tp) AS tp,
               count(*) FILTER (row_id >= tp AND row_id < tp + fp) AS fp,
               count(*) FILTER (row_id >= tp + fp AND row_id < tp + fp + tn) AS tn,
               count(*) FILTER (row_id >= tp + fp + tn) AS fn
        FROM draws_{name}, cells_{name} GROUP BY iter_id"""


def _scores(name: str) -> str:
    return f"""
        SELECT iter_id,
               CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS F1,
               CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS P,
               CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS R
        FROM reps_{name}"""


def _stats(name: str) -> str:
    parts = [
        f"SELECT '{m}' AS metric, count({m}) AS n, avg({m}) AS mean, var_samp({m}) AS variance FROM scores_{name}"
        for m in ("F1", "P", "R")
    ]
    return " UNION ALL ".join(parts)


for _n in ("a", "b"):
    _up = ("tx", "feat", "ranked", "sides", f"scored_{_n}")
    STEPS[f"cells_{_n}"] = (_up, _cells(_n))
    STEPS[f"rates_{_n}"] = ((*_up, f"cells_{_n}"), _rates(_n))
    STEPS[f"classes_{_n}"] = (_up, _classes(_n))
    STEPS[f"areas_{_n}"] = (_up, _areas(_n))
    STEPS[f"draws_{_n}"] = (_up, _draws(f"scored_{_n}"))
    STEPS[f"reps_{_n}"] = ((*_up, f"cells_{_n}", f"draws_{_n}"), _replicates(_n))
    STEPS[f"scores_{_n}"] = ((*_up, f"cells_{_n}", f"draws_{_n}", f"reps_{_n}"), _scores(_n))
    STEPS[f"stats_{_n}"] = (
        (*_up, f"cells_{_n}", f"draws_{_n}", f"reps_{_n}", f"scores_{_n}"),
        _stats(_n),
    )

STEPS["welch"] = (
    ("stats_a", "stats_b"),
    """
    SELECT metric, a.mean AS base_mean, b.mean AS candidate_mean, b.mean - a.mean AS improvement,
           (a.mean - b.mean) / sqrt(a.variance / a.n + b.variance / b.n) AS t,
           power(a.variance / a.n + b.variance / b.n, 2)
             / (power(a.variance / a.n, 2) / (a.n - 1) + power(b.variance / b.n, 2) / (b.n - 1)) AS df,
           abs(b.mean - a.mean) / sqrt((a.variance + b.variance) / 2) AS effect_size
    FROM stats_a a JOIN stats_b b USING (metric)""",
)
# Simpson's rule over the density from 0 to |t|; beyond 40 nothing is left
STEPS["tested"] = (
    ("welch",),
    """
    SELECT w.*, CASE WHEN abs(t) > 40 THEN CAST(0 AS DOUBLE) ELSE greatest(0, 1 - 2 * area) END AS p
    FROM welch w JOIN (
        SELECT metric, sum(weight * exp(lgamma((df + 1) / 2) - lgamma(df / 2))
                   / sqrt(df * pi()) * power(1 + x * x / df, -(df + 1) / 2)) * max(h) / 3 AS area
        FROM (SELECT metric, df, least(abs(t), 40) / 20000 AS h, least(abs(t), 40) / 20000 * k AS x,
                     CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS weight
              FROM welch, (SELECT unnest(range(20001)) AS k))
        GROUP BY metric) USING (metric)""",
)


def _closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []
    for name in names:
        for step in (*_closure(STEPS[name][0]), name):
            if step not in order:
                order.append(step)
    return order


def oracle(name: str, sql: str, *steps: str) -> None:
    """Register ``sql`` under ``name`` behind the steps it reads."""
    ctes = ", ".join(f"{s} AS ({STEPS[s][1]})" for s in _closure(steps))
    ORACLES[name] = f"WITH {ctes} {sql}"


# --- scans, cleaning, features ---------------------------------------------------

oracle("scan_parquet", f"SELECT {NINE} FROM tx", "tx")
oracle(
    "scan_text_roundtrip",
    """SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, date_trunc('second', tx_datetime) AS tx_datetime,
              CAST(customer_id AS VARCHAR) AS customer_id, CAST(terminal_id AS VARCHAR) AS terminal_id, tx_amount,
              tx_time_seconds, tx_time_days, tx_fraud, CAST(tx_fraud_scenario AS VARCHAR) AS tx_fraud_scenario
       FROM tx""",
    "tx",
)
oracle("scan_csv_header_roundtrip", f"SELECT {NINE} FROM txt", "txt")
oracle("clean_trim", f"SELECT {NINE} FROM trimmed", "trimmed")
oracle(
    "clean_cast",
    """SELECT transaction_id, customer_id, terminal_id, tx_amount, tx_time_seconds, tx_time_days,
              tx_fraud, tx_fraud_scenario FROM typed""",
    "typed",
)
oracle("clean_timestamp", "SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, tx_datetime FROM typed", "typed")
oracle(
    "clean_datetime_string",
    """SELECT CAST(transaction_id AS VARCHAR) AS transaction_id,
              strftime(tx_datetime, '%Y-%m-%d %H:%M:%S') AS tx_datetime FROM typed""",
    "typed",
)
COMPLETE = """tx_datetime IS NOT NULL AND tx_amount IS NOT NULL AND tx_time_seconds IS NOT NULL
              AND tx_time_days IS NOT NULL AND tx_fraud IS NOT NULL"""
oracle(
    "clean_required",
    f"""SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, tx_datetime, CAST(customer_id AS VARCHAR) AS customer_id,
               CAST(terminal_id AS VARCHAR) AS terminal_id, tx_amount, tx_time_seconds, tx_time_days, tx_fraud,
               CAST(tx_fraud_scenario AS VARCHAR) AS tx_fraud_scenario
        FROM typed WHERE {COMPLETE}""",
    "typed",
)
oracle(
    "clean_replay",
    f"""SELECT transaction_id, strftime(tx_datetime, '%Y-%m-%d %H:%M:%S') AS tx_datetime, customer_id, terminal_id,
               tx_amount, tx_time_seconds, tx_time_days, tx_fraud, tx_fraud_scenario
        FROM typed WHERE transaction_id IS NOT NULL AND {COMPLETE}""",
    "typed",
)
oracle(
    "fill_zero",
    """SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, coalesce(tx_amount, 0) AS tx_amount,
              coalesce(tx_time_seconds, 0) AS tx_time_seconds, coalesce(tx_time_days, 0) AS tx_time_days FROM typed""",
    "typed",
)
oracle("class_distribution", "SELECT split, tx_fraud, count(*) AS rows FROM sides GROUP BY ALL", "sides")
oracle("time_features", "SELECT transaction_id, tx_hour, tx_day_of_week, tx_month, is_weekend FROM feat", "feat")
oracle("features_batch", f"SELECT transaction_id, tx_fraud, {FEATURES} FROM feat", "feat")
oracle("features_stream", f"SELECT message_key, transaction_id, tx_timestamp, {FEATURES} FROM msgfeat", "msgfeat")
oracle(
    "request_impute",
    """SELECT transaction_id, customer_id, terminal_id, tx_amount, tx_time_seconds, tx_time_days,
              CASE WHEN terminal_id > 50 THEN tx_hour ELSE 0 END AS tx_hour,
              0 AS tx_day_of_week, 0 AS tx_month, 0 AS is_weekend FROM feat""",
    "feat",
)
oracle("latency_seconds", "SELECT transaction_id, terminal_id AS latency_seconds FROM tx", "tx")

# --- messages ---------------------------------------------------------------------

oracle("json_parse", f"SELECT message_key, {NINE} FROM msg", "msg")
oracle(
    "json_roundtrip",
    """SELECT CAST(transaction_id AS VARCHAR) AS key,
              tx.* REPLACE (strftime(tx_datetime, '%Y-%m-%d %H:%M:%S') AS tx_datetime) FROM tx""",
    "tx",
)
oracle(
    "prediction_envelope",
    f"""SELECT CAST(transaction_id AS VARCHAR) AS key, transaction_id, tx_datetime, customer_id, terminal_id, {FEATURES},
               tx_amount / CAST(100 AS DOUBLE) AS score, CASE WHEN tx_amount / CAST(100 AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS prediction,
               tx_fraud, date_trunc('second', kafka_timestamp) + INTERVAL 90 SECOND AS processed_at,
               date_trunc('millisecond', kafka_timestamp) AS kafka_timestamp, CAST(90 AS BIGINT) AS latency_seconds
        FROM msgfeat WHERE transaction_id IS NOT NULL""",
    "msgfeat",
)
# the payload of a dead letter: plain garbage, or the JSON text with a quoted id
DEAD_LETTERS = """
    SELECT CAST(NULL AS VARCHAR) AS key,
           CASE WHEN terminal_id < 5 THEN 'garbage' ELSE
             '{"transaction_id":"' || transaction_id || '","tx_datetime":"' || strftime(tx_datetime, '%Y-%m-%d %H:%M:%S')
             || '","customer_id":' || customer_id || ',"terminal_id":' || terminal_id || ',"tx_amount":' || tx_amount
             || ',"tx_time_seconds":' || tx_time_seconds || ',"tx_time_days":' || tx_time_days
             || ',"tx_fraud":' || tx_fraud || ',"tx_fraud_scenario":' || tx_fraud_scenario || '}' END AS raw_payload,
           'transaction_id is null or JSON parse failed' AS error_message
    FROM tx WHERE terminal_id < 10"""
oracle("dead_letter_envelope", DEAD_LETTERS, "tx")
# what the messages hold, as text
STEPS["payload"] = (
    ("tx",),
    """SELECT CAST(transaction_id AS VARCHAR) AS key, tx_datetime AS timestamp, terminal_id,
              CASE WHEN terminal_id < 5 THEN 'garbage' ELSE
                '{"transaction_id":' || CASE WHEN terminal_id < 10 THEN '"' || transaction_id || '"' ELSE CAST(transaction_id AS VARCHAR) END
                || ',"tx_datetime":"' || strftime(tx_datetime, '%Y-%m-%d %H:%M:%S')
                || '","customer_id":' || customer_id || ',"terminal_id":' || terminal_id
                || ',"tx_amount":' || CASE WHEN terminal_id BETWEEN 10 AND 19 THEN '"abc"' ELSE CAST(tx_amount AS VARCHAR) END
                || ',"tx_time_seconds":' || tx_time_seconds || ',"tx_time_days":' || tx_time_days
                || ',"tx_fraud":' || tx_fraud || ',"tx_fraud_scenario":' || tx_fraud_scenario || '}'
                || CASE WHEN terminal_id BETWEEN 20 AND 24 THEN ' trailing' ELSE '' END END AS value
       FROM tx""",
)

# --- split, order ---------------------------------------------------------------------

oracle("stratified_split", "SELECT transaction_id, tx_fraud, split FROM sides", "sides")
oracle(
    "split_quota_summary",
    """SELECT tx_fraud, count(*) AS rows, count(*) FILTER (split = 'train') AS train_rows,
              count(*) FILTER (split = 'test') AS test_rows FROM sides GROUP BY tx_fraud""",
    "sides",
)
oracle(
    "validation_split",
    """SELECT transaction_id, tx_fraud,
              CASE WHEN vr <= floor(vn * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'test' END AS split
       FROM (SELECT *, count(*) OVER (PARTITION BY tx_fraud) AS vn,
                    row_number() OVER (PARTITION BY tx_fraud ORDER BY md5(concat_ws('|', 43, transaction_id))) AS vr
             FROM sides WHERE split = 'train')""",
    "sides",
)
oracle(
    "dense_row_id",
    """SELECT transaction_id, tx_fraud AS y_true, prediction AS y_pred,
              row_number() OVER (ORDER BY transaction_id) - 1 AS row_id FROM scored_a""",
    "scored_a",
)
oracle("replay_first_n", f"SELECT {NINE} FROM tx ORDER BY tx_datetime, transaction_id LIMIT 5000", "tx")
oracle(
    "replay_slots",
    """SELECT transaction_id, seq, seq // 50 AS slot
       FROM (SELECT transaction_id, row_number() OVER (ORDER BY tx_datetime, transaction_id) - 1 AS seq FROM tx)""",
    "tx",
)
oracle(
    "replay_messages",
    """SELECT CAST(transaction_id AS VARCHAR) AS key,
              first.* REPLACE (strftime(tx_datetime, '%Y-%m-%d %H:%M:%S') AS tx_datetime)
       FROM (SELECT * FROM tx ORDER BY date_trunc('second', tx_datetime), transaction_id) AS first""",
    "tx",
)

oracle(
    "replay_paced",
    """SELECT CAST(CAST(floor(seq / CAST(1200.5 AS DOUBLE)) AS BIGINT) // 2 AS INTEGER) AS span, CAST(transaction_id AS VARCHAR) AS key,
              r.* EXCLUDE (seq) REPLACE (strftime(tx_datetime, '%Y-%m-%d %H:%M:%S') AS tx_datetime)
       FROM (SELECT *, row_number() OVER (ORDER BY date_trunc('second', tx_datetime), transaction_id) - 1 AS seq FROM tx) AS r""",
    "tx",
)

# --- weights and metrics ---------------------------------------------------------------

TRAIN_COUNTS = """(SELECT count(*) FILTER (tx_fraud = 0) AS count_0, count(*) FILTER (tx_fraud = 1) AS count_1
                   FROM sides WHERE split = 'train')"""
oracle(
    "class_weights",
    f"""SELECT count_0, count_1, (count_0 + count_1) / (CAST(2 AS DOUBLE) * count_0) AS weight_0,
               (count_0 + count_1) / (CAST(2 AS DOUBLE) * count_1) AS weight_1 FROM {TRAIN_COUNTS}""",
    "sides",
)
oracle(
    "weighted_rows",
    f"""SELECT transaction_id, tx_fraud,
               (count_0 + count_1) / (CAST(2 AS DOUBLE) * CASE WHEN tx_fraud = 1 THEN count_1 ELSE count_0 END) AS class_weight
        FROM sides, {TRAIN_COUNTS} WHERE split = 'train'""",
    "sides",
)
oracle(
    "threshold_flag",
    "SELECT transaction_id, CASE WHEN tx_amount / CAST(100 AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS prediction FROM tx",
    "tx",
)
oracle("confusion", "SELECT tp, fp, tn, fn FROM cells_a", "cells_a")
oracle("precision_recall", "SELECT p AS fraud_precision, r AS fraud_recall FROM rates_a", "rates_a")
oracle("fraud_f1", "SELECT round(f, 10) AS fraud_f1 FROM rates_a", "rates_a")
oracle("auc_roc", "SELECT round(auc, 10) AS auc FROM areas_a", "areas_a")
oracle("auc_pr", "SELECT round(pr_auc, 10) AS pr_auc FROM areas_a", "areas_a")
oracle("accuracy", "SELECT round(accuracy, 10) AS accuracy FROM classes_a", "classes_a")
oracle("weighted_f1", "SELECT round(weighted_f1, 10) AS weighted_f1 FROM classes_a", "classes_a")
oracle(
    "evaluate_scores",
    """SELECT round(auc, 10) AS auc, round(pr_auc, 10) AS pr_auc, round(accuracy, 10) AS accuracy,
              round(weighted_f1, 10) AS f1, round(p, 10) AS fraud_precision, round(r, 10) AS fraud_recall,
              tp, fp, tn, fn, round(f, 10) AS fraud_f1
       FROM areas_b, classes_b, rates_b""",
    "areas_b",
    "classes_b",
    "rates_b",
)

# --- resampling and comparison -----------------------------------------------------------

oracle(
    "bootstrap_join",
    """SELECT iter_id, count(*) FILTER (tx_fraud = 1 AND prediction = 1) AS tp,
              count(*) FILTER (tx_fraud = 0 AND prediction = 1) AS fp,
              count(*) FILTER (tx_fraud = 0 AND prediction = 0) AS tn,
              count(*) FILTER (tx_fraud = 1 AND prediction = 0) AS fn
       FROM draws_a JOIN (SELECT *, row_number() OVER (ORDER BY transaction_id) - 1 AS row_id FROM scored_a) USING (row_id)
       GROUP BY iter_id""",
    "draws_a",
)
oracle("bootstrap_cells", "SELECT iter_id, tp, fp, tn, fn FROM reps_a", "reps_a")
oracle(
    "bootstrap_scores",
    "SELECT iter_id, round(F1, 10) AS F1, round(P, 10) AS P, round(R, 10) AS R FROM scores_a ORDER BY iter_id",
    "scores_a",
)
oracle(
    "replicate_stats",
    "SELECT metric, n, round(mean, 10) AS mean, round(variance, 10) AS variance FROM stats_a",
    "stats_a",
)
oracle("welch_t", "SELECT metric, round(t, 6) AS t_statistic, round(df, 6) AS degrees FROM welch", "welch")
oracle("welch_p", "SELECT metric, round(p, 8) AS p_value, p < 0.01 AS is_significant FROM tested", "tested")
oracle("effect_size", "SELECT metric, round(effect_size, 8) AS effect_size FROM welch", "welch")
oracle(
    "model_improvement",
    """SELECT metric, round(base_mean, 10) AS base_mean, round(candidate_mean, 10) AS candidate_mean,
              round(improvement, 10) AS improvement FROM welch""",
    "welch",
)
VERDICT = """CASE WHEN NOT p < 0.01 THEN 'not significant' WHEN improvement > 0 THEN 'better'
                  WHEN improvement < 0 THEN 'worse' ELSE 'different' END AS verdict"""
oracle("verdict_label", f"SELECT metric, {VERDICT} FROM tested", "tested")
oracle("deploy_decision", "SELECT p < 0.01 AND improvement > 0 AS should_deploy FROM tested WHERE metric = 'F1'", "tested")
oracle(
    "ab_test",
    f"""SELECT metric, round(t, 6) AS t_statistic, round(df, 6) AS degrees, round(p, 6) AS p_value,
               round(effect_size, 6) AS effect_size, p < 0.01 AS is_significant, round(base_mean, 6) AS base_mean,
               round(candidate_mean, 6) AS candidate_mean, round(improvement, 6) AS improvement, {VERDICT}
        FROM tested WHERE metric IN ('F1', 'P')""",
    "tested",
)
oracle(
    "score_requests",
    """SELECT transaction_id, tx_amount / CAST(100 AS DOUBLE) AS fraud_probability,
              CASE WHEN tx_amount / CAST(100 AS DOUBLE) >= 0.75 THEN 1 ELSE 0 END AS fraud_prediction FROM tx""",
    "tx",
)

oracle(
    "fit_forest_layout",
    "SELECT count(*) AS rows, count(*) AS equal_scores FROM sides WHERE split = 'test'",
    "sides",
)
oracle(
    "score_forest_check",
    "SELECT count(*) AS rows, count(*) AS in_range, count(*) AS flags_agree FROM sides WHERE split = 'test'",
    "sides",
)
oracle(
    "stored_forest_agrees",
    "SELECT count(*) AS rows, count(*) AS equal_scores FROM sides WHERE split = 'test'",
    "sides",
)

# --- run log and aliases ------------------------------------------------------------------

oracle(
    "run_log_pivot",
    """SELECT run_id, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(tn AS DOUBLE) AS tn, CAST(fn AS DOUBLE) AS fn,
              round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 10) AS fraud_precision,
              round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 10) AS fraud_recall
       FROM (SELECT 'day-' || tx_time_days AS run_id,
                    count(*) FILTER (tx_fraud = 1 AND tx_amount >= 50) AS tp, count(*) FILTER (tx_fraud = 0 AND tx_amount >= 50) AS fp,
                    count(*) FILTER (tx_fraud = 0 AND tx_amount < 50) AS tn, count(*) FILTER (tx_fraud = 1 AND tx_amount < 50) AS fn
             FROM tx GROUP BY tx_time_days)""",
    "tx",
)
STEPS["reg"] = (
    ("tx",),
    """SELECT 'model-' || customer_id AS model, transaction_id AS version, transaction_id AS event_seq,
              CASE WHEN row_number() OVER (PARTITION BY customer_id ORDER BY transaction_id) = 1
                   THEN 'champion' ELSE 'challenger' END AS alias
       FROM tx""",
)
STEPS["cur"] = (
    ("reg",),
    "SELECT model, alias, max(version) AS version, max(event_seq) AS event_seq FROM reg GROUP BY model, alias",
)
oracle("register_alias", "SELECT model, alias, version, event_seq FROM reg", "reg")
oracle("resolve_alias", "SELECT model, alias, version, event_seq FROM cur", "cur")
oracle(
    "promote_alias",
    """SELECT c.model, c.alias, coalesce(h.version, c.version) AS version,
              CASE WHEN h.version IS NULL THEN c.event_seq ELSE (SELECT max(event_seq) + 1 FROM reg) END AS event_seq
       FROM cur c LEFT JOIN (
            SELECT model, version FROM cur WHERE alias = 'challenger'
              AND model IN (SELECT 'model-' || customer_id FROM tx WHERE tx_amount >= 200)) h
         ON h.model = c.model AND c.alias = 'champion'""",
    "cur",
)

# --- streams ---------------------------------------------------------------------------------

oracle("stream_source_rows", "SELECT key, value, timestamp FROM payload", "payload")
oracle("stream_parse", f"SELECT message_key, kafka_timestamp, {NINE} FROM msg", "msg")
oracle("stream_valid", "SELECT message_key, transaction_id FROM msg WHERE transaction_id IS NOT NULL", "msg")
oracle("stream_dead_letter", DEAD_LETTERS, "tx")
oracle("stream_features", f"SELECT transaction_id, {FEATURES} FROM msgfeat WHERE transaction_id IS NOT NULL", "msgfeat")
oracle(
    "stream_scored",
    f"""SELECT 'fraud.output.predictions' AS topic, CAST(transaction_id AS VARCHAR) AS key, transaction_id, tx_datetime, customer_id,
               terminal_id, {FEATURES}, tx_amount / CAST(100 AS DOUBLE) AS score,
               CASE WHEN tx_amount / CAST(100 AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS prediction, tx_fraud,
               true AS has_processed_at, date_trunc('millisecond', kafka_timestamp) AS kafka_timestamp, true AS has_latency_seconds,
               CAST(NULL AS VARCHAR) AS raw_payload, CAST(NULL AS VARCHAR) AS error_message, false AS has_failed_at
        FROM msgfeat WHERE transaction_id IS NOT NULL
        UNION ALL BY NAME
        SELECT 'fraud.dead_letter' AS topic, value AS raw_payload, 'transaction_id is null or JSON parse failed' AS error_message,
               false AS has_processed_at, false AS has_latency_seconds, true AS has_failed_at
        FROM payload WHERE terminal_id < 10""",
    "msgfeat",
    "payload",
)
oracle(
    "stream_branches",
    """SELECT CASE WHEN transaction_id IS NULL THEN 'fraud.dead_letter' ELSE 'fraud.output.predictions' END AS topic,
              count(*) AS rows FROM msg GROUP BY 1""",
    "msg",
)
oracle(
    "stream_forest_agrees",
    "SELECT count(*) AS rows, count(*) AS equal_scores FROM msg WHERE transaction_id IS NOT NULL",
    "msg",
)
oracle(
    "forest_nodes_agree",
    """SELECT 'fitted' AS model, count(*) AS rows, count(*) AS equal_scores FROM sides WHERE split = 'test'
       UNION ALL SELECT 'loaded', count(*), count(*) FROM sides WHERE split = 'test'
       UNION ALL SELECT 'streamed', count(*), count(*) FROM msg WHERE transaction_id IS NOT NULL""",
    "sides",
    "msg",
)
oracle(
    "ab_test_stored",
    """SELECT 200 AS replicates, 200 AS in_range, 2 AS means_agree, count(*) AS rows, count(*) AS equal_scores, true AS promoted_as_decided
       FROM sides WHERE split = 'test'""",
    "sides",
)
oracle(
    "tune_trials_check",
    "SELECT 20 AS trials, 20 AS in_space, 20 AS in_range, count(*) > 0 AS best_is_maximum, count(*) > 0 AS best_is_a_trial FROM tx",
    "tx",
)
