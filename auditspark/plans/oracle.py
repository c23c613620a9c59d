"""SQL of the analytics queries, for an engine with ANSI windows, and the inline rows that some use."""

from __future__ import annotations

FEATURE_NAMES = (
    "risk_card1 riskn_card1 risk_max mem_known_compromised vel_txn_1d miss_blk_V1 miss_density nan_count regime card1 addr2 bin_proxy ProductCD_card4"
    " D1 D15 D1n C1 C14 Cx V110 M9 id_31 DeviceType DeviceInfo TransactionAmt hour odd_hour"
).split()
PAYSIM_ROWS = (
    (1, 181.0, 181.0, 0.0, 0.0, 0.0, 1, 0),
    (1, 181.0, 181.0, 0.0, 21182.0, 0.0, 1, 0),
    (25, 9839.64, 170136.0, 160296.36, 0.0, 0.0, 0, 0),
    (26, 1864.28, 21249.0, 19384.72, 0.0, 1864.28, 0, 0),
    (49, 11668.14, 41554.0, 29885.86, 100.0, 100.0, 0, 0),
    (50, 7817.71, 7817.70999, 0.0, 5.0, 7822.71, 0, 0),
    (73, 200000.5, 200000.5, 0.0, 10.0, 200010.5, 1, 1),
    (74, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0),
    (75, 50.25, 40.0, 0.0, 3.5, 53.75, 0, 0),
)
MEASURED = (("rung0", 0.84), ("rung1", 0.83), ("rung2", 0.58), ("rung3", 0.08), ("extra", 0.5))
SUPPOSED = (("rung0", 0.9), ("rung1", 0.85), ("rung2", 0.7), ("rung3", 0.45))


def _values(rows: tuple, names: str) -> str:
    def one(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


_O = """o AS (
  SELECT o_orderkey AS row_id, epoch_us(o_orderdate) // 1000000 AS t, o_custkey AS entity, (o_orderstatus = 'F')::INTEGER AS y,
    o_totalprice AS amount, o_orderpriority AS priority, c_mktsegment AS segment, c_nationkey AS nation,
    ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE AS score, (epoch_us(o_orderdate) // 1000000 // 86400)::INTEGER AS day
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
_SPARSE = f"""{_O}, sp AS (
  SELECT *, CASE WHEN row_id % 7 <> 0 THEN amount END AS a, CASE WHEN row_id % 7 <> 0 THEN nation END AS b,
    CASE WHEN NOT row_id % 5 < 2 THEN segment END AS c, CASE WHEN NOT (row_id % 11 = 3 OR row_id % 13 = 5) THEN priority END AS d FROM o
)"""
_AGED = f"""{_O}, ag AS (
  SELECT *, day - min(day) OVER (PARTITION BY entity) AS d1, (day - (day - min(day) OVER (PARTITION BY entity)))::BIGINT AS d1n FROM o
)"""
_BLOCKED = f"""{_AGED}, bl AS (
  SELECT *, CASE WHEN row_id % 17 = 0 THEN '__solo_' || row_id ELSE nation || '|' || segment || '|' || d1n END AS block, nation || '|' || d1n AS coarse FROM ag
)"""
_PAIRS = f"""{_BLOCKED}, rep AS (
  SELECT block, min(row_id) AS first_row, arg_min(coarse, row_id) AS coarse, arg_min(segment, row_id) AS segment, arg_min(priority, row_id) AS priority,
    arg_min(d1n, row_id) AS d15n FROM bl GROUP BY block
), grp AS (
  SELECT coarse, count(*) AS blocks, arg_min(block, first_row) AS anchor, arg_min(segment, first_row) AS a_segment, arg_min(priority, first_row) AS a_priority,
    arg_min(d15n, first_row) AS a_d15n FROM rep GROUP BY coarse HAVING count(*) BETWEEN 2 AND 200
), pr AS (
  SELECT rep.*, blocks, anchor, a_segment, a_priority, a_d15n,
    ((CASE WHEN segment = a_segment THEN 1.2 ELSE 0 END) + (CASE WHEN priority = a_priority THEN 0.6 ELSE 0 END)) / 1.8 AS score
  FROM rep JOIN grp USING (coarse) WHERE block <> anchor
)"""
_RESOLVED = f"""{_PAIRS}, rs AS (
  SELECT bl.row_id, bl.t, bl.y, bl.entity AS true_entity, coalesce(m.anchor, bl.block) AS entity
  FROM bl LEFT JOIN (SELECT block, anchor FROM pr WHERE score >= 0.55 AND NOT abs(a_d15n - d15n) > 3) m USING (block)
)"""


def _sizes(rel: str) -> str:
    return f"""SELECT count(*) AS n_entities, round(avg(n), 6) AS size_mean, round(quantile_cont(n, 0.5), 6)::DOUBLE AS size_median,
      round(quantile_cont(n, 0.95), 6)::DOUBLE AS size_p95, max(n) AS size_max, round(avg((n = 1)::INTEGER), 6) AS singleton_share
      FROM (SELECT entity, count(*) AS n FROM {rel} GROUP BY entity)"""


def _purity(rel: str) -> str:
    return f"""SELECT round(avg((lo = hi)::INTEGER), 6) AS label_purity, round(avg(CASE WHEN hi = 1 AND n >= 2 THEN (lo = hi)::INTEGER END), 6) AS positive_purity,
      round(1 - sum(hi)::DOUBLE / sum(pos), 6) AS propagated_share, round(avg(hi), 6) AS positive_entity_share
      FROM (SELECT entity, count(*) AS n, min(y) AS lo, max(y) AS hi, sum(y) AS pos FROM {rel} GROUP BY entity)"""


_QUALITY = """SELECT round(coalesce(p, 0), 6) AS pair_precision, round(coalesce(r, 0), 6) AS pair_recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS pair_f1 FROM (
  SELECT b / nullif(f, 0) AS p, b / nullif(g, 0) AS r FROM
    (SELECT sum(n * (n - 1) / 2)::DOUBLE AS b FROM (SELECT count(*) AS n FROM rs GROUP BY entity, true_entity)),
    (SELECT sum(n * (n - 1) / 2)::DOUBLE AS f FROM (SELECT count(*) AS n FROM rs GROUP BY entity)),
    (SELECT sum(n * (n - 1) / 2)::DOUBLE AS g FROM (SELECT count(*) AS n FROM rs GROUP BY true_entity)))"""

_LONG = f"""{_O}, lg AS (
  SELECT row_id, t, entity, y, 'priority' AS attr, priority AS value FROM o UNION ALL
  SELECT row_id, t, entity, y, 'segment', segment FROM o UNION ALL SELECT row_id, t, entity, y, 'nation', nation::VARCHAR FROM o
)"""
_PRIOR = f"""{_LONG}, vr AS (SELECT attr, value, count(*) AS n, avg(y) AS rate FROM lg GROUP BY attr, value
), bs AS (SELECT attr, least(greatest(avg(y), 1e-4), 1 - 1e-4) AS base FROM lg GROUP BY attr
), ft AS (SELECT attr, count(*) AS kinds, least(greatest(avg(rate), 1e-4), 1 - 1e-4) AS m, var_samp(rate) AS v FROM vr WHERE n >= 30 GROUP BY attr
), pj AS (
  SELECT attr, CASE WHEN coalesce(kinds, 0) >= 5 THEN m ELSE base END AS c,
    coalesce(kinds, 0) >= 5 AND v > 1e-12 AND v < m * (1 - m) AS fits, least(greatest(m * (1 - m) / v - 1, 1.0), 5000.0) AS s FROM bs LEFT JOIN ft USING (attr)
), prior AS (
  SELECT attr, CASE WHEN fits THEN c * s ELSE 20.0 * c END AS alpha0, CASE WHEN fits THEN (1 - c) * s ELSE 20.0 * (1 - c) END AS beta0 FROM pj
)"""
_T = "((t - 788918400) / 2592000.0::DOUBLE)"
_RISK = f"""{_PRIOR}, ws AS (
  SELECT row_id, attr,
    exp(-{_T}) * coalesce(sum(y * exp({_T})) OVER v, 0) AS p1, exp(-{_T}) * coalesce(sum(exp({_T})) OVER v, 0) AS n1,
    exp(-{_T}) * coalesce(sum(y * exp({_T})) OVER e, 0) AS p2, exp(-{_T}) * coalesce(sum(exp({_T})) OVER e, 0) AS n2
  FROM lg WINDOW v AS (PARTITION BY attr, value ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 2592001 PRECEDING),
    e AS (PARTITION BY attr, value, entity ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 2592001 PRECEDING)
), rk AS (
  SELECT row_id, attr, CASE WHEN p1 - p2 < 1e-9 THEN 0 ELSE p1 - p2 END AS pos, CASE WHEN n1 - n2 < 1e-9 THEN 0 ELSE n1 - n2 END AS tot FROM ws
), ri AS (SELECT rk.*, (alpha0 + pos) / (alpha0 + beta0 + tot) AS risk FROM rk JOIN prior USING (attr))"""

_REGIMES = f"""{_SPARSE}, rw AS (
  SELECT *, ((a IS NULL)::BIGINT + 2 * (c IS NULL)::BIGINT + 4 * (d IS NULL)::BIGINT) AS pattern FROM sp
), pt AS (SELECT pattern, count(*) AS n, count(*) / (SELECT count(*) FROM rw)::DOUBLE AS support FROM rw GROUP BY pattern
), rg AS (
  SELECT row_number() OVER (ORDER BY pattern) - 1 AS regime, pattern, n, support FROM (
    SELECT *, row_number() OVER (ORDER BY n DESC, pattern) AS r FROM pt) WHERE r <= 60 AND (support >= 0.05 OR r = 1)
), nr AS (
  SELECT pattern, regime FROM (SELECT pt.pattern, rg.regime, row_number() OVER (PARTITION BY pt.pattern ORDER BY bit_count(xor(pt.pattern, rg.pattern)), rg.regime) AS k FROM pt, rg) WHERE k = 1
), ra AS (SELECT rw.*, nr.regime FROM rw JOIN nr USING (pattern))"""
_DRIFT = f"""{_REGIMES}, wd AS (
  SELECT ((day - (SELECT min(day) FROM ra)) // 90)::INTEGER AS win, regime, count(*) AS n FROM ra GROUP BY 1, 2
), tt AS (SELECT win, sum(n) AS total FROM wd GROUP BY win
), gr AS (
  SELECT tt.win, rg.regime, tt.total, coalesce(wd.n, 0) AS n, (coalesce(wd.n, 0) / tt.total::DOUBLE + 1e-12) / (1 + (SELECT count(*) FROM rg) * 1e-12) AS p
  FROM tt CROSS JOIN rg LEFT JOIN wd ON wd.win = tt.win AND wd.regime = rg.regime
), dr AS (
  SELECT g.win AS "window", ((SELECT min(day) FROM ra) + g.win * 90)::INTEGER AS day_start, max(g.total)::BIGINT AS n,
    greatest(sum(0.5 * g.p * log2(g.p / ((g.p + q.p) / 2)) + 0.5 * q.p * log2(q.p / ((g.p + q.p) / 2))), 0) AS js,
    (arg_min(g.regime, g.n * -1000 + g.regime))::INTEGER AS top_regime
  FROM gr g JOIN gr q ON q.regime = g.regime AND q.win = 0 GROUP BY g.win
)"""


def _folds(latency: int, disjoint: bool) -> str:
    shared = "EXISTS (SELECT 1 FROM te WHERE te.start = mb.start AND te.entity = mb.entity)" if disjoint else "FALSE"
    return f"""wn AS (SELECT unnest(range((SELECT min(day) FROM o) + 360, (SELECT max(day) FROM o) + 1, 90))::INTEGER AS start
), mb AS (
  SELECT start, row_id, entity, y, score, CASE WHEN day >= start THEN 'test' WHEN day < start - {latency} THEN 'train' ELSE 'immature' END AS base FROM o JOIN wn ON day < start + 90
), te AS (SELECT DISTINCT start, entity FROM mb WHERE base = 'test'
), me AS (SELECT mb.*, CASE WHEN base = 'train' AND {shared} THEN 'shared' ELSE base END AS role FROM mb
), fm AS (
  SELECT row_number() OVER (ORDER BY start) - 1 AS fold_id, * FROM (
    SELECT start, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'shared') AS n_entity_dropped,
      count(*) FILTER (role = 'immature') AS n_immature_dropped, sum(y) FILTER (role = 'train') AS p, sum(y) FILTER (role = 'test') AS q FROM me GROUP BY start
  ) WHERE n_test >= 50 AND n_train >= 200 AND p >= 5
)"""


def _ranked(rel: str, by: str = "") -> str:
    """Relation rk_: metrics of (y, score) by group."""
    part = f"PARTITION BY {by}" if by else ""
    comma = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""sc AS (SELECT {comma}score, sum(y) AS p, sum(1 - y) AS n FROM {rel} GROUP BY {comma}score
), cm AS (SELECT *, sum(p) OVER ({part} ORDER BY score DESC) AS tp, sum(n) OVER ({part} ORDER BY score DESC) AS fp FROM sc
), rk AS (
  SELECT {comma}(sum(p) + sum(n))::BIGINT AS n, sum(p)::BIGINT AS n_pos, sum(p)::DOUBLE / (sum(p) + sum(n)) AS base_rate,
    CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * tp::DOUBLE / (tp + fp)) / sum(p) END AS auprc,
    CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(n::DOUBLE * (tp - p) + 0.5 * n * p) / (sum(p)::DOUBLE * sum(n)) END AS auroc FROM cm {group}
)"""


_INDEX = "ix AS (SELECT *, coalesce(row_id = first_value(row_id) OVER (PARTITION BY entity ORDER BY CASE WHEN y = 1 THEN 0 ELSE 1 END, t, row_id) AND y = 1, FALSE) AS is_index FROM o)"
_CALIBRATION = """SELECT sum(sq) / sum(n) AS brier, sum(abs(p - yy)) / sum(n) AS ece FROM (
  SELECT least(floor(score * 15), 14) AS bin, count(*)::DOUBLE AS n, sum(score) AS p, sum(y)::DOUBLE AS yy, sum((score - y) * (score - y)) AS sq FROM o GROUP BY 1)"""
_TOP = "tk AS (SELECT * FROM o ORDER BY score DESC, row_id LIMIT (SELECT greatest(1, round_even(count(*) * 0.01, 0))::BIGINT FROM o))"
_RUNS = f"WITH {_O}, {_ranked('o', 'segment, nation')}"
_MASS = """ms AS (
  SELECT p_brand AS family, CASE WHEN l_returnflag = 'A' THEN 'leaky' ELSE 'closed' END AS protocol, sum(l_extendedprice) AS mass
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2
), sh AS (SELECT family, protocol, mass / sum(mass) OVER (PARTITION BY protocol) AS share FROM ms)"""
_PAYSIM = _values(PAYSIM_ROWS, "step, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud")
_PS = f"""ps AS (SELECT *, oldbalanceOrg - amount - newbalanceOrig AS balance_err_orig, oldbalanceDest + amount - newbalanceDest AS balance_err_dest,
  (oldbalanceOrg > 0 AND newbalanceOrig = 0)::INTEGER AS orig_emptied, (abs(amount - oldbalanceOrg) <= 1e-8 + 1e-5 * abs(oldbalanceOrg))::INTEGER AS amount_eq_oldbalance FROM {_PAYSIM})"""
_R6 = ", ".join

SQL: dict[str, str] = {
    "base_features": f"""WITH {_O} SELECT row_id, day, ((t // 3600) % 24)::INTEGER AS hour, (day % 7)::INTEGER AS dow,
      ((t // 3600) % 24 < 6 OR (t // 3600) % 24 >= 22)::INTEGER AS odd_hour, round(ln(1 + amount), 6) AS log_amt,
      (round(amount * 100)::BIGINT % 100)::DOUBLE AS amt_cents, (round(amount * 100)::BIGINT % 100 = 0)::INTEGER AS amt_is_round FROM o""",
    "composite_keys": f"""WITH {_SPARSE} SELECT row_id, coalesce(c, 'nan') || '_' || coalesce(d, 'nan') AS product_card,
      coalesce(b::VARCHAR, '<NA>') || '|' || coalesce(c, '<NA>') || '|' || coalesce(d, '<NA>') AS bin_proxy FROM sp""",
    "nan_count": f"WITH {_SPARSE} SELECT row_id, (a IS NULL)::INTEGER + (b IS NULL)::INTEGER + (c IS NULL)::INTEGER + (d IS NULL)::INTEGER AS nan_count FROM sp",
    "factorize_codes": f"""WITH {_SPARSE}, f AS (SELECT c, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM sp WHERE c IS NOT NULL GROUP BY c)
      SELECT row_id, coalesce(code, -1)::INTEGER AS code FROM sp LEFT JOIN f USING (c)""",
    "d1n_key": f"WITH {_AGED} SELECT row_id, d1n, d1n AS d15n FROM ag",
    "block_keys": f"WITH {_BLOCKED} SELECT row_id, block, coarse FROM bl",
    "er_candidate_pairs": f"WITH {_PAIRS} SELECT block, anchor, coarse, blocks FROM pr",
    "er_agreement": f"WITH {_PAIRS} SELECT block, anchor, round(score, 6)::DOUBLE AS score, a_priority <> priority OR abs(a_d15n - d15n) > 3 AS in_conflict FROM pr",
    "er_pair_f1": f"WITH {_RESOLVED} {_QUALITY}",
    "entity_size_stats": f"WITH {_O} {_sizes('o')}",
    "entity_label_purity": f"WITH {_O} {_purity('o')}",
    "t2_entity_stats": f"""WITH {_RESOLVED} SELECT * FROM ({_sizes('rs')}), ({_purity('rs')}), ({_QUALITY}),
      (SELECT sum(y)::BIGINT AS n_left_truncated FROM (SELECT arg_min(y, t * 1000000000 + row_id) AS y FROM rs GROUP BY entity))""",
    "c_monotonicity": f"""WITH {_O}, cc AS (
        SELECT *, count(*) OVER w AS c1, CASE WHEN row_id % 19 <> 0 THEN sum(floor(amount)) OVER w END AS c2 FROM o
        WINDOW w AS (PARTITION BY entity ORDER BY t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      ), lg AS (
        SELECT 'customer' AS key, c1, c2, lag(c1) OVER w AS b1, lag(c2) OVER w AS b2 FROM cc WINDOW w AS (PARTITION BY entity ORDER BY t, row_id) UNION ALL
        SELECT 'nation', c1, c2, lag(c1) OVER w, lag(c2) OVER w FROM cc WINDOW w AS (PARTITION BY nation ORDER BY t, row_id)
      ) SELECT key, n_pairs, n_falls, round(n_falls::DOUBLE / n_pairs, 6) AS violation_rate FROM (
        SELECT key, (count(b1) + count(c2 + b2))::BIGINT AS n_pairs, (count(*) FILTER (c1 < b1) + count(*) FILTER (c2 < b2))::BIGINT AS n_falls FROM lg GROUP BY key)""",
    "index_events": f"WITH {_O}, {_INDEX} SELECT row_id, is_index FROM ix",
    "left_truncated": f"""WITH {_O} SELECT sum(y)::BIGINT AS n_left_truncated, count(*) AS n_entities
      FROM (SELECT y FROM o QUALIFY row_number() OVER (PARTITION BY entity ORDER BY t, row_id) = 1)""",
    "label_propagation": f"WITH {_O} SELECT row_id, max(y) OVER (PARTITION BY entity ORDER BY t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y_propagated FROM o",
    "left_join_coverage": """SELECT c_mktsegment, count(*) AS n_rows, count(n) AS n_matched, round(count(n) / count(*)::DOUBLE, 6) AS coverage
      FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    "eb_prior": f"WITH {_PRIOR} SELECT attr AS attribute, round(alpha0, 4) AS alpha0, round(beta0, 4) AS beta0 FROM prior",
    "assoc_risk_gated": f"WITH {_RISK} SELECT row_id, attr, round(pos, 4) AS pos, round(tot, 4) AS tot, round(risk, 6) AS risk FROM ri",
    "assoc_risk_summary": f"""WITH {_RISK} SELECT row_id, round(max(risk), 6) AS risk_max, round(avg(risk), 6) AS risk_mean,
      round(0.4 * max(risk) + 0.6 * avg(risk), 6) AS risk_prop FROM ri GROUP BY row_id""",
    "entity_memory": f"""WITH {_O}, w AS (SELECT row_id, t, count(*) OVER e AS n, coalesce(sum(y) OVER e, 0) AS p, min(CASE WHEN y = 1 THEN t END) OVER e AS f FROM o
        WINDOW e AS (PARTITION BY entity ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 2592001 PRECEDING))
      SELECT row_id, n AS mem_prior_txn_count, p::BIGINT AS mem_prior_fraud_count, (p > 0)::INTEGER AS mem_known_compromised,
        round((t - f) / 86400.0::DOUBLE, 6) AS mem_days_since_first_fraud FROM w""",
    "velocity": """WITH e AS (SELECT event_id AS row_id, epoch_us(ts) AS t, user_id AS entity, value AS amount FROM events
      ), w AS (SELECT *, list({'t': t, 'a': amount}) OVER (PARTITION BY entity ORDER BY t, row_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS past,
        lag(t) OVER (PARTITION BY entity ORDER BY t, row_id) AS last FROM e)
      SELECT row_id, len(list_filter(coalesce(past, []), lambda x: x.t >= t - 86400000000)) AS vel_txn_1d, len(list_filter(coalesce(past, []), lambda x: x.t >= t - 604800000000)) AS vel_txn_7d,
        round(coalesce(list_sum(list_transform(list_filter(coalesce(past, []), lambda x: x.t >= t - 604800000000), lambda x: x.a)), 0), 4)::DOUBLE AS vel_amt_7d,
        round((t - last) / 86400000000.0::DOUBLE, 6) AS vel_recency_days FROM w""",
    "regime_patterns": f"WITH {_REGIMES} SELECT regime, pattern, n, round(support, 6) AS support FROM rg",
    "regime_assign": f"WITH {_REGIMES} SELECT row_id, pattern, regime FROM ra",
    "missing_blocks": f"""WITH {_SPARSE}, m AS (
        SELECT 'a' AS col, bit_xor(CASE WHEN a IS NULL THEN hash(row_id) END) AS h FROM sp UNION ALL SELECT 'b', bit_xor(CASE WHEN b IS NULL THEN hash(row_id) END) FROM sp UNION ALL
        SELECT 'c', bit_xor(CASE WHEN c IS NULL THEN hash(row_id) END) FROM sp UNION ALL SELECT 'd', bit_xor(CASE WHEN d IS NULL THEN hash(row_id) END) FROM sp)
      SELECT string_agg(col, ',' ORDER BY col) AS columns, count(*)::INTEGER AS n_columns FROM m GROUP BY h""",
    "missing_features": f"""WITH {_SPARSE} SELECT row_id, (a IS NULL)::INTEGER AS miss_blk_a, (c IS NULL)::INTEGER AS miss_blk_c, (d IS NULL)::INTEGER AS miss_blk_d,
      round(((a IS NULL)::INTEGER + (c IS NULL)::INTEGER + (d IS NULL)::INTEGER) / 3.0::DOUBLE, 6) AS miss_density FROM sp""",
    "regime_distribution": f"""WITH {_REGIMES} SELECT regime, count(ra.row_id) AS n, round(count(ra.row_id) / (SELECT count(*) FROM ra)::DOUBLE, 6) AS share
      FROM rg LEFT JOIN ra USING (regime) GROUP BY regime""",
    "drift_js": f'WITH {_DRIFT} SELECT "window", day_start, n, round(js, 6) AS js, top_regime FROM dr',
    "drift_asof_perf": f"""WITH {_DRIFT}, {_folds(0, False)}, {_ranked("(SELECT start, score, y FROM me WHERE role = 'test')", 'start').replace('rk AS', 'pf AS')},
      nf AS (SELECT * FROM (SELECT d."window", f.fold_id, f.start, row_number() OVER (PARTITION BY d."window" ORDER BY abs(f.start - d.day_start), f.fold_id) AS k FROM dr d, fm f) WHERE k = 1)
      SELECT d."window", d.day_start, round(d.js, 6) AS js, nf.fold_id, nf.start AS fold_start, round(pf.auprc, 6) AS auprc FROM dr d LEFT JOIN nf USING ("window") LEFT JOIN pf USING (start)""",
    "entity_disjoint_train": f"WITH {_O}, {_folds(30, True)} SELECT start, count(*) AS n_train, sum(row_id)::BIGINT AS sum_row_id FROM me WHERE role = 'train' GROUP BY start",
    "fold_meta": f"""WITH {_O}, {_folds(30, True)} SELECT fold_id, start, n_train, n_test, n_entity_dropped, n_immature_dropped,
      round(p::DOUBLE / n_train, 6) AS train_rate, round(q::DOUBLE / n_test, 6) AS test_rate FROM fm""",
    "cold_entity_rows": f"""WITH {_O}, {_folds(0, False)} SELECT start, row_id, NOT EXISTS (SELECT 1 FROM me x WHERE x.start = me.start AND x.entity = me.entity AND x.role = 'train') AS is_cold
      FROM me WHERE role = 'test'""",
    "size_control_folds": f"""WITH a AS (WITH {_O}, {_folds(0, False)} SELECT start, n_train FROM fm), b AS (WITH {_O}, {_folds(30, True)} SELECT start, n_train FROM fm)
      SELECT start, a.n_train AS n_full, b.n_train AS n_disjoint, least(a.n_train, b.n_train) AS n_matched FROM a JOIN b USING (start)""",
    "random_folds": f"""WITH {_O} SELECT k::INTEGER AS split, row_id, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY (row_id * (2 * k + 1)) % 1000003, row_id) <= (SELECT round_even(count(*) * 0.25, 0) FROM o)
      THEN 'test' ELSE 'train' END AS role FROM o, range(3) r(k)""",
    "size_matched_sample": f"WITH {_O} SELECT row_id, y FROM o ORDER BY (row_id * 7919) % 104729, row_id LIMIT 1000",
    "chrono_split": f"WITH {_O} SELECT row_id, CASE WHEN row_number() OVER (ORDER BY t, row_id) <= (SELECT floor(count(*) * 0.7) FROM o) THEN 'train' ELSE 'test' END AS role FROM o",
    "auprc": f"WITH {_O}, {_ranked('o')} SELECT n, n_pos, round(base_rate, 6) AS base_rate, round(auprc, 6) AS auprc, round(auprc / base_rate, 6) AS auprc_lift FROM rk",
    "auroc": f"WITH {_O}, {_ranked('o', 'segment')} SELECT segment, n, round(auroc, 6) AS auroc FROM rk",
    "ece_brier": f"WITH {_O} SELECT round(brier, 6) AS brier, round(ece, 6) AS ece FROM ({_CALIBRATION})",
    "index_auprc": f"""WITH {_O}, {_INDEX}, kp AS (SELECT score, is_index::INTEGER AS y FROM ix WHERE y = 0 OR is_index), {_ranked('kp')}
      SELECT n_pos AS n_index_positives, (SELECT count(*) FROM ix WHERE y = 1 AND NOT is_index) AS n_masked_propagated, round(base_rate, 6) AS index_base_rate,
      round(auprc, 6) AS index_auprc, round(auprc / base_rate, 6) AS index_auprc_lift FROM rk""",
    "cold_entity_auprc": f"""WITH {_O}, {_folds(0, False)}, cl AS (
        SELECT score, y FROM me WHERE role = 'test' AND NOT EXISTS (SELECT 1 FROM me x WHERE x.start = me.start AND x.entity = me.entity AND x.role = 'train')), {_ranked('cl')}
      SELECT coalesce(n, 0)::BIGINT AS cold_n, coalesce(n_pos, 0)::BIGINT AS cold_n_pos, round(auprc, 6) AS cold_auprc FROM rk""",
    "time_to_detection": f"""WITH {_O}, {_INDEX}, al AS (
        SELECT *, score >= (SELECT quantile_cont(score, 0.95) FROM o) AS alert, row_number() OVER (PARTITION BY entity ORDER BY t, row_id) AS seq FROM ix
      ), pe AS (
        SELECT entity, min(CASE WHEN is_index THEN seq END) AS si, min(CASE WHEN alert THEN seq END) AS sa, min(CASE WHEN is_index THEN t END) AS ti,
          arg_min(t, CASE WHEN alert THEN seq END) AS ta FROM al GROUP BY entity HAVING bool_or(is_index)
      ) SELECT count(*) AS ttd_n_entities, round(avg((sa IS NOT NULL)::INTEGER), 6) AS ttd_detected_share, round(quantile_cont((sa - si)::DOUBLE, 0.5), 6) AS ttd_median_txn,
        round(quantile_cont(CASE WHEN sa IS NOT NULL THEN (ta - ti) / 3600.0::DOUBLE END, 0.5), 6) AS ttd_median_hours, round(avg((sa < si)::INTEGER), 6) AS ttd_early_share FROM pe""",
    "dollar_recall_at_k": f"""WITH {_O}, {_TOP} SELECT round((SELECT sum(y * amount) FROM tk) / (SELECT sum(y * amount) FROM o), 6) AS dollar_recall_at_k,
      round((SELECT sum(y) FROM tk) / (SELECT sum(y) FROM o)::DOUBLE, 6) AS count_recall_at_k, round((SELECT avg(y) FROM tk), 6) AS alert_precision_at_k, 0.01::DOUBLE AS k,
      (SELECT count(*) FROM tk) AS n_reviewed""",
    "evaluate_row": f"""WITH {_O}, {_INDEX}, {_TOP}, {_ranked('o')}, cal AS ({_CALIBRATION}), {_ranked('(SELECT score, is_index::INTEGER AS y FROM ix WHERE y = 0 OR is_index)').replace('sc AS', 'sc2 AS').replace('FROM sc', 'FROM sc2').replace('cm AS', 'cm2 AS').replace('FROM cm', 'FROM cm2').replace('rk AS', 'rk2 AS')}
      SELECT rk.n, rk.n_pos, round(rk.base_rate, 6) AS base_rate, round(rk.auprc, 6) AS auprc, round(rk.auroc, 6) AS auroc, round(rk.auprc / rk.base_rate, 6) AS auprc_lift,
        round(brier, 6) AS brier, round(ece, 6) AS ece, rk2.n_pos AS n_index_positives, round(rk2.auprc, 6) AS index_auprc,
        round((SELECT sum(y * amount) FROM tk) / (SELECT sum(y * amount) FROM o), 6) AS dollar_recall_at_k, (SELECT count(*) FROM tk) AS n_reviewed FROM rk, rk2, cal""",
    "aggregate_runs": _RUNS + " SELECT segment, " + _R6(f"round({f}({c}), 6) AS {c}_{s}" for c in ("n", "auprc", "auroc") for f, s in (("avg", "mean"), ("stddev_samp", "std"))) + " FROM rk GROUP BY segment",
    "size_control_attribution": f"""{_RUNS}, a AS (SELECT segment, avg(auprc) AS v FROM rk GROUP BY segment),
      w AS (SELECT max(v) FILTER (segment = 'BUILDING') AS f, max(v) FILTER (segment = 'MACHINERY') AS s, max(v) FILTER (segment = 'FURNITURE') AS d FROM a)
      SELECT round(f - d, 4) AS total_drop_auprc, round(f - s, 4) AS attributable_to_training_size, round(s - d, 4) AS attributable_to_entity_leakage,
      round((s - d) / nullif(f - d, 0), 4) AS leakage_share_of_drop FROM w""",
    "mass_by_family": f"WITH {_MASS} SELECT family, protocol, round(share, 6) AS share FROM sh",
    "pivot_migration": f"""WITH {_MASS}, w AS (SELECT family, coalesce(sum(share) FILTER (protocol = 'leaky'), 0) AS l, coalesce(sum(share) FILTER (protocol = 'closed'), 0) AS c FROM sh GROUP BY family)
      SELECT family, round(l, 6) AS leaky, round(c, 6) AS closed, round(c - l, 6) AS change FROM w""",
    "feature_families": f"""SELECT feature, CASE WHEN starts_with(feature, 'risk_') OR starts_with(feature, 'riskn_') THEN 'association_risk' WHEN starts_with(feature, 'mem_') THEN 'entity_memory'
      WHEN starts_with(feature, 'vel_') THEN 'velocity' WHEN starts_with(feature, 'miss_') OR feature IN ('nan_count', 'regime', 'miss_density') THEN 'missingness'
      WHEN starts_with(feature, 'card') OR starts_with(feature, 'addr') OR feature IN ('bin_proxy', 'ProductCD_card4') THEN 'identity_proxy'
      WHEN regexp_full_match(feature, '[DCVM][0-9]+') THEN feature[1] || '_columns' WHEN starts_with(feature, 'id_') OR feature IN ('DeviceType', 'DeviceInfo') THEN 'id_columns'
      ELSE 'behaviour' END AS family FROM {_values(tuple((n,) for n in FEATURE_NAMES), 'feature')}""",
    "paysim_residuals": f"""WITH {_PS} SELECT step, round(balance_err_orig, 4) AS balance_err_orig, round(balance_err_dest, 4) AS balance_err_dest, orig_emptied, amount_eq_oldbalance,
      (step // 24)::INTEGER AS day, (step % 24)::INTEGER AS hour_of_day, round(ln(1 + amount), 6) AS log_amount FROM ps""",
    "paysim_evidence": f"""WITH {_PS} SELECT isFraud, count(*) AS n, round(avg(amount_eq_oldbalance), 4) AS share_amount_eq_oldbalance, round(avg(orig_emptied), 4) AS share_orig_emptied,
      round(quantile_cont(balance_err_orig, 0.5), 4) AS median_balance_err_orig, round(avg((oldbalanceDest = newbalanceDest)::INTEGER), 4) AS share_dest_balance_unchanged,
      round(avg(isFlaggedFraud), 4) AS share_flagged FROM ps GROUP BY isFraud""",
    "ladder_vs_hypothesis": f"""SELECT m.rung, s.hypothesised, m.measured, round(m.measured - s.hypothesised, 6) AS difference,
      CASE WHEN s.hypothesised IS NULL THEN '' WHEN abs(m.measured - s.hypothesised) <= 0.10 THEN 'yes' ELSE 'NO' END AS prediction_held
      FROM (SELECT * FROM {_values(MEASURED, 'rung, measured')}) m LEFT JOIN (SELECT * FROM {_values(SUPPOSED, 'rung, hypothesised')}) s USING (rung)""",
    "knn_minority": """WITH m AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 0),
      p AS (SELECT a.id, b.id AS neighbour, list_distance(a.v, b.v) AS distance FROM m a JOIN m b ON a.id <> b.id)
      SELECT id, neighbour, rank, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM p) WHERE rank <= 5""",
    "smote_counts": """WITH c AS (SELECT sum((label = 0)::INTEGER)::BIGINT AS p, sum((label <> 0)::INTEGER)::BIGINT AS n FROM embeddings)
      SELECT 1 AS y, FALSE AS synthetic, p AS n FROM c UNION ALL SELECT 0, FALSE, n FROM c UNION ALL SELECT 1, TRUE, n // 2 - p FROM c WHERE n // 2 > p""",
}
