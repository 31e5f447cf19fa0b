"""Queries over leadership transitions at an evaluation date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketlake.operators import transition as tr, transition_dates as td
from marketlake.plans.ctes import define, with_ctes
from marketlake.plans.daily import sector_series, sector_table
from marketlake.plans.registry import big, query, rnd, rounded

REQUEST = tr.TransitionRequest(
    evaluation_date=date(2000, 1, 3),
    sector_codes=["EUROPE", " asia", "AFRICA", "AMERICA", "MIDDLE_EAST", "ASIA"],
    focus_sector_codes=["europe", "ASIA"],
)
WIDER = tr.TransitionRequest(evaluation_date=date(2000, 1, 3), sector_codes=[*REQUEST.universe, "OCEANIA"])

define("hist", "SELECT sector_code, date, sector_return, relative_strength FROM waved WHERE sector_level = 1", "waved")
define("known", "SELECT * FROM hist WHERE date <= DATE '2000-01-03'", "hist")
define("universe", "SELECT unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE_EAST']) sector_code")
define("horizons", "SELECT unnest([1, 5, 10]) h")
define("leaders", """
SELECT date, sector_code leader FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY relative_strength DESC NULLS LAST, sector_code) rn FROM known)
WHERE rn = 1""", "known")
define("counts", """
SELECT h, leader from_sector, nxt to_sector, count(*) transitions FROM (
  SELECT h, leader, CASE h WHEN 1 THEN lead(leader, 1) OVER w WHEN 5 THEN lead(leader, 5) OVER w ELSE lead(leader, 10) OVER w END nxt
  FROM leaders CROSS JOIN horizons WINDOW w AS (PARTITION BY h ORDER BY date))
WHERE nxt IS NOT NULL GROUP BY ALL""", "leaders", "horizons")
define("matrix", """
SELECT g.h, g.f from_sector, g.t to_sector, coalesce(transitions, 0) n, sum(coalesce(transitions, 0)) OVER (PARTITION BY g.h, g.f) sample_count,
  coalesce(coalesce(transitions, 0) / nullif(sum(coalesce(transitions, 0)) OVER (PARTITION BY g.h, g.f), 0), 0)::double probability
FROM (SELECT h, f.sector_code f, t.sector_code t FROM horizons CROSS JOIN universe f CROSS JOIN universe t) g
LEFT JOIN counts c ON c.h = g.h AND c.from_sector = g.f AND c.to_sector = g.t""", "horizons", "universe", "counts")
define("fwd", """
SELECT sector_code, h, CASE WHEN count(*) > h THEN coalesce(avg(c), 0) ELSE 0 END predicted_return FROM (
  SELECT sector_code, h, CASE WHEN row_number() OVER w >= h THEN
    CASE h WHEN 1 THEN product(1 + coalesce(sector_return, 0)) OVER (w ROWS 0 PRECEDING) WHEN 5 THEN product(1 + coalesce(sector_return, 0)) OVER (w ROWS 4 PRECEDING)
    ELSE product(1 + coalesce(sector_return, 0)) OVER (w ROWS 9 PRECEDING) END - 1 END c
  FROM known CROSS JOIN horizons WINDOW w AS (PARTITION BY sector_code, h ORDER BY date)) GROUP BY sector_code, h""", "known", "horizons")
define("state", """
SELECT sector_code, date, relative_strength, sector_return FROM (SELECT *, row_number() OVER (PARTITION BY sector_code ORDER BY date DESC) rn FROM known) WHERE rn = 1""", "known")
define("pred", """
SELECT m.h, m.from_sector, m.to_sector, probability, sample_count, s.relative_strength current_relative_strength, s.sector_return current_sector_return,
  s.date generated_from_date, predicted_return, predicted_return * probability score
FROM matrix m JOIN state s ON s.sector_code = m.from_sector JOIN fwd f ON f.sector_code = m.to_sector AND f.h = m.h
WHERE m.from_sector IN ('ASIA', 'EUROPE')""", "matrix", "state", "fwd")
define("decided", "SELECT *, CASE WHEN score > 0.01 THEN 'BUY' WHEN score < -0.01 THEN 'SELL' ELSE 'HOLD' END action FROM pred", "pred")
define("resolved", """
SELECT *, CASE WHEN predicted_return > 0.01 THEN 'UP' WHEN predicted_return < -0.01 THEN 'DOWN' ELSE 'FLAT' END predicted_direction,
  CASE WHEN realized_return > 0.01 THEN 'UP' WHEN realized_return < -0.01 THEN 'DOWN' ELSE 'FLAT' END realized_direction
FROM pred JOIN (SELECT sector_code to_sector, row_number() OVER w h, date resolved_date, product(1 + coalesce(sector_return, 0)) OVER (w ROWS UNBOUNDED PRECEDING) - 1 realized_return
  FROM hist WHERE date > DATE '2000-01-03' WINDOW w AS (PARTITION BY sector_code ORDER BY date)) USING (to_sector, h)""", "pred", "hist")


def _known(spark, sf_dir):
    return sector_series(spark, sf_dir).where("sector_level = 1").where(F.col("date") <= F.lit(REQUEST.evaluation_date))


@query("daily_leaders", with_ctes("""
SELECT sector_level::bigint sector_level, date, sector_code leader FROM (
  SELECT *, row_number() OVER (PARTITION BY sector_level, date ORDER BY relative_strength DESC NULLS LAST, sector_code) rn FROM waved)
WHERE rn = 1""", "waved"))
def daily_leaders(spark, sf_dir):
    return tr.daily_leaders(sector_series(spark, sf_dir)).select(F.col("sector_level").cast("bigint").alias("sector_level"), "date", "leader")


@query("state_at_t", with_ctes("""
SELECT sector_code, date, round(relative_strength, 6) relative_strength, round(sector_return, 6) sector_return FROM state""", "state"))
def state_at_t(spark, sf_dir):
    return tr.state_at(sector_series(spark, sf_dir), REQUEST).select(
        "sector_code", "date", *rounded(6, "relative_strength", "sector_return")
    )


@query("missing_sector_states", with_ctes("""
SELECT sector_code, DATE '2000-01-03' evaluation_date, 'BLOCKED' status FROM (SELECT sector_code FROM universe UNION ALL SELECT 'OCEANIA') u
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.sector_code = u.sector_code)""", "universe", "known"))
def missing_sector_states(spark, sf_dir):
    return tr.missing_sector_states(sector_series(spark, sf_dir), WIDER)


@query("transition_counts", with_ctes("""
SELECT h::bigint horizon_sessions, from_sector, to_sector, transitions::bigint transitions FROM counts""", "counts"))
def transition_counts(spark, sf_dir):
    counts = tr.transition_counts(tr.daily_leaders(_known(spark, sf_dir)), REQUEST.horizons)
    return counts.select(big("horizon_sessions"), "from_sector", "to_sector", "transitions")


@query("transition_probabilities", with_ctes("""
SELECT DATE '2000-01-03' evaluation_date, h::bigint horizon_sessions, from_sector, to_sector, round(probability, 6) probability,
  sample_count::bigint sample_count FROM matrix""", "matrix"))
def transition_probabilities(spark, sf_dir):
    return tr.probabilities(sector_series(spark, sf_dir), REQUEST).select(
        "evaluation_date", big("horizon_sessions"), "from_sector", "to_sector", rnd("probability"), "sample_count"
    )


@query("historical_forward_return", with_ctes("""
SELECT sector_code, h::bigint horizon_sessions, round(predicted_return, 6) predicted_return FROM fwd""", "fwd"))
def historical_forward_return(spark, sf_dir):
    return tr.historical_forward_return(_known(spark, sf_dir), REQUEST.horizons).select(
        "sector_code", big("horizon_sessions"), rnd("predicted_return")
    )


@query("transition_predictions", with_ctes("""
SELECT h::bigint horizon_sessions, from_sector, to_sector, round(current_relative_strength, 6) current_relative_strength,
  round(current_sector_return, 6) current_sector_return, round(predicted_return, 6) predicted_return,
  round(probability, 6) transition_probability, sample_count::bigint sample_count, generated_from_date FROM pred""", "pred"))
def transition_predictions(spark, sf_dir):
    return tr.analyze(sector_table(spark, sf_dir), REQUEST).predictions.select(
        big("horizon_sessions"), "from_sector", "to_sector",
        *rounded(6, "current_relative_strength", "current_sector_return", "predicted_return", "transition_probability"),
        "sample_count", "generated_from_date",
    )


@query("transition_decisions", with_ctes("""
SELECT h::bigint horizon_sessions, from_sector, to_sector, action, round(score, 6) score, round(probability, 6) confidence,
  action || ' ' || from_sector || ' -> ' || to_sector || ' over ' || h || ' trading sessions from T-anchored state' reason,
  'PRIVATE_INTERNAL' visibility FROM decided""", "decided"))
def transition_decisions(spark, sf_dir):
    return tr.analyze(sector_table(spark, sf_dir), REQUEST).decisions.select(
        big("horizon_sessions"), "from_sector", "to_sector", "action", *rounded(6, "score", "confidence"),
        "reason", "visibility",
    )


@query("transition_outcomes", with_ctes("""
SELECT h::bigint horizon_sessions, from_sector, to_sector, resolved_date, round(predicted_return, 6) predicted_return,
  round(realized_return, 6) realized_return, predicted_direction, realized_direction, predicted_direction = realized_direction direction_correct
FROM resolved""", "resolved"))
def transition_outcomes(spark, sf_dir):
    series = sector_table(spark, sf_dir)
    resolved = tr.outcomes(tr.analyze(series, REQUEST).predictions, series, REQUEST)
    return resolved.select(
        big("horizon_sessions"), "from_sector", "to_sector", "resolved_date",
        *rounded(6, "predicted_return", "realized_return"), "predicted_direction", "realized_direction",
        "direction_correct",
    )


@query("target_trading_date", with_ctes("""
SELECT h::bigint horizon_sessions, target_date FROM horizons LEFT JOIN (
  SELECT date target_date, row_number() OVER (ORDER BY date) rn FROM (SELECT DISTINCT date FROM hist WHERE date > DATE '2000-01-03')) ON rn = h""",
    "horizons", "hist"))
def target_trading_date(spark, sf_dir):
    return tr.target_trading_date(sector_series(spark, sf_dir), REQUEST).select(
        big("horizon_sessions"), "target_date"
    )


@query("transition_accuracy", with_ctes("""
SELECT action, r.to_sector, r.h::bigint horizon_sessions, least(floor(d.probability * 10), 9)::bigint probability_bucket, count(*)::bigint n,
  round(avg((predicted_direction = realized_direction)::int), 6) accuracy
FROM decided d JOIN resolved r ON r.from_sector = d.from_sector AND r.to_sector = d.to_sector AND r.h = d.h
GROUP BY ALL""", "decided", "resolved"))
def transition_accuracy(spark, sf_dir):
    series = sector_table(spark, sf_dir)
    analysis = tr.analyze(series, REQUEST)
    resolved = tr.outcomes(analysis.predictions, series, REQUEST)
    return tr.transition_accuracy(analysis.decisions, resolved).select(
        "action", "to_sector", big("horizon_sessions"), big("probability_bucket"), "n", rnd("accuracy")
    )


# Every month end as the evaluation date; the twins cut the history once per date.
define("ends", "SELECT max(date) t FROM hist GROUP BY date_trunc('month', date)", "hist")
define("t_known", "SELECT t, hist.* FROM hist JOIN ends ON date <= t", "hist", "ends")
define("t_leaders", """
SELECT t, date, sector_code leader FROM (
  SELECT *, row_number() OVER (PARTITION BY t, date ORDER BY relative_strength DESC NULLS LAST, sector_code) rn FROM t_known) WHERE rn = 1""", "t_known")
define("t_counts", """
SELECT t, h, leader from_sector, nxt to_sector, count(*) transitions FROM (
  SELECT t, h, leader, CASE h WHEN 1 THEN lead(leader, 1) OVER w WHEN 5 THEN lead(leader, 5) OVER w ELSE lead(leader, 10) OVER w END nxt
  FROM t_leaders CROSS JOIN horizons WINDOW w AS (PARTITION BY t, h ORDER BY date))
WHERE nxt IS NOT NULL GROUP BY ALL""", "t_leaders", "horizons")
define("t_matrix", """
SELECT g.t, g.h, g.f from_sector, g.u to_sector, sum(coalesce(transitions, 0)) OVER (PARTITION BY g.t, g.h, g.f) sample_count,
  coalesce(coalesce(transitions, 0) / nullif(sum(coalesce(transitions, 0)) OVER (PARTITION BY g.t, g.h, g.f), 0), 0)::double probability
FROM (SELECT t, h, f.sector_code f, u.sector_code u FROM ends CROSS JOIN horizons CROSS JOIN universe f CROSS JOIN universe u) g
LEFT JOIN t_counts c ON c.t = g.t AND c.h = g.h AND c.from_sector = g.f AND c.to_sector = g.u""", "ends", "horizons", "universe", "t_counts")
define("t_fwd", """
SELECT t, sector_code, h, CASE WHEN count(*) > h THEN coalesce(avg(c), 0) ELSE 0 END predicted_return FROM (
  SELECT t, sector_code, h, CASE WHEN row_number() OVER w >= h THEN
    CASE h WHEN 1 THEN product(1 + coalesce(sector_return, 0)) OVER (w ROWS 0 PRECEDING) WHEN 5 THEN product(1 + coalesce(sector_return, 0)) OVER (w ROWS 4 PRECEDING)
    ELSE product(1 + coalesce(sector_return, 0)) OVER (w ROWS 9 PRECEDING) END - 1 END c
  FROM t_known CROSS JOIN horizons WINDOW w AS (PARTITION BY t, sector_code, h ORDER BY date)) GROUP BY t, sector_code, h""", "t_known", "horizons")
define("t_state", """
SELECT t, sector_code, date, relative_strength, sector_return, count(*) OVER (PARTITION BY t) sectors FROM (
  SELECT *, row_number() OVER (PARTITION BY t, sector_code ORDER BY date DESC) rn FROM t_known) WHERE rn = 1""", "t_known")
define("t_pred", """
SELECT m.t, m.h, m.from_sector, m.to_sector, probability, sample_count, s.relative_strength current_relative_strength,
  s.sector_return current_sector_return, s.date generated_from_date, predicted_return, predicted_return * probability score,
  CASE WHEN predicted_return * probability > 0.01 THEN 'BUY' WHEN predicted_return * probability < -0.01 THEN 'SELL' ELSE 'HOLD' END action
FROM t_matrix m JOIN t_state s ON s.t = m.t AND s.sector_code = m.from_sector AND s.sectors = 5
JOIN t_fwd f ON f.t = m.t AND f.sector_code = m.to_sector AND f.h = m.h
WHERE m.from_sector IN ('ASIA', 'EUROPE')""", "t_matrix", "t_state", "t_fwd")
define("t_resolved", """
SELECT *, CASE WHEN predicted_return > 0.01 THEN 'UP' WHEN predicted_return < -0.01 THEN 'DOWN' ELSE 'FLAT' END predicted_direction,
  CASE WHEN realized_return > 0.01 THEN 'UP' WHEN realized_return < -0.01 THEN 'DOWN' ELSE 'FLAT' END realized_direction
FROM t_pred JOIN (SELECT t, sector_code to_sector, row_number() OVER w h, date resolved_date,
    product(1 + coalesce(sector_return, 0)) OVER (w ROWS UNBOUNDED PRECEDING) - 1 realized_return
  FROM hist JOIN ends ON date > t WINDOW w AS (PARTITION BY t, sector_code ORDER BY date)) USING (t, to_sector, h)""", "t_pred", "hist", "ends")


def _months(spark, sf_dir):
    series = sector_table(spark, sf_dir).where("sector_level = 1")
    return td.analyze_dates(series, td.month_ends(series.where(F.col("sector_code").isin(REQUEST.universe))), REQUEST)


@query("transition_probabilities_months", with_ctes("""
SELECT t evaluation_date, h::bigint horizon_sessions, from_sector, to_sector, round(probability, 6) probability,
  sample_count::bigint sample_count FROM t_matrix""", "t_matrix"))
def transition_probabilities_months(spark, sf_dir):
    return _months(spark, sf_dir).probabilities.select(
        "evaluation_date", big("horizon_sessions"), "from_sector", "to_sector", rnd("probability"), "sample_count"
    )


@query("transition_decisions_months", with_ctes("""
SELECT t evaluation_date, h::bigint horizon_sessions, from_sector, to_sector, action, round(score, 6) score, round(probability, 6) confidence,
  sample_count::bigint sample_count FROM t_pred""", "t_pred"))
def transition_decisions_months(spark, sf_dir):
    return _months(spark, sf_dir).decisions.select(
        "evaluation_date", big("horizon_sessions"), "from_sector", "to_sector", "action", *rounded(6, "score", "confidence"), "sample_count"
    )


@query("transition_outcomes_months", with_ctes("""
SELECT t evaluation_date, h::bigint horizon_sessions, from_sector, to_sector, resolved_date, round(predicted_return, 6) predicted_return,
  round(realized_return, 6) realized_return, predicted_direction, realized_direction FROM t_resolved""", "t_resolved"))
def transition_outcomes_months(spark, sf_dir):
    return _months(spark, sf_dir).outcomes.select(
        "evaluation_date", big("horizon_sessions"), "from_sector", "to_sector", "resolved_date",
        *rounded(6, "predicted_return", "realized_return"), "predicted_direction", "realized_direction",
    )


@query("transition_accuracy_months", with_ctes("""
SELECT action, to_sector, h::bigint horizon_sessions, least(floor(probability * 10), 9)::bigint probability_bucket, count(*)::bigint n,
  round(avg((predicted_direction = realized_direction)::int), 6) accuracy FROM t_resolved GROUP BY ALL""", "t_resolved"))
def transition_accuracy_months(spark, sf_dir):
    months = _months(spark, sf_dir)
    return tr.transition_accuracy(months.decisions, months.outcomes).select(
        "action", "to_sector", big("horizon_sessions"), big("probability_bucket"), "n", rnd("accuracy")
    )
