"""SQL building blocks for the oracle queries (DuckDB dialect)."""

from __future__ import annotations

__all__ = ["with_ctes"]

# name -> (names it reads, body)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (needs, body)


def with_ctes(final: str, *names: str) -> str:
    """``WITH`` clause of ``names`` and everything they need, in order, then ``final``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in _CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in ordered) + "\n" + final


define("trades", """
SELECT concat('S', lpad(cast(l_suppkey AS varchar), 6, '0')) code, cast(l_shipdate AS date) AS date,
       1000 + (cast(round(l_extendedprice*100) AS bigint) % 10000) / 100.0::double price, l_quantity qty,
       l_orderkey, l_linenumber, l_partkey, cast(round(l_extendedprice*100) AS bigint) cents
FROM lineitem""")

define("eod", """
SELECT code, date, max(CASE WHEN a=1 THEN price END) ad_open, max(price) ad_high, min(price) ad_low,
       max(CASE WHEN z=1 THEN price END) ad_close, sum(qty) nm_volume, count(*) n_trades
FROM (SELECT *,
  row_number() OVER (PARTITION BY code,date ORDER BY l_orderkey,l_linenumber,l_partkey,cents) a,
  row_number() OVER (PARTITION BY code,date ORDER BY l_orderkey DESC,l_linenumber DESC,l_partkey DESC,cents DESC) z
  FROM trades) r
GROUP BY code, date""", "trades")

define("symbols", """
SELECT concat('S', lpad(cast(s_suppkey AS varchar),6,'0')) code,
  CASE s_suppkey % 3 WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' ELSE 'UPCOM' END exchange,
  upper(replace(r_name,' ','_')) sectorlv1code, upper(replace(n_name,' ','_')) sectorlv2code,
  (s_acctbal >= 0) is_active, s_suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

define("features", """
SELECT date, exchange || '-' || code symbol_key, exchange, code symbol, ad_close AS close, nm_volume AS volume,
  ad_close / nullif(lag(ad_close,1) OVER w, 0) - 1 return_1d, ad_close / nullif(lag(ad_close,5) OVER w, 0) - 1 return_5d,
  ad_close / nullif(lag(ad_close,10) OVER w, 0) - 1 return_10d, ad_close / nullif(lag(ad_close,20) OVER w, 0) - 1 return_20d,
  CASE WHEN count(*) OVER w20 >= 20 THEN avg(ad_close) OVER w20 END ma20,
  CASE WHEN count(*) OVER w20 >= 20 THEN nm_volume / nullif(avg(nm_volume) OVER w20, 0) END volume_ratio,
  coalesce(ad_close > CASE WHEN count(*) OVER w20 >= 20 THEN avg(ad_close) OVER w20 END, false) above_ma20,
  lead(ad_close,5) OVER w / nullif(ad_close,0) - 1 forward_return_t5, lead(ad_close,10) OVER w / nullif(ad_close,0) - 1 forward_return_t10,
  lead(ad_close,15) OVER w / nullif(ad_close,0) - 1 forward_return_t15, lead(ad_close,20) OVER w / nullif(ad_close,0) - 1 forward_return_t20
FROM eod JOIN symbols USING (code)
WINDOW w AS (PARTITION BY exchange, code ORDER BY date),
  w20 AS (PARTITION BY exchange, code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "eod", "symbols")

define("member_days", """
SELECT 1 sector_level, sectorlv1code sector_code, f.* FROM features f JOIN symbols s ON s.code = f.symbol
UNION ALL
SELECT 2, sectorlv2code, f.* FROM features f JOIN symbols s ON s.code = f.symbol""", "features", "symbols")

define("daily", """
SELECT d.*, n_members / n_universe::double coverage_ratio FROM (
  SELECT sector_level, sector_code, date, count(*) n_members, avg(return_1d) sector_return, avg(volume_ratio) volume_ratio,
         avg(above_ma20::int) breadth_above_ma20
  FROM member_days GROUP BY ALL) d
JOIN (SELECT sector_level, sector_code, count(DISTINCT symbol) n_universe FROM member_days GROUP BY ALL) u
USING (sector_level, sector_code)""", "member_days")

define("indexed", """
SELECT *, CASE WHEN count(*) OVER w20 >= 20 THEN avg(sector_index) OVER w20 END ma20, sector_return relative_strength FROM (
  SELECT *, 100 * product(1 + coalesce(sector_return, 0)) OVER (PARTITION BY sector_level, sector_code ORDER BY date
         ROWS UNBOUNDED PRECEDING) sector_index FROM daily)
WINDOW w20 AS (PARTITION BY sector_level, sector_code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "daily")

define("waved", """
SELECT *, CASE WHEN coalesce(relative_strength,0) > 0 AND coalesce(sector_return,0) > 0 AND coalesce(sector_index > ma20, false) THEN 'LEADING'
  WHEN coalesce(relative_strength,0) > 0 THEN 'IMPROVING' WHEN coalesce(sector_return,0) < 0 THEN 'WEAKENING' ELSE 'LAGGING' END sector_wave
FROM indexed""", "indexed")

define("winners", """
SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY sector_level, sector_code ORDER BY date), pos) lag_sessions,
  previous_sector_code || '->' || sector_code transition FROM (
  SELECT *, lag(sector_code) OVER s previous_sector_code, row_number() OVER s pos FROM (
    SELECT *, row_number() OVER (PARTITION BY sector_level, date ORDER BY relative_strength DESC, sector_code) AS "rank"
    FROM waved WHERE relative_strength IS NOT NULL) WHERE "rank" = 1
  WINDOW s AS (PARTITION BY sector_level ORDER BY date))""", "waved")
