"""Queries over symbol snapshots, classification and the sector dimension."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketlake.functions.text import canonical_code, split_symbol_key, valid_symbol_key
from marketlake.operators import symbols as sym, taxonomy as tax
from marketlake.plans.ctes import define, with_ctes
from marketlake.plans.registry import big, query
from marketlake.sources import companies as src, fixtures

_CODE = "'S' || lpad(s_suppkey::varchar, 6, '0')"
define("geo", f"""
SELECT {_CODE} code, *, CASE s_suppkey % 3 WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' ELSE 'UPCOM' END exchange
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
define("icb", """
SELECT code symbol, s_name organ_name, CASE WHEN s_acctbal < 0 THEN 'CT' ELSE 'NH' END com_type_code, s_suppkey, level icb_level, icb_code, raw_name FROM (
  SELECT *, 1 AS level, 'R' || r_regionkey icb_code, r_name raw_name FROM geo UNION ALL
  SELECT *, 2, CASE WHEN n_nationkey % 7 <> 0 THEN 'N' || n_nationkey END, n_name FROM geo UNION ALL
  SELECT *, 3, CASE WHEN s_acctbal >= 0 THEN 'A' || (s_nationkey % 4) END, s_name FROM geo)
WHERE icb_code IS NOT NULL""", "geo")
define("wide", """
SELECT symbol, any_value(organ_name) organ_name,
  max(CASE WHEN icb_level = 1 THEN icb_code END) icbLv1Code, max(CASE WHEN icb_level = 1 THEN 'VI ' || raw_name END) icbLv1NameVi,
  max(CASE WHEN icb_level = 1 THEN raw_name END) raw1,
  max(CASE WHEN icb_level = 2 THEN icb_code END) icbLv2Code, max(CASE WHEN icb_level = 2 THEN 'VI ' || raw_name END) icbLv2NameVi,
  max(CASE WHEN icb_level = 2 THEN raw_name END) raw2,
  max(CASE WHEN icb_level = 3 THEN icb_code END) icbLv3Code, max(CASE WHEN icb_level = 3 THEN raw_name END) raw3
FROM icb GROUP BY symbol""", "icb")
define("snap", f"""
SELECT upper(code) code, exchange, status, company_name, s_acctbal, s_suppkey FROM (SELECT {_CODE} code,
  CASE s_suppkey % 3 WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' ELSE 'UPCOM' END exchange, CASE WHEN s_acctbal < 0 THEN 'delisted' ELSE 'listed' END status,
  s_name company_name, s_acctbal, s_suppkey FROM supplier)""")


def _bilingual(spark, sf_dir):
    vi, en = (sym.flatten_classification(src.companies(spark, sf_dir, lang)) for lang in ("vi", "en"))
    return sym.bilingual_classification(vi, en)


def _normalized(spark, sf_dir, level: int = 2):
    return sym.normalize_symbols(
        sym.validate_snapshot(src.snapshot(spark, sf_dir)), _bilingual(spark, sf_dir), "icb", level
    )


@query("icb_flatten", with_ctes("""
SELECT symbol, organ_name, com_type_code, icb_level::bigint icb_level, icb_code, 'VI ' || raw_name icb_name FROM icb""", "icb"))
def icb_flatten(spark, sf_dir):
    flat = sym.flatten_classification(src.companies(spark, sf_dir, "vi"))
    return flat.select("symbol", "organ_name", "com_type_code", big("icb_level"), "icb_code", "icb_name")


@query("icb_bilingual_pivot", with_ctes("""
SELECT symbol, organ_name, icbLv1Code, icbLv1NameVi, icbLv2Code, icbLv2NameVi, icbLv3Code, lower(raw2) || ' & co-op' name_en FROM wide""", "wide"))
def icb_bilingual_pivot(spark, sf_dir):
    wide = _bilingual(spark, sf_dir)
    return wide.select(
        "symbol", "organ_name", "icbLv1Code", "icbLv1NameVi", "icbLv2Code", "icbLv2NameVi", "icbLv3Code",
        F.lower("icbLv2NameEn").alias("name_en"),
    )


@query("sector_canonical_code", """
SELECT DISTINCT upper(replace(replace(n_name, ' ', '_'), '-', '_')) || '_AND_CO_OP' sector_code, n_name FROM nation""")
def sector_canonical_code(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.lower("n_name"), F.lit(" & Co-op "))
    return fixtures.load(spark, sf_dir, "nation").select(canonical_code(raw).alias("sector_code"), "n_name").distinct()


_CANON = "upper(replace(raw{0}, ' ', '_')) || '_AND_CO_OP'"
define("normal", f"""
SELECT s.*, 'ICB' taxonomy, w.icbLv2Code source_code, w.icbLv2NameVi source_name_vi, {_CANON.format(1)} lv1, {_CANON.format(2)} lv2,
  w.icbLv1Code, w.icbLv1NameVi, w.icbLv2Code, w.icbLv2NameVi, raw1, raw2 FROM snap s LEFT JOIN wide w ON w.symbol = s.code""", "snap", "wide")


@query("symbols_normalized", with_ctes("""
SELECT code, exchange, taxonomy "sectorTaxonomy", source_code "sourceSectorCode", source_name_vi "sourceSectorNameVi", lv1 "sectorLv1Code", lv2 "sectorLv2Code" FROM normal""", "normal"))
def symbols_normalized(spark, sf_dir):
    return _normalized(spark, sf_dir).select(
        "code", "exchange", "sectorTaxonomy", "sourceSectorCode", "sourceSectorNameVi", "sectorLv1Code", "sectorLv2Code"
    )


@query("validate_symbols_snapshot", with_ctes("""
SELECT code, exchange floor, status, company_name FROM snap""", "snap"))
def validate_symbols_snapshot(spark, sf_dir):
    return sym.validate_snapshot(src.snapshot(spark, sf_dir)).select(
        F.upper("code").alias("code"), F.upper("floor").alias("floor"), "status", F.col("companyName").alias("company_name")
    )


@query("preserve_classification", with_ctes("""
SELECT code, exchange, coalesce(source_code, CASE WHEN status = 'listed' THEN 'OLD' END) "sourceSectorCode", coalesce(lv2, CASE WHEN status = 'listed' THEN 'OLD_SECTOR' END) "sectorLv2Code" FROM normal""", "normal"))
def preserve_classification(spark, sf_dir):
    """The class feed misses some nations; the previous snapshot covers the listed symbols."""
    previous = src.snapshot(spark, sf_dir).where("status = 'listed' and companyName <> 'LATER COPY'").select(
        "code", "floor", F.lit("OLD").alias("sourceSectorCode"), F.lit("OLD_SECTOR").alias("sectorLv2Code")
    )
    return sym.preserve_classification(_normalized(spark, sf_dir), previous).select(
        "code", "exchange", "sourceSectorCode", "sectorLv2Code"
    )


@query("classification_coverage", with_ctes("""
SELECT *, CASE WHEN match_percentage < 90 THEN 'ERROR' WHEN match_percentage < 98 THEN 'WARNING' ELSE 'OK' END verdict FROM (
  SELECT count(*)::bigint symbols, count(source_code)::bigint matched_count, (count(*) - count(source_code))::bigint unmatched_count,
    round(100.0 * count(source_code) / count(*)::double, 6) match_percentage FROM normal)""", "normal"))
def classification_coverage(spark, sf_dir):
    return sym.classification_coverage(_normalized(spark, sf_dir)).withColumn(
        "match_percentage", F.round("match_percentage", 6)
    )


@query("snapshot_diagnostics", """
SELECT kind, coalesce(value, '-') AS value, count(*)::bigint AS "rows", count(DISTINCT code)::bigint unique_codes, count(*) FILTER (WHERE status = 'DELISTED')::bigint delisted FROM (
  SELECT kind, CASE kind WHEN 'floor' THEN floor WHEN 'status' THEN status END AS value, code, status FROM (
    SELECT s_suppkey code, CASE s_suppkey % 3 WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' ELSE 'UPCOM' END floor,
      CASE WHEN s_acctbal < 0 THEN 'DELISTED' ELSE 'LISTED' END status FROM (SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_acctbal > 5000)),
  (SELECT unnest(['floor', 'status', 'all']) kind))
GROUP BY kind, value""")
def snapshot_diagnostics(spark, sf_dir):
    return sym.snapshot_diagnostics(src.snapshot(spark, sf_dir)).withColumn("value", F.coalesce("value", F.lit("-")))


@query("symbol_upsert_events", with_ctes("""
SELECT exchange AS key, code, company_name "companyName", lv2 "sectorLv2Code", status, count(*) OVER (PARTITION BY exchange)::bigint batch_size FROM normal""", "normal"))
def symbol_upsert_events(spark, sf_dir):
    """JSON events, read back into columns so that content and not text is compared."""
    events = sym.symbol_events(sym.symbol_records(_normalized(spark, sf_dir).drop("_seq", "balance")), "run-1")
    text = F.col("value")
    return events.select(
        "key", F.get_json_object(text, "$.code").alias("code"), F.get_json_object(text, "$.companyName").alias("companyName"),
        F.get_json_object(text, "$.sectorLv2Code").alias("sectorLv2Code"),
        F.get_json_object(text, "$.meta.status").alias("status"),
        F.get_json_object(text, "$.actualCount").cast("bigint").alias("batch_size"),
    )


@query("symbol_meta_whitelist", with_ctes("""
SELECT code, exchange, concat_ws(';', 'companyName=' || company_name, 'listedDate=1999-01-01', 'sectorLevel=2', 'sectorLv1Code=' || lv1,
  'sectorLv2Code=' || lv2, 'sectorLv3Code=' || lv3, 'sectorTaxonomy=ICB', 'sourceSectorCode=' || source_code) meta FROM (
  SELECT n.*, upper(replace(replace(raw3, '#', '#'), ' ', '_')) || '_AND_CO_OP' lv3 FROM normal n LEFT JOIN (SELECT symbol, raw3 FROM wide) w ON w.symbol = n.code)""", "normal", "wide"))
def symbol_meta_whitelist(spark, sf_dir):
    stored = sym.symbol_meta(sym.symbol_records(_normalized(spark, sf_dir).drop("_seq")))
    pairs = F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return stored.select("code", "exchange", F.array_join(pairs, ";").alias("meta"))


@query("parse_symbol_key", with_ctes("""
SELECT key symbol_key, CASE WHEN ok THEN split_part(key, '-', 1) END exchange, CASE WHEN ok THEN substr(key, strpos(key, '-') + 1) END code, ok valid FROM (
  SELECT key, strpos(key, '-') > 0 AND trim(split_part(key, '-', 1)) <> '' AND trim(substr(key, strpos(key, '-') + 1)) <> '' ok FROM (
    SELECT CASE WHEN s_acctbal < 0 THEN '-' || code WHEN s_acctbal < 2000 THEN exchange || '- ' WHEN s_acctbal < 4000 THEN code
      ELSE exchange || '-' || code || '-X' END key FROM geo))""", "geo"))
def parse_symbol_key(spark, sf_dir):
    base = fixtures.symbols(spark, sf_dir).drop("is_active").join(
        fixtures.load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey"
    )
    balance = F.col("s_acctbal")
    key = (
        F.when(balance < 0, F.concat(F.lit("-"), F.col("code")))
        .when(balance < 2000, F.concat(F.col("exchange"), F.lit("- ")))
        .when(balance < 4000, F.col("code"))
        .otherwise(F.concat(F.col("exchange"), F.lit("-"), F.col("code"), F.lit("-X")))
    )
    exchange, code = split_symbol_key(F.col("symbol_key"))
    return base.select(key.alias("symbol_key")).select(
        "symbol_key", exchange.alias("exchange"), code.alias("code"), valid_symbol_key(F.col("symbol_key")).alias("valid")
    )


@query("active_symbols_by_sector", with_ctes("""
SELECT code, exchange FROM symbols WHERE is_active AND sectorlv1code IN ('ASIA', 'EUROPE')""", "symbols"))
def active_symbols_by_sector(spark, sf_dir):
    return sym.active_by_sector(src.stored_symbols(spark, sf_dir), 1, ["ASIA", "EUROPE"])


@query("distinct_sector_codes", with_ctes("""
SELECT DISTINCT sectorlv2code sector_code FROM symbols WHERE is_active""", "symbols"))
def distinct_sector_codes(spark, sf_dir):
    return sym.distinct_sector_codes(src.stored_symbols(spark, sf_dir), 2)


@query("active_symbol_counts", with_ctes("""
SELECT exchange, count(*)::bigint active_symbols FROM symbols WHERE is_active GROUP BY exchange""", "symbols"))
def active_symbol_counts(spark, sf_dir):
    return sym.active_counts(src.stored_symbols(spark, sf_dir))


@query("symbols_scd_apply", with_ctes("""
SELECT exchange, code, CASE WHEN delivered THEN incoming ELSE is_active END is_active, CASE WHEN incoming THEN 'new' ELSE sectorlv1code END sector
FROM (SELECT *, bool_or(incoming) OVER (PARTITION BY exchange) delivered FROM (
  SELECT *, sectorlv1code IN ('ASIA', 'AFRICA') AND exchange <> 'HNX' incoming FROM symbols))
WHERE is_active OR incoming""", "symbols"))
def symbols_scd_apply(spark, sf_dir):
    """Stored: the active symbols. Delivered: two sectors, and nothing at all for HNX."""
    stored = src.stored_symbols(spark, sf_dir)
    delivered = stored.where(
        F.col("meta")["sectorLv1Code"].isin("ASIA", "AFRICA") & (F.col("exchange") != "HNX")
    ).select("exchange", "code", F.create_map(F.lit("sectorLv1Code"), F.lit("new")).alias("meta"))
    return sym.apply_snapshot(stored.where("is_active"), delivered).select(
        "exchange", "code", "is_active", F.col("meta")["sectorLv1Code"].alias("sector")
    )


@query("sector_records_merge", with_ctes("""
SELECT sector_code, taxonomy_level::bigint taxonomy_level, source_code, name_vi, max_by(code, s_suppkey) last_symbol FROM (
  SELECT lv1 sector_code, 1 taxonomy_level, icbLv1Code source_code, icbLv1NameVi name_vi, code, s_suppkey FROM normal UNION ALL
  SELECT lv2, 2, icbLv2Code, icbLv2NameVi, code, s_suppkey FROM normal WHERE lv2 IS NOT NULL)
GROUP BY ALL""", "normal"))
def sector_records_merge(spark, sf_dir):
    merged = tax.merged_sector_records(tax.sector_records(_normalized(spark, sf_dir)))
    return merged.where("taxonomy_level <= 2").select(
        "sector_code", big("taxonomy_level"), "source_code", "name_vi", F.col("meta")["sourceSymbolCode"].alias("last_symbol")
    )


_RECORDS = """
  SELECT lv1 sector_code, 1 taxonomy_level, icbLv1Code source_code, icbLv1NameVi name_vi, code, s_suppkey FROM normal WHERE lv1 IS NOT NULL UNION ALL
  SELECT lv2, 2, icbLv2Code, icbLv2NameVi, code, s_suppkey FROM normal WHERE lv2 IS NOT NULL UNION ALL
  SELECT upper(replace(w.raw3, ' ', '_')) || '_AND_CO_OP', 3, w.icbLv3Code, 'VI ' || w.raw3, n.code, n.s_suppkey
  FROM normal n JOIN wide w ON w.symbol = n.code WHERE w.raw3 IS NOT NULL"""


@query("sector_records_merge_levels", with_ctes(f"""
SELECT sector_code, taxonomy_level::bigint taxonomy_level, min_by(source_code, s_suppkey) source_code, min_by(name_vi, s_suppkey) name_vi,
  max_by(code, s_suppkey) last_symbol FROM ({_RECORDS})
GROUP BY sector_code, taxonomy_level""", "normal", "wide"))
def sector_records_merge_levels(spark, sf_dir):
    """``sector_records_merge`` with the records of every level."""
    merged = tax.merged_sector_records(tax.sector_records(_normalized(spark, sf_dir)))
    return merged.select(
        "sector_code", big("taxonomy_level"), "source_code", "name_vi", F.col("meta")["sourceSymbolCode"].alias("last_symbol")
    )


@query("sectors_upsert", with_ctes("""
SELECT coalesce(m.sector_code, t.code) code, coalesce(m.name_vi, t.name_vi) name_vi, coalesce(m.source_code, t.source_code) source_code,
  m.source_code IS NOT NULL OR t.is_active is_active, t.region, CASE WHEN m.source_code IS NULL THEN 'stored' ELSE 'sync-symbols' END origin
FROM (SELECT n_name code, 'VI ' || n_name name_vi, 'N' || n_nationkey source_code, n_regionkey <> 3 is_active, n_regionkey::varchar region FROM nation) t
FULL JOIN (SELECT DISTINCT lv2 sector_code, icbLv2Code source_code, icbLv2NameVi name_vi FROM normal WHERE icbLv2Code IS NOT NULL) m
ON m.source_code = t.source_code""", "normal"))
def sectors_upsert(spark, sf_dir):
    merged = tax.merged_sector_records(tax.sector_records(_normalized(spark, sf_dir))).where("taxonomy_level = 2")
    renamed = F.transform_keys("meta", lambda k, _: F.when(k == "source", "origin").otherwise(k))
    incoming = merged.withColumn("meta", renamed).withColumnRenamed("sector_code", "code")
    out = tax.upsert_sectors(src.sector_table(spark, sf_dir), incoming)
    return out.select(
        "code", "name_vi", "source_code", "is_active", F.col("meta")["region"].alias("region"), F.col("meta")["origin"].alias("origin")
    )


@query("sectors_upsert_levels", with_ctes(f"""
SELECT coalesce(m.sector_code, t.code) code, coalesce(m.name_vi, t.name_vi) name_vi, coalesce(m.source_code, t.source_code) source_code,
  m.source_code IS NOT NULL OR t.is_active is_active, coalesce(m.taxonomy_level, 2)::bigint taxonomy_level, t.region,
  CASE WHEN m.source_code IS NULL THEN 'stored' ELSE 'sync-symbols' END origin
FROM (SELECT n_name code, 'VI ' || n_name name_vi, 'N' || n_nationkey source_code, n_regionkey <> 3 is_active, n_regionkey::varchar region FROM nation) t
FULL JOIN (SELECT source_code, max(sector_code) sector_code, max_by(name_vi, sector_code) name_vi, max_by(taxonomy_level, sector_code) taxonomy_level
  FROM ({_RECORDS}) GROUP BY source_code) m
ON m.source_code = t.source_code""", "normal", "wide"))
def sectors_upsert_levels(spark, sf_dir):
    """``sectors_upsert`` with the records of every level; of sectors that share a source code the largest code counts."""
    merged = tax.merged_sector_records(tax.sector_records(_normalized(spark, sf_dir)))
    renamed = F.transform_keys("meta", lambda k, _: F.when(k == "source", "origin").otherwise(k))
    incoming = merged.withColumn("meta", renamed).withColumnRenamed("sector_code", "code")
    out = tax.upsert_sectors(src.sector_table(spark, sf_dir), incoming)
    return out.select(
        "code", "name_vi", "source_code", "is_active", big("taxonomy_level"), F.col("meta")["region"].alias("region"),
        F.col("meta")["origin"].alias("origin")
    )


@query("active_sector_mappings", """
SELECT 'ICB' taxonomy, 2::bigint AS level, 'N' || n_nationkey source_code, n_name canonical_code FROM nation WHERE n_regionkey <> 3""")
def active_sector_mappings(spark, sf_dir):
    out = tax.active_mappings(src.sector_table(spark, sf_dir), "ICB", 2)
    return out.select("taxonomy", big("level"), "source_code", "canonical_code")


@query("sector_seed_insert", """
SELECT count(*)::bigint + 19 sectors, count(*)::bigint stored FROM nation""")
def sector_seed_insert(spark, sf_dir):
    """Seeds are inserted only where (taxonomy, source code) is new: here, all 19 of them."""
    stored = src.sector_table(spark, sf_dir)
    both = stored.withColumn("old", F.lit(1)).unionByName(tax.seed_sectors(spark, stored).withColumn("old", F.lit(0)))
    return both.agg(F.count("*").alias("sectors"), F.sum("old").cast("bigint").alias("stored"))


@query("incremental_load_plan", with_ctes("""
SELECT symbol_key, strftime(CASE WHEN kind < 2 THEN d END, '%Y-%m-%d') from_day,
  CASE WHEN d IS NULL OR kind = 2 THEN 10000 ELSE greatest(date_diff('day', d, DATE '2001-12-31') + 1, 1) END::bigint fetch_size
FROM (SELECT exchange || '-' || code symbol_key, s_suppkey FROM symbols WHERE is_active) s LEFT JOIN (
  SELECT o_custkey, max_by(kind, o_orderkey) kind, max_by(d, o_orderkey) d FROM (
    SELECT *, o_orderdate::date d, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END kind FROM orders WHERE o_orderpriority <> '5-LOW')
  GROUP BY o_custkey) l ON l.o_custkey = s.s_suppkey""", "symbols"))
def incremental_load_plan(spark, sf_dir):
    """Runs of symbol k are the orders of customer k; offsets are instants, dates or junk."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    offset = (
        F.when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("T07:30:00Z")))
        .when(F.col("o_orderstatus") == "P", day).otherwise(F.concat(F.lit("offset "), day))
    )
    listed = fixtures.symbols(spark, sf_dir)
    key = F.concat_ws("-", "exchange", "code").alias("symbol_key")
    runs = fixtures.load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("s_suppkey"), F.lit("prices").alias("job_id"), F.col("o_orderkey").alias("finished_at"),
        F.when(F.col("o_orderpriority") != "5-LOW", offset).alias("new_offset"),
    ).join(listed.select("s_suppkey", key), "s_suppkey").drop("s_suppkey")
    plan = sym.load_plan(runs, listed.where("is_active").select(key), F.lit("prices"), date(2001, 12, 31))
    return plan.select("symbol_key", F.date_format("from_offset", "yyyy-MM-dd").alias("from_day"), "fetch_size")
