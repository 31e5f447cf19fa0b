"""Symbol snapshots: classification, validation, diagnostics, records and state."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from marketlake.functions.keyed import keep_first, keep_last, require_columns
from marketlake.functions.numeric import safe_div
from marketlake.functions.text import blank_to_null, canonical_code
from marketlake.operators.normalize import clean_value, fetch_size

__all__ = [
    "CLASSIFICATION_COLUMNS", "META_KEYS", "active_by_sector", "active_counts", "apply_snapshot",
    "bilingual_classification", "classification_coverage", "coverage_problem", "distinct_sector_codes",
    "flatten_classification", "load_plan", "normalize_symbols", "preserve_classification", "snapshot_diagnostics",
    "symbol_events", "symbol_meta", "symbol_records", "validate_snapshot", "whitelisted",
]

LEVELS = (1, 2, 3, 4)
# The classification columns of a symbol row and the metadata keys that are kept.
CLASSIFICATION_COLUMNS = [
    "sectorTaxonomy", "sectorLevel", "sourceSectorCode", "sourceSectorNameVi", "sourceSectorNameEn",
    *[f"{stem.format(n)}" for n in LEVELS for stem in ("icbLv{}Code", "icbLv{}NameVi", "icbLv{}NameEn", "sectorLv{}Code")],
    "classificationUpdatedAt",
]
META_KEYS = [
    "companyName", "listedDate", "sectorTaxonomy", "sectorLevel", "sourceSectorCode", "sectorLv1Code",
    "sectorLv2Code", "sectorLv3Code", "sectorLv4Code", "classificationUpdatedAt",
]
COVERAGE_ERROR_BELOW = 90.0
COVERAGE_WARNING_BELOW = 98.0


def flatten_classification(companies: DataFrame) -> DataFrame:
    """One row per company and taxonomy level 1..4; levels without a code are dropped.

    ``companies`` has ``code, name, comTypeCode`` and ``icbLv1..icbLv4`` structs of code and name.
    """
    entries = F.array(
        *[F.struct(F.lit(n).alias("level"), F.col(f"icbLv{n}.code").alias("code"), F.col(f"icbLv{n}.name").alias("name")) for n in LEVELS]
    )
    extra = ["_seq"] if "_seq" in companies.columns else []
    return companies.select(
        F.col("code").alias("symbol"), F.col("name").alias("organ_name"), F.col("comTypeCode").alias("com_type_code"),
        *extra, F.explode(entries).alias("_e"),
    ).select(
        "symbol", "organ_name", "com_type_code", *extra, F.col("_e.level").alias("icb_level"),
        F.col("_e.code").alias("icb_code"), F.col("_e.name").alias("icb_name"),
    ).where("icb_code <> ''")


def bilingual_classification(vi: DataFrame, en: DataFrame) -> DataFrame:
    """One wide row per symbol: codes and native names from ``vi``, English names from ``en``.

    Written as one aggregation with conditional picks, so it combines on the map side; on
    repeats the row with the largest ``_seq`` wins.
    """
    def tagged(df: DataFrame, lang: int) -> DataFrame:
        seq = F.col("_seq") if "_seq" in df.columns else F.lit(0)
        return df.select("symbol", "organ_name", "icb_level", "icb_code", "icb_name", seq.alias("_seq"), F.lit(lang).alias("_lang"))

    rows = tagged(vi, 0).unionByName(tagged(en, 1))

    def pick(value: str, lang: int, level: int) -> Column:
        hit = (F.col("_lang") == lang) & (F.col("icb_level") == level)
        return F.max_by(F.when(hit, F.col(value)), F.when(hit, F.col("_seq")))

    picks = []
    for n in LEVELS:
        picks += [
            pick("icb_code", 0, n).alias(f"icbLv{n}Code"),
            pick("icb_name", 0, n).alias(f"icbLv{n}NameVi"),
            pick("icb_name", 1, n).alias(f"icbLv{n}NameEn"),
        ]
    return rows.groupBy("symbol").agg(F.min_by("organ_name", F.struct("_lang", "_seq")).alias("organ_name"), *picks)


def normalize_symbols(
    symbols: DataFrame, sectors: DataFrame | None, taxonomy: str = "ICB", level: int = 3,
    updated_at: datetime | None = None,
) -> DataFrame:
    """Symbols with their classification (left join on code) and canonical sector codes.

    ``level`` picks the taxonomy level that becomes ``sourceSector*``. Without sectors all
    classification columns are null; see ``preserve_classification`` to carry older ones over.
    """
    df = symbols.withColumns({"code": F.upper("code"), "exchange": F.upper("floor")})
    if sectors is not None:
        df = df.join(sectors.drop("organ_name").withColumnRenamed("symbol", "code"), "code", "left")
        cols = {
            "sectorTaxonomy": F.lit(taxonomy.upper()),
            "sectorLevel": F.lit(level),
            "sourceSectorCode": F.col(f"icbLv{level}Code"),
            "sourceSectorNameVi": F.col(f"icbLv{level}NameVi"),
            "sourceSectorNameEn": F.col(f"icbLv{level}NameEn"),
        }
        cols.update({f"sectorLv{n}Code": canonical_code(F.col(f"icbLv{n}NameEn")) for n in LEVELS})
        cols["classificationUpdatedAt"] = F.lit(updated_at)
        df = df.withColumns(cols)
    absent = [c for c in CLASSIFICATION_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("int" if c == "sectorLevel" else "string") for c in absent})


def preserve_classification(df: DataFrame, previous: DataFrame) -> DataFrame:
    """Fill classification columns from the previous snapshot where the new ones are null.

    Of previous rows that repeat a symbol the one classified last counts.
    """
    if "exchange" not in previous.columns and "floor" in previous.columns:
        previous = previous.withColumn("exchange", F.col("floor"))
    if not {"code", "exchange"} <= set(previous.columns):
        return df
    known = [c for c in CLASSIFICATION_COLUMNS if c in previous.columns]
    if not known:
        return df
    old = previous.select(
        F.upper("exchange").alias("exchange"), F.upper("code").alias("code"), *[F.col(c).alias(f"_p_{c}") for c in known]
    )
    values = [f"_p_{c}" for c in sorted(known, key=lambda c: c != "classificationUpdatedAt")]
    joined = df.join(keep_last(old, ["exchange", "code"], values), ["exchange", "code"], "left")
    carried = {
        c: F.coalesce(F.col(c), F.col(f"_p_{c}")) if c in df.columns else F.col(f"_p_{c}") for c in known
    }
    return joined.withColumns(carried).drop(*[f"_p_{c}" for c in known])


def validate_snapshot(df: DataFrame) -> DataFrame:
    """Required columns, then the first row per (floor, code) ignoring case."""
    require_columns(df, ["code", "floor", "status"], "symbol snapshot")
    keyed = df.withColumns({"_floor": F.upper("floor"), "_code": F.upper("code")})
    return keep_first(keyed, ["_floor", "_code"]).drop("_floor", "_code")


def snapshot_diagnostics(df: DataFrame) -> DataFrame:
    """Counts of a snapshot in one pass: (kind, value, rows, unique_codes, delisted)."""
    names = ["floor", "exchange", "status"]
    ready = df.select(
        *[(F.upper(n) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in names],
        F.upper("code").alias("code"),
        (F.col("delistedDate").isNotNull() if "delistedDate" in df.columns else F.lit(False)).alias("delisted"),
    )
    grouped = ready.groupingSets([[F.col(n)] for n in names] + [[]], *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("rows"), F.countDistinct("code").alias("unique_codes"),
        F.sum(F.col("delisted").cast("int")).cast("bigint").alias("delisted"),
    )
    # grouping_id has one bit per column, set when the column is not part of the set
    kind = F.when(F.col("_g") == 3, "floor").when(F.col("_g") == 5, "exchange").when(F.col("_g") == 6, "status").otherwise("all")
    value = F.coalesce("floor", "exchange", "status")
    return grouped.select(kind.alias("kind"), value.alias("value"), "rows", "unique_codes", "delisted").where(
        "kind = 'all' or value is not null"
    )


def classification_coverage(df: DataFrame) -> DataFrame:
    """Matched share of a normalised snapshot and its verdict; an empty snapshot counts as complete."""
    share = F.coalesce(safe_div(F.col("matched_count") * 100.0, F.col("symbols")), F.lit(100.0))
    verdict = F.when(share < COVERAGE_ERROR_BELOW, "ERROR").when(share < COVERAGE_WARNING_BELOW, "WARNING").otherwise("OK")
    return (
        df.agg(F.count("*").alias("symbols"), F.count("sourceSectorCode").alias("matched_count"))
        .withColumns({"unmatched_count": F.col("symbols") - F.col("matched_count"), "match_percentage": share})
        .withColumn("verdict", verdict)
    )


def coverage_problem(df: DataFrame) -> str | None:
    """Raise below the error threshold, return a warning text below the warning threshold."""
    row = classification_coverage(df).first()
    if row.verdict == "ERROR":
        raise ValueError(f"sector classification coverage below failure threshold: {row.match_percentage:.2f}%")
    if row.verdict == "WARNING":
        return f"sector classification coverage below warning threshold: {row.match_percentage:.2f}%"
    return None


def _first_filled(df: DataFrame, names: Sequence[str]) -> Column:
    found = [clean_value(df, n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def symbol_records(df: DataFrame) -> DataFrame:
    """Upsert records: named fields, everything else that is non-null as a string map.

    Rows without a code or an exchange are dropped.
    """
    excluded = {"code", "exchange", *CLASSIFICATION_COLUMNS}
    rest = [c for c in df.columns if c not in excluded]
    pairs = [x for c in rest for x in (F.lit(c), clean_value(df, c).cast("string"))]
    meta = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    named = ["sectorTaxonomy", "sectorLevel", "sourceSectorCode", *[f"sectorLv{n}Code" for n in LEVELS], "classificationUpdatedAt"]
    exchange = F.coalesce(*[blank_to_null(F.col(c)) for c in ("exchange", "floor") if c in df.columns])
    return df.select(
        blank_to_null(F.col("code")).alias("code"), exchange.alias("exchange"),
        _first_filled(df, ["companyId", "organCode"]).alias("companyId"),
        _first_filled(df, ["companyName", "organName"]).alias("companyName"),
        _first_filled(df, ["listedDate"]).alias("listedDate"),
        *[_first_filled(df, [c]).cast("string").alias(c) for c in named],
        meta.alias("meta"),
    ).where("code is not null and exchange is not null")


def symbol_events(records: DataFrame, execution_id: str, parent_execution_id: str | None = None) -> DataFrame:
    """JSON upsert events keyed by exchange, one per symbol, each with the size of its batch.

    One event per symbol instead of one list per exchange: no exchange has to fit into a
    single record, and a consumer can tell from ``actualCount`` when a batch is complete.
    """
    counts = records.groupBy("exchange").agg(F.count("*").alias("actualCount"))
    body = records.join(counts, "exchange").withColumns(
        {"executionId": F.lit(execution_id), "parentExecutionId": F.lit(parent_execution_id or execution_id)}
    )
    return body.select(F.col("exchange").alias("key"), F.to_json(F.struct(*sorted(body.columns))).alias("value"))


def whitelisted(meta: Column) -> Column:
    return F.map_filter(meta, lambda k, _: k.isin(META_KEYS))


def symbol_meta(records: DataFrame) -> DataFrame:
    """Stored metadata: the record's map overlaid with its named fields, allowed keys only.

    The allowed keys are a fixed list, so the result is built key by key: no map merge and
    no dependence on the session's duplicate-key policy.
    """
    def value(key: str) -> Column:
        own = F.col("meta")[key]
        return F.coalesce(F.col(key).cast("string"), own) if key in records.columns else own

    pairs = [x for k in META_KEYS for x in (F.lit(k), value(k))]
    return records.withColumn("meta", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))


def apply_snapshot(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Symbol state after a snapshot: insert or reactivate with new metadata, deactivate what
    the snapshot lacks. Exchanges without any incoming row are left alone, so an empty
    delivery cannot deactivate a market. Of rows that repeat a symbol the last one delivered
    counts: the largest ``_seq``, and of rows without it the largest metadata text."""
    delivered = incoming.select("exchange").distinct().withColumn("_delivered", F.lit(True))
    order = incoming if "_seq" in incoming.columns else incoming.withColumn("_seq", F.lit(0))
    new = keep_last(
        order.withColumn("_text", F.to_json("meta")), ["exchange", "code"], ["_seq", "_text"]
    ).select("exchange", "code", F.col("meta").alias("_meta"), F.lit(True).alias("_in"))
    both = current.join(new, ["exchange", "code"], "full_outer").join(delivered, "exchange", "left")
    active = F.when(F.col("_in"), True).when(F.col("_delivered"), False).otherwise(F.col("is_active"))
    meta = F.when(F.col("_in"), F.col("_meta")).otherwise(F.col("meta"))
    return both.select("exchange", "code", active.alias("is_active"), meta.alias("meta"))


def active_by_sector(symbols: DataFrame, level: int, sector_codes: Sequence[str] | None = None) -> DataFrame:
    """Active symbols of the given sectors at a level (None = all), by metadata key."""
    out = symbols.where("is_active")
    if sector_codes is not None:
        out = out.where(F.col("meta")[f"sectorLv{level}Code"].isin(list(sector_codes)))
    return out.select("code", "exchange")


def distinct_sector_codes(symbols: DataFrame, level: int, sector_codes: Sequence[str] | None = None) -> DataFrame:
    """Sector codes in use among active symbols, sorted."""
    code = F.col("meta")[f"sectorLv{level}Code"]
    out = symbols.where("is_active").select(code.alias("sector_code")).where("sector_code is not null")
    if sector_codes:
        out = out.where(F.col("sector_code").isin(list(sector_codes)))
    return out.distinct().orderBy("sector_code")


def active_counts(symbols: DataFrame) -> DataFrame:
    return symbols.where("is_active").groupBy("exchange").agg(F.count("*").alias("active_symbols"))


def load_plan(
    executions: DataFrame, active: DataFrame, job_id: Column, to_day: date,
) -> DataFrame:
    """Fetch window per active symbol from the last stored offset.

    The offset of the latest finished run wins (a run without a finish time ranks as the
    newest); it may be an instant or a date, anything else counts as unknown.
    """
    rank = F.struct(F.col("finished_at").isNull(), F.col("finished_at"))
    last = (
        executions.where(F.col("new_offset").isNotNull() & (F.col("job_id") == job_id))
        .groupBy("symbol_key").agg(F.max_by("new_offset", rank).alias("new_offset"))
    )
    text = F.col("new_offset")
    instant = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T[0-9:.]+Z$"), F.try_to_timestamp(text))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))))
    planned = active.join(last, "symbol_key", "left").withColumn("from_offset", F.coalesce(instant, day))
    return planned.select(
        "symbol_key", "from_offset", fetch_size(F.col("from_offset").cast("date"), to_day).alias("fetch_size")
    )
