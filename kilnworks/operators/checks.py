"""Contract checks and coercions on uploaded tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of booleans.
TRUE_WORDS = ["true", "1", "1.0", "yes"]
FALSE_WORDS = ["false", "0", "0.0", "no"]


def parse_boolean(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(TRUE_WORDS), True).when(s.isin(FALSE_WORDS), False)


def strict_boolean(df: DataFrame, col: str, nullable: bool = False) -> DataFrame:
    """Parse a boolean column; unknown words (and null unless allowed) raise."""
    parsed = parse_boolean(F.col(col))
    bad = parsed.isNull() & (F.col(col).isNotNull() if nullable else F.lit(True))
    sample = df.filter(bad).select(col).distinct().limit(5).collect()
    if sample:
        raise ValueError(f"invalid boolean values in {col}: {sorted(str(r[0]) for r in sample)}")
    return df.withColumn(col, parsed)


def column_defaults(df: DataFrame, numeric: Sequence[str], text: Sequence[str], flags: Sequence[str],
                    dates: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add missing typed columns at their neutral value; also name what was added."""
    plan = [(numeric, F.lit(0.0)), (text, F.lit("unknown")), (flags, F.lit(False)), (dates, F.lit(None).cast("date"))]
    add = {c: v for cols, v in plan for c in cols if c not in df.columns}
    return (df.withColumns(add) if add else df), sorted(add)


def coerce_contract(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Exactly the contract's columns: text 'unknown' for null, numbers or null, dates or null, booleans."""
    out = []
    for name, kind in contract.items():
        c = F.col(name) if name in df.columns else F.lit(None)
        if kind == "string":
            c = F.coalesce(c.cast("string"), F.lit("unknown"))
        elif kind == "boolean":
            c = F.coalesce(parse_boolean(c), F.lit(False))
        else:
            c = c.cast("string").try_cast(kind)
        out.append(c.alias(name))
    return df.select(*out)


def search_rows(df: DataFrame, needle: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any of the columns contains the text, whatever its case."""
    if not needle:
        return df
    low = F.lower(F.lit(needle))
    hits = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), low), F.lit(False)) for c in (columns or df.columns)]
    return df.filter(reduce(lambda a, b: a | b, hits))


def override(df: DataFrame, changes: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Replace allowed non-negative numbers of chosen keys; anything else raises."""
    fields = [c for c in changes.columns if c not in keys]
    unknown = sorted(set(fields) - set(allowed))
    if unknown:
        raise ValueError(f"unsupported overrides: {unknown}")
    if not changes.filter(reduce(lambda a, b: a | b, [F.col(c) < 0 for c in fields])).isEmpty():
        raise ValueError("overrides must not be negative")
    named = changes.withColumnsRenamed({c: f"__new_{c}" for c in fields})
    out = df.join(named, list(keys), "left")
    return out.withColumns({c: F.coalesce(f"__new_{c}", c) for c in fields}).drop(*[f"__new_{c}" for c in fields])


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with its number of violating rows, from a single pass."""
    counted = df.agg(*[F.count_if(r).alias(n) for n, r in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]))
    return counted.select(pairs.alias("p")).select("p.*")


def snapshot_rules(quantities: Sequence[str]) -> dict[str, Column]:
    rules = {f"negative_{c}": F.col(c) < 0 for c in quantities}
    rel = F.col("calculated_vendor_reliability")
    rules["reliability_range"] = (rel < 0) | (rel > 1)
    return rules


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def injected_mismatches(df: DataFrame) -> DataFrame:
    """Injected rows that break their contract, with the reason.

    The origin must be in stock, the outcome exactly a week later, and equal to
    the real row of that date.
    """
    real = df.select("item_id", "warehouse_id", F.col("snapshot_date").alias("__next"),
                     F.col("stockout_flag").alias("__actual"))
    inj = df.filter("business_scenario_injected").withColumn("__next", F.date_add("snapshot_date", 7))
    j = inj.join(real, ["item_id", "warehouse_id", "__next"], "left")
    why = (F.when(F.col("stockout_flag") | (F.col("available_qty") <= 0), "origin_not_in_stock")
           .when(F.col("future_outcome_date_1w").isNull() | F.col("future_stockout_flag_1w").isNull(), "no_outcome")
           .when(F.col("future_outcome_date_1w") != F.col("__next"), "outcome_not_next_week")
           .when(F.col("__actual").isNull(), "no_future_row")
           .when(F.col("__actual") != F.col("future_stockout_flag_1w"), "outcome_mismatch"))
    return j.withColumn("problem", why).filter(F.col("problem").isNotNull())


def new_rows_only(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return incoming.join(existing.select(key), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def distinct_counts(df: DataFrame) -> DataFrame:
    """Distinct non-null values per column: one row per (column, value) pair, then a count.

    Column values are unpivoted to text pairs, so no task keeps a column's value set.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.to_json(F.struct(F.col(c))).alias("v"),
                 F.col(c).isNotNull().alias("present")) for c in df.columns]))
    p = df.select(pairs.alias("p")).select("p.*").groupBy("column_name", "v").agg(F.max("present").alias("present"))
    return p.groupBy("column_name").agg(F.count_if("present").alias("distinct_values"))


def readiness(tables: dict[str, tuple[DataFrame, Sequence[str], str | None, str | None]]) -> DataFrame:
    """Per source table: rows, distinct dates, distinct labels, missing columns, trainable or not."""
    out = None
    for name, (df, required, date, label) in tables.items():
        missing = sorted(set(required) - set(df.columns))
        row = df.agg(F.count(F.lit(1)).alias("rows"),
                     (F.count_distinct(date) if date in df.columns else F.lit(0)).cast("bigint").alias("dates"),
                     (F.count_distinct(label) if label in df.columns else F.lit(0)).cast("bigint").alias("labels")
                     ).withColumns({"source": F.lit(name), "missing": F.lit(",".join(missing))})
        row = row.withColumn("trainable", (F.col("rows") > 0) & (F.col("missing") == "") & (F.col("labels") >= 2))
        out = row if out is None else out.unionByName(row)
    return out


# Columns that leak the outcome or go stale.
FORBIDDEN_FEATURES = ["rop_status", "tenant_id", "real_duration", "actual_start", "actual_end", "completed_at"]


def schema_gate(df: DataFrame, not_null: Sequence[str], finite: Sequence[str], allowed: Sequence[str],
                parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Violations of one table: nulls, non-finite numbers, missing parents, unknown and forbidden columns."""
    rules = {f"null:{c}": F.col(c).isNull() for c in not_null}
    rules |= {f"non_finite:{c}": F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in finite}
    names = [(f"unknown_column:{c}", 1) for c in sorted(set(df.columns) - set(allowed))]
    names += [(f"forbidden_column:{c}", 1) for c in sorted(set(df.columns) & set(FORBIDDEN_FEATURES))]
    out = violation_counts(df, rules)
    if names:
        out = out.unionByName(df.sparkSession.createDataFrame(names, "rule string, violations bigint"))
    for fk, (parent, pk) in parents.items():
        lost = orphans(df, parent, fk, pk).agg(F.count(F.lit(1)).alias("violations"))
        out = out.unionByName(lost.withColumn("rule", F.lit(f"missing_parent:{fk}")))
    return out


def realism_gate(df: DataFrame, label: str, features: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Positive rate inside its band and no constant feature (compared by min and max)."""
    one = df.agg(F.avg(F.col(label).cast("double")).alias("positive_rate"),
                 *[(F.min(c) == F.max(c)).alias(c) for c in features])
    flat = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(True)), F.lit(c)) for c in features]))
    return one.select("positive_rate", F.concat_ws(",", flat).alias("constant_features"),
                      (F.col("positive_rate").between(lo, hi) & (F.size(flat) == 0)).alias("passed"))
