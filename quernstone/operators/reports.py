"""Reports over profiles, mappings, cases, versions and logs; each is a DataFrame in and a DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.delivery import audit_id
from quernstone.operators.scoring import FLOOR


def field_coverage(feeds: DataFrame) -> DataFrame:
    """field, coverage: filled cells of the columns that feed a field, over the rows of the files (file, sheet) they come from.

    feeds: field, file, sheet, column, non_null, total. Files count once each, by their fullest column.
    """
    per_file = feeds.groupBy("field", "file", "sheet").agg(F.sum("non_null").alias("filled"), F.max("total").alias("rows"))
    return per_file.groupBy("field").agg(F.least(F.lit(1.0), F.sum("filled") / F.sum("rows")).alias("coverage"))


def header_groups(profiles: DataFrame) -> DataFrame:
    """header (lower case), n_columns, best (file of the fullest), filled: columns of one name over all files, commonest first."""
    return profiles.groupBy(F.lower("column").alias("header")).agg(F.count(F.lit(1)).alias("n_columns"), F.max_by("file", F.struct("non_null", F.col("file"))).alias("best"), F.max("non_null").alias("filled"))


def mapping_metrics(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of counts of decisions (file, column, field, status) against truth (file, column, expected; null: must not map): right, wrong, noise, over, under, agreement."""
    both = truth.join(decided, ["file", "column"], "left")
    auto, want = F.col("status") == "auto", F.col("expected")
    right = auto & F.col("field").eqNullSafe(want)
    return both.agg(
        F.count_if(F.coalesce(right, F.lit(False))).alias("n_right"), F.count_if(F.coalesce(auto & want.isNotNull() & (F.col("field") != want), F.lit(False))).alias("n_wrong"),
        F.count_if(F.coalesce(auto & want.isNull(), F.lit(False))).alias("n_noise"), F.count_if((F.col("status") == "review") & want.isNotNull()).alias("n_over"),
        F.count_if((F.coalesce("status", F.lit("unmapped")) == "unmapped") & want.isNotNull()).alias("n_under"),
        (F.count_if(F.coalesce(right, F.lit(False)) | (want.isNull() & ~F.coalesce(auto, F.lit(False)))) / F.count(F.lit(1))).alias("agreement"),
    )


def waiting_counts(cases: DataFrame) -> DataFrame:
    """case_key, waiting: distinct records that a case (case_key, blocked, children) holds up, by either list."""
    return cases.select("case_key", F.size(F.array_distinct(F.array_union("blocked", "children"))).alias("waiting"))


def lookup_options(lookups: DataFrame, n: int = 8) -> DataFrame:
    """name, options: the first n codes of each lookup in order."""
    ranked = lookups.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("code"))).where(F.col("_r") <= n)
    return ranked.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("options"))


def latest_version(versions: DataFrame, state: str) -> DataFrame:
    """run_id, version: the newest schema version of each run in a state."""
    return versions.where(F.col("state") == state).groupBy("run_id").agg(F.max("version").alias("version"))


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("run_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def fingerprint(parts: DataFrame, key: str, part: Column) -> DataFrame:
    """key, fingerprint: one hash over the sorted parts of each key, whatever order they came in."""
    return parts.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "|"), 256).alias("fingerprint"))


def snapshot(saved: DataFrame, now: DataFrame) -> DataFrame:
    """run_id, payload: the newest saved snapshot whose fingerprint is still the run's; saved: run_id, fingerprint, at, payload."""
    return saved.join(now.select("run_id", "fingerprint"), ["run_id", "fingerprint"]).groupBy("run_id").agg(F.max_by("payload", "at").alias("payload"))


def run_name(raw: Column) -> Column:
    """A run's name: white space collapsed and trimmed, 120 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(raw, r"(?U)\s+", " "), r"^ | $", ""), 1, 120)


def rename_runs(runs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """runs (run_id, name, others) under their new names (names: run_id, name, one for each run), and the audit rows of those that changed (id, run_id, actor, action, before, after).

    Of a new name white space is collapsed; a blank one, or one of more than 120 characters, changes nothing.
    """
    collapsed = F.regexp_replace(F.regexp_replace("name", r"(?U)\s+", " "), r"^ | $", "")
    told = names.select("run_id", collapsed.alias("_new")).where("_new <> '' and length(_new) <= 120")
    both = runs.join(told, "run_id", "left").withColumn("_new", F.coalesce("_new", "name"))
    changed = both.where("not (_new <=> name)").select(audit_id(F.col("run_id"), F.lit("run.renamed"), F.col("name"), F.col("_new")).alias("id"), "run_id", F.lit("human").alias("actor"), F.lit("run.renamed").alias("action"), F.col("name").alias("before"), F.col("_new").alias("after"))
    return both.select(*(F.col("_new").alias(c) if c == "name" else F.col(c) for c in runs.columns)), changed


def without_runs(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows of a table (run_id, others) without those of deleted runs (gone: run_id)."""
    return rows.join(gone.select("run_id").distinct(), "run_id", "left_anti").select(*rows.columns)


# The four looks that an investigation of a case takes at the data.

def values_in_column(counts: DataFrame, file: str, column: str, n: int = 20) -> DataFrame:
    return counts.where((F.col("file") == file) & (F.col("column") == column) & F.col("v").isNotNull()).groupBy("v").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "v").limit(n)


def known_values(lookups: DataFrame, name: str) -> DataFrame:
    return lookups.where(F.col("name") == name).select("code").distinct().orderBy("code")


def what_other_sources_say(cells: DataFrame, keys: DataFrame, file: str) -> DataFrame:
    """file, column, value of the cells of the same entities (keys: file, row, entity) in other files."""
    entities = keys.where(F.col("file") == file).select("entity").distinct()
    others = keys.where(F.col("file") != file).join(entities, "entity", "left_semi")
    return cells.join(others, ["file", "row"]).select("entity", "file", "column", "value")


def columns_in_file(cells: DataFrame, file: str) -> DataFrame:
    return cells.where(F.col("file") == file).select("column").distinct().orderBy("column")


def review_share(decided: DataFrame) -> DataFrame:
    return decided.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= FLOOR).cast("double")).alias("share_above_floor"))
