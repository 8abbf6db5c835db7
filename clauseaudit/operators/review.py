"""Officers' work on findings, retention, deletion, and change logs."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseaudit.operators.rules import Facts


def latest(x: DataFrame, keys: list[str], ts: str = "ts", *ties: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), *[F.desc(t) for t in ties])
    return x.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with their last decision (finding_id, decision, reason, decided_by, ts)."""
    d = latest(decisions, ["finding_id"], "ts", "decision").select("finding_id", "decision", "reason", "decided_by", F.col("ts").alias("decided_on"))
    return findings.join(d, "finding_id", "left")


def unknown_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on findings that do not exist."""
    return decisions.join(findings.select("finding_id"), "finding_id", "left_anti")


def log_rows(x: DataFrame, action: str, table: str, record: str, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Audit-log rows with the record's values as JSON."""
    return x.select(F.col(ts).alias("ts"), F.col(user).alias("user_id"), F.lit(action).alias("action"), F.lit(table).alias("table_name"), F.col(record).cast("string").alias("record_id"), F.to_json(F.struct(*x.columns)).alias("new_values"))


def replace_clause_findings(findings: DataFrame, edited: DataFrame, new: DataFrame) -> DataFrame:
    """Findings of edited clauses (doc_id, clause_id) give way to the new ones."""
    return findings.join(edited.select("doc_id", "clause_id").distinct(), ["doc_id", "clause_id"], "left_anti").unionByName(new)


def retention_split(sessions: DataFrame, as_of: datetime.datetime, days: int = 30) -> DataFrame:
    """``sessions`` with ``purged``: older than the retention period."""
    return sessions.withColumn("purged", F.coalesce(F.col("created_at") < F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS"), F.lit(False)))


def delete_audits(audits: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left, and the requests (audit_id, user_id, role) with their outcome: owners and admins may delete."""
    x = requests.join(audits.select("audit_id", F.col("user_id").alias("_owner")), "audit_id", "left")
    allowed = (F.col("_owner") == F.col("user_id")) | (F.col("role") == "Admin")
    x = x.withColumn("outcome", F.when(F.col("_owner").isNull(), "NOT_FOUND").when(allowed, "DELETED").otherwise("REJECTED")).drop("_owner")
    return audits.join(x.where("outcome = 'DELETED'").select("audit_id"), "audit_id", "left_anti"), x


def upsert_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Terms with those new ones whose phrase is absent; of equal new phrases the first by id."""
    fresh = new.join(terms.select("term"), "term", "left_anti")
    w = Window.partitionBy("term").orderBy("id")
    fresh = fresh.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return terms.unionByName(fresh.select(*terms.columns)).orderBy("term")


def decision_log(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """A FINDING_DECISION row for every decision (finding_id, decision, reason, decided_by, ts) on a finding that exists."""
    known = decisions.join(findings.select("finding_id").distinct(), "finding_id", "left_semi")
    return log_rows(known, "FINDING_DECISION", "findings", "finding_id", "decided_by")


def deletion_log(outcomes: DataFrame) -> DataFrame:
    """A DELETE_AUDIT row for every request of ``delete_audits`` (with a ts) that was carried out."""
    return log_rows(outcomes.where("outcome = 'DELETED'"), "DELETE_AUDIT", "audits", "audit_id")


def purge_log(split: DataFrame, as_of: datetime.datetime, days: int = 30, user: str = "system") -> DataFrame:
    """The one RETENTION_PURGE row of a run of ``retention_split``: how many sessions went, and the period; it is written if none went, too."""
    x = split.agg(F.count_if("purged").alias("purged")).select(F.lit(as_of).alias("ts"), F.lit(user).alias("user_id"), F.lit("all").alias("record"), "purged", F.lit(days).alias("days"))
    return log_rows(x, "RETENTION_PURGE", "sessions", "record").withColumn("purged", F.get_json_object("new_values", "$.purged").cast("long"))


def upsert_errors(terms: DataFrame, new: DataFrame) -> DataFrame:
    """(id, term, error) of the new terms that ``upsert_terms`` does not take: their phrase exists, or an earlier new one has it."""
    w = Window.partitionBy("term").orderBy("id")
    x = new.join(terms.select("term", F.lit(True).alias("_old")).distinct(), "term", "left").withColumn("_rn", F.row_number().over(w))
    error = F.when(F.col("_old"), "phrase exists").when(F.col("_rn") > 1, "phrase repeated")
    return x.select("id", "term", error.alias("error")).where("error is not null")


def delete_terms(terms: DataFrame, ids: DataFrame) -> DataFrame:
    return terms.join(ids.select("id"), "id", "left_anti").orderBy("term")


def recent(x: DataFrame, order: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the newest rows; the limit is the feature."""
    return x.orderBy(*[F.desc(c) for c in order]).offset(offset).limit(limit)


def page(x: DataFrame, columns: list[str], key: str = "id", offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of a table's public columns in order of its key; the limit is the feature."""
    return x.select(*columns).orderBy(key).offset(offset).limit(limit)


def product_rules(products: DataFrame, rules: DataFrame) -> DataFrame:
    """Products with ``rules``: their certification rules in order of id, none for a product without."""
    own = rules.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in rules.columns if c not in ("id", "product_id")]))).alias("rules"))
    nothing = F.array().cast(own.schema["rules"].dataType)
    return products.join(own.withColumnRenamed("product_id", "id"), "id", "left").withColumn("rules", F.coalesce("rules", nothing))


def get_by_id(x: DataFrame, value: object, key: str = "id") -> DataFrame:
    """The row with an id (none if it does not exist)."""
    return x.where(F.col(key) == F.lit(value))


def finding_filter(findings: DataFrame, severity: str = "ALL", clause_id: str | None = None) -> DataFrame:
    """Findings of a severity (or all), of one clause if it is given."""
    x = findings if severity == "ALL" else findings.where(F.col("severity") == severity)
    return x if clause_id is None else x.where(F.col("clause_id") == clause_id)


def recent_audit_logs(log: DataFrame, limit: int = 100, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest log rows; at most 500."""
    return recent(log, ["ts", *ties], min(limit, 500))


def terms_sorted(terms: DataFrame) -> DataFrame:
    return terms.orderBy("term")


def edited_clause_findings(findings: DataFrame, edited: DataFrame, facts: Facts, evaluate: Callable[[Facts], DataFrame]) -> DataFrame:
    """Findings after officers' edits of clauses (doc_id, clause_id): the edited clauses alone are evaluated again (``evaluate`` of ``facts``
    with their new extractions), and their findings replaced."""
    return replace_clause_findings(findings, edited, evaluate(facts).join(edited.select("doc_id", "clause_id").distinct(), ["doc_id", "clause_id"], "left_semi"))


def findings_with_clause_text(findings: DataFrame, clauses: DataFrame) -> DataFrame:
    """Findings with their clause's snippet and the report's defaults."""
    from clauseaudit.functions.text import snippet

    c = clauses.select("doc_id", "clause_id", snippet(F.col("text")).alias("_snippet"))
    x = findings.join(c, ["doc_id", "clause_id"], "left")
    state = F.coalesce("decision", F.lit("Pending Review")) if "decision" in findings.columns else F.lit("Pending Review")
    return x.withColumn("snippet", F.coalesce("_snippet", F.lit("N/A"))).withColumn("decision", state).drop("_snippet")


def row_change_log(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, action, old_values, new_values) of inserted and updated rows between two snapshots."""
    pack = lambda d, n: d.select(key, F.to_json(F.struct(*sorted(d.columns)), {"ignoreNullFields": "false"}).alias(n))
    x = pack(before, "old_values").join(pack(after, "new_values"), key, "full_outer").where("new_values is not null and not (old_values <=> new_values)")
    return x.select(key, F.when(F.col("old_values").isNull(), "INSERT").otherwise("UPDATE").alias("action"), "old_values", "new_values")
