"""Control tables: joins of the list pages, upserts, counters, deletes, rules that rows must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending_executions(executions: DataFrame, jobs: DataFrame, most: int = 10) -> DataFrame:
    """The oldest pending executions (execution, job, state, started) with the name of their job."""
    return executions.filter("state = 'pending'").join(jobs.select("job", "name"), "job").orderBy("started", "execution").limit(most).select("execution", "job", "name", "started")


def user_permissions(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """user, permission, each once; roles keep a JSON list."""
    held = roles.select("role", F.explode(F.from_json("permissions", "array<string>")).alias("permission"))
    return user_roles.join(held, "role").select("user", "permission").distinct()


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the values of changes where those aren't null; a key that changes lack stays as it is."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return rows.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*rows.columns)


def upserted(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """rows without those that more replaces, and more."""
    return rows.join(more.select(key), key, "left_anti").select(*more.columns).unionByName(more)


def inserted(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """rows, and those of more whose key isn't there yet, each once."""
    return rows.unionByName(more.dropDuplicates([key]).join(rows.select(key), key, "left_anti").select(*rows.columns))


def deleted(tables: dict[str, DataFrame], start: str, gone: DataFrame, children: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """tables after the rows of start with the keys of gone went, and what refers to them.

    children: (child table, its column, parent table, its key), parents before their children.
    """
    key = gone.columns[0]
    out, left = dict(tables), {start: gone}
    out[start] = tables[start].join(gone, key, "left_anti")
    for child, column, parent, parent_key in children:
        if parent in left:
            lost = left[parent].select(F.col(parent_key).alias(column))
            left[child] = tables[child].join(lost, column, "left_semi")
            out[child] = out[child].join(lost, column, "left_anti")
    return out


def violations(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """key, rule for every rule (a condition that must not be false) that a row breaks."""
    broken = F.filter(F.array(*(F.when(~c, F.lit(name)) for name, c in rules.items())), lambda n: n.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def label_key(labels: Column) -> Column:
    """A map as text, the same for equal maps: maps themselves can't be grouped."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def metric_state(updates: DataFrame) -> DataFrame:
    """name, labels, value: the last value of gauges and the sum of counters (name, labels map, kind, value, at)."""
    groups = updates.groupBy("name", label_key(F.col("labels")).alias("labels"), "kind")
    return groups.agg(F.when(F.col("kind") == "counter", F.sum("value")).otherwise(F.max_by("value", "at")).alias("value"))


def next_version(policies: DataFrame, policy: str, target: int) -> DataFrame:
    """policies (policy, version, body) with a copy of the target version of policy as its newest."""
    last = policies.filter(F.col("policy") == policy).agg(F.max("version").alias("_last"))
    copy = policies.filter((F.col("policy") == policy) & (F.col("version") == target)).crossJoin(last)
    return policies.unionByName(copy.withColumn("version", F.col("_last") + 1).drop("_last"))


def listed(policies: DataFrame) -> DataFrame:
    return policies.orderBy(F.desc("priority"), "name")


def test_counts(lines: DataFrame) -> DataFrame:
    """passed and failed lines of test logs (value)."""
    v = F.col("value")
    return lines.agg(F.count_if(v.startswith("ok") | v.contains("test result: ok")).alias("passed"), F.count_if(v.startswith("FAIL") | v.contains("test result: FAILED")).alias("failed"))


def roll_up(versions: DataFrame, refs: DataFrame, repository: str) -> DataFrame:
    """repository, versions, size, chunks of each repository."""
    v = versions.groupBy(repository).agg(F.count("*").alias("versions"), F.round(F.sum("size"), 2).alias("size"))
    c = refs.join(versions.select("version", repository), "version").groupBy(repository).agg(F.countDistinct("chunk").alias("chunks"))
    return v.join(c, repository, "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)).cast("long"))


def index_stat(index: DataFrame) -> DataFrame:
    """One row over the chunk index (ref_count, stored_size, status): chunks, active, pending, references, bytes."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    of = lambda s: F.count_if(F.col("status") == s)
    return index.agg(F.count("*").alias("chunks"), of("active").alias("active"), of("gc_pending").alias("pending"), total("ref_count").alias("references"), total("stored_size").alias("bytes"))


def batch_put(items: DataFrame) -> DataFrame:
    """One row from items (hash, data): accepted (the hash is right) and refused."""
    good = F.coalesce(F.sha2("data", 256) == F.col("hash"), F.lit(False))
    return items.agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("refused"))


def cross_granted(users: DataFrame, roles: DataFrame, user: str, role: str) -> DataFrame:
    """user_id, role_id of the named user and role: a row if both are there."""
    return users.filter(F.col("name") == user).select("user_id").crossJoin(roles.filter(F.col("name") == role).select("role_id"))


def audit_records(entries: DataFrame, redact) -> DataFrame:
    """entries (id, actor, action, target, result, at, detail map) ready to be appended: values of detail redacted, a missing result is unknown."""
    return entries.select("id", "actor", "action", "target", F.coalesce("result", F.lit("unknown")).alias("result"), "at", redact(F.col("detail")).alias("detail"))


def missing_parents(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
