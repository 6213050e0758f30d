"""Small decisions: states, immutability, exceptions, targets, fixtures, throughput, alignment of foreign settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the alignment of a foreign job decides about an exception.
DECISIONS = {
    "network_break": "retry", "disk_full": "abort", "permission_denied": "skip", "file_locked": "retry",
    "source_missing": "skip", "repo_unavailable": "retry", "process_killed": "resume", "power_off": "self_check_and_isolate",
}
#: What a running execution does about one; anything else is mark_failed.
ENGINE_ACTIONS = {
    "disk_full": "abort", "permission_denied": "skip", "source_missing": "skip", "file_locked": "retry",
    "network_break": "retry", "repo_unavailable": "retry", "process_killed": "continue", "power_off": "continue",
}
#: The states of a version that nobody sees.
HIDDEN = ("created", "writing", "verifying", "committing", "purged")
#: The states of an execution in their order, and those that have no next one.
PROGRESSION = ("pending", "aligning", "scanning", "chunking", "encrypting", "uploading", "comp_committing", "verifying", "success")
ENDED = ("success", "failed")
#: Chunk bytes, memory in MB, parallel tasks (None: half the cores) and cached entries by tier.
TIERS = {"legacy": (1 << 20, 32, 1, 32_000), "standard": (4 << 20, 128, 2, 128_000), "modern": (8 << 20, 512, None, 512_000)}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def decision(kind: Column) -> Column:
    """By DECISIONS; null for a kind that isn't among them."""
    return _looked_up(DECISIONS, kind)


def engine_action(kind: Column) -> Column:
    return F.coalesce(_looked_up(ENGINE_ACTIONS, kind), F.lit("mark_failed"))


def visible(status: Column) -> Column:
    return ~status.isin(*HIDDEN)


def terminal(status: Column) -> Column:
    return status == "purged"


def sealed(status: Column) -> Column:
    return F.coalesce(status == "sealed", F.lit(False))


def next_state(state: Column) -> Column:
    """The state after one of PROGRESSION; null where there is none."""
    return _looked_up(dict(zip(PROGRESSION, PROGRESSION[1:])), state)


def ended(state: Column) -> Column:
    return state.isin(*ENDED)


def active(state: Column) -> Column:
    return ~state.isin(*ENDED, "paused")


def blocked(until: Column, now: Column) -> Column:
    """Immutable as long as now is before until; no until never blocks."""
    return F.coalesce(now < until, F.lit(False))


def target_status(frozen: Column, target: Column, measured: Column) -> Column:
    """pending until the target is frozen, not_tested for a target of 0, else pass or exceed."""
    return F.when(~F.coalesce(frozen, F.lit(False)), "pending").when(target == 0, "not_tested").when(measured <= target, "pass").otherwise("exceed")


def low_memory(available: Column) -> Column:
    """enabled, buffer bytes, concurrency and budget bytes by available bytes: below 4 GiB less of all."""
    low = available < 4 << 30
    pick = lambda a, b: F.when(low, a).otherwise(b)
    budget = F.floor(available * pick(F.lit(0.7), F.lit(0.8))).cast("long")
    return F.struct(low.alias("enabled"), pick(64 << 20, 256 << 20).cast("long").alias("buffer"), pick(1, 4).alias("concurrency"), budget.alias("budget"))


def tier(memory_mb: Column) -> Column:
    return F.when(memory_mb <= 4096, "legacy").when(memory_mb <= 8192, "standard").otherwise("modern")


def tier_settings(name: Column, cores: Column) -> Column:
    """chunk_bytes, memory_mb, parallelism and cache entries of a tier."""
    out = F.lit(None)
    for k, (chunk, memory, tasks, cache) in TIERS.items():
        parallel = F.greatest(F.floor(cores / 2).cast("int"), F.lit(1)) if tasks is None else F.lit(tasks)
        one = F.struct(F.lit(chunk).cast("long").alias("chunk_bytes"), F.lit(memory).alias("memory_mb"), parallel.alias("parallelism"), F.lit(cache).alias("cache"))
        out = F.when(name == k, one) if k == "legacy" else out.when(name == k, one)
    return out


def throughput(n_bytes: Column, ms: Column) -> Column:
    """Bytes a second; 0 where no time went by."""
    return F.coalesce(n_bytes * 1000 / F.nullif(ms, F.lit(0)), F.lit(0.0))


def clamped(progress: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress))


def gc_due(enabled: Column, last: Column, now: Column, used_percent: Column) -> Column:
    """Enabled and never run or an hour ago, or four fifths full."""
    old = last.isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) >= 3_600_000_000)
    return (enabled & old) | (used_percent >= 80)


def fixture_verdict(path: Column, size: Column, digest: Column, kind: Column, deleted: Column) -> Column:
    """Deleted files pass; else the last rule that is broken."""
    return F.when(deleted, "pass").when((size > 0) & (kind != "large") & (F.coalesce(digest, F.lit("")) == ""), "no_digest").when(size < 0, "bad_size").when(F.coalesce(path, F.lit("")) == "", "no_path").otherwise("pass")


def verdict_gap(status: Column, root_cause: Column, reason: Column, rationale: Column | None = None) -> Column:
    """What a verdict lacks: a fail its root cause, one that wasn't tested or isn't supported its reason, one by design its rationale; null if whole."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    out = F.when((status == "fail") & empty(root_cause), "root_cause").when((status == "not_tested") & empty(reason), "not_tested_reason").when((status == "not_supported") & empty(reason), "not_supported_reason")
    return out if rationale is None else out.when((status == "different_by_design") & empty(rationale), "design_rationale")


def aligned_path(path: Column) -> Column:
    """A foreign path with forward slashes; null for an empty one, which can't be taken over."""
    return F.nullif(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(""))


def aligned_compression(name: Column) -> Column:
    """The codec that stands for a foreign one; null for an unknown name."""
    low = F.lower(name)
    return F.when(low.isin("zip", "gzip", "deflate"), "zstd").when(low.isin("lz4", "lzma", "brotli"), "lz4").when(low.isin("none", "no-compression"), "none")


def aligned_level(level: Column) -> Column:
    return F.least(level, F.lit(22))


def aligned_encryption(name: Column, passphrase: Column) -> Column:
    """Every AES name stands for one cipher; null without a passphrase and for none or unknown names."""
    known = F.lower(name).isin("aes-256", "aes-256-gcm", "aes-gcm", "aes-128", "aes-128-cbc", "aes-cbc")
    return F.when(known & (F.coalesce(passphrase, F.lit("")) != ""), "aes-256-gcm")


def aligned_backup_type(incremental: Column) -> Column:
    return F.when(incremental, "incremental").otherwise("full")


def json_or(text: Column, path: str, default: str = "") -> Column:
    """A string field of a JSON text, the default where it is missing, empty or the text isn't JSON."""
    return F.coalesce(F.nullif(F.get_json_object(text, path), F.lit("")), F.lit(default))


def stale(last: Column, now: Column, seconds: int = 30) -> Column:
    """A peer that was never heard of, or longer ago than seconds."""
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) > seconds * 1_000_000, F.lit(True))
