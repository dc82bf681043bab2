"""The registry of common codes: minting, mappings, audit trail, review.

Tables are DataFrames (``Tables``); every operation returns new ones, and ``transact`` makes what it returns current at once or
not at all.  Minting follows the order of matches, decided for all items together by pointers that are followed in doubling
steps; new codes are numbered over all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from ..stages import numbered, saved, small, staged

REGISTRY = "cnmc_code string, canonical_description string, confidence_at_merge double, merge_type string, created_at timestamp_ntz"
MAPPING = "id long, cnmc_code string, source_cpse string, original_code string"
AUDIT = "entry_id long, cnmc_code string, action string, actor string, details string, timestamp timestamp_ntz"
DECISIONS = "match_id string, reviewer_decision string, decision string, reviewer_id string, reviewed_at timestamp, notes string"
SCHEMAS = {"registry": REGISTRY, "mapping": MAPPING, "audit": AUDIT, "decisions": DECISIONS}
ACTIONS = ("auto_linked", "human_approved", "human_rejected", "safety_gate_blocked")


@dataclass
class Tables:
    registry: DataFrame
    mapping: DataFrame
    audit: DataFrame
    decisions: DataFrame
    version: str | None = None  # the stored version that these were loaded from


def empty(spark: SparkSession) -> Tables:
    """Fresh tables."""
    return Tables(*(spark.createDataFrame([], s) for s in SCHEMAS.values()))


def save(t: Tables, path: str) -> str:
    """All four tables as one new version of the registry in ``path``, current at once or not at all; gives its name.

    Tables go to a folder of their own, so ``t`` may come from the very registry that it replaces, and whoever reads an older
    version goes on reading it.  Raises ``Conflict`` if ``t`` was loaded and another version has become current since.
    """
    return versions.publish(t.registry.sparkSession, path, {n: getattr(t, n) for n in SCHEMAS}, t.version)


def load(spark: SparkSession, path: str) -> Tables:
    """The current version of the registry in ``path``; ``FileNotFoundError`` without one."""
    name, tables = versions.current(spark, path, SCHEMAS)
    return Tables(**tables, version=name)


def open_or_create(spark: SparkSession, path: str) -> Tables:
    """``load``, or fresh tables where there are none."""
    try:
        return load(spark, path)
    except FileNotFoundError:
        return empty(spark)


def transact(spark: SparkSession, path: str, *changes: Callable[[Tables], Tables]) -> Tables:
    """Applies ``changes`` one after the other to the registry in ``path`` and makes the result current in one step.

    If one of them raises, or the driver dies, nothing has changed.  Tables that break a rule are not stored: ``Broken``.
    """
    t = open_or_create(spark, path)
    for change in changes:
        t = change(t)
    broken = violations(t).limit(20).collect()
    if broken:
        raise Broken([tuple(r) for r in broken])
    save(t, path)
    return load(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Resets the registry in ``path`` to empty tables, as one version more: the older ones stay until they are swept."""
    save(empty(spark), path)


class Broken(ValueError):
    """Tables with rows that break a rule; holds the first of them."""


def next_number(registry: DataFrame) -> int:
    """One more than the largest number of a code, as a number (so it goes on beyond six digits)."""
    top = registry.filter("cnmc_code like 'CNMC-%'").agg(F.max(F.regexp_extract("cnmc_code", r"-(\d+)$", 1).try_cast("long"))).first()[0]
    return (top or 0) + 1


def code_of(number: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.lit("CNMC-"), F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text))


def _coded(matches: DataFrame, old: DataFrame) -> DataFrame:
    """Which code each item of ``matches`` has in the end: ``node, ord, origin, cnmc_code``, one row for each.

    An item without a code gets one at its first match, whatever that does: a new code, if the match is the first of both its
    items, else the code of the other item, which has one already.  So every item points to the item it takes its code from,
    and pointers lead to items that were mapped before (``cnmc_code``) or to a match that mints (``origin``, its ``ord``).  Each
    round follows pointers twice as far, so a chain of any length takes a logarithm of rounds.  No group is one task: an item
    of very many matches is reduced to its first one before the shuffle.
    """
    ends = matches.select("ord", F.col("node_a").alias("node"), F.col("node_b").alias("other")).union(matches.select("ord", "node_b", "node_a"))
    first = ends.groupBy("node").agg(F.min(F.struct("ord", "other")).alias("x")).select("node", "x.ord", "x.other")
    known = old.select("node", F.col("cnmc_code"))
    items = saved(first.join(known, "node", "left").withColumn("ord", F.when(F.col("cnmc_code").isNull(), F.col("ord"))))
    # a match that is first at both its items, neither of them mapped, mints
    minting = items.filter("ord is not null").groupBy("ord").agg(F.count("*").alias("n"), F.count_if(F.col("node") == F.col("other")).alias("own")).filter("n = 2 or own = 1").select("ord", F.col("ord").alias("origin"))
    table = items.join(minting, "ord", "left").select("node", "ord", "origin", "cnmc_code", F.when(F.col("origin").isNull() & F.col("cnmc_code").isNull(), F.col("other")).alias("other"))
    done, open_ = None, saved(table)
    while True:
        settled = open_.filter("other is null")
        done = settled if done is None else saved(done.unionByName(settled))
        rest = open_.filter("other is not null")
        if rest.isEmpty():
            return done.drop("other")
        # whoever a pointer leads to is settled, or points further
        target = done.unionByName(rest).select(F.col("node").alias("other"), F.col("origin").alias("o"), F.col("cnmc_code").alias("c"), F.col("other").alias("further"))
        open_ = saved(rest.drop("origin", "cnmc_code").join(target, "other").select("node", "ord", F.col("o").alias("origin"), F.col("c").alias("cnmc_code"), F.col("further").alias("other")))


def mint(t: Tables, matches: DataFrame, action: str, actor, at) -> Tables:
    """Applies approved ``matches`` in the order of ``ord``.

    Neither item mapped: a new code for both.  One mapped: the other joins it.  Both: nothing, even if their codes differ.
    ``matches``: ``ord, match_id, item_a, item_b, source_cpse_a, source_cpse_b, canonical_description, confidence_score``.
    ``at`` is the time of the entries; it and ``actor`` may be columns of ``matches``.
    """
    t, entries = _minted(t, matches, action, actor, at)
    return replace(t, audit=_audited(t.audit, entries))


def _minted(t: Tables, matches: DataFrame, action: str, actor, at) -> tuple[Tables, DataFrame]:
    """``mint`` without its audit entries, and these entries."""
    node = lambda s: F.concat_ws("\u0001", f"source_cpse_{s}", f"item_{s}")
    m = saved(matches.withColumns({"node_a": node("a"), "node_b": node("b")}))
    bad = m.filter("source_cpse_a is null or source_cpse_b is null or item_a is null or item_b is null or canonical_description is null or confidence_score is null")
    if not bad.isEmpty():
        raise ValueError("matches need items, sources, a description and a confidence")
    old = t.mapping.groupBy(F.concat_ws("\u0001", "source_cpse", "original_code").alias("node")).agg(F.min_by("cnmc_code", "id").alias("cnmc_code"))
    codes = _coded(m, old)
    # items by the match that gives them their code: two are minted together, one is attached
    gained = codes.filter("ord is not null").groupBy("ord").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.min("origin").alias("origin"), F.min("cnmc_code").alias("code"))
    effects = saved(gained.withColumn("effect", F.when(F.col("origin") == F.col("ord"), "mint").otherwise("attach")))
    fresh = numbered(effects.filter("effect = 'mint'").select("ord"), next_number(t.registry))
    effects = effects.join(fresh.select(F.col("ord").alias("origin"), code_of(F.col("number")).alias("minted")), "origin", "left")
    done = saved(m.join(effects.withColumn("cnmc_code", F.coalesce("minted", "code")).drop("code", "minted", "origin"), "ord"))
    when = F.lit(at).cast("timestamp_ntz")
    registry = done.filter("effect = 'mint'").select("cnmc_code", "canonical_description", F.col("confidence_score").alias("confidence_at_merge"), F.lit(action).alias("merge_type"), when.alias("created_at"))
    gets = lambda s, i: F.when(F.array_contains("nodes", F.col(f"node_{s}")), F.struct(F.lit(i).alias("i"), F.col(f"source_cpse_{s}").alias("source_cpse"), F.col(f"item_{s}").alias("original_code")))
    added = done.withColumn("x", F.explode(F.array_compact(F.array(gets("a", 0), F.when(F.col("node_a") != F.col("node_b"), gets("b", 1))))))
    mapping = added.select("ord", "cnmc_code", "x.source_cpse", "x.original_code", "x.i")
    top = t.mapping.agg(F.max("id")).first()[0] or 0
    mapping = numbered(mapping.withColumn("ord", F.col("ord") * 2 + F.col("i")), top + 1).select(F.col("number").alias("id"), "cnmc_code", "source_cpse", "original_code")
    details = F.to_json(F.struct("match_id", "item_a", "item_b", "source_cpse_a", "source_cpse_b", "confidence_score"))
    entries = done.select("ord", "cnmc_code", F.lit(action).alias("action"), F.lit(actor).alias("actor"), details.alias("details"), when.alias("timestamp"))
    return replace(t, registry=t.registry.unionByName(registry), mapping=t.mapping.unionByName(mapping)), entries


def _audited(audit: DataFrame, entries: DataFrame) -> DataFrame:
    top = audit.agg(F.max("entry_id")).first()[0] or 0
    new = numbered(entries, top + 1).select(F.col("number").alias("entry_id"), "cnmc_code", "action", "actor", "details", "timestamp")
    return audit.unionByName(new)


def audit_only(t: Tables, matches: DataFrame, action: str, actor: str, at, reason: str = "block_reason") -> Tables:
    """Entries without a code: blocked and rejected matches."""
    return replace(t, audit=_audited(t.audit, _uncoded(matches, action, actor, at, reason)))


def _uncoded(matches: DataFrame, action: str, actor, at, reason: str) -> DataFrame:
    details = F.to_json(F.struct("match_id", "item_a", "item_b", "source_cpse_a", "source_cpse_b", "confidence_score", F.col(reason).alias("reason")))
    return matches.select("ord", F.lit(None).cast("string").alias("cnmc_code"), F.lit(action).alias("action"), F.lit(actor).alias("actor"), details.alias("details"), F.lit(at).cast("timestamp_ntz").alias("timestamp"))


def enriched(matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """Matches with sources and the canonical description, which is item A's clean one; raises if an item is not known."""
    known = catalog.select("item_id", "source_cpse", "clean_description")
    out = matches.drop("source_cpse_a", "source_cpse_b", "canonical_description")
    for s in "ab":
        out = out.join(known.select(F.col("item_id").alias(f"item_{s}"), F.col("source_cpse").alias(f"source_cpse_{s}"), F.col("clean_description").alias(f"_d{s}")), f"item_{s}", "left")
    if not out.filter("source_cpse_a is null or source_cpse_b is null").isEmpty():
        raise KeyError("a match names an item that is not in the catalog")
    return out.withColumnRenamed("_da", "canonical_description").drop("_db")


def integrate(t: Tables, matches: DataFrame, catalog: DataFrame, at, dry_run: bool = False) -> tuple[Tables, DataFrame]:
    """Mints what was linked automatically and records what was blocked; gives the new tables and counts by status.

    Items are checked before anything is written.  With ``dry_run`` nothing is.
    """
    counts = matches.groupBy("status").count()
    relevant = enriched(matches.filter(F.col("status").isin("auto_linked", "safety_gate_blocked")), catalog)
    if dry_run:
        return t, counts
    t = mint(t, relevant.filter("status = 'auto_linked'"), "auto_linked", "tier2_system", at)
    return audit_only(t, relevant.filter("status = 'safety_gate_blocked'"), "safety_gate_blocked", "safety_gate", at), counts


def process(t: Tables, match: DataFrame, actor: str, at) -> Tables:
    """One batch of decided matches by their status; raises on a status that is none."""
    statuses = {r[0] for r in match.select("status").distinct().collect()}
    if statuses - {"auto_linked", "human_approved", "safety_gate_blocked"}:
        raise ValueError(f"unsupported status: {sorted(statuses)}")
    for s in ("auto_linked", "human_approved"):
        if s in statuses:
            t = mint(t, match.filter(F.col("status") == s), s, actor, at)
    return audit_only(t, match.filter("status = 'safety_gate_blocked'"), "safety_gate_blocked", actor, at) if "safety_gate_blocked" in statuses else t


def decide(t: Tables, matches: DataFrame, catalog: DataFrame, match_id: str, decision: str, reviewer: str, at, notes: str | None = None) -> Tables:
    """A reviewer's decision on one match, kept as a row.  Blocked matches cannot be approved."""
    decision = (decision or "").strip().lower()
    if decision not in ("approved", "rejected"):
        raise ValueError("a decision is approved or rejected")
    one = matches.filter(F.col("match_id") == match_id).orderBy("ord").limit(1)
    found = one.first()
    if found is None:
        raise KeyError(match_id)
    if decision == "approved" and found["status"] == "safety_gate_blocked":
        raise ValueError("a blocked match cannot be approved")
    row = t.decisions.sparkSession.createDataFrame([(match_id, decision, decision, reviewer, at, notes)], DECISIONS)
    t = replace(t, decisions=t.decisions.unionByName(row))
    full = enriched(one, catalog)
    if decision == "rejected":
        return audit_only(t, full.withColumn("_notes", F.lit(notes)), "human_rejected", reviewer, at, "_notes")
    return mint(t, full, "human_approved", reviewer, at)


def decide_all(t: Tables, matches: DataFrame, catalog: DataFrame, decisions: DataFrame, at) -> tuple[Tables, DataFrame]:
    """A table of reviewers' decisions, with the effects that ``decide`` has for one after the other in the order of time.

    ``decisions``: ``match_id, decision, reviewer_id, reviewed_at, notes``.  Ties in time go by match, decision, reviewer and
    notes; a decision without a time is taken at ``at``.  Gives the new tables, and the decisions that are refused, with their
    ``reason``: those that are neither approved nor rejected, of an unknown match, or an approval of a blocked match.  Several
    decisions on one match all count; of matches with equal ids, the first by ``ord``.  Raises if a match that is decided names
    an item that is not in the catalog.
    """
    known = matches.groupBy("match_id").agg(F.min_by(F.struct(*[c for c in matches.columns if c != "match_id"]), "ord").alias("m"))
    verdict = F.lower(F.regexp_replace(F.coalesce("decision", F.lit("")), r"^\s+|\s+$", ""))
    asked = decisions.select("match_id", verdict.alias("verdict"), "decision", "reviewer_id", F.coalesce(F.col("reviewed_at").cast("timestamp"), F.lit(at).cast("timestamp")).alias("reviewed_at"), "notes")
    reason = (
        F.when(~F.col("verdict").isin("approved", "rejected"), "a decision is approved or rejected")
        .when(F.col("m").isNull(), "match is not known")
        .when((F.col("verdict") == "approved") & (F.col("m.status") == "safety_gate_blocked"), "a blocked match cannot be approved")
    )
    judged = saved(asked.join(known, "match_id", "left").withColumn("reason", reason))
    refused = judged.filter("reason is not null").select("match_id", "decision", "reviewer_id", "reviewed_at", "notes", "reason")
    taken = numbered(judged.filter("reason is null").drop("reason").withColumn("_o", F.struct("reviewed_at", "match_id", "verdict", "reviewer_id", "notes")), 1, "_o")
    fields = ("item_a", "item_b", "source_cpse_a", "source_cpse_b", "confidence_score")
    one = taken.select(F.col("number").alias("ord"), "match_id", "verdict", "reviewer_id", "reviewed_at", "notes", *(F.col(f"m.{c}") for c in fields))
    full = saved(enriched(one, catalog))
    rows = full.select("match_id", F.col("verdict").alias("reviewer_decision"), F.col("verdict").alias("decision"), "reviewer_id", "reviewed_at", "notes")
    who, when = F.col("reviewer_id"), F.col("reviewed_at")
    t, approved = _minted(replace(t, decisions=t.decisions.unionByName(rows)), full.filter("verdict = 'approved'"), "human_approved", who, when)
    rejected = _uncoded(full.filter("verdict = 'rejected'"), "human_rejected", who, when, "notes")
    return replace(t, audit=_audited(t.audit, approved.unionByName(rejected))), refused


def batch_approve(t: Tables, matches: DataFrame, catalog: DataFrame, at, min_confidence: float = 0.70, reviewer: str = "senior_procurement_lead", compat: bool = False) -> Tables:
    """Approves every match of enough confidence that is not blocked; those a reviewer rejected only with ``compat``."""
    chosen = matches.filter((F.col("confidence_score") >= min_confidence) & (F.col("status") != "safety_gate_blocked"))
    if not compat:
        latest = t.decisions.groupBy("match_id").agg(F.max_by("decision", "reviewed_at").alias("d")).filter("d = 'rejected'")
        chosen = chosen.join(latest, "match_id", "left_anti")
    rows = chosen.select("match_id", F.lit("approved").alias("reviewer_decision"), F.lit("approved").alias("decision"), F.lit(reviewer).alias("reviewer_id"), F.lit(at).cast("timestamp").alias("reviewed_at"), F.concat(F.lit("Batch approved (Confidence "), F.col("confidence_score").cast("string"), F.lit(")")).alias("notes"))
    return mint(replace(t, decisions=t.decisions.unionByName(rows)), enriched(chosen, catalog), "human_approved", reviewer, at)


def codes_of(mapping: DataFrame) -> DataFrame:
    """``original_code, codes``: the codes that each item is mapped to, sorted."""
    return mapping.groupBy("original_code").agg(F.array_sort(F.collect_set("cnmc_code")).alias("codes"))


def shown(matches: DataFrame, status: str | None = None) -> DataFrame:
    """``status`` and ``cnmc_code`` as the review queue shows them, of matches that carry what was ``decided`` and their items'
    ``codes_a, codes_b``: so nothing is looked up for a match.  With ``status``, only those that are shown with it."""
    wanted = _wanted(status)
    # two items are linked if they share a code: their own codes are compared, not all items of each code
    linked = F.coalesce(F.arrays_overlap("codes_a", "codes_b"), F.lit(False)) & (F.col("item_a") != F.col("item_b"))
    told = F.when(F.col("decided") == "approved", "human_approved").when(F.col("decided") == "rejected", "human_rejected").when(linked, "human_approved").otherwise(F.col("status"))
    code = lambda s: F.try_element_at(f"codes_{s}", F.lit(1))
    out = _may_be_shown(matches, wanted).withColumn("cnmc_code", F.coalesce(code("a"), code("b"))).withColumn("status", told)
    return out.filter(F.col("status") == wanted) if wanted else out


def _wanted(status: str | None) -> str | None:
    return {"safety_blocked": "safety_gate_blocked"}.get(status, status) if status != "all" else None


def _may_be_shown(matches: DataFrame, wanted: str | None) -> DataFrame:
    """A match keeps the status that it came with, or is shown as a person's: the others need no lookup."""
    if not wanted or wanted in ("human_approved", "human_rejected"):
        return matches
    return matches.filter((F.col("status") == wanted) & (F.col("decided").isNull() | ~F.col("decided").isin("approved", "rejected")))


def pending(matches: DataFrame, catalog: DataFrame, mapping: DataFrame, decisions: DataFrame | None, status: str | None = None) -> DataFrame:
    """The review queue: matches with both descriptions, the code of either item and that code's mappings.

    ``status`` of a row is the reviewer's decision if there is one, else approved if both items share a code.  Without
    ``decisions`` each match has its latest one as ``decided``: so matches are not dealt by their ids.
    """
    latest = None if decisions is None else decisions.groupBy("match_id").agg(F.max_by("decision", "reviewed_at").alias("decided"))
    all_of = mapping.groupBy(F.col("cnmc_code")).agg(F.array_sort(F.collect_list(F.struct("source_cpse", "original_code"))).alias("mappings"))
    # one lookup by item: far fewer items than matches
    known = catalog.select(F.col("item_id").alias("item"), F.col("clean_description").alias("description"))
    items = small(staged(known.join(codes_of(mapping).withColumnRenamed("original_code", "item"), "item", "full")))
    out = _may_be_shown(matches if latest is None else matches.join(latest, "match_id", "left"), _wanted(status))
    for s in "ab":
        out = out.join(items.select(*(F.col(c).alias(f"{c}_{s}") for c in ("item", "description", "codes"))), f"item_{s}", "left")
    return shown(out, status).join(small(staged(all_of)), "cnmc_code", "left").drop("decided", "codes_a", "codes_b")


def violations(t: Tables) -> DataFrame:
    """Rows that break a rule: unique codes and mappings, known codes, legal actions; ``transact`` does not store such tables."""
    twice = t.registry.groupBy("cnmc_code").count().filter("count > 1").select(F.lit("code is not unique").alias("rule"), F.col("cnmc_code").alias("row"))
    double = t.mapping.groupBy("source_cpse", "original_code").count().filter("count > 1").select(F.lit("mapping is not unique").alias("rule"), F.concat_ws("/", "source_cpse", "original_code").alias("row"))
    lost = t.mapping.join(t.registry, "cnmc_code", "left_anti").select(F.lit("code is not registered").alias("rule"), F.col("cnmc_code").alias("row"))
    illegal = t.audit.filter(~F.col("action").isin(*ACTIONS)).select(F.lit("action is not legal").alias("rule"), F.col("action").alias("row"))
    return double.unionByName(twice).unionByName(lost).unionByName(illegal)


def update_description(registry: DataFrame, code: str, description: str) -> DataFrame:
    """The registry with one code's description replaced."""
    return registry.withColumn("canonical_description", F.when(F.col("cnmc_code") == code, description).otherwise(F.col("canonical_description")))

