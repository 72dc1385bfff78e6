"""Lifecycle and control gates: sign-off gate/sync/propagate/summary, approval
decisions, state transitions, queue eligibility, reaping, milestones, access.

All rules are joins against small aggregated state tables plus ordered ``when``
chains — no per-row driver logic.  ``now`` is always a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restate.operators.match import DIM_BROADCAST_ROWS, sized_broadcast
from restate.spec import SIGNOFF_ALL_ENTITIES, STAGE_RETENTION_DAYS, STALE_RUNNING_MINUTES

# Sign-off states that block restatements.
SIGNOFF_BLOCKING = ("SIGNED_OFF", "REOPEN_REQUESTED", "SIGNOFF_REQUESTED")
SIGNOFF_PENDING = ("SIGNOFF_REQUESTED", "REOPEN_REQUESTED")
# Older state machine (status -> allowed next statuses).
VALID_TRANSITIONS = {
    "DRAFT": ["PENDING_APPROVAL"],
    "PENDING_APPROVAL": ["APPROVED", "REJECTED"],
    "APPROVED": ["APPLIED"],
    "APPLIED": ["REVERSED"],
    "REJECTED": [],
    "REVERSED": [],
}


def _u(c) -> Column:
    return F.upper(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))


def signoff_verdicts(status: DataFrame, cob="cobid", scope="process_type", entity="entity_code",
                     state="sign_off_status") -> DataFrame:
    """Per (cob, scope, ENTITY|'*'): blocked=True / open=False / undecided=NULL.

    Any blocking sub-type row blocks the entity; REOPENED opens it only when
    nothing is blocked.
    """
    s = status.select(F.col(cob).alias("cobid"), _u(scope).alias("scope"),
                      F.coalesce(_u(entity), F.lit(SIGNOFF_ALL_ENTITIES)).alias("entity"), _u(state).alias("st"))
    agg = s.groupBy("cobid", "scope", "entity").agg(
        F.max(F.col("st").isin(*SIGNOFF_BLOCKING).cast("int")).alias("_b"),
        F.max((F.col("st") == "REOPENED").cast("int")).alias("_r"))
    return agg.select("cobid", "scope", "entity",
                      F.when(F.col("_b") == 1, F.lit(True)).when(F.col("_r") == 1, F.lit(False)).alias("verdict"))


def signoff_gate(requests: DataFrame, status: DataFrame, feed: DataFrame, cob="cobid", scope="process_type",
                 entity="entity_code", out_col="signoff_blocked") -> DataFrame:
    """Blocked-by-sign-off flag for each request.

    Entity request: entity verdict, else the '*' verdict, else the upstream feed
    (SIGNEDOFF for that entity, unless an app REOPENED row for it or '*').
    Broad request (no entity): blocked by ANY blocking row, else by any feed sign-off.
    """
    v = signoff_verdicts(status)
    ent_v = v.where(F.col("entity") != SIGNOFF_ALL_ENTITIES).select(
        F.col("cobid").alias("_ec"), F.col("scope").alias("_es"), F.col("entity").alias("_ee"),
        F.col("verdict").alias("_ev"))
    star_v = v.where(F.col("entity") == SIGNOFF_ALL_ENTITIES).select(
        F.col("cobid").alias("_sc"), F.col("scope").alias("_ss"), F.col("verdict").alias("_sv"))
    any_b = v.groupBy(F.col("cobid").alias("_ac"), F.col("scope").alias("_as")).agg(
        F.max(F.coalesce(F.col("verdict"), F.lit(False)).cast("int")).alias("_ab"))
    reopened = status.where(_u("sign_off_status") == "REOPENED").select(
        F.col("cobid").alias("_rc"), _u("process_type").alias("_rs"), _u("entity_code").alias("_re"))
    f = feed.where(_u("publish_status") == "SIGNEDOFF").select(
        F.col("cobid").alias("fc"), _u("process_type").alias("fs"), _u("entity_code").alias("fe"))
    f = f.join(reopened, (F.col("fc") == F.col("_rc")) & (F.col("fs") == F.col("_rs"))
               & (F.col("fe") == F.col("_re")), "left_anti")
    f = f.join(reopened.where(F.col("_re") == SIGNOFF_ALL_ENTITIES).select("_rc", "_rs").distinct(),
               (F.col("fc") == F.col("_rc")) & (F.col("fs") == F.col("_rs")), "left_anti")
    feed_ent = f.select(F.col("fc").alias("_fc"), F.col("fs").alias("_fs"), F.col("fe").alias("_fe")).distinct() \
        .withColumn("_fhit", F.lit(True))
    feed_any = f.select(F.col("fc").alias("_gc"), F.col("fs").alias("_gs")).distinct().withColumn("_ghit", F.lit(True))

    r = requests.withColumn("_rcob", F.col(cob)).withColumn("_rscope", _u(scope)).withColumn("_rent", _u(entity))
    r = r.join(ent_v, (F.col("_rcob") == F.col("_ec")) & (F.col("_rscope") == F.col("_es"))
               & (F.col("_rent") == F.col("_ee")), "left")
    r = r.join(star_v, (F.col("_rcob") == F.col("_sc")) & (F.col("_rscope") == F.col("_ss")), "left")
    r = r.join(any_b, (F.col("_rcob") == F.col("_ac")) & (F.col("_rscope") == F.col("_as")), "left")
    r = r.join(feed_ent, (F.col("_rcob") == F.col("_fc")) & (F.col("_rscope") == F.col("_fs"))
               & (F.col("_rent") == F.col("_fe")), "left")
    r = r.join(feed_any, (F.col("_rcob") == F.col("_gc")) & (F.col("_rscope") == F.col("_gs")), "left")
    blocked = F.when(F.col("_rent").isNotNull(),
                     F.coalesce(F.col("_ev"), F.col("_sv"), F.col("_fhit"), F.lit(False))) \
        .otherwise((F.coalesce(F.col("_ab"), F.lit(0)) == 1) | F.coalesce(F.col("_ghit"), F.lit(False)))
    return r.select(*requests.columns, blocked.alias(out_col))


def signoff_sync(feed: DataFrame, status: DataFrame) -> DataFrame:
    """Feed -> status: insert OPEN rows for unseen (cob, scope, entity); flip OPEN ->
    SIGNED_OFF where the feed says SIGNEDOFF; leave app-governed rows untouched.

    Returns the new status rows with an ``action`` column (INSERT/FLIP/KEEP).
    """
    keys = ["cobid", "process_type", "entity_code"]
    fk = feed.select(*[F.col(k).alias(f"_f_{k}") for k in keys], F.col("publish_status").alias("_fp"))
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_f_{k}") for k in keys])
    j = status.join(fk, cond, "left")
    flip = (F.upper(F.col("sign_off_status")) == "OPEN") & (F.upper(F.col("_fp")) == "SIGNEDOFF")
    kept = j.select(*keys, "sub_type",
                    F.when(flip, F.lit("SIGNED_OFF")).otherwise(F.col("sign_off_status")).alias("sign_off_status"),
                    F.when(flip, F.lit("FLIP")).otherwise(F.lit("KEEP")).alias("action"))
    present = status.select(*[F.col(k).alias(f"_s_{k}") for k in keys]).distinct()
    new = feed.join(present, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_s_{k}") for k in keys]), "left_anti")
    ins = new.select(*keys, F.lit("ALL").alias("sub_type"),
                     F.when(F.upper("publish_status") == "SIGNEDOFF", "SIGNED_OFF").otherwise("OPEN").alias("sign_off_status"),
                     F.lit("INSERT").alias("action"))
    return kept.unionByName(ins)


def signoff_propagate(events: DataFrame, feed: DataFrame, native_scopes) -> DataFrame:
    """Push applied sign-off changes back to the feed: update-or-insert for native
    scopes, update-only otherwise.  Returns the new feed with ``action``."""
    keys = ["cobid", "process_type", "entity_code"]
    ev = events.select(*keys, F.when(F.col("new_status") == "SIGNED_OFF", "SIGNEDOFF")
                       .otherwise(F.col("new_status")).alias("_np"))
    ek = ev.select(*[F.col(k).alias(f"_e_{k}") for k in keys], "_np")
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_e_{k}") for k in keys])
    upd = feed.join(ek, cond, "left").select(
        *keys, F.coalesce(F.col("_np"), F.col("publish_status")).alias("publish_status"),
        F.when(F.col("_np").isNotNull(), "UPDATE").otherwise("KEEP").alias("action"))
    fkeys = feed.select(*[F.col(k).alias(f"_f_{k}") for k in keys])
    ins = ev.where(F.col("process_type").isin(*native_scopes)).join(
        fkeys, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_f_{k}") for k in keys]), "left_anti") \
        .select(*keys, F.col("_np").alias("publish_status"), F.lit("INSERT").alias("action"))
    return upd.unionByName(ins)


def signoff_summary(status: DataFrame, group=("cobid", "process_type")) -> DataFrame:
    """One effective label per (cob, scope) from its entity rows."""
    st = _u("sign_off_status")
    g = status.groupBy(*group).agg(
        F.min(F.when(st.isin(*SIGNOFF_PENDING), F.struct(F.col("entity_code"), st.alias("s")))).alias("_p"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(st.isin(*SIGNOFF_BLOCKING).cast("int")).alias("n_blocked"),
        F.sum((st == "SIGNED_OFF").cast("int")).alias("n_signed"),
        F.sum((st == "REOPENED").cast("int")).alias("n_reopened"))
    label = (F.when(F.col("_p").isNotNull(),
                    F.when(F.col("_p.s") == "SIGNOFF_REQUESTED", "SIGN-OFF PENDING").otherwise("RE-OPEN PENDING"))
             .when(F.col("n_blocked") == F.col("n_rows"), "SIGNED OFF")
             .when(F.col("n_signed") > 0, "PARTIALLY SIGNED OFF")
             .when(F.col("n_reopened") > 0, "RE-OPENED")
             .otherwise("OPEN"))
    sub = (F.when(F.col("n_blocked") == F.col("n_rows"), "Blocked")
           .when(F.col("n_blocked") > 0, F.format_string("Blocked for %d/%d entities", F.col("n_blocked"), F.col("n_rows")))
           .otherwise("Allowed"))
    return g.select(*group, label.alias("effective_status"), sub.alias("submissions"), "n_rows", "n_blocked")


def worst_status(status: DataFrame, keys, state="sign_off_status", ranks: dict | None = None) -> DataFrame:
    """Worst status per key across sub-types (``max_by`` on a fixed rank)."""
    ranks = ranks or {"SIGNED_OFF": 4, "SIGNOFF_REQUESTED": 3, "REOPEN_REQUESTED": 2, "REOPENED": 1, "OPEN": 0}
    m = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    r = F.coalesce(m[_u(state)], F.lit(-1))
    return status.groupBy(*keys).agg(F.max_by(_u(state), F.struct(r, _u(state))).alias("worst_status"))


def decide(headers: DataFrame, decisions: DataFrame, approvers: DataFrame, id_col="adj_key",
           status_col="run_status", submitter_col="username", scope_col="process_type") -> DataFrame:
    """Bulk approve/reject with four-eyes rules; one outcome (or refusal reason) per decision."""
    h = headers.select(F.col(id_col).alias("_hid"), F.col(status_col).alias("_hst"),
                       F.col(submitter_col).alias("_hsub"), F.col(scope_col).alias("_hscope"))
    a = approvers.where(F.col("is_active")).select(_u("approver").alias("_ap"), _u("process_type").alias("_apscope")) \
        .distinct().withColumn("_aok", F.lit(True))
    a, _ = sized_broadcast(a, DIM_BROADCAST_ROWS)
    j = decisions.join(h, F.col(id_col) == F.col("_hid"), "left")
    j = j.join(a, (_u("approver") == F.col("_ap")) & (_u("_hscope") == F.col("_apscope")), "left")
    outcome = (F.when(F.col("_hid").isNull(), "Refused: unknown restatement")
               .when(F.col("_hst") != "Pending Approval", "Refused: not pending approval")
               .when(_u("approver") == _u("_hsub"), "Refused: approver is the submitter")
               .when(F.col("_aok").isNull(), "Refused: not an approver for this scope")
               .when(F.lower("decision") == "approve", "Approved")
               .when(F.lower("decision") == "reject", "Rejected")
               .otherwise("Refused: unknown decision"))
    return j.select(*decisions.columns, outcome.alias("outcome"))


def transition_check(transitions: DataFrame, old_col="old_status", new_col="new_status",
                     allowed: dict | None = None) -> DataFrame:
    """Flag each transition as valid against the allowed-pairs table (broadcast join)."""
    allowed = allowed or VALID_TRANSITIONS
    spark = transitions.sparkSession
    pairs = spark.createDataFrame([(a, b) for a, bs in allowed.items() for b in bs], "_o string, _n string") \
        .withColumn("_ok", F.lit(True))
    j = transitions.join(F.broadcast(pairs), (_u(old_col) == F.col("_o")) & (_u(new_col) == F.col("_n")), "left")
    return j.select(*transitions.columns, F.coalesce(F.col("_ok"), F.lit(False)).alias("is_valid"))


def eligible(headers: DataFrame, status_col="run_status", blocked_col="blocked_by_adj_id",
             deleted_col="is_deleted") -> DataFrame:
    """Pending/Approved, unblocked, not deleted."""
    return headers.where(F.col(status_col).isin("Pending", "Approved") & F.col(blocked_col).isNull()
                         & ~F.coalesce(F.col(deleted_col), F.lit(False)))


def reap_stale(headers: DataFrame, now, start_col="start_date", status_col="run_status",
               minutes: int = STALE_RUNNING_MINUTES) -> DataFrame:
    """Running longer than the threshold -> Failed (returns the reaped rows)."""
    limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    return headers.where((F.col(status_col) == "Running") & (F.col(start_col) < limit)).select(
        *[c for c in headers.columns if c != status_col], F.lit("Failed").alias(status_col))


def purge_stage(stage: DataFrame, now, created_col: str, days: int = STAGE_RETENTION_DAYS) -> DataFrame:
    """Keep stage rows newer than the retention window."""
    return stage.where(F.col(created_col) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def is_broad(entity="entity_code", book="book_code", department="department_code") -> Column:
    """Entity set but no book / department narrowing."""
    return F.col(entity).isNotNull() & F.col(book).isNull() & F.col(department).isNull()


def milestones(history: DataFrame, id_col="adj_key", status_col="new_status", at_col="changed_at",
               by_col="changed_by", stages=("Approved", "Processed", "Failed")) -> DataFrame:
    """First time and actor per milestone status (MIN_BY keeps time and actor together)."""
    aggs = []
    for s in stages:
        hit = F.col(status_col) == s
        key = s.lower().replace(" ", "_")
        aggs.append(F.min(F.when(hit, F.col(at_col))).alias(f"{key}_at"))
        aggs.append(F.min_by(F.when(hit, F.col(by_col)), F.when(hit, F.col(at_col))).alias(f"{key}_by"))
    return history.groupBy(id_col).agg(*aggs)


def lifecycle_stage(status_col="run_status") -> Column:
    from restate.spec import LIFECYCLE_STAGES
    s = F.col(status_col)
    expr = None
    for pat, label in LIFECYCLE_STAGES:
        cond = s.like(pat) if "%" in pat else (s == pat)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(s)


def row_access(df: DataFrame, grants: DataFrame, user: str, entity_col="entity_code", admin: bool = False) -> DataFrame:
    """Rows limited to entities granted to the user; admins see everything."""
    if admin:
        return df
    g = grants.where(_u("user_name") == user.upper()).select(_u("entity_code").alias("_ge")).distinct()
    return df.join(g, _u(entity_col) == F.col("_ge"), "left_semi")


def mask(df: DataFrame, col: str, privileged: bool, placeholder=None) -> DataFrame:
    """Hide a column unless the caller is privileged."""
    return df if privileged else df.withColumn(col, F.lit(placeholder).cast(df.schema[col].dataType))


def recipients(events: DataFrame, approvers: DataFrame, prefs: DataFrame) -> DataFrame:
    """Who hears about an event: active approvers of the scope with the event type
    enabled (NULL scope in prefs = all scopes), never the actor."""
    a = approvers.where(F.col("is_active")).select(F.col("approver").alias("_ap"), F.col("process_type").alias("_as"))
    p = prefs.select(F.col("user_name").alias("_pu"), F.col("event_type").alias("_pe"), F.col("process_type").alias("_ps"))
    j = events.join(a, F.col("process_type") == F.col("_as")).join(
        p, (F.col("_ap") == F.col("_pu")) & (F.col("event_type") == F.col("_pe"))
        & (F.col("_ps").isNull() | (F.col("_ps") == F.col("process_type"))))
    return j.where(F.col("_ap") != F.col("actor")).select("event_id", F.col("_ap").alias("recipient")).distinct()


def share_of_run(df: DataFrame, run_col: str, dur_col: str, out_col: str = "pct_of_run") -> DataFrame:
    """Step share of run time: round(100 * d / nullif(sum(d) over run, 0), 1)."""
    w = Window.partitionBy(run_col)
    tot = F.sum(F.coalesce(F.col(dur_col), F.lit(0))).over(w)
    return df.withColumn(out_col, F.round(F.lit(100) * F.coalesce(F.col(dur_col), F.lit(0)) / F.nullif(tot, F.lit(0)), 1))
