"""Whole runs, put together from the operators."""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockledger.operators.admission import RestorePolls
from blockledger.operators.aggregates import dedupe
from blockledger.operators.assign import attach_replicas, pick_replica
from blockledger.operators.filters import backup_eligible, drop_ignored, unbackable
from blockledger.operators.joins import small_side
from blockledger.operators.metrics import gc_totals
from blockledger.operators.payload import apply_deletes, backup_payload, restore_payload
from blockledger.operators.ranking import assign_batches
from blockledger.operators.reconcile import gc, pool_actions, reconcile
from blockledger.operators.restore import restore_candidates
from blockledger.operators.validate import mark_validated, to_validate
from blockledger.schema import BACKUP_BATCH, DELETE_BATCH, KEY, RESTORE_CAPACITY, RESTORE_POLL, RESTORE_TTL
from blockledger.session import checkpoint_dir, materialize
from blockledger.sources.inventory import live_blocks, with_snapshots
from blockledger.sources.reports import action_events, framing_events, listing_events


@dataclass
class BlockCheck:
    plan: DataFrame  # every action with its batch and chosen replica
    unbackable: DataFrame
    report: DataFrame


def block_check(
    files, snapshots, ignore, store, *, batch_size=BACKUP_BATCH, run_id="run", ts="1970-01-01", debug=False, seed=0
) -> BlockCheck:
    """Full audit: list, filter, compare, batch, choose replicas, report.

    The namespace is read, filtered and flattened once, into a table of its blocks of which each later step reads the
    columns it needs. The actions are written out once as well. They are few against the inventories, several steps
    read them, and a delete must not be decided a second time when a task is run again.
    """
    listed = with_snapshots(live_blocks(drop_ignored(files, ignore)), drop_ignored(snapshots, ignore))
    live = materialize(listed.select(*KEY, "replicas"))
    compared = reconcile(live, store, unknown_only=True)
    actions = materialize(compared.filter(F.col("action") != "in_sync"))
    batches = assign_batches(actions, batch_size)
    backups = batches.filter(F.col("action") == "backup")
    wanted = small_side(actions.filter(F.col("action") == "backup").select(*KEY))
    holders = dedupe(live.join(wanted, KEY, "left_semi"))
    placed = pick_replica(attach_replicas(backups, holders), seed)
    plan = placed.unionByName(batches.filter(F.col("action") != "backup"), allowMissingColumns=True)
    events = (
        framing_events(pool_actions(live, store), run_id, ts)
        .unionByName(action_events(batches, run_id, ts, debug))
        .unionByName(listing_events(live.select(*KEY), run_id, ts, "statusExtendedBlocksFromNameNode", debug))
        .unionByName(listing_events(store, run_id, ts, "statusExtendedBlocksFromBackStore", debug))
    )
    return BlockCheck(plan.drop("replicas"), unbackable(placed).select(*KEY), events)


@dataclass
class GcRun:
    deletes: DataFrame
    totals: DataFrame
    store: DataFrame  # what is left once the deletes are carried out


def gc_run(store, live, *, match_on="key", batch_size=DELETE_BATCH, errors=None) -> GcRun:
    """Garbage collection over the whole store at once, with totals. The deletes are decided once and written out."""
    deletes = materialize(gc(store, live, match_on))
    batches = assign_batches(deletes.withColumn("action", F.lit("delete")), batch_size)
    return GcRun(batches, gc_totals(store, deletes, errors), apply_deletes(store, deletes))


@dataclass
class RestoreRun:
    requests: DataFrame  # what was asked for in each poll, of which node, and whether it took the request
    copied: DataFrame | None


def restore_run(
    observed,
    store,
    present,
    nodes,
    *,
    ttl=RESTORE_TTL,
    capacity=RESTORE_CAPACITY,
    poll=RESTORE_POLL,
    busy=None,
    force=None,
    payload=None,
    seed=0,
) -> RestoreRun:
    """Plan and copy, poll by poll. `observed` has one row per sighting of a corrupt block (key, ts).

    A block that no node took is asked for again at its next sighting, one that was taken not before `ttl` has passed;
    rows of `force` (key, ts) are asked for all the same. See `operators/admission.py` for what a poll is.
    """
    nothing = observed.select(*KEY).limit(0)
    todo = restore_candidates(observed, store, present, nothing).filter(F.col("reason") == "restore")
    seen = observed.join(todo.select(*KEY), KEY, "left_semi").select(*KEY, "ts", F.lit(False).alias("force"))
    if force is not None:
        seen = seen.unionByName(force.select(*KEY, "ts", F.lit(True).alias("force")))
    folder = f"{checkpoint_dir(observed.sparkSession).rstrip('/')}/polls-{uuid.uuid4().hex}"
    polls = RestorePolls.over(nodes, folder, poll=poll, ttl=ttl, busy=busy, capacity=capacity, seed=seed)
    requests = polls.run(seen)
    copied = None
    if payload is not None:
        copied = restore_payload(requests.filter("accepted"), payload, present)
    return RestoreRun(requests, copied)


@dataclass
class NodeValidate:
    checked: DataFrame
    ledger: DataFrame
    copied: DataFrame | None  # what was copied of the eligible blocks, with the contents, when they were at hand


def node_validate(node_blocks, stored, ledger, *, payload=None, ignore_previous=False, failed=None) -> NodeValidate:
    """Check the finalized blocks of all nodes, copy what is missing, and mark what needs no further look.

    That is what the store has, what may not be copied, and copies of `payload` that came out right. An eligible block
    without such a copy, and one whose check `failed`, is looked at again in the next run.
    """
    todo = to_validate(node_blocks, ledger, ignore_previous)
    facts = node_blocks.groupBy(*KEY).agg(
        F.bool_or("is_valid").alias("is_valid"), F.bool_and("is_symlink").alias("is_symlink")
    )
    checked = backup_eligible(facts.join(todo, KEY, "left_semi"), stored)
    done, copied = checked.filter(F.col("reason") != "eligible").select(*KEY), None
    if payload is not None:
        copied = materialize(backup_payload(checked.filter(F.col("reason") == "eligible"), payload))
        done = done.unionByName(copied.filter(F.col("status") == "ok").select(*KEY))
    if failed is not None:
        done = done.join(failed.select(*KEY), KEY, "left_anti")
    return NodeValidate(checked, mark_validated(ledger, done), copied)


@dataclass
class Converged:
    store: DataFrame  # after deletes and backups were carried out
    audit: DataFrame  # what a second comparison says of it
    copied: DataFrame | None


def converge(live, store, *, payload=None) -> Converged:
    """Carry the plan out and compare again: garbage is gone, backups are there, lost pools are kept.

    With `payload` only blocks whose contents could be copied count as backed up; the audit names the others again.
    The plan is decided once and written out before anything is done about it.
    """
    plan = materialize(reconcile(live, store).filter(F.col("action") != "in_sync"))
    left = apply_deletes(store.select(*KEY), plan.filter(F.startswith("action", F.lit("delete"))))
    backups, copied = plan.filter(F.col("action") == "backup").select(*KEY), None
    if payload is not None:
        copied = materialize(backup_payload(backups, payload))
        backups = copied.filter(F.col("status") == "ok").select(*KEY)
    after = materialize(left.unionByName(backups))
    return Converged(after, reconcile(live, after), copied)
