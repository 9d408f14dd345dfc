"""Change detection over a sequence of captures per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens.operators.diffing import diff_snapshots
from tarifflens.operators.history import changed_only, day_slice

SNAPSHOT_FIELDS = ["company_id", "snapshot_id", "captured_at", "content_hash", "payload", "is_verified"]


def detect_changes(
    extracted: DataFrame, known: DataFrame | None = None, slice_by: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """New snapshots and diffs from ok captures in time order.

    ``extracted``: output of ``extract_pricing`` with ``company_id, snapshot_id, captured_at``.
    ``known``: the newest snapshot per company from earlier runs.  A capture with the hash of the
    one before makes no snapshot; every other one does and is compared with its predecessor.
    """
    times = day_slice("captured_at") if slice_by is None else slice_by
    fresh = extracted.where(F.col("status") == "ok").select(*SNAPSHOT_FIELDS, F.lit(True).alias("_new"))
    rows = fresh if known is None else fresh.unionByName(known.select(*SNAPSHOT_FIELDS, F.lit(False).alias("_new")))
    # Hashes decide; payloads only travel with the rows that stay.
    gated = changed_only(
        rows.select("company_id", "snapshot_id", "captured_at", "content_hash", "_new"),
        ["company_id"], ["captured_at", "snapshot_id"], "content_hash", times,
    ).where(F.col("changed") | ~F.col("_new"))
    kept = rows.drop("_new", "content_hash", "captured_at").join(
        gated.select("company_id", "snapshot_id", "captured_at", "content_hash", "_new"), ["company_id", "snapshot_id"]
    )
    diffs = diff_snapshots(kept, slice_by=times)
    if known is not None:
        # Only the newest known snapshot per company takes part, so it never is a current one.
        diffs = diffs.join(known.select(F.col("snapshot_id").alias("current_snapshot_id")), "current_snapshot_id", "left_anti")
    return kept.where("_new").select(*SNAPSHOT_FIELDS), diffs
