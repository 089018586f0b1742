"""Archive, replay, position translation and audit of partitioned event logs on Spark."""

from logharbor.plans.jobs import (
    archive_log,
    plan_restore,
    restore_log,
    snapshot_groups,
    translate_groups,
)

__all__ = [
    "archive_log",
    "plan_restore",
    "restore_log",
    "snapshot_groups",
    "translate_groups",
]
