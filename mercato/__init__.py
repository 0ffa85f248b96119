"""mercato: commerce-operations analytics on Spark.

Read questions (catalogues, order histories, request boards, dashboards,
per-user feeds) and write rules (validation, pricing, upserts, patches,
status transitions, cascading deletes, notification fan-out) expressed as
DataFrame jobs over whole tables, plus Structured Streaming versions of the
stateful rules.
"""

from mercato.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
