"""eventboard: dated-event boards from page snapshots, feeds and status documents, on Spark."""

from eventboard.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
