"""lintlake: rule scans over file corpora and analytics over their findings, on Spark."""

from lintlake.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
