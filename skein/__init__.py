"""skein: code and text graph analytics as Spark DataFrame jobs."""

from skein.session import build_session, clear_scratch, cut, fits_broadcast, shared_folder

__all__ = ["build_session", "clear_scratch", "cut", "fits_broadcast", "shared_folder"]
