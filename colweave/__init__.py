"""Feature-graph analytics for grouped tables, expressed as Spark jobs.

A *station* is a group of rows (a directory of files, or a key column).  Every
operator takes and returns DataFrames that carry the ``station`` column, so all
stations are worked on in one plan.
"""

from colweave.config import Settings

__all__ = ["Settings"]
