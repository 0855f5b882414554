"""fieldframe: particle, field, image-cube and run-log analytics as Spark DataFrames.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is executed until the caller runs an action, except where a
docstring says that a bounded number of scalars is fetched first.
"""

from fieldframe.session import configure, scratch_dir

__all__ = ["configure", "scratch_dir"]
