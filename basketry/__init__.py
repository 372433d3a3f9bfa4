"""basketry: set-based asset-allocation analytics on Spark DataFrames.

Every operator takes whole tables (a ``scenarios`` table, a long
``portfolios`` or ``population`` table, the ``features`` panel) and returns
a DataFrame.  Nothing loops over symbols, portfolios or individuals on the
driver; the only driver loop is the generation counter of the search.
"""

from basketry.session import build_session, checkpoint_dir, scratch_path

__all__ = ["build_session", "checkpoint_dir", "scratch_path"]
