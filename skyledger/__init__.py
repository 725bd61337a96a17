"""skyledger: a Spark-native asset-inventory engine.

Provider responses become typed asset tables, each collection is merged into a
current-state snapshot (first seen, last seen, active/removed), and the
inventory is queried through filtered, searched, sorted and paged views,
unified removed-asset and search results, a collector run log, and exports.
Every job is a DataFrame plan; nothing passes through the driver.
"""

from skyledger.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
