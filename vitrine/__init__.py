"""vitrine: gallery and exhibition analytics on Spark.

Typical use::

    from vitrine import configure, load_gallery
    from vitrine.operators import reports

    configure(spark)                      # AQE, skew joins, checkpoint folder
    g = load_gallery(spark, "/data/sf1")  # canonical tables over the source parquet
    reports.top_customers(g, 10).show()

Operators live in ``vitrine.operators`` (reports, catalogue, cart, admission,
audit, changes, display) and ``vitrine.streaming``; every one is registered
with its SQL oracle in ``vitrine.plans.registry``.
"""

from vitrine.session import configure
from vitrine.sources.adapter import load_gallery
from vitrine.sources.tables import Gallery, from_rows, read_tables, write_tables

__all__ = ["configure", "load_gallery", "Gallery", "from_rows", "read_tables", "write_tables"]
