"""shelfwise: product-catalogue analytics as Spark DataFrame plans.

Every analysis is a pure ``DataFrame -> DataFrame`` function built from
Spark built-in expressions, so Catalyst plans it and the executors run it.
Sub-packages:

* ``sources``   - readers for the raw, text-typed catalogue (CSV / Parquet) and
                  the catalogue derived from the TPC-H style fixture tables.
* ``functions`` - column-level parsing, validity profiles, labelling, formatting.
* ``operators`` - scale-safe relational building blocks (distributed per-group
                  row numbers and NTILE, top-k, shares, metric lists, ...).
* ``plans``     - the analyses themselves (exploration, advanced analytics,
                  KPI dashboard, feature pipeline, dashboard data sets, MLlib).
* ``streaming`` - the file-stream form of the catalogue loader.
"""

__version__ = "0.1.0"
