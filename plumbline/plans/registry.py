"""All queries of the library and their SQL twins."""

from __future__ import annotations

from plumbline.plans import graphs, kernels, rasters

QUERIES: dict = rasters.QUERIES | graphs.QUERIES | kernels.QUERIES
SQL: dict[str, str] = rasters.SQL | graphs.SQL | kernels.SQL
