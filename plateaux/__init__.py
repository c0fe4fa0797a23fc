"""Analytics over large tables of per-cell feature profiles, as Spark DataFrame jobs."""
