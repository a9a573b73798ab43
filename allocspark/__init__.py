"""Analytics over emergency-allocation records, and operations on text corpora, as Spark jobs."""
