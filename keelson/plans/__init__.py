"""Query plans over the test tables: stand-in datasets, the query catalog and
the end-to-end pipelines."""
