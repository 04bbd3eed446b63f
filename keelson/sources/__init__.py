"""Scans and sinks: typed CSV, labelled images, weight tables, synthetic rows."""
