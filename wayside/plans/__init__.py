"""Whole queries built from the operators: reporting views, dashboards, the daily run."""
