"""Whole queries: the page-view set, data preparation, reports, and their registration."""
