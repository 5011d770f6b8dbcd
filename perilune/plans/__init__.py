"""Whole queries: the operators applied to the driver's tables, each beside the SQL that it must agree with."""
