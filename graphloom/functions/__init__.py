"""Scalar functions on terms, IRIs, dates and JSON, as functions from columns to columns."""
