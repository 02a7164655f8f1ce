"""Operators for preparing training corpora. Nothing else in talweg imports this subpackage."""
