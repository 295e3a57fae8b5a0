"""Operators for preparing text collections; nothing outside this subpackage imports it."""
