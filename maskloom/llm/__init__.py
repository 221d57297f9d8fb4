"""Operators for training-data pipelines, one module per operator.

`queries` binds them to the test tables; nothing outside this package imports it."""
