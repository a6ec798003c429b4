"""Compositions of operators: the batch run and the registered queries."""
