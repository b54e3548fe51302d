"""Operators for preparing large collections of training data. Nothing else in the package imports this one."""
