"""Training-data operators: one module per operator, each with its `opN_` query.

Nothing else in the package imports this subpackage.
"""
