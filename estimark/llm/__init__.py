"""Training-data operators: each module holds one operator and works on any table of its schema.

Nothing else in the library imports this subpackage; ``queries`` registers
the driver's ``opN_*`` queries.
"""
