"""Queries over the given tables; importing a module registers its queries."""

from workload import modelling, reporting, searching, streams, understanding

MODULES = [reporting, understanding, modelling, searching, streams]
