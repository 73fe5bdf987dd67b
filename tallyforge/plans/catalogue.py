"""Every query of the library, but for the training-data operators."""

from tallyforge.plans import evaluation, governance, registry, stores

#: The modules add their queries as they are imported.
MODULES = [registry, governance, evaluation, stores]
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
