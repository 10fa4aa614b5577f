"""All registered queries and their SQL twins."""

from asofspark.catalog import features, ledgers, models, prices, sequences, stores, streams, wide

_MODULES = (features, prices, sequences, models, ledgers, streams, stores, wide)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
