"""All registered queries and their SQL, whichever module holds them."""

from . import charges, frames, meshes, more, queries  # noqa: F401  each adds its queries to the same tables

QUERIES = queries.QUERIES
ORACLES = queries.ORACLES
