"""The registered queries: ``queries.QUERIES`` and ``queries.ORACLE_SQL`` hold those of all modules here."""

from seamark.plans import vessel_queries  # noqa: F401  registers its queries
