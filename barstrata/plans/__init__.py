"""Named queries over the driver's tables and their DuckDB SQL."""

from . import auditions, catalog, context, decisions, evidence, exits, grades, live, market, patterns, records, setups, universe, upkeep, venues  # noqa: F401
