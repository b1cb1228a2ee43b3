"""Registered queries over the shared tables, each with the DuckDB text that says the same."""


def registered() -> tuple[dict, dict]:
    """Queries by name and their SQL."""
    from stintlab.plans import across, circuits, closing, day_rows, inputs, laps_along, lines, profiles, recordings, references, replaced, seasons, skills  # noqa: F401
    from stintlab.plans.registry import QUERIES, SQL

    return QUERIES, SQL
