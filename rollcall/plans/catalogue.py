"""Every query of the engine and its SQL."""

from . import continuity, credits, names, parsing, project

_PLANS = (continuity, names, parsing, credits, project)
QUERIES = {name: f for p in _PLANS for name, f in p.QUERIES.items()}
SQL = {name: text for p in _PLANS for name, text in p.SQL.items()}
