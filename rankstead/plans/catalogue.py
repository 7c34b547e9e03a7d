"""All queries outside the optional subpackage."""

from rankstead.plans import dealt, evaluation, flow, selections, sequences

_PLANS = (dealt, evaluation, sequences, selections, flow)
QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PLANS for k, s in p.SQL.items()}
