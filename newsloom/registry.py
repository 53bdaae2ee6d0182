"""Every query of the core by name, and its SQL where SQL can say it."""

from newsloom.plans import market, problems

QUERIES = {**market.QUERIES, **problems.QUERIES}
ORACLES = {**market.ORACLES, **problems.ORACLES}
