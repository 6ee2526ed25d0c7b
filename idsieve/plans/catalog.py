"""All queries by name, and the SQL for each that SQL can express.

The driver's tables hold no identity documents, so each query builds its input from them: orders stand for
screenings, customers for documents and their holders, events for audit and ledger events, words of texts for
recognised words. Every query runs over its whole tables.
"""

from __future__ import annotations

from idsieve.plans import files, identity, imaging, integrity, layout, relational  # noqa: F401
from idsieve.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
