"""Every core query by name, and its SQL."""

from __future__ import annotations

from . import checked, evaluation, relational, textual

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (relational, textual, checked, evaluation):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
