"""All registered queries of the training-data operators and the SQL of those that have one."""

from __future__ import annotations

from cinetable.llm import queries_sequence as _sequence
from cinetable.llm import queries_text as _text

QUERIES = _sequence.QUERIES | _text.QUERIES
SQL = _sequence.SQL | _text.SQL
