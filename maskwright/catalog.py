"""All queries of the library, and the SQL that gives the same rows."""

from __future__ import annotations

from maskwright.plans import act, detect, measure, parts, screen, stream, whole

QUERIES = detect.QUERIES | screen.QUERIES | act.QUERIES | measure.QUERIES | whole.QUERIES | stream.QUERIES | parts.QUERIES
ORACLE_SQL = detect.ORACLE | screen.ORACLE | act.ORACLE | measure.ORACLE | whole.ORACLE | stream.ORACLE | parts.ORACLE
