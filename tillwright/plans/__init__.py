"""The reports, declared over a source of sales lines.

Each plan takes a source with ``lines(*roles, rows=...)`` and names the roles it needs, so nothing
else is read or joined. Audits take ``raw(*roles)`` and ``raw_parts()`` instead.
"""
