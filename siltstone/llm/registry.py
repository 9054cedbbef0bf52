"""All registered queries of the subpackage."""

from . import bytebpe, decontaminate, langid, preferences, quality, repeats, rollups, setjoin, sharding, simhash, suffixtree, turnrepair, veccodes

MODULES = [suffixtree, decontaminate, repeats, rollups, bytebpe, sharding, setjoin, preferences, quality, langid, veccodes, simhash, turnrepair]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
