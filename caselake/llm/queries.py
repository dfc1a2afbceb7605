"""The corpus operators' queries and their SQL."""

from . import bpe, dac, itq, jaccard, langid, license, media, merkle, mixing, sarray, secrets, trie, urlrules

_MODULES = (langid, itq, sarray, license, dac, media, bpe, urlrules, jaccard, mixing, trie, merkle, secrets)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
