"""The queries of this subpackage and their SQL."""

from seqloom.llm import bpe, html, langid, lmscore, mixing, neardup, quality, secrets, suffixdedup, topk

_MODULES = (mixing, bpe, secrets, suffixdedup, html, lmscore, neardup, langid, quality, topk)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: f for m in _MODULES for k, f in m.ORACLE.items()}
