"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from . import compaction, decontaminate, language_id, mixture_pack, neardup, quality, secrets, token_pack, toxicity, warc

_MODULES = [language_id, neardup, decontaminate, compaction, quality, secrets, toxicity, token_pack, mixture_pack, warc]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in getattr(m, "ORACLES", {}).items()}
