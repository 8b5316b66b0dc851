"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, chat, decontaminate, lines, quality, secrets, simhash, toxicity, warc, wavelet

MODULES = (simhash, wavelet, warc, quality, decontaminate, toxicity, chat, lines, bpe, secrets)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
