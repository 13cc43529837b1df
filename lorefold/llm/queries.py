"""The registered queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_warc_revisits": "warc", "op2_language_id": "language_id", "op3_sharding": "sharding", "op4_embedding_dedup": "embedding_dedup", "op5_ngram_join": "ngram_join",
    "op6_mixing": "mixing", "op7_license_scan": "license_scan", "op8_line_dedup": "line_dedup", "op9_decontamination": "decontamination", "op10_toxicity": "toxicity",
    "op11_bpe_codec": "bpe", "op12_merkle_manifest": "merkle", "op13_collocations": "collocations",
}
_LOADED = {name: import_module(f"{__package__}.{module}") for name, module in _MODULES.items()}
QUERIES = {name: getattr(module, name) for name, module in _LOADED.items()}
SQL = {name: sql for module in _LOADED.values() for name, sql in module.SQL.items()}
