"""Settings of the retrieval pipeline, with overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    data_dir: str = "data/raw"
    index_dir: str = "data/index"
    embed_dir: str = "models"
    log_dir: str = "logs"
    chunking_strategy: str = "simple"
    chunk_size: int = 512
    chunk_overlap: int = 64
    embedding_model: str = "hash"
    embedding_device: str = "cpu"
    normalize_embeddings: bool = True
    hnsw_ef_construction: int = 100
    hnsw_ef_search: int = 100
    hnsw_max_neighbors: int = 16
    top_k: int = 5
    metadata_filter: bool = False
    metadata_enhancement: bool = False
    post_bm25_rerank: bool = False
    similarity_threshold: float = 3.0
    llm_host: str = "http://localhost"
    llm_model: str = "stub"
    temperature: float = 0.0
    max_tokens: int = 512
    log_level: str = "INFO"


#: Keys whose variable isn't the upper-case key.
_VARIABLES = {"metadata_enhancement": "METADATA_ENHACEMENT", "llm_model": "OLLAMA_MODEL"}


def override(value: str | None, default, placeholder: str = ""):
    """default for unset, empty and placeholder values; else value in the type of default. Unknown words are true."""
    if not value or value == placeholder:
        return default
    if isinstance(default, bool):
        return value.strip().lower() not in ("false", "f", "no", "n")
    return type(default)(value)


def load(environ: Mapping[str, str] | None = None, base: Config | None = None) -> Config:
    env, base = os.environ if environ is None else environ, base or Config()
    found = {}
    for f in fields(base):
        name = _VARIABLES.get(f.name, f.name.upper())
        found[f.name] = override(env.get(name), getattr(base, f.name), f"__GMT_VAR_{name}__")
    return replace(base, **found)
