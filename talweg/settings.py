"""Settings out of the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from talweg.operators.chunking import OVERLAP, SIZE
from talweg.operators.indexing import IndexConfig
from talweg.operators.retrieval import TOP

#: What counts as yes.
YES = ("1", "true", "si", "sí", "yes", "on")


def flag(value: str | None, otherwise: bool = False) -> bool:
    return otherwise if value is None or not value.strip() else value.strip().lower() in YES


def whole(value: str | None, otherwise: int) -> int:
    """A whole number; the alternative for anything else."""
    try:
        return int((value or "").strip())
    except ValueError:
        return otherwise


@dataclass(frozen=True)
class Settings:
    """Modes of retrieval and answering, and the configuration of the index."""

    mode: str = "hybrid"
    backend: str = "auto"
    rerank: bool = False
    scorers: tuple[str, ...] = ()
    top: int = TOP
    rewrite: bool = True
    numbered: bool = True
    ocr: bool = False
    index: IndexConfig = IndexConfig()

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ, prefix: str = "TALWEG_") -> "Settings":
        get = lambda name: env.get(prefix + name)
        mode, backend = (get("MODE") or cls.mode).strip(), (get("BACKEND") or cls.backend).strip()
        if mode not in ("dense", "lexical", "hybrid") or backend not in ("auto", "exact", "approximate"):
            raise ValueError(f"unknown mode or backend: {mode}, {backend}")
        index = IndexConfig(embedding_model=get("EMBEDDING_MODEL") or IndexConfig.embedding_model, embedding_dim=whole(get("EMBEDDING_DIM"), IndexConfig.embedding_dim), chunk_size=whole(get("CHUNK_SIZE"), SIZE), chunk_overlap=whole(get("CHUNK_OVERLAP"), OVERLAP))
        scorers = tuple(x.strip() for x in (get("SCORERS") or "").split(",") if x.strip())
        return cls(mode, backend, flag(get("RERANK")), scorers, whole(get("TOP"), TOP), flag(get("REWRITE"), True), flag(get("NUMBERED"), True), flag(get("OCR")), index)
