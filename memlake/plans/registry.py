"""Extension points. Every entry is a Column function or a DataFrame function, never a row function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import chunking, keywords
from memlake.functions.embedding import encoder, register_encoder  # noqa: F401
from memlake.functions.paths import extension
from memlake.operators.edits import register_hook, register_mode  # noqa: F401
from memlake.operators.index import register_existence  # noqa: F401

Chunker = Callable[[Column, int, float], Column]
Extractor = Callable[[Column, Column], Column]

CHUNKERS: dict[str, Chunker] = {".md": chunking.header_chunks}
EXTRACTORS: dict[str, Extractor] = {"identifiers": keywords.extract_keywords}
ACTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_chunker(ext: str, chunker: Chunker) -> None:
    """Chunk documents with this extension by another Column function."""
    CHUNKERS[ext.lower()] = chunker


def register_extractor(name: str, extractor: Extractor) -> None:
    EXTRACTORS[name] = extractor


def register_action(name: str, action: Callable[[DataFrame], DataFrame]) -> None:
    """Handle manifest steps of another action: steps in, steps with a ``text`` column out."""
    ACTIONS[name] = action


def chunk_column(path: Column, text: Column, max_chars: int, overlap: float) -> Column:
    """Chunks of a text by the chunker of its extension; sliding windows for all others."""
    out = chunking.overlap_chunks(text, max_chars, overlap)
    ext = extension(path)
    for suffix, chunker in CHUNKERS.items():
        out = F.when(ext == suffix, chunker(text, max_chars, overlap)).otherwise(out)
    return out
