"""The whole plan: parsed documents to blocks, sections, nodes and chunks, each a lazy table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from docloom.operators import blocks, chunk, enrich, structure
from docloom.sources import extract


@dataclass
class Documents:
    """Tables of a batch. All order-dependent steps share one partitioning by doc_id."""

    parsed: DataFrame

    @classmethod
    def from_files(cls, files: DataFrame) -> Documents:
        return cls(extract.extract_files(files))

    @classmethod
    def from_texts(cls, texts: DataFrame, mime: str = "text/plain", path: str = "", closed_references: bool = False) -> Documents:
        return cls(extract.extract_texts(texts, mime, path, closed_references))

    @cached_property
    def raw(self) -> DataFrame:
        return extract.raw_blocks(self.parsed)

    @cached_property
    def blocks(self) -> DataFrame:
        return blocks.canonical_blocks(self.raw)

    @cached_property
    def sections(self) -> DataFrame:
        return structure.with_sections(self.blocks)

    @cached_property
    def nodes(self) -> DataFrame:
        return structure.nodes(self.sections)

    @cached_property
    def placed(self) -> DataFrame:
        """Sections, which carry their heading paths."""
        return self.sections

    @cached_property
    def described(self) -> DataFrame:
        """Sections with `about` on each document's last one, from one parse; see extract.described_blocks."""
        return structure.with_sections(blocks.canonical_blocks(extract.described_blocks(enrich.described(self.parsed))))

    @cached_property
    def statistics(self) -> DataFrame:
        return enrich.statistics(self.blocks)

    @cached_property
    def metadata(self) -> DataFrame:
        return enrich.metadata(self.parsed, enrich.document_dates(self.blocks))

    def chunks(self, max_tokens: int = chunk.MAX_TOKENS, overlap: int = chunk.OVERLAP) -> DataFrame:
        return chunk.chunks(self.placed, max_tokens, overlap)
