"""Constants that define what the operators compute, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Defaults of the engine; pass a changed copy to an operator to compute something else."""

    similarity_floor: float = 0.5
    suggestion_limit: int = 3
    relation_top_k: int = 20
    alias_threshold: float = 0.95
    paragraph_min_chars: int = 100
    paragraph_max_chars: int = 1500
    footnote_max_chars: int = 240
    footnote_min_y: float = 0.88
    footnote_max_height: float = 0.02
    footnote_max_width: float = 0.5
    min_coverage: float = 0.9
    table_min_quality: float = 0.7
    cell_limit: int = 32_767
    sheet_rows: int = 1_048_576
    download_max_mb: int = 50
    as_of_year: int = 2024
    default_section: str = "본문"
    licenses: tuple[str, ...] = ("cc-by", "cc-by-sa", "cc0")
    categories: tuple[str, ...] = field(default=("title", "author", "abstract", "section_header", "text", "table", "table_caption", "figure", "figure_caption", "formula", "reference", "header_footer"))


DEFAULTS = Settings()
