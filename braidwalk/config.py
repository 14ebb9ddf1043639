"""Parameters of the anchor operators, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    anchor_length: int = 16
    nodes_in_anchor: int = 2
    gaf_fields: int = 16
    map_quality: int = 1
    cs_length: int = 6
    anchor_reads: int = 2  # more than
    merge_reads: tuple[int, int] = (9, 3)  # more than, by round
    read_floor: int = 9
    independent_reads: int = 3
    drop_fraction: float = 0.1
    linkage: int = 3
    add_back_hom: bool = True
    reliable_fraction: float = 0.1  # more than
    partition_tolerance: int = 0
    reference_name: str = "chm13"
    dust_window: int = 40
    dust_threshold: int = 4
    #: Upper bounds of half-open ranges for plots of positions by number of reads.
    ranges: tuple[int, ...] = (1, 5, 10, 20, 40, 60, 100, 1000)
    bins: int = 40


DEFAULT = Settings()
