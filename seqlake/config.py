"""Parameters of the tasks, with their defaults, ranges and combinations checked."""

from __future__ import annotations

from dataclasses import dataclass

#: The tasks, the programs for spacers, the ways to cluster, and the marker genes of trees.
TASKS = ("end_to_end", "identify", "taxonomy", "lifestyle", "annotation", "host", "contamination", "units", "tree")
SPACER_PROGRAMS = ("blastn", "blastn-short")
MODES = ("ANI", "AAI")
MARKERS = ("terl", "portal", "head", "endolysin", "holin")


@dataclass(frozen=True)
class Config:
    task: str = "end_to_end"
    #: Take all contigs as viral in the end-to-end task.
    skip: bool = False
    min_length: int = 3000
    cover: float = 50
    reject: float = 10
    aai: float = 75
    share: float = 15
    pair_cover: float = 80
    spacer_identity: float = 90
    spacer_cover: float = 90
    spacer_program: str = "blastn"
    #: Folder of genomes (MAGs) and table of their taxonomy.
    genomes: str | None = None
    genome_taxonomy: str | None = None
    #: Hosts from the genomes alone.
    genomes_only: bool = False
    prophage_length: int = 1000
    trna_cover: float = 0.95
    sensitive: bool = False
    mode: str = "ANI"
    ani: float = 95
    target_cover: float = 85
    markers: tuple[str, ...] = ("terl", "portal")
    marker_identity: float = 25
    marker_cover: float = 50
    #: Align markers, align them with the references, and build a tree.
    align: bool = False
    align_references: bool = True
    tree: bool = False
    near_top: float = 0.9
    lca_share: float = 0.5
    sentence_length: int = 300
    text_length: int = 298
    inflation: float = 2.0

    def __post_init__(self):
        for name in ("cover", "aai", "share", "pair_cover", "spacer_cover", "ani", "target_cover", "marker_identity", "marker_cover"):
            if not 0 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must be within 0 and 100")
        if not 90 <= self.spacer_identity <= 100:
            raise ValueError("spacer_identity must be within 90 and 100")
        if not 0 <= self.reject <= 20:
            raise ValueError("reject must be within 0 and 20")
        if self.min_length < 0 or self.prophage_length < 0:
            raise ValueError("lengths can't be negative")
        for name, known in (("task", TASKS), ("spacer_program", SPACER_PROGRAMS), ("mode", MODES)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")
        if bad := [m for m in self.markers if m not in MARKERS]:
            raise ValueError(f"unknown markers {', '.join(bad)}; known are {', '.join(MARKERS)}")
        if self.genomes is None and self.genomes_only:
            raise ValueError("hosts from the genomes alone need a folder of genomes")
        if self.genomes is None and self.genome_taxonomy is not None:
            raise ValueError("a taxonomy of genomes needs their folder")
