"""Parameters of a run, checked when they are made."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class FilterPolicy:
    """Thresholds on homology hits; None turns one off. Boundaries pass. top_k keeps ties."""

    max_evalue: float | None = None
    min_pident: float | None = None
    min_qcov: float | None = None
    min_alnlen: int | None = None
    top_k: int | None = None

    def __post_init__(self):
        if self.max_evalue is not None and not 0 < self.max_evalue <= 1000:  # NaN and infinity fail too
            raise ValueError("max_evalue must be in (0, 1000]")
        for name in ("min_pident", "min_qcov"):
            value = getattr(self, name)
            if value is not None and not 0 <= value <= 100:
                raise ValueError(f"{name} must be in [0, 100]")
        for name in ("min_alnlen", "top_k"):
            value = getattr(self, name)
            if value is not None and value < 1:
                raise ValueError(f"{name} must be at least 1")

    @classmethod
    def recommended(cls) -> FilterPolicy:
        """What the web form fills in."""
        return cls(max_evalue=1e-10, min_pident=80.0, top_k=1)


@dataclass(frozen=True)
class GoOptions:
    """Which edges an ontology closure follows, and whether a term is in its own closure."""

    edge_types: tuple[str, ...] = ("is_a", "part_of")
    include_self: bool = True

    @classmethod
    def from_text(cls, text: str, include_self: bool = True) -> GoOptions:
        """Comma-separated edge types; an empty text gives the default ones."""
        types = tuple(x.strip() for x in text.split(",") if x.strip())
        return cls(types or cls.edge_types, include_self)


def plain_name(name: str) -> str:
    """The name of a database, which must be no path; '' for none."""
    if ".." in name or "/" in name or "\\" in name:
        raise ValueError("a database is named by a plain file name")
    return name


def email(address: str) -> str:
    """An address to notify, without white space around it; '' for none."""
    address = address.strip()
    if address and not re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", address):
        raise ValueError("no e-mail address")
    return address
