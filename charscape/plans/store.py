"""Where the products of jobs live, and their public addresses."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Store:
    """Table paths are Hadoop file system URIs; the bases are the public prefixes."""

    root: str
    product_base: str
    catalog_base: str

    @property
    def items(self) -> str:
        return f"{self.root}/items"

    @property
    def rejected_items(self) -> str:
        return f"{self.root}/rejected-items"

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest"

    @property
    def coarse_grids(self) -> str:
        return f"{self.root}/grids/coarse"

    @property
    def refined_grids(self) -> str:
        return f"{self.root}/grids/refined"

    @property
    def boundaries(self) -> str:
        return f"{self.root}/boundaries"

    @property
    def layers(self) -> str:
        return f"{self.root}/layers"

    @property
    def matrices(self) -> str:
        return f"{self.root}/matrices"
