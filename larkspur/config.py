"""Configurations of the two programs."""

from __future__ import annotations

import os
from dataclasses import dataclass

from larkspur.operators.layout import DEFAULT, Layout, layout


@dataclass(frozen=True)
class OrganizeConfig:
    source: str = "."
    target: str = "."
    layout_name: str = DEFAULT
    recursive: bool = False
    dry_run: bool = False
    verbose: bool = False
    track_numbers: bool = True
    consolidate: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "source", os.path.abspath(self.source or "."))
        object.__setattr__(self, "target", os.path.abspath(self.target or "."))
        object.__setattr__(self, "layout_name", self.layout_name or DEFAULT)
        layout(self.layout_name)

    @property
    def layout(self) -> Layout:
        return layout(self.layout_name)


@dataclass(frozen=True)
class PlaylistConfig:
    csv: str
    source: str = "."
    output: str = "playlist.m3u"
    prefix: str = ""
    recursive: bool = False
    dry_run: bool = False
    verbose: bool = False
    debug: bool = False

    def __post_init__(self) -> None:
        if not self.csv:
            raise ValueError("csv path is required")
        object.__setattr__(self, "source", os.path.abspath(self.source or "."))
        object.__setattr__(self, "output", self.output or "playlist.m3u")
        object.__setattr__(self, "prefix", self.prefix.rstrip("/"))
