"""Settings from TOML: traits with their bins, panels, matching and analysis.

A settings file is read once into plain dicts; what the library asks of it are panels by name, the levels of a trait in a
binning, and folders beside the file.
"""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from hashlib import sha256
from pathlib import Path
from typing import Any

DEFAULT = Path(__file__).with_name("default.toml")
#: What a trait's column in each binning is called after the trait.
SUFFIX = {"coarse": "", "fine": "_fine"}


def column(trait: str, binning: str = "coarse") -> str:
    """Name of the column that holds the trait in the binning."""
    try:
        return trait + SUFFIX[binning]
    except KeyError:
        raise ValueError(f"binning is {' or '.join(SUFFIX)}, not {binning}") from None


class Config(Mapping[str, Any]):
    """The tables of a settings file, with the digest of its text and the folder that its paths start from."""

    def __init__(self, text: str, folder: str | Path = "."):
        self.tables: dict[str, Any] = tomllib.loads(text)
        self.sha256, self.folder = sha256(text.encode()).hexdigest(), Path(folder)

    @classmethod
    def read(cls, file: Path) -> Config:
        return cls(file.read_text(), file.resolve().parent)

    def __getitem__(self, key: str) -> Any:
        return self.tables[key]

    def __iter__(self):
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    def path(self, name: str) -> Path:
        return self.folder / self.tables["paths"][name]

    def panel(self, name: str) -> list[str]:
        """The traits of the panel, in its order."""
        return [*self.tables["panels"][name]]

    def panel_levels(self, traits: list[str], binning: str = "coarse") -> dict[str, list[str]]:
        """Levels by column name, in the order of the traits."""
        return {column(t, binning): [*self.tables["traits"][t][binning + "_levels"]] for t in traits}


def load_config(path: str | Path | None = None) -> Config:
    return Config.read(DEFAULT if path is None else Path(path))
