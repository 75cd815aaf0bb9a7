"""Texts that the library brings along."""

from importlib import resources


def read(name: str) -> str:
    """The text of a file of this package, also where the library is imported from an archive."""
    return resources.files(__package__).joinpath(name).read_text(encoding="utf-8")
