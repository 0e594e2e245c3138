"""Sources by name, and unions over several of which some may fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame

Reader = Callable[[], DataFrame]


class AllFailed(OSError):
    """No source answered; ``errors`` has what each said."""

    def __init__(self, errors: dict[str, Exception]) -> None:
        super().__init__("; ".join(f"{k}: {v}" for k, v in errors.items()))
        self.errors = errors


class Registry:
    """Readers by source name; registering a name again replaces it."""

    def __init__(self) -> None:
        self._readers: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, reader: Callable[..., DataFrame]) -> Registry:
        self._readers[name] = reader
        return self

    def get(self, name: str) -> Callable[..., DataFrame] | None:
        return self._readers.get(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self._readers)

    def read(self, name: str, **options) -> DataFrame:
        if name not in self._readers:
            raise KeyError(f"no source named {name}")
        return self._readers[name](**options)


def union_of(readers: Mapping[str, Reader]) -> tuple[DataFrame, dict[str, Exception]]:
    """Rows of all sources that answer, one after another, and the others' errors; an error if none does."""
    frames, errors = [], {}
    for name, read in readers.items():
        try:
            frames.append(read())
        except Exception as e:  # noqa: BLE001  any failure of one source leaves the others
            errors[name] = e
    if not frames:
        raise AllFailed(errors)
    return reduce(DataFrame.unionByName, frames), errors
