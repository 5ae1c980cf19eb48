"""What can go wrong. Messages name the offending values."""

from __future__ import annotations


class GalenaError(Exception):
    """The base of all errors of this package."""


class InvalidArgumentError(GalenaError):
    pass


class DimensionMismatchError(InvalidArgumentError):
    def __init__(self, expected: int, actual: int, where: str = "vector"):
        super().__init__(f"{where} has dimension {actual}, expected {expected}")
        self.expected, self.actual = expected, actual


class InvalidVectorError(InvalidArgumentError):
    pass


class FilterSyntaxError(InvalidArgumentError):
    """A filter that does not parse; the message shows where."""

    def __init__(self, message: str, text: str, position: int):
        super().__init__(f"{message} at position {position}\n  {text}\n  {' ' * position}^")
        self.position = position


class NotFoundError(GalenaError):
    pass


class DuplicateIdError(GalenaError):
    pass


class IoError(GalenaError):
    pass


class CorruptionError(GalenaError):
    pass


class UnsupportedVersionError(CorruptionError):
    def __init__(self, what: str, found: int, supported: int):
        super().__init__(f"{what} has version {found}; this build reads version {supported}")


class MetadataError(GalenaError):
    pass
