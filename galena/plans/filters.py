"""The metadata filter language: conditions joined by and, compiled to a column over a map of typed values.

    filter    := [condition (and condition)*]
    condition := key op value        op: == = != < <= > >=
    key       := letters, digits, _ . -
    value     := 'quoted' | "quoted" (a backslash escapes) | anything up to white space

A bare value is an integer if it is one of 64 bits, else a real if it is a finite number, else text; a quoted one is
text. A condition on a key that a row lacks never holds, != included, nor does one between kinds that do not compare.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FilterSyntaxError, InvalidArgumentError
from ..functions.metadata import INT, NULL, REAL, TEXT

_KEY = re.compile(r"[A-Za-z0-9_.-]+")
_OP = re.compile(r"==|!=|<=|>=|<|>|=")
_WORD = re.compile(r"[A-Za-z]+")
_HEX = re.compile(r"[+-]?0[xX](?:[0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?\Z")
_INT = re.compile(r"-?[0-9]+\Z")
OPS = ("==", "!=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Condition:
    key: str
    op: str
    value: int | float | str | None

    def __post_init__(self):
        if self.op not in OPS:
            raise InvalidArgumentError(f"unknown operator {self.op!r}")
        if not self.key:
            raise InvalidArgumentError("a condition needs a key")
        if isinstance(self.value, float) and not math.isfinite(self.value):
            raise InvalidArgumentError(f"{self.key}: {self.value} is not finite")

    def compile(self, metadata: Column) -> Column:
        """Never null: a row that lacks the key, or holds another kind, does not match."""
        held = F.try_element_at(metadata, F.lit(self.key))
        kind = held["t"]
        if self.value is None:  # null compares with null only, as equal
            return F.coalesce((kind == NULL) & F.lit(self.op in ("==", "<=", ">=")), F.lit(False))
        if isinstance(self.value, str):
            return F.coalesce((kind == TEXT) & _compare(held["s"], self.op, F.lit(self.value)), F.lit(False))
        if isinstance(self.value, int):  # two integers compare as such, without rounding
            whole = (kind == INT) & _compare(held["i"], self.op, F.lit(self.value).cast("long"))
            return F.coalesce(whole, F.lit(False)) | F.coalesce((kind == REAL) & _compare(held["r"], self.op, F.lit(float(self.value))), F.lit(False))
        number = F.when(kind == INT, held["i"].cast("double")).when(kind == REAL, held["r"])
        return F.coalesce(_compare(number, self.op, F.lit(self.value)), F.lit(False))

    def __str__(self) -> str:
        if isinstance(self.value, str):
            quoted = self.value.replace("\\", "\\\\").replace('"', '\\"')
            return f'{self.key} {self.op} "{quoted}"'
        return f"{self.key} {self.op} {self.value!r}"


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


@dataclass(frozen=True)
class Filter:
    conditions: tuple[Condition, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.conditions)

    def compile(self, metadata: Column) -> Column:
        """Whether all conditions hold; true without any."""
        return reduce(and_, [c.compile(metadata) for c in self.conditions], F.lit(True)) if self.conditions else F.lit(True)

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))

    @classmethod
    def parse(cls, text: str) -> Filter:
        return _Parser(text).filter()


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, message: str, at: int | None = None) -> FilterSyntaxError:
        return FilterSyntaxError(message, self.text, self.at if at is None else at)

    def skip(self) -> bool:
        before = self.at
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.at > before

    def filter(self) -> Filter:
        self.skip()
        if self.at == len(self.text):
            return Filter()
        out = [self.condition()]
        while True:
            gap = self.skip()
            if self.at == len(self.text):
                return Filter(tuple(out))
            word = _WORD.match(self.text, self.at)
            low = word[0].lower() if word else ""
            if low == "or":
                raise self.fail("or is not supported: filters are conditions joined by and")
            if low != "and" or not gap:
                raise self.fail("expected and")
            start, self.at = self.at, word.end()
            if not self.skip():
                raise self.fail("expected a condition after and" if self.at == len(self.text) else "expected white space after and", start)
            out.append(self.condition())

    def condition(self) -> Condition:
        key = _KEY.match(self.text, self.at)
        if not key:
            raise self.fail("expected a key")
        self.at = key.end()
        self.skip()
        op = _OP.match(self.text, self.at)
        if not op:
            raise self.fail("expected an operator (== != < <= > >=)")
        self.at = op.end()
        self.skip()
        return Condition(key[0], "==" if op[0] == "=" else op[0], self.value())

    def value(self) -> int | float | str:
        start = self.at
        if start == len(self.text):
            raise self.fail("expected a value")
        quote = self.text[start]
        if quote in "\"'":
            out = []
            i = start + 1
            while i < len(self.text):
                c = self.text[i]
                if c == quote:
                    self.at = i + 1
                    return "".join(out)
                if c == "\\" and i + 1 < len(self.text):
                    i += 1
                    c = self.text[i]
                out.append(c)
                i += 1
            raise self.fail("unterminated string", start)
        end = start
        while end < len(self.text) and not self.text[end].isspace():
            end += 1
        self.at = end
        try:
            return typed(self.text[start:end])
        except InvalidArgumentError as e:
            raise self.fail(str(e), start) from e


def typed(word: str) -> int | float | str:
    """A bare value: an integer of 64 bits, else a finite number, which may be hexadecimal (0x10, 0x1.8p3), else text."""
    if _INT.match(word) and -(1 << 63) <= int(word) < 1 << 63:
        return int(word)
    try:
        number = (float.fromhex(word) if _HEX.match(word) else float(word)) if "_" not in word else None
    except (ValueError, OverflowError):
        return word
    if number is None:
        return word
    if not math.isfinite(number):
        raise InvalidArgumentError(f"{word} is not a finite number; quote it if it is text")
    return number
