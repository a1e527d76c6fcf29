"""Typed conditions, so that callers can tell them apart by class or by kind."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F


class ReadsError(Exception):
    """An error of a known kind."""

    kinds = frozenset({"UnspecifiedError", "InternalError", "RemoteError", "InputError", "ValueUnavailable", "ArgumentMismatch", "IncompatibleTypes", "ValidityError"})
    kind = "UnspecifiedError"

    def __init__(self, message: str, kind: str | None = None):
        super().__init__(message)
        self.kind = kind or type(self).kind
        if self.kind not in self.kinds:
            raise ValueError(f"unknown kind of error: {self.kind}")


class InputError(ReadsError):
    kind = "InputError"


class ArgumentMismatch(ReadsError, ValueError):
    kind = "ArgumentMismatch"


class ValueUnavailable(ReadsError):
    kind = "ValueUnavailable"


class IncompatibleTypes(ReadsError, TypeError):
    kind = "IncompatibleTypes"


class ValidityError(ReadsError):
    kind = "ValidityError"


class ReadsWarning(UserWarning):
    kinds = frozenset({"UnspecifiedWarning", "InputWarning", "ArgumentWarning"})

    def __init__(self, message: str, kind: str = "UnspecifiedWarning"):
        super().__init__(message)
        if kind not in self.kinds:
            raise ValueError(f"unknown kind of warning: {kind}")
        self.kind = kind


def warn(message: str, kind: str = "UnspecifiedWarning") -> None:
    warnings.warn(ReadsWarning(message, kind), stacklevel=3)


def one_of(value, allowed, name: str):
    """The value if it is allowed, else an error that lists what is."""
    if value not in allowed:
        raise ArgumentMismatch(f"'{name}' must be one of {', '.join(map(str, allowed))}; it is {value!r}")
    return value


def raised(kind: type[ReadsError], *message: Column | str) -> Column:
    """A column that raises an error of a class when a row needs it; typed_errors() gives the class back."""
    return F.raise_error(F.concat(F.lit(f"{kind.__name__}: "), *[F.lit(m) if isinstance(m, str) else m for m in message]))


_CLASSES = {c.__name__: c for c in (ReadsError, InputError, ArgumentMismatch, ValueUnavailable, IncompatibleTypes, ValidityError)}
_NAMED = re.compile(r"\b(?:strandmill\.errors\.)?(" + "|".join(_CLASSES) + r"): (.*)")


@contextmanager
def typed_errors() -> Iterator[None]:
    """Actions within it raise this module's errors where a task did: what stands in a plan, or runs in a worker, fails in
    Spark's own classes, which carry the class's name and the message."""
    try:
        yield
    except PySparkException as e:
        found = _NAMED.findall(str(e))
        if not found:
            raise
        name, message = found[-1] if "Traceback" in str(e) else found[0]
        raise _CLASSES[name](message.split(" SQLSTATE:")[0].strip()) from e
