"""Errors of the engine, each with the service status a client sees."""

from __future__ import annotations


class VectorError(Exception):
    """Base of all errors; ``status`` is the service status name."""

    status = "INTERNAL"


class InvalidArgument(VectorError, ValueError):
    """A malformed request or vector, a wrong dimension, a duplicate id."""

    status = "INVALID_ARGUMENT"


class ResourceExhausted(VectorError):
    """A limit, quota or budget would be exceeded."""

    status = "RESOURCE_EXHAUSTED"


class LimitExceeded(ResourceExhausted):
    """A request is longer than allowed (batch, Top-K, log size)."""


class FailedPrecondition(VectorError):
    """The store is in a state that forbids the request."""

    status = "FAILED_PRECONDITION"


class ReadOnlyStore(FailedPrecondition):
    """A write to a read-only store."""


class EpochError(FailedPrecondition):
    """A deduplication epoch that is expired, closed, in the future or unsupported."""


class RecoveryRequired(FailedPrecondition):
    """The writer failed after a record was admitted and must be recovered."""


class SnapshotMismatch(FailedPrecondition):
    """An identity or generation other than the expected one."""


class PublicationDisabled(FailedPrecondition):
    """Snapshot publication is switched off."""


class PublicationBusy(ResourceExhausted):
    """Another snapshot is being prepared."""


class SearchRejected(ResourceExhausted):
    """The search queue is full; with ``stopping`` the executor is shutting down."""

    def __init__(self, message: str, stopping: bool = False):
        super().__init__(message)
        self.stopping = stopping
        if stopping:
            self.status = "UNAVAILABLE"


class SearchInterrupted(VectorError):
    """A search ended early: ``reason`` is cancelled, deadline or shutdown."""

    _STATUS = {"cancelled": "CANCELLED", "deadline": "DEADLINE_EXCEEDED", "shutdown": "UNAVAILABLE"}

    def __init__(self, reason: str):
        super().__init__(f"search stopped: {reason}")
        self.reason = reason
        self.status = self._STATUS[reason]


def status_of(error: BaseException) -> str:
    """The service status of any error."""
    if isinstance(error, VectorError):
        return error.status
    if isinstance(error, MemoryError):
        return "RESOURCE_EXHAUSTED"
    return "INVALID_ARGUMENT" if isinstance(error, ValueError) else "INTERNAL"
