"""Limits and memory costs that are checked in the driver before a plan is made."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from vecloom.errors import InvalidArgument, LimitExceeded, ResourceExhausted

MAX_U64 = (1 << 64) - 1


def checked_add(*values: int) -> int:
    """Sum that must fit an unsigned 64-bit number."""
    total = sum(values)
    if total > MAX_U64:
        raise ResourceExhausted("size overflows")
    return total


def checked_multiply(left: int, right: int) -> int:
    """Product that must fit an unsigned 64-bit number."""
    if left * right > MAX_U64:
        raise ResourceExhausted("size overflows")
    return left * right


@dataclass(frozen=True)
class ResourceLimits:
    """Limits of one index; the defaults are those of the service. Fixed values."""

    dimension: int = 65_536
    vectors: int = 1_000_000
    index_bytes: int = 1 << 30
    top_k: int = 10_000

    def flat_bytes(self, vectors: int, dimension: int) -> int:
        """Cost of an exact index."""
        return checked_multiply(vectors, checked_add(4 * dimension, 512))

    def durable_bytes(self, vectors: int, dimension: int) -> int:
        """Cost of an exact index with a log."""
        return checked_multiply(vectors, checked_add(4 * dimension, 1024))

    def graph_bytes(self, nodes: int, dimension: int, max_connections: int) -> int:
        """Cost of a writable graph index; ``nodes`` counts deleted ones too."""
        return checked_multiply(nodes, checked_add(4 * dimension, 512, checked_multiply(64, 48 + 32 * max_connections)))

    def read_only_graph_bytes(self, nodes: int, dimension: int, edges: int, max_level: int) -> int:
        """Cost of a loaded graph that takes no more vectors."""
        return checked_add(self.flat_bytes(nodes, dimension), 16 * edges, 48 * nodes * (max_level + 1))

    def loading_bytes(self, file_size: int, vectors: int) -> int:
        """Cost of loading a snapshot file."""
        return checked_add(checked_multiply(16, file_size), checked_multiply(512, vectors))

    def search_bytes(self, task_bytes: int, k: int, vectors: int) -> int:
        """Cost of one search."""
        return checked_add(task_bytes, checked_multiply(64, k), checked_multiply(16, vectors))

    def check_shape(self, dimension: int, vectors: int) -> None:
        """Raise if an index of this shape is not allowed."""
        if dimension > self.dimension or vectors > self.vectors or self.flat_bytes(vectors, dimension) > self.index_bytes:
            raise ResourceExhausted("index shape exceeds the limits")

    def check_growth(self, dimension: int, vectors: int, added: int) -> None:
        """Raise if an index may not grow by ``added`` vectors."""
        self.check_shape(dimension, checked_add(vectors, added))

    def check_top_k(self, k: int) -> None:
        """Raise if more neighbours are asked for than allowed."""
        if k > self.top_k:
            raise LimitExceeded(f"k exceeds {self.top_k}")


class MemoryBudget:
    """A byte budget shared by threads; :meth:`reserve` gives a lease that ends with its ``with`` block."""

    def __init__(self, total: int):
        self.total, self.used = total, 0
        self._lock = threading.Lock()

    def reserve(self, size: int) -> Lease:
        with self._lock:
            if size < 0 or self.used + size > self.total:
                raise ResourceExhausted("memory budget exceeded")
            self.used += size
        return Lease(self, size)

    def _release(self, size: int) -> None:
        with self._lock:
            self.used -= size


class Lease:
    """Reserved bytes of a budget, given back once."""

    def __init__(self, budget: MemoryBudget, size: int):
        self._budget, self.size = budget, size

    def release(self) -> None:
        size, self.size = self.size, 0
        self._budget._release(size)

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def parse_unsigned(text: str, most: int = MAX_U64, positive: bool = False) -> int:
    """A decimal number without sign, blanks or other characters."""
    if not (text.isascii() and text.isdigit()) or int(text) > most or (positive and int(text) == 0):
        raise InvalidArgument(f"not {'a positive' if positive else 'an unsigned'} number: {text!r}")
    return int(text)


def parse_bool(text: str) -> bool:
    """``true`` or ``false``, nothing else."""
    if text not in ("true", "false"):
        raise InvalidArgument(f"not a boolean: {text!r}")
    return text == "true"
