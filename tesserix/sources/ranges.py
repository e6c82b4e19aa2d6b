"""Which byte ranges of a file are fetched together."""

from __future__ import annotations

from collections.abc import Iterator

#: Ranges at most this far apart are fetched by one read: passing over some bytes costs less than another request.
GAP = 64 << 10
#: A read that joins ranges ends here; one longer range is still read whole.
READ_BYTES = 8 << 20


def apart(start: int, end: int, a: int, b: int, gap: int = GAP, limit: int = READ_BYTES) -> bool:
    """Whether the range [a, b) needs another read than the one of [start, end) before it."""
    return a > end + gap or max(end, b) - start > limit


def merged(ranges: list[tuple[int, int]], gap: int = GAP, limit: int = READ_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, positions) of each read over half-open ``ranges`` sorted by start. Ranges may overlap and be empty."""
    start = end = 0
    members: list[int] = []
    for i, (a, b) in enumerate(ranges):
        if members and apart(start, end, a, b, gap, limit):
            yield start, end, members
            members = []
        if not members:
            start = end = a
        end = max(end, b)
        members.append(i)
    if members:
        yield start, end, members
