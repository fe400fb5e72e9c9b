"""Text as a persistent tree of pieces of one origin each: an edit makes a new version in logarithmic time and leaves the old
one as it is, so that versions share what they have in common. Positions count characters of the text given."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Characters of a piece at most.
PIECE = 1024
_RANDOM = random.Random(0)


class Node:
    __slots__ = ("left", "right", "rank", "text", "origin", "size", "breaks")

    def __init__(self, left: Node | None, right: Node | None, rank: float, text: str, origin: int):
        self.left, self.right, self.rank, self.text, self.origin = left, right, rank, text, origin
        self.size = len(text) + (left.size if left else 0) + (right.size if right else 0)
        self.breaks = text.count("\n") + (left.breaks if left else 0) + (right.breaks if right else 0)


def size(n: Node | None) -> int:
    return n.size if n else 0


def breaks(n: Node | None) -> int:
    return n.breaks if n else 0


def join(a: Node | None, b: Node | None) -> Node | None:
    if not a or not b:
        return a or b
    if a.rank > b.rank:
        return Node(a.left, join(a.right, b), a.rank, a.text, a.origin)
    return Node(join(a, b.left), b.right, b.rank, b.text, b.origin)


def split(n: Node | None, at: int) -> tuple[Node | None, Node | None]:
    if not n:
        return None, None
    before = size(n.left)
    if at <= before:
        a, b = split(n.left, at)
        return a, Node(b, n.right, n.rank, n.text, n.origin)
    if at >= before + len(n.text):
        a, b = split(n.right, at - before - len(n.text))
        return Node(n.left, a, n.rank, n.text, n.origin), b
    k = at - before
    return Node(n.left, None, n.rank, n.text[:k], n.origin), join(Node(None, None, _RANDOM.random(), n.text[k:], n.origin), n.right)


def made(text: str, origin: int) -> Node | None:
    out = None
    for k in range(0, len(text), PIECE):
        out = join(out, Node(None, None, _RANDOM.random(), text[k : k + PIECE], origin))
    return out


def pieces(n: Node | None) -> Iterator[tuple[str, int]]:
    stack: list[Node] = []
    while stack or n:
        while n:
            stack.append(n)
            n = n.left
        n = stack.pop()
        yield n.text, n.origin
        n = n.right


def text(n: Node | None) -> str:
    return "".join(t for t, _ in pieces(n))


def runs(n: Node | None) -> list[tuple[int, int, int]]:
    """(offset, length, origin) of the longest stretches of one origin."""
    out: list[list[int]] = []
    at = 0
    for t, origin in pieces(n):
        if out and out[-1][2] == origin:
            out[-1][1] += len(t)
        else:
            out.append([at, len(t), origin])
        at += len(t)
    return [tuple(x) for x in out]


def part(n: Node | None, start: int, stop: int) -> Node | None:
    return split(split(n, stop)[0], start)[1]


def line_start(n: Node | None, line: int) -> int:
    """Where a line begins; the text's length beyond the last."""
    if line <= 0:
        return 0
    at, left = 0, line
    while n:
        before = breaks(n.left)
        if left <= before:
            n = n.left
            continue
        at, left = at + size(n.left), left - before
        own = n.text.count("\n")
        if left <= own:
            k = -1
            for _ in range(left):
                k = n.text.index("\n", k + 1)
            return at + k + 1
        at, left, n = at + len(n.text), left - own, n.right
    return at


def place(n: Node | None, line: int, character: int) -> int:
    """Offset of a position; one beyond a line's end is its end, one beyond the last line the text's end."""
    if line > breaks(n):
        return size(n)
    start = line_start(n, line)
    stop = line_start(n, line + 1) - 1 if line < breaks(n) else size(n)
    return min(start + max(character, 0), stop)


def replaced(n: Node | None, start: int, stop: int, new: str, origin: int) -> Node | None:
    """The text with [start, stop) replaced; a stop before the start keeps what is between twice, as slices do."""
    head, tail = split(n, start)[0], split(n, stop)[1]
    return join(join(head, made(new, origin)), tail)
