"""Recursive character splitting of prose into overlapping chunks."""

from __future__ import annotations

SIZE, OVERLAP = 512, 50
SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters where separators allow, each beginning with up to `overlap` of the last.

    The first separator that occurs cuts the text, and stays at the head of the piece that follows it. Pieces that are
    too long are cut by the separators after it; the others are joined as far as they fit.
    """
    chosen = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    separator, finer = separators[chosen], separators[chosen + 1 :]
    pieces = list(text) if not separator else [p for p in _headed(text, separator) if p]
    out: list[str] = []
    fitting: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            fitting.append(piece)
            continue
        out += _joined(fitting, size, overlap)
        fitting = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + _joined(fitting, size, overlap)


def _headed(text: str, separator: str) -> list[str]:
    first, *rest = text.split(separator)
    return [first, *(separator + r for r in rest)]


def _joined(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    begin = total = 0
    for piece in pieces:
        if total + len(piece) > size and begin < len(held):
            out.append("".join(held[begin:]).strip())
            while begin < len(held) and (total > overlap or total + len(piece) > size):
                total -= len(held[begin])
                begin += 1
        held.append(piece)
        total += len(piece)
    out.append("".join(held[begin:]).strip())
    return [chunk for chunk in out if chunk]
