"""Merges replayed on one word."""

from __future__ import annotations

from bisect import bisect_right

Merge = tuple[str, str]


def replayed(own: list[str], merges: list[Merge], ranks: dict[Merge, list[int]]) -> list[str]:
    """Symbols after all merges in order, looking only at those whose pair occurs; ranks holds the places of each pair."""
    last = -1
    while len(own) > 1:
        nexts = (r[k] for p in zip(own, own[1:]) if (r := ranks.get(p)) and (k := bisect_right(r, last)) < len(r))
        last = min(nexts, default=None)
        if last is None:
            break
        a, b = merges[last]
        out, i = [], 0
        while i < len(own):
            pair = own[i] == a and i + 1 < len(own) and own[i + 1] == b
            out.append(a + b if pair else own[i])
            i += 2 if pair else 1
        own = out
    return own
