"""Linear suffix sorting by grouping, after Baier.

Suffixes are grouped by their longest Lyndon prefix. Groups are worked off in descending order:
the previous smaller suffix of each member is found over pointers, and its own Lyndon prefix
grows by the group's, so it moves to a new group behind the one it had. Once all groups stand,
one pass over the array emits each group's members in order. Nothing is renamed or sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order; symbols are integers, an end counts as smallest."""
    n = len(text) + 1
    held: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        held.setdefault(symbol, []).append(i)
    group, members, size, start_of = [0] * n, {0: [n - 1]}, [0] * n, [0] * (n + 1)
    size[0], at = 1, 1  # a group's name is its first place in the array
    for symbol in sorted(held):
        rows = held[symbol]
        for i in rows:
            group[i] = at
        members[at], size[at], start_of[at + len(rows)] = rows, len(rows), at
        at += len(rows)
    smaller = [-1] * n

    end = n
    while end > 1:
        start = start_of[end]
        hits: dict[int, int] = {}
        for i in members.pop(start):
            if group[i] != start:  # moved since
                continue
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        end = start
        # by descending number of hits, each group's share goes to its end, so a rest comes first
        moved: dict[tuple[int, int], list[int]] = {}
        for j, many in hits.items():
            moved.setdefault((-many, group[j]), []).append(j)
        for key in sorted(moved) if len(moved) > 1 else moved:
            rows, own = moved[key], key[1]
            rest = size[own] - len(rows)
            if rest:
                new = own + rest
                size[own], size[new] = rest, len(rows)
                start_of[new + len(rows)], start_of[new] = new, own
                if len(rows) > 1:
                    rows.sort()
                for j in rows:
                    group[j] = new
                members[new] = rows

    out, placed, free = [-1] * n, [False] * n, list(range(n))
    out[0], placed[n - 1] = n - 1, True
    for i in out:  # filled while it is read
        j = i - 1
        while j >= 0 and not placed[j]:
            own = group[j]
            out[free[own]] = j
            free[own] += 1
            placed[j] = True
            j = smaller[j]
    return out[1:]
