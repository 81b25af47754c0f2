"""Edit distance of whole texts."""

from __future__ import annotations

from collections.abc import Sequence


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and changes from ``a`` to ``b``, characters of strings or elements of lists.

    Bit-parallel: a column of the distance table is two whole numbers whose bits say where it steps up and down, and one
    element of the shorter side moves the whole column on. Only a band around the diagonal is kept, which doubles until the
    distance fits in it, so alike texts cost their length times their distance. What both sides begin and end with is left
    out.
    """
    if len(a) < len(b):
        a, b = b, a
    lo, hi = 0, 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    while hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not b:
        return len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    where = {x: _bits(places[x], len(a)) for x in set(b) if x in places}
    most = max(32, 2 * (len(a) - len(b)))
    while most < len(a):
        found = _in_band(where, len(a), b, most)
        if found <= most:
            return found
        most *= 4
    return _in_band(where, len(a), b, len(a))


def _in_band(where: dict, n: int, b: Sequence, most: int) -> int:
    """The distance of ``b`` from n elements that stand where ``where`` says, if it is at most ``most``, else a larger one.
    Bit i of a column is the row i above the band's lower edge, which moves down by one with every element."""
    wide = 2 * most + 2
    whole = (1 << wide) - 1
    up, down, score = whole ^ ((1 << (wide - most - 1)) - 1), 0, most
    corner, line = 1 << (wide - 1), 1 << (wide - 2)
    start = most + 1 - wide
    get = where.get
    for j, x in enumerate(b):
        same = get(x, 0)
        if same:
            same = (same >> start if start >= 0 else same << -start) & whole
        start += 1
        diagonal = ((((same & up) + up) ^ up) | same | down) & whole
        rise = down | (whole ^ (diagonal | up))
        fall = diagonal & up
        if j < n - most:
            if not diagonal & corner:
                score += 1
        else:
            if rise & line:
                score += 1
            elif fall & line:
                score -= 1
            line >>= 1
        diagonal >>= 1
        up = fall | (whole ^ (diagonal | rise))
        down = diagonal & rise
    return score


def _bits(at: list[int], n: int) -> int:
    out = bytearray(n // 8 + 1)
    for i in at:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")
