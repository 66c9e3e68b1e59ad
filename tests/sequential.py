"""The order-dependent rules restated one row at a time, to check the Spark jobs against."""

from __future__ import annotations

SECOND = 1_000_000


def keep_spaced(times, interval_sec):
    """Indices kept by the greedy rule, in the given order."""
    kept, last = [], None
    for i, t in enumerate(times):
        if last is None or (t - last) // SECOND >= interval_sec:
            kept.append(i)
            last = t
    return kept


def segment_starts(points):
    """Start time of the segment of each point; points are (us, sog, nav_status) in time order."""
    pieces, piece, run = [], [], []
    previous = None
    for us, sog, status in points:
        still = status in (1, 5)
        if previous is not None and ((us - previous[0]) // SECOND > 21_600 or still != previous[1]):
            pieces.append(piece)
            piece, run = [], []
        piece.append(us)
        if sog is not None and sog < 0.5:
            run.append(us)
            if len(run) >= 6 and (us - run[0]) // SECOND >= 1_800:
                cut = piece.index(run[0])
                pieces.append(piece[:cut])
                piece, run = piece[cut:], []
        else:
            run = []
        previous = (us, still)
    pieces.append(piece)
    return [(us, p[0]) for p in pieces for us in p]


def assembled(sentences):
    """(payload, seq) of whole messages; sentences are (seq, total, num, key, payload) in order, one file."""
    open_groups, out = {}, []
    for seq, total, num, key, payload in sentences:
        if total == 1:
            out.append((payload, seq))
            continue
        if num == 1:
            open_groups[key] = [None] * total
        slots = open_groups.get(key)
        if slots is None or num > len(slots):
            continue
        slots[num - 1] = payload
        if num == total and all(s is not None for s in slots):
            out.append(("".join(slots), seq))
            del open_groups[key]
    return out
