"""Burrows-Wheeler transform and common prefixes of a collection, column by column.

One round adds one symbol of every string, from the strings' ends: the suffix
that grew in the last round by the symbol in front of it finds its place by
counting that symbol in the transform so far, and the common prefixes beside
it follow from the smallest one between two neighbours.  Transform and common
prefixes live in files that every round reads and writes from front to back.
"""

from __future__ import annotations

import tempfile


def smallest(values, low, high):
    """The smallest of ``values[low:high]`` for each pair; none is empty."""
    import numpy as np

    level = np.frexp(high - low)[1] - 1  # two spans of 2**level cover each
    out = np.empty(len(low), dtype=values.dtype)
    top = int(level.max()) if len(level) else -1
    for k in range(top + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(values[low[own]], values[high[own] - (1 << k)])
        if k < top:
            values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


def collection(symbols, starts, lengths):
    """(string, offset, lcp) of all suffixes of a collection in order.

    ``symbols`` holds the strings as numbers from 1 to 255 (uint8), each of at
    least one and under 255 symbols.  Row k's suffix is that of ``string[k]``
    from ``offset[k]`` (the string's length for the empty suffix), and
    ``lcp[k]`` is what it shares with row k - 1; strings end apart.
    """
    import numpy as np

    m = len(starts)
    left = lengths.astype(np.int64)
    cursor = starts.astype(np.int64) + left - 1
    place = np.arange(m)
    growing = np.arange(m)
    with tempfile.TemporaryFile() as bwt_file, tempfile.TemporaryFile() as lcp_file:
        rows = 0

        def write(*columns):
            nonlocal rows
            rows = len(columns[0])
            for file, column in zip((bwt_file, lcp_file), columns):
                file.seek(0)
                file.write(column.data)
                file.flush()

        def read():
            columns = []
            for file in (bwt_file, lcp_file):
                file.seek(0)
                columns.append(np.empty(rows, dtype=np.uint8))
                if file.readinto(columns[-1].data) != rows:
                    raise OSError("a file of the order is cut short")
            return columns

        write(symbols[cursor], np.zeros(m, dtype=np.uint8))
        while len(growing):
            bwt, lcp = read()
            n = len(bwt)
            order = np.argsort(bwt, kind="stable")
            rank = np.empty(n, dtype=np.int32)
            rank[order] = np.arange(n, dtype=np.int32)
            ended = n - np.count_nonzero(bwt)
            own = rank[place[growing]].astype(np.int64)
            # neighbours that were apart until now: the new rows and those behind them
            beside = np.zeros(n + 1, dtype=bool)
            beside[own] = beside[own + 1] = True
            touched = np.flatnonzero(beside[:n])
            above, below = order[touched - 1], order[touched]
            shared = (touched > ended) & (bwt[above] == bwt[below])
            touched, above, below = touched[shared], above[shared], below[shared]
            least = smallest(lcp, above + 1, below + 1)
            to = m + own - ended
            size = m + n - ended
            old = np.ones(size, dtype=bool)
            old[to] = False
            grown_bwt, grown_lcp = np.empty(size, dtype=np.uint8), np.empty(size, dtype=np.uint8)
            grown_bwt[old], grown_lcp[old] = bwt, lcp
            left[growing] -= 1
            cursor[growing] -= 1
            more = left[growing] > 0
            grown_bwt[to] = np.where(more, symbols[np.maximum(cursor[growing], 0)], 0)
            grown_lcp[to] = 0
            behind = to + 1
            grown_lcp[behind[behind < size]] = 0
            grown_lcp[m + touched - ended] = least + 1
            write(grown_bwt, grown_lcp)
            place[growing] = to
            growing = growing[more]
        bwt, lcp = read()

    # from every string's end its suffixes are found by stepping to the row of the one before
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[order] = m + np.arange(n) - (n - np.count_nonzero(bwt))
    string, offset = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
    row, at, rest = np.arange(m), np.arange(m), lengths.astype(np.int64)
    while len(row):
        string[row], offset[row] = at, rest
        on = rest > 0
        row, at, rest = step[row[on]], at[on], rest[on] - 1
    return string, offset, lcp
