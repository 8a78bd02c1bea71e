"""Cheapest repair of a sequence of turns, by Bertsekas' auction algorithm for shortest paths.

The lattice has a node for each place between two rows and each state of the grammar ``(s?(ua)+)?`` (nothing yet, after
system, after user, after assistant).  Arcs keep, re-role or delete the next row, or insert an empty one.  Node prices
start as a lower bound (each row's least cost) and never exceed an arc's cost plus the price behind it.  From an origin a
path grows along arcs that meet their price; where no arc does, the last node's price rises to the best it can get and the
path loses that node.  When the path arrives, the origin's price is its distance, every arc of every cheapest path is
tight, and the least audit is traced along the tight arcs that lead on to the end.

A row is one letter: s, u, a, x by its role's initial (x: any other), upper case if it is truncated, ``-`` if it must be
deleted; ``$`` is the end.  Long sequences are settled window by window from the end: the prices at a window's end are those
at the start of the next.
"""

from __future__ import annotations

from math import inf

#: States of the grammar, and the role that an inserted or re-roled row takes in each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("", "system", "user", "assistant")
_KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Prices after the end.
ACCEPTED = (0, inf, inf, 0)
#: Rows settled at once: the work of an auction grows faster than its rows.
WINDOW = 24
#: Windows remembered by their letters and end prices.
REMEMBERED = 100_000


def _arcs(letter: str, state: int) -> tuple[tuple[int, int, str], ...]:
    """(cost, step to the node it leads to, edit's initial), by initial."""
    def to(level: int, there: int) -> int:
        return 4 * level + there - state

    if letter == "$":
        end = ((0, to(1, state), ""),) if ACCEPTED[state] == 0 else ()
        return (*end, (INSERT, to(0, NEXT[state]), "I"))
    out = [(DELETE, to(1, state), "D"), (INSERT, to(0, NEXT[state]), "I")]
    if letter != "-":
        more = TRUNCATED if letter.isupper() else 0
        kept = _KEPT.get((state, letter.lower()))
        if kept is not None:
            out.append((KEEP + more, to(1, kept), "K"))
        out.append((REROLE + more, to(1, NEXT[state]), "R"))
    return tuple(out)


ARCS = {y: tuple(_arcs(y, s) for s in range(4)) for y in "suaxSUAX-$"}
_LEAST = {y: min(cost for arcs in ARCS[y] for cost, _, edit in arcs if edit != "I") for y in ARCS}


def _auction(letters: str, price: list, origin: int) -> None:
    """Raises prices until ``origin``'s is its distance; nodes that no path leads from have infinite prices."""
    path, end = [origin], 4 * len(letters)
    while path[-1] < end:
        i = path[-1]
        best, there = inf, i
        for cost, step, _ in ARCS[letters[i >> 2]][i & 3]:
            if cost + price[i + step] < best:
                best, there = cost + price[i + step], i + step
        if best > price[i]:
            price[i] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(there)


def _leading(letters: str, price: list, tight: bool) -> list[bool]:
    """Nodes from which arcs (``tight``: that meet their price) lead to the end."""
    n = 4 * len(letters)
    good = [False] * n + [p < inf for p in price[n:]]
    for level in range(n - 4, -1, -4):
        arcs = ARCS[letters[level >> 2]]
        for _ in range(3):  # inserts lead to a node of the same level, two of them at most in a row
            for i in range(level, level + 4):
                if not good[i]:
                    good[i] = any(good[i + step] and (not tight or price[i] == cost + price[i + step])
                                  for cost, step, _ in arcs[i & 3])
    return good


class Window:
    """Settled prices of a window whose end prices are given."""

    __slots__ = ("letters", "price", "good")

    def __init__(self, letters: str, after: tuple):
        self.letters = letters
        least = min(after)
        price: list = [0] * (4 * len(letters)) + list(after)
        for k in range(len(letters) - 1, -1, -1):
            least += _LEAST[letters[k]]
            price[4 * k:4 * k + 4] = [least] * 4
        price = [p if can else inf for p, can in zip(price, _leading(letters, price, False))]
        for origin in range(4):
            if price[origin] < inf:
                _auction(letters, price, origin)
        self.price = price
        self.good = _leading(letters, price, True)

    def start(self) -> tuple:
        return tuple(self.price[:4])

    def trace(self, state: int) -> tuple[str, int]:
        """The least audit from ``state`` on, and the state at the end."""
        i, end, out = state, 4 * len(self.letters), []
        while i < end:
            for cost, step, edit in ARCS[self.letters[i >> 2]][i & 3]:
                if self.good[i + step] and self.price[i] == cost + self.price[i + step]:
                    out.append(edit)
                    i += step
                    break
            else:
                raise AssertionError("no tight arc")
        return "".join(out), i & 3


_WINDOWS: dict[tuple, Window] = {}


def _window(letters: str, after: tuple) -> tuple[Window, float]:
    """The window and what to add to its prices; equal windows are settled once."""
    base = min(after)
    key = (letters, tuple(x - base for x in after))
    got = _WINDOWS.get(key)
    if got is None:
        if len(_WINDOWS) >= REMEMBERED:
            _WINDOWS.clear()
        got = _WINDOWS[key] = Window(*key)
    return got, base


def settle(letters: str, after: tuple) -> tuple[list[Window], tuple]:
    """Windows in order, and the prices of the four states at the start; ``after``: the prices at the end."""
    out = []
    for lo in range((len(letters) - 1) // WINDOW * WINDOW, -1, -WINDOW):
        w, base = _window(letters[lo:lo + WINDOW], after)
        out.append(w)
        after = tuple(base + x for x in w.start())
    return out[::-1], after


def trace(windows: list[Window], state: int) -> tuple[str, int]:
    out = []
    for w in windows:
        audit, state = w.trace(state)
        out.append(audit)
    return "".join(out), state


def repair(letters: str) -> tuple[int, str]:
    """Cost and least audit of a whole sequence."""
    windows, prices = settle(letters + "$", ACCEPTED)
    return prices[NOTHING], trace(windows, NOTHING)[0]


def transfer(letters: str) -> list[list]:
    """Distances of a part of a sequence: from each state at its start (rows) to each at its end."""
    return [list(row) for row in zip(*(settle(letters, tuple(0 if s == end else inf for s in range(4)))[1]
                                       for end in range(4)))]
