"""For each node of a graph the heaviest clique that holds it, without a look at every clique.

A dense graph has far more maximal cliques than can be listed (millions for 150 nodes), but the largest one of each node
is found by branch and bound: what a branch can still reach is bounded by sets of nodes of which no two are neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator


def bits(x: int) -> Iterator[int]:
    while x:
        yield (low := x & -x).bit_length() - 1
        x ^= low


class Heaviest:
    """Nodes are 0, 1, 2, ..., the heaviest first; near holds their neighbours as bits.

    A clique weighs the sum of its nodes' weights (above 0), and bonus more if one of flagged is in it. Of equally heavy ones
    the one with the greatest name counts; name is asked for a clique as bits.
    """

    def __init__(self, near: list[int], weight: list[int], flagged: int, bonus: int, name: Callable[[int], str]):
        self.near, self.weight, self.flagged, self.bonus, self.name = near, weight, flagged, bonus, name
        self.all = (1 << len(near)) - 1
        self.far = [self.all & ~n & ~(1 << i) for i, n in enumerate(near)]
        self.best: list[tuple[int, str, int]] = [(0, "", 0)] * len(near)  # weight, name, clique

    def weigh(self, clique: int) -> int:
        return sum(self.weight[i] for i in bits(clique)) + (self.bonus if clique & self.flagged else 0)

    def _offer(self, clique: int, weight: int) -> None:
        name = None
        for i in bits(clique):
            if weight >= self.best[i][0]:
                name = name or self.name(clique)
                if (weight, name) > self.best[i][:2]:
                    self.best[i] = (weight, name, clique)

    def _greedy(self, clique: int, open_: int) -> None:
        for i in self.by_reach:
            if open_ >> i & 1:
                clique |= 1 << i
                open_ &= self.near[i]
        self._offer(clique, self.weigh(clique))

    def _beyond(self, open_: int, room: int) -> int:
        """Nodes of open_ such that a clique without any of them weighs less than room: the others' bound is below it.

        No clique holds two nodes of a class, so weights are taken off class by class and add up to a bound.
        """
        far, left, total = self.far, self.weight[:], 0
        while open_:
            rest, members, least = open_, [], -1
            while rest:
                i = (rest & -rest).bit_length() - 1
                members.append(i)
                if least < 0 or left[i] < least:
                    least = left[i]
                rest &= far[i]
            total += least
            if total >= room:
                return open_
            for i in members:
                left[i] -= least
                if not left[i]:
                    open_ ^= 1 << i
        return 0

    def _search(self, chosen: int, open_: int, least: int) -> None:
        """Offers the heaviest cliques of chosen and some of open_ (all neighbours of chosen), all of the same weight, if they weigh least or more."""
        near, far, weight, flagged, bonus = self.near, self.far, self.weight, self.flagged, self.bonus
        stack = [(chosen, open_, self.weigh(chosen))]
        while stack:
            chosen, open_, value = stack.pop()
            again = True
            while again and open_:  # nodes heavier than all that they keep out are in every heaviest clique
                again = False
                look = open_
                while look:
                    bit = look & -look
                    look ^= bit
                    i = bit.bit_length() - 1
                    out = open_ & far[i]
                    if out and (out.bit_count() > 3 or not (chosen | bit) & flagged or sum(weight[k] for k in bits(out)) >= weight[i]):
                        continue
                    value += weight[i] + (bonus if bit & flagged and not chosen & flagged else 0)
                    chosen |= bit
                    open_ &= near[i]
                    look &= open_
                    again = again or out != 0
            if not open_:
                if value >= least:
                    least = value
                    self._offer(chosen, value)
                continue
            room = least - value - (bonus if open_ & flagged and not chosen & flagged else 0)
            if room > 0:
                branch = self._beyond(open_, room)
            else:
                branch = open_
            keep = open_ & ~branch
            for i in sorted(bits(branch), key=lambda k: (open_ & near[k]).bit_count()):
                bit = 1 << i
                branch ^= bit
                stack.append((chosen | bit, (keep | branch) & near[i], value + weight[i] + (bonus if bit & flagged and not chosen & flagged else 0)))

    def run(self, mine: int) -> list[tuple[int, str, int]]:
        """(weight, name, clique) for each node; right for those in mine."""
        reach = [sum(self.weight[k] for k in bits(n)) + w for n, w in zip(self.near, self.weight)]
        self.by_reach = sorted(range(len(reach)), key=lambda i: -reach[i])
        if not mine:
            return self.best
        self._greedy(0, self.all)
        self._search(0, self.all, max(w for w, _, _ in self.best))
        most = max(w for w, _, _ in self.best)
        top = next(c for w, _, c in self.best if w == most)
        open_ = [i for i in bits(mine) if self.best[i][0] < most]
        for i in open_:
            self._greedy(1 << i, self.near[i])
            start = 1 << i | top & self.near[i]
            others = self.near[i]
            for k in bits(start & ~(1 << i)):
                others &= self.near[k]
            self._greedy(start, others)
        settled = 0
        while open_:  # the lightest first: whoever is searched for later needs no node that is settled and in lighter cliques only
            i = min(open_, key=lambda k: self.best[k][0])
            open_.remove(i)
            least = self.best[i][0]
            lighter = sum(1 << k for k in bits(settled) if self.best[k][0] < least)
            self._search(1 << i, self.near[i] & ~lighter, least)
            settled |= 1 << i
        return self.best
