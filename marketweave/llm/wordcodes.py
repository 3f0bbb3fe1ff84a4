"""Words as four characters each, so that texts of words can be searched and compared as strings."""

from __future__ import annotations

#: Characters of a word's code, and the code of a word that has none.
SIZE = 4
UNSEEN = "\x20" * SIZE


class WordCodes:
    """Gives every word that is learned a code; nodes of an automaton over codes have at most 64 children."""

    def __init__(self) -> None:
        self.code: dict[bytes, str] = {}

    def learned(self, words: list[bytes]) -> str:
        for w in words:
            if w not in self.code:
                n = len(self.code)
                self.code[w] = "".join(chr(48 + (n >> shift & 63)) for shift in (18, 12, 6, 0))
        return self.of(words)

    def of(self, words: list[bytes]) -> str:
        return "".join([self.code.get(w, UNSEEN) for w in words])


def equal_before(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many words before word i of a equal those before word j of b, looking at so many."""
    n = 0
    while n < most and a[SIZE * (i - n - 1) : SIZE * (i - n)] == b[SIZE * (j - n - 1) : SIZE * (j - n)]:
        n += 1
    return n


def equal_from(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many words from word i of a equal those from word j of b, looking at so many: in steps that double while they hold."""
    n, step = 0, 4
    while n < most and step:
        step = min(step, most - n)
        if a[SIZE * (i + n) : SIZE * (i + n + step)] == b[SIZE * (j + n) : SIZE * (j + n + step)]:
            n, step = n + step, 2 * step
        else:
            most, step = n + step - 1, step // 2
    return n


#: Places of a phrase up to which they are all followed; beyond it only those whose window is met.
FEW = 16


class Crowd:
    """The places of a phrase that many texts share, by the windows round it: an occurrence leads to the places that have a whole window in common with it, and to no others."""

    def __init__(self, places: list[tuple[int, int]], coded: list[str], phrase: int, window: int):
        self.window, self.before = window, window - phrase
        self.by: dict[str, list[tuple[int, int]]] = {}
        for place in places:
            of, at = place
            for first in range(max(0, at - self.before), min(at, len(coded[of]) // SIZE - window) + 1):
                met = self.by.setdefault(coded[of][SIZE * first : SIZE * (first + window)], [])
                if not met or met[-1] != place:
                    met.append(place)

    def met(self, text: str, at: int) -> list[tuple[int, int]]:
        """Places with a window in common with the text's, for the phrase at word `at`."""
        found = [self.by.get(text[SIZE * first : SIZE * (first + self.window)], ()) for first in range(max(0, at - self.before), at + 1)]
        return list(dict.fromkeys(place for places in found for place in places))
