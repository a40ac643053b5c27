"""Texts cut into pre-tokens, each encoded once and looked up when it comes again."""

from collections.abc import Callable, Iterator

import regex

# Characters of a text that are split at once, so a long text is never a long list.
SLICE = 1 << 20


class Store(dict):
    """Words and what ``make`` gives for them, in two generations of at most ``kept`` words each.

    When the young one is full, it becomes the old one.  Words that are used
    again come back from there, so common words stay.
    """

    def __init__(self, make: Callable[[str], bytes], kept: int, longest: int):
        super().__init__()
        self.make, self.kept, self.longest = make, kept, longest
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordSplitter:
    """Encodes texts by their pre-tokens, the matches of ``pattern``, with ``piece`` giving the bytes of one.

    Most words stand between single blanks.  A blank that has no white space
    beside it begins a pre-token whatever stands further away, so such words
    are matched by themselves and looked up when they come again.  This holds
    for patterns whose pre-tokens have a blank only in front, or are white
    space; other texts are matched whole.
    """

    def __init__(self, pattern: str, piece: Callable[[str], bytes], kept: int, longest: int):
        self.pattern = regex.compile(pattern)
        # Words are most of what comes; their parts come again less often.
        self.pieces = Store(piece, kept // 4, longest)
        self.words = Store(self._word, kept, longest)

    def matched(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError("white space beside a blank")
        if word.isalpha():
            # Letters only: one pre-token, which the store of words keeps.
            return self.pieces.make(" " + word)
        return self.matched(" " + word)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.slice, slices(text)))

    def slice(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if first[-1:].isspace():
            return self.matched(text)
        try:
            return self.matched(first) + b"".join(map(self.words.__getitem__, words))
        except LookupError:
            return self.matched(text)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """``text`` in parts of about ``size``, cut before a blank without white space beside it."""
    start, cut = 0, size
    while cut < len(text) - 1:
        cut = text.find(" ", cut)
        if cut < 0:
            break
        if not text[cut - 1].isspace() and not text[cut + 1 : cut + 2].isspace() and cut + 1 < len(text):
            yield text[start:cut]
            start, cut = cut, cut + size
        else:
            cut += 1
    yield text[start:]
