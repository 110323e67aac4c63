"""Words of texts inside Python kernels."""

from __future__ import annotations

from collections.abc import Callable

#: Words whose values are kept, some 35 MB of them.
_WORDS = 1 << 18
#: Bytes between words read as spaces, those of letters beyond ASCII among them.
_SPACED = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def words_of(text: str) -> list[str]:
    """Runs of a-z and 0-9 of a lower-cased text, as findall of [a-z0-9]+ gives them; in one pass over its bytes, without a regex."""
    return text.encode().translate(_SPACED).decode("ascii").split()


class Known(dict):
    """Value of each word, made the first time it is met. Starts anew at _WORDS words, so that it does not grow with the rows."""

    def __init__(self, make: Callable[[str], object]):
        self._make = make

    def __missing__(self, word: str):
        if len(self) >= _WORDS:
            self.clear()
        found = self[word] = self._make(word)
        return found
