"""Cutting a text where byte-level BPE never joins anything, so that pieces can be remembered."""

import re

_DOUBLE = re.compile(r" \s")
_BOUNDARY = re.compile(r"(?= \S)")
LONGEST = 200  # longer pieces are encoded, not remembered


def units(text):
    """(head, rest): the text is head, then each of rest after a space.

    Both tokenizers' patterns put a space that a non-space follows in front of that word, and no
    other match reaches over it; so each unit is encoded the same alone and in its text."""
    if text.endswith(" ") or _DOUBLE.search(text):
        head, *rest = _BOUNDARY.split(text)
        if head.startswith(" ") and head[1:2].strip():
            return "", [head[1:], *[u[1:] for u in rest]]
        return head, [u[1:] for u in rest]
    head, *rest = text.split(" ")
    return head, rest


class Remembered:
    """Units -> bytes of their ids (little-endian unsigned 32 bits). ``encode`` maps a list of
    strings to such bytes; at most ``most`` units are kept, then the memory starts afresh."""

    def __init__(self, encode, most=600_000, group=20_000):
        self.encode, self.most, self.group = encode, most, group
        self.known = {}

    def _learn(self, unseen):
        unseen = [u for u in unseen if len(u) <= LONGEST]
        self.known.update(zip(unseen, self.encode([" " + u for u in unseen]), strict=True))

    def _ids(self, head, rest):
        known, out = self.known, [self.encode([head])[0]] if head else []
        if rest and max(map(len, rest)) > LONGEST:
            for u in rest:
                out.append(known[u] if len(u) <= LONGEST else self.encode([" " + u])[0])
            return b"".join(out)
        return b"".join(out) + b"".join(map(known.__getitem__, rest))

    def __call__(self, texts):
        """An iterator over the ids of each text. Texts are read in groups of about ``group``
        units, so that encoding works on many at once and no group's size grows with the data;
        a text of more units is read in several goes."""
        held, count, unseen = [], 0, set()
        for text in texts:
            head, rest = units(text)
            if len(rest) > self.group:
                yield from self._flush(held, unseen)
                held, count, unseen = [], 0, set()
                parts = [self._slice(head if not i else "", rest[i : i + self.group])
                         for i in range(0, len(rest), self.group)]
                yield b"".join(parts)
                continue
            held.append((head, rest))
            unseen.update(rest)
            count += len(rest)
            if count >= self.group:
                yield from self._flush(held, unseen)
                held, count, unseen = [], 0, set()
        yield from self._flush(held, unseen)

    def _slice(self, head, rest):
        return next(iter(self._flush([(head, rest)], set(rest))))

    def _flush(self, held, unseen):
        new = unseen.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = unseen
        self._learn(new)
        return [self._ids(head, rest) for head, rest in held]
