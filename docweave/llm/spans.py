"""Spans by kind, as the finders of personal data and secrets give them."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the kinds' order, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def replaced(text: str, spans: list[Span], by: str = "<{}>") -> str:
    """text with every span, or run of overlapping spans, in place of which stands the first one's kind."""
    out, last = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], by.format(k.upper())]
        last = max(last, b)
    return "".join([*out, text[last:]])
