"""Alternations rearranged for a backtracking engine: the same matches, fewer alternatives tried at each place.

A list of words such as ``adopt|choose|选择`` is tried word by word at every character of a text.  ``by_head`` puts
words with one first character together and those that begin beyond ASCII behind one test, so that a place costs one
test for each first character.  Words of different first characters never match at one place, so their order is free.
"""

from __future__ import annotations

import re
from functools import cache

#: What makes the character before it optional or repeated.
QUANTIFIERS = "?*+{"
BEYOND_ASCII = r"[\x{80}-\x{10FFFF}]"


def alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern."""
    out, depth, in_class, at, k = [], 0, False, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[at:k])
            at = k + 1
        k += 1
    return [*out, pattern[at:]]


def leading_group(alternative: str) -> tuple[str, str] | None:
    """Inside and rest of an alternative that begins with a plain group, unless the group may repeat or be left out."""
    if not alternative.startswith("(?:"):
        return None
    for end in (k for k, c in enumerate(alternative) if c == ")"):
        inside, rest = alternative[3:end], alternative[end + 1 :]
        plain = re.sub(r"\[[^\[\]()|\\]*\]", "", inside)
        if inside.count("(") == inside.count(")") and "[" not in plain and "\\" not in plain:
            return None if rest[:1] and rest[0] in QUANTIFIERS else (inside, rest)
    return None


def words(pattern: str) -> list[str]:
    """The alternatives, those with a leading group written out."""
    out = []
    for a in alternatives(pattern):
        group = leading_group(a)
        out += [w + group[1] for w in words(group[0])] if group else [a]
    return out


def head(word: str) -> str | None:
    """What the first character may be, as part of a character class, if it is one letter or digit, any digit, or a dot, and must be there."""
    for start, of in ((r"\.", r"\."), ("[0-9]", "0-9")):
        if word.startswith(start):
            return None if word[len(start) : len(start) + 1] in ("?", "*") or word[len(start) :].startswith("{0") else of
    return word[0] if word and (word[0].isalnum() or ord(word[0]) > 127) and not (len(word) > 1 and word[1] in QUANTIFIERS) else None


@cache
def by_head(pattern: str) -> str:
    """A pattern with the same matches; the pattern itself if what its alternatives begin with is unknown or overlaps."""
    every = words(pattern)
    heads = [head(w) for w in every]
    if len(every) < 4 or None in heads or ("0-9" in heads and any(h.isdigit() for h in heads)):
        return pattern
    wide = [w for w, h in zip(every, heads) if ord(h[0]) > 127]
    near = list(dict.fromkeys(h for h in heads if ord(h[0]) < 128))
    of = lambda h: [w for w, x in zip(every, heads) if x == h]
    grouped = [f"{h}(?:{'|'.join(w[1:] for w in of(h))})" if len(h) == 1 else f"(?=[{h}])(?:{'|'.join(of(h))})" for h in near]
    grouped += [f"(?={BEYOND_ASCII})(?:{'|'.join(wide)})"] if wide else []
    first = "[" + "".join(near) + (BEYOND_ASCII[1:-1] if wide else "") + "]"
    return f"(?={first})(?:{'|'.join(grouped)})"
