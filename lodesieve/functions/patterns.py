r"""Patterns of rules: into Java's dialect, and with every capture's place told.

Rules come in a dialect in which \w and \b are ASCII, $ is the very end, and groups are named (?P<name>...). Spark
gives the text of a group, not where it stands. So all that stands before a capture, at each level, is made a group too:
the lengths of these add up to the capture's offset in the match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

WORD = "A-Za-z0-9_"
EDGE = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
POSIX = {"[:alnum:]": "A-Za-z0-9", "[:alpha:]": "A-Za-z", "[:digit:]": "0-9", "[:xdigit:]": "0-9A-Fa-f", "[:upper:]": "A-Z", "[:lower:]": "a-z", "[:space:]": r"\t-\r\x20", "[:word:]": WORD,
         "[:ascii:]": r"\x00-\x7F", "[:blank:]": r"\t\x20", "[:cntrl:]": r"\x00-\x1F\x7F", "[:graph:]": r"!-~", "[:print:]": r"\x20-~", "[:punct:]": r"!-/:-@\[-`{-~"}


@dataclass(frozen=True)
class Capture:
    """own: its number in the pattern; group: in the opened one; before: the groups whose lengths make its offset."""

    own: int
    group: int
    before: tuple[int, ...]


def tokens(pattern: str) -> list[str]:
    """Escapes, classes, the openings of groups, and single characters."""
    out, at = [], 0
    while at < len(pattern):
        c, end = pattern[at], at + 1
        if c == "\\":
            end = at + 2
            if pattern[at + 1 : at + 2] in ("x", "p", "P", "u") and pattern[at + 2 : at + 3] == "{":
                end = pattern.index("}", at) + 1
        elif c == "[":
            depth, end = 1, at + 1
            if pattern[end : end + 1] == "^":
                end += 1
            if pattern[end : end + 1] == "]":
                end += 1
            while depth:
                if end >= len(pattern):
                    raise ValueError(f"a class has no end: {pattern}")
                depth += (pattern[end] == "[") - (pattern[end] == "]")
                end += 2 if pattern[end] == "\\" else 1
        elif pattern.startswith("(?", at):
            end = at + 2
            while end < len(pattern) and pattern[end] not in ":)=!>":
                end += 1
            end += 1
        out.append(pattern[at:end])
        at = end
    return out


def to_java(pattern: str) -> str:
    """ValueError for what Java has not, or means otherwise and can't be told: the flags for swapped greed and for line ends of two characters, unknown classes."""
    out, parts = [], tokens(pattern)
    flags = "".join(t[2:-1].partition("-")[0] for t in parts if t.startswith("(?") and t[2:3] not in "P<=!")
    if extra := set(flags) - set("ims:u"):
        raise ValueError(f"flags {sorted(extra)} are not supported: {pattern}")
    for t in parts:
        if t.startswith("["):
            for name, chars in POSIX.items():
                t = t.replace(name, chars).replace(name.replace("[:", "[:^"), f"[^{chars}]")
            if re.search(r"\[:\^?[a-z]+:\]", t):
                raise ValueError(f"an unknown class: {t}")
            t = t.replace(r"\w", WORD)
        elif t == r"\w":
            t = f"[{WORD}]"
        elif t == r"\W":
            t = f"[^{WORD}]"
        elif t == r"\b":
            t = EDGE
        elif t == "$":
            t = r"(?=\n|\z)" if "m" in flags else r"\z"
        elif t.startswith("(?P<") or t.startswith("(?<") and t[3:4] not in "=!":
            t = "("  # nothing refers to a name, and Java allows fewer of them
        elif t.startswith("(?") and "-u" in t:
            t = "(?:" if t.endswith(":") else ""
        elif t.startswith(r"\x{"):
            t = "\\" + t[1:]
        out.append(t)
    # Of line ends only that of Unix counts, for dots and for beginnings of lines.
    return ("(?d)" if "." in parts or "m" in flags else "") + "".join(out)


def captures(t: str) -> bool:
    return t == "(" or t.startswith("(?<") and t.endswith(">")


@dataclass
class Node:
    """A group, or a piece of pattern (head None). branches: of its alternatives the items in order."""

    head: str | None
    text: str
    branches: list[list[Node]]
    repeat: str = ""

    def holds(self) -> bool:
        """Whether a capture is, or stands in, it."""
        return self.head is not None and (captures(self.head) or any(n.holds() for b in self.branches for n in b))


def tree(pattern: str) -> Node:
    root = Node("", "", [[]])
    stack, parts, at = [root], tokens(pattern), 0
    while at < len(parts):
        t = parts[at]
        at += 1
        here = stack[-1].branches[-1]
        if t.startswith("(") and not (t.startswith("(?") and t.endswith(")")):
            stack.append(Node(t, "", [[]]))
            here.append(stack[-1])
        elif t == ")":
            if len(stack) < 2:
                raise ValueError(f"a group has no beginning: {pattern}")
            stack.pop()
        elif t == "|":
            stack[-1].branches.append([])
        elif here and (t in ("*", "+", "?") or t == "{" and (at < len(parts) and (parts[at].isdigit() or parts[at] == ","))):
            while t == "{" or "{" in t and "}" not in t:
                t += parts[at]
                at += 1
            while at < len(parts) and parts[at] in ("?", "+"):
                t += parts[at]
                at += 1
            here[-1].repeat += t
        else:
            here.append(Node(None, t, []))
    if len(stack) > 1:
        raise ValueError(f"a group has no end: {pattern}")
    return root


def opened(pattern: str) -> tuple[str, list[Capture]]:
    """The pattern with groups before its captures, and the captures in their order. A capture within a repetition, or within a lookaround, has no place: an error.

    Of captures within captures the inner ones have none either, and are left out: an outer one is chosen before them.
    """
    found: list[Capture] = []
    count = seen = 0

    def plain(n: Node) -> str:
        nonlocal count, seen
        if n.head is None:
            return n.text + n.repeat
        count += captures(n.head)
        seen += captures(n.head)
        return n.head + "|".join("".join(map(plain, b)) for b in n.branches) + ")" + n.repeat

    def branch(items: list[Node], before: tuple[int, ...]) -> str:
        nonlocal count
        out, run = [], []

        def close() -> None:
            nonlocal count, before
            flags = [n for n in run if n.head is None and n.text.startswith("(?")]
            rest = [n for n in run if not (n.head is None and n.text.startswith("(?"))]
            if flags and rest and run[: len(flags)] != flags:
                raise ValueError(f"flags within a pattern with captures: {pattern}")
            out.append("".join(map(plain, flags)))
            if rest:
                count += 1
                before = (*before, count)
                out.append("(" + "".join(map(plain, rest)) + ")")
            run.clear()

        for n in items:
            if not n.holds():
                run.append(n)
                continue
            if n.repeat not in ("", "?", "??", "?+") or n.head.startswith(("(?=", "(?!", "(?<=", "(?<!")):
                raise ValueError(f"a capture within a repetition or lookaround: {pattern}")
            close()
            if captures(n.head):
                number = count + 1
                found.append(Capture(seen + 1, number, before))
                out.append(plain(n))
                before = (*before, number)
            else:
                # A group around all of it tells its length to what follows.
                count += 1
                own = count
                inner = [branch(b, before) for b in n.branches]
                out.append("(" + n.head + "|".join(inner) + ")" + n.repeat + ")")
                before = (*before, own)
        out.append("".join(map(plain, run)))
        return "".join(out)

    root = tree(pattern)
    if not any(n.holds() for b in root.branches for n in b):
        return pattern, []
    return "|".join(branch(b, ()) for b in root.branches), found
