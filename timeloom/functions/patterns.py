"""Filter patterns, as a linear-time engine reads them, for the engine that Spark matches with.

The syntax is that of RE2: what it doesn't have is an error here too, and what the two engines read in different ways is written
out. :func:`translated` goes through a pattern once; groups are kept on a stack, so depth is no matter of recursion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MOST_REPEATS, MOST_DEPTH = 1000, 1000
#: General categories, and ASCII classes by name.
CATEGORIES = frozenset("C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split())
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-\/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_PERL = {"d": "0-9", "s": r"\t\n\f\r ", "w": "0-9A-Za-z_"}
_CONTROLS = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
_ANY, _NONE = r"[\x{0}-\x{10FFFF}]", r"(?!)"
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_NO_EDGE = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
_REPEAT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")
_GROUP = re.compile(r"\(\?P?<([^>]*)>")
_FLAGS = re.compile(r"\(\?([imsU]*)(-[imsU]+)?([:)])")


class PatternError(ValueError):
    pass


@dataclass
class _Group:
    """An open group: what came before the last bar, the items since, and the flags to go back to."""

    opening: str
    flags: frozenset[str]
    branches: list[str] = field(default_factory=list)
    items: list[str] = field(default_factory=list)
    #: For each item how often it repeats what is in it at most, and whether a repeat was the last to be read.
    repeats: list[int] = field(default_factory=list)
    most: int = 1

    def add(self, item: str, repeats: int = 1) -> None:
        self.items.append(item)
        self.repeats.append(repeats)
        self.most = max(self.most, repeats)

    def closed(self) -> str:
        return "|".join([*self.branches, "".join(self.items)])


def _code(c: str | int) -> str:
    return f"\\x{{{ord(c) if isinstance(c, str) else c:X}}}"


class _Reader:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0
        self.scripts: set[str] = set()

    def fail(self, why: str) -> PatternError:
        return PatternError(f"invalid filter pattern: {why} at {self.i} in {self.p}")

    def escape(self) -> int:
        """The character that an escape stands for, in or out of brackets; what else an escape can be has been read before."""
        p, i = self.p, self.i
        c = p[i + 1 : i + 2]
        self.i += 2
        if c in _CONTROLS:
            return _CONTROLS[c]
        if m := re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}").match(p, i + 1):
            self.i = m.end()
            return int(m[0], 8)
        if m := re.compile(r"x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})").match(p, i + 1):
            self.i, value = m.end(), int(m[1] or m[2], 16)
            if value <= 0x10FFFF:
                return value
        elif c and c < "\x80" and not c.isalnum():
            return ord(c)
        self.i = i
        raise self.fail("unknown escape" if c else "a backslash ends it")

    def shorthand(self) -> str | None:
        """The inside of brackets for a class by letter or property, if one comes next."""
        if m := re.compile(r"\\([dswDSW])").match(self.p, self.i):
            self.i = m.end()
            inside = _PERL[m[1].lower()]
            return f"[^{inside}]" if m[1].isupper() else inside
        if m := re.compile(r"\\([pP])(?:\{(\^?)([^}]*)\}|(.))", re.S).match(self.p, self.i):
            name, negative = m[3] if m[4] is None else m[4], (m[1] == "P") != (m[2] == "^")
            if name == "Any":
                inside = _ANY[1:-1]
            elif name in CATEGORIES:
                inside = f"\\p{{{name}}}"
            elif re.fullmatch(r"[A-Z][A-Za-z]+(_[A-Z][A-Za-z]+)*", name):
                self.scripts.add(name)
                inside = f"\\p{{script={name}}}"
            else:
                raise self.fail(f"unknown property {name!r}")
            self.i = m.end()
            return f"[^{inside}]" if negative else inside
        return None

    def brackets(self) -> str:
        """A bracketed class; a negative one is written as what it isn't, then any character."""
        self.i += 1
        negative = self.p.startswith("^", self.i)
        self.i += negative
        parts, first = [], True
        while first or not self.p.startswith("]", self.i):
            first = False
            if self.i >= len(self.p):
                raise self.fail("a bracket is open")
            if m := re.compile(r"\[:(\^?)([^\]]*?):\]").match(self.p, self.i):
                if m[2] not in CLASSES:
                    raise self.fail(f"unknown class {m[2]!r}")
                self.i = m.end()
                parts.append(f"[^{CLASSES[m[2]]}]" if m[1] else CLASSES[m[2]])
                continue
            if (short := self.shorthand()) is not None:
                parts.append(short)
                continue
            low = high = self.character()
            if self.p.startswith("-", self.i) and self.i + 1 < len(self.p) and self.p[self.i + 1] != "]":
                self.i += 1
                high = self.character()
                if high < low:
                    raise self.fail("a range is backwards")
            parts.append(_code(low) if low == high else f"{_code(low)}-{_code(high)}")
        self.i += 1
        inside = "".join(parts)
        return f"(?:(?![{inside}])(?s:.))" if negative else f"[{inside}]"

    def character(self) -> int:
        if self.p.startswith("\\", self.i):
            return self.escape()
        if self.i >= len(self.p):
            raise self.fail("a bracket is open")
        self.i += 1
        return ord(self.p[self.i - 1])

    def translated(self) -> str:
        p, stack, names, repeated = self.p, [_Group("", frozenset())], set(), False
        flags: frozenset[str] = frozenset()

        def put(item: str, fold: bool = False) -> None:
            stack[-1].add(f"(?iu:{item})" if fold and "i" in flags else item)

        while self.i < len(p):
            c, was_repeat, repeated = p[self.i], repeated, False
            if c == "(":
                if len(stack) > MOST_DEPTH:
                    raise self.fail("groups are too deep")
                opening, after = "(", flags
                if p.startswith("(?", self.i):
                    if m := _GROUP.match(p, self.i):
                        if not re.fullmatch(r"[0-9A-Za-z_]+", m[1]) or m[1] in names:
                            raise self.fail(f"the group name {m[1]!r} is bad or there already")
                        names.add(m[1])  # nothing refers to it
                        self.i = m.end()
                    elif m := _FLAGS.match(p, self.i):
                        after = (flags | set(m[1])) - set((m[2] or "")[1:])
                        self.i = m.end()
                        if m[3] == ")":
                            flags = after
                            continue
                        opening = "(?:"
                    else:
                        raise self.fail("a group of another engine")
                else:
                    self.i += 1
                stack.append(_Group(opening, flags))
                flags = after
            elif c == ")":
                if len(stack) == 1:
                    raise self.fail("a group is closed that isn't open")
                self.i += 1
                group = stack.pop()
                flags = group.flags
                stack[-1].add(f"{group.opening}{group.closed()})", group.most)
            elif c == "|":
                self.i += 1
                stack[-1].branches.append("".join(stack[-1].items))
                stack[-1].items, stack[-1].repeats = [], []
            elif c in "*+?" or c == "{" and (m := _REPEAT.match(p, self.i)):
                self.repeat(stack[-1], None if c != "{" else m, was_repeat)
                repeated = True
            elif c == "[":
                put(self.brackets(), True)
            elif c == ".":
                self.i += 1
                put(_ANY if "s" in flags else r"[^\n]")
            elif c == "^":
                self.i += 1
                put(r"(?:\A|(?<=\n))" if "m" in flags else r"\A")
            elif c == "$":
                self.i += 1
                put(r"(?=\n|\z)" if "m" in flags else r"\z")
            elif c == "\\":
                two = p[self.i : self.i + 2]
                if two == r"\Q":
                    end = p.find(r"\E", self.i)
                    for x in p[self.i + 2 : end if end >= 0 else len(p)]:
                        put(_code(x), True)
                    self.i = end + 2 if end >= 0 else len(p)
                elif two == r"\E":
                    self.i += 2
                    repeated = was_repeat
                elif two in (r"\A", r"\z", r"\b", r"\B"):
                    self.i += 2
                    put({r"\b": _EDGE, r"\B": _NO_EDGE}.get(two, two))
                elif (short := self.shorthand()) is not None:
                    put(f"[{short}]", True)
                else:
                    put(_code(self.escape()), True)
            else:
                self.i += 1
                put(c if c.isascii() and c.isalnum() else _code(c), True)
        if len(stack) > 1:
            raise self.fail("a group is open")
        return stack[0].closed()

    def repeat(self, group: _Group, m: re.Match | None, was_repeat: bool) -> None:
        if not group.items:
            raise self.fail("nothing to repeat")
        if was_repeat:
            raise self.fail("a repeat is repeated")
        most = 1
        if m is None:
            text = self.p[self.i]
            self.i += 1
        else:
            low, high = int(m[1]), int(m[3]) if m[3] else None
            if low > MOST_REPEATS or high is not None and not low <= high <= MOST_REPEATS:
                raise self.fail("too many repeats, or fewer at most than at least")
            most, text = max(low, high or 0, 1), m[0]
            self.i = m.end()
        if self.p.startswith("?", self.i):  # which of several matches is found makes no difference to a filter
            self.i += 1
        inner = group.repeats.pop()
        if most * inner > MOST_REPEATS:
            raise self.fail("too many repeats")
        group.add(f"(?:{group.items.pop()}){text}", most * inner)


def translated(pattern: str) -> tuple[str, set[str]]:
    """(the pattern for Java, the names of the scripts that it asks for); :class:`PatternError` if it isn't one."""
    reader = _Reader(pattern)
    return reader.translated(), reader.scripts
