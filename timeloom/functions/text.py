"""Text expressions that agree with byte-oriented formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_REGEX_BYTES = 65_536
_MARK = "\x01\x17\x01"


#: Named classes within brackets.
NAMED_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}


def java_regex(pattern: str) -> str:
    """A pattern written for a linear-time engine, for Java.

    ``.`` excludes line feeds alone, ``$`` is the very end unless lines are matched, ``\\s`` has no vertical tab, named groups are
    ``(?P<name>...)``, brackets hold ``[:class:]`` names, and an open bracket or ``&&`` in brackets is just that.
    """
    out, in_class, i = [], False, 0
    by_line = [False]  # whether $ matches at line ends, by open group
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern.startswith(r"\Q", i):
                end = pattern.find(r"\E", i)
                end = len(pattern) if end < 0 else end + 2
                out.append(pattern[i:end])
                i = end
                continue
            two = pattern[i : i + 2]
            out.append({r"\s": r"\t\n\f\r " if in_class else r"[\t\n\f\r ]", r"\S": two if in_class else r"[^\t\n\f\r ]"}.get(two, two))
            i += 2
            continue
        if in_class:
            named = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
            if named and named[2] in NAMED_CLASSES:
                name = NAMED_CLASSES[named[2]]
                out.append((name[0] + name[1].swapcase() + name[2:]) if named[1] else name)
                i += named.end()
                continue
            if c == "]":
                in_class = False
            elif c == "[" or pattern.startswith("&&", i):
                c = "\\" + c
        elif c == "[":
            in_class = True
            for more in ("^", "]"):  # a closing bracket that comes first is one of the characters
                if pattern[i + 1 : i + 2] == more:
                    c, i = c + more.replace("]", "\\]"), i + 1
        elif c == "(":
            flags = re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]*)?([:)])", pattern[i:])
            now = by_line[-1]
            if flags:
                now = "m" in flags[1] or (now and "m" not in (flags[2] or ""))
            if flags and flags[3] == ")":
                by_line[-1] = now
                out.append(flags[0])
                i += flags.end()
                continue
            by_line.append(now)
            if pattern.startswith("(?P<", i):
                c, i = "(?<", i + 3
        elif c == ")":
            if len(by_line) > 1:
                by_line.pop()
        elif c == "$" and not by_line[-1]:
            c = r"\z"
        out.append(c)
        i += 1
    return "(?du)" + "".join(out)


def groups(line: Column, pattern: str) -> Column:
    """The groups of an anchored pattern as an array, null where it doesn't match; one match a line, however many groups.

    A line feed is between the groups, which a line hasn't, as splitting at one character takes no pattern; in texts that have one it is a mark.
    """
    n = re.compile(pattern).groups
    by = lambda f: F.when(line.contains("\n"), f(_MARK)).otherwise(f("\n"))
    marked = F.regexp_replace(line, F.lit(java_regex(pattern)), by(lambda mark: "".join(f"{mark}${i}" for i in range(1, n + 1))))
    parts = F.split(marked, by(lambda mark: mark), -1)
    # Both tests are of the parts: what is read more than once before a branch is evaluated once for it too.
    return F.when((F.size(parts) == n + 1) & (parts[0] == ""), F.slice(parts, 2, n))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match anywhere, empty where there is none or it took no part."""
    return F.regexp_extract(c, java_regex(pattern), group)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(java_regex(pattern))


def truncated(line: Column, most: int = MAX_REGEX_BYTES) -> Column:
    """At most ``most`` bytes; a character cut apart becomes a replacement character."""
    return F.when(F.octet_length(line) > most, head_bytes(line, most)).otherwise(line)


def head_bytes(c: Column, n: int) -> Column:
    return F.call_function("decode", F.substring(F.encode(c, "UTF-8"), 1, n), F.lit("UTF-8"))


def cut_bytes(c: Column, limit: int, keep: int) -> Column:
    """The first ``keep`` bytes and an ellipsis where there are more than ``limit``."""
    return F.when(F.octet_length(c) > limit, F.concat(head_bytes(c, keep), F.lit("..."))).otherwise(c)


def tail_bytes(c: Column, limit: int, keep: int) -> Column:
    """An ellipsis and the last ``keep`` bytes where there are more than ``limit``."""
    last = F.call_function("decode", F.substring(F.encode(c, "UTF-8"), -keep, keep), F.lit("UTF-8"))
    return F.when(F.octet_length(c) > limit, F.concat(F.lit("..."), last)).otherwise(c)


def trimmed(c: Column) -> Column:
    """Without white space at either end, line breaks and tabs included."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def known(c: Column) -> Column:
    """Null where empty."""
    return F.nullif(c, F.lit(""))


def labelled(label: str, c: Column, after: str = "") -> Column:
    """``label`` and the value, null where the value is null or empty; for :func:`pyspark.sql.functions.concat_ws`."""
    return F.concat(F.lit(label), known(c), F.lit(after))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+\z", 0)


def evaluated(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, which are evaluated once a row however often what follows reads them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
