"""Column helpers for text: patterns with Python's meaning, lines, first hits and offsets.

Patterns here run in Java, where ``(?d)`` makes only the line feed end a line. Classes are ASCII, which is
several times as fast as Java's Unicode classes: ``plain_spaces`` first turns the other white space
into spaces, so ``\\s`` means the same. No match is null everywhere, never an empty string.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT, FOLDED = "(?d)", "(?id)"
#: White space beyond ASCII, and the ASCII separators that a str.split() also splits at.
ODD_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u0085"


_BUILT: dict = {}


def once(make: Callable, *args):
    """make(*args), built once per session's JVM: each node of a large expression is a call to it, and expressions hold no data."""
    key = (make.__module__, make.__qualname__, make.__code__.co_firstlineno, args, id(SparkContext._gateway))
    if key not in _BUILT:
        _BUILT[key] = make(*args)
    return _BUILT[key]


def plain_spaces(text: Column) -> Column:
    """text with other white space as spaces; a text of ASCII alone has none and is not rewritten."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, ODD_SPACES, " " * len(ODD_SPACES)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. Higher-order functions are interpreted, so what is inside can't outgrow a generated method."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def const_array(values: list[str]) -> Column:
    """A constant array of texts as one literal, which analysis sees as a single node."""
    return F.split(F.lit("\x1f".join(values)), "\x1f", -1)


def const_map(values: dict[str, str]) -> Column:
    """A constant map of texts."""
    return F.map_from_arrays(const_array(list(values)), const_array(list(values.values())))


def mentioning(low: Column, words: tuple[str, ...], value: Column) -> Column:
    """value where the lower-cased text has one of the words, else null; spares patterns that can't match."""
    some = low.contains(words[0])
    for w in words[1:]:
        some = some | low.contains(w)
    return F.when(some, value)


class Labels:
    """Dispatch by label: where each of some words first stands in a text, looked up once for all rules.

    ``index`` is an array with, for each word, the 1-based place at which the first line with it begins, 0 without any. A rule that has
    to begin on a line with one of its words searches from the earliest of those places (``behind``), and not at all where there is none.
    Words are ASCII, and folded as patterns fold them. A few letters grow when lower-cased; in a text with one, lines with a word count from the text's start.
    """

    def __init__(self, text: Column, index: Column, words: list[str]):
        self.text, self.index, self.words = text, index, words

    @staticmethod
    def index(text: Column, words: list[str]) -> Column:
        def place(low: Column, same: Column, word: Column) -> Column:
            head = lambda p: F.substring(low, F.lit(1), p - 1)
            # contains is several times as fast as position, and most words are absent
            return let(F.when(F.contains(low, word), F.position(word, low)).otherwise(0), lambda p: F.when(p < 2, p).when(same, p - F.char_length(F.substring_index(head(p), "\n", -1))).otherwise(1))

        return let(F.lower(text), lambda low: let(F.char_length(low) == F.char_length(text), lambda same: F.transform(const_array(words), lambda w: place(low, same, w))))

    def at(self, *words: str) -> Column:
        """Where the first line with one of the words begins, or null."""
        places = [F.get(self.index, self.words.index(w)) for w in words]
        return F.nullif(places[0], F.lit(0)) if len(places) == 1 else F.array_min(F.filter(F.array(*places), lambda p: p > 0))

    def has(self, *words: str) -> Column:
        return self.at(*words).isNotNull()

    def behind(self, words: tuple[str, ...], body: Callable[[Column], Column]) -> Column:
        """body of the text from the first line with one of the words; null without any."""
        return let(self.at(*words), lambda p: F.when(p.isNotNull(), let(F.substring(self.text, p, F.lit(1 << 30)), body)))

    def first_of(self, rules: list[tuple[tuple[str, ...], str]], guard: Callable[[Column], Column] | None = None, clean: Callable[[Column], Column] | None = None) -> Column:
        """first_of where each pattern comes with the words that it can begin with."""
        return F.coalesce(*[self.behind(words, lambda t, p=p: first_of(t, p, guard=guard, clean=clean)) for words, p in rules])


class Mentioned:
    """Dispatch by label as plain columns: a rule runs on a whole text that has one of its words, and not at all on others.

    ``low`` is the text lower-cased; a word that begins with ``_`` is the name of a column that says whether a rule can match. Unlike ``Labels`` nothing here is a higher-order function, so rules are compiled and those nothing asks for are left out of the plan.
    """

    def __init__(self, text: Column, low: Column):
        self.text, self.low = text, low

    def has(self, *words: str) -> Column:
        return reduce(lambda a, b: a | b, [F.col(w) if w.startswith("_") else self.low.contains(w) for w in words])

    def behind(self, words: tuple[str, ...], body: Callable[[Column], Column]) -> Column:
        """body of a text with one of the words; null without any."""
        return F.when(self.has(*words), body(self.text))

    def first_of(self, rules: list[tuple[tuple[str, ...], str]], guard: Callable[[Column], Column] | None = None, clean: Callable[[Column], Column] | None = None) -> Column:
        """first_of where each pattern comes with the words that it can begin with."""
        return F.coalesce(*[self.behind(words, lambda t, p=p: first_of(t, p, guard=guard, clean=clean)) for words, p in rules])


def strip(c: Column | str) -> Column:
    """Without white space at either end, line feeds included."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def filled(c: Column) -> Column:
    """Null where empty; the value is computed once, and not in a higher-order function."""
    return F.get(F.array_remove(F.array(c), ""), 0)


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def find(text: Column, pattern: str, group: int = 1, flags: str = FOLDED) -> Column:
    """The group of the first match, or null. The text is searched once: nullif would be planned as a search for the test and another for the value."""
    return filled(F.regexp_extract(text, flags + pattern, group))


def has(text: Column, pattern: str, flags: str = FOLDED) -> Column:
    return text.rlike(flags + pattern)


def sub(text: Column, pattern: str, replacement: str, flags: str = FOLDED) -> Column:
    return F.regexp_replace(text, flags + pattern, replacement)


def find_all(text: Column, pattern: str, group: int = 1, flags: str = FOLDED) -> Column:
    """The group of every match, in order; an empty array without any."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group)), F.array().cast("array<string>"))


def first_of(text: Column, *patterns: str, guard: Callable[[Column], Column] | None = None, clean: Callable[[Column], Column] | None = None, flags: str = FOLDED) -> Column:
    """Pattern by pattern over the whole text: the first whose value passes the guard."""
    arms = []
    for p in patterns:
        value = find(text, p, flags=flags)
        if clean:
            value = let(value, clean)
        arms.append(let(value, lambda v: F.when(guard(v), v)) if guard else value)
    return F.coalesce(*arms)


def on_line(pattern: str) -> str:
    """The pattern with white space that doesn't cross a line end."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(r" \t\r\f\x0B " if inside else r"[ \t\r\f\x0B ]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        if two[0] in "[]":
            inside = two[0] == "["
        out.append(two[0])
        i += 1
    return "".join(out)


def line_first(text: Column, *patterns: str, guard: Callable[[Column], Column] | None = None, clean: Callable[[Column], Column] | None = None, head: str | None = None) -> Column:
    """Line by line: on the earliest line that any pattern matches, the first such pattern's value.

    A pattern may span lines where it says ``\\n``. Each has one group. ``head``: what the first line of every match has; lines without it are passed over in one search for all patterns.
    """
    arms = [on_line(p) for p in patterns]
    if len(arms) == 1:
        # the first match stands on the earliest line
        value = find(text, f"(?m){arms[0]}")
    else:
        # the whole text is searched once; which arm it was is found in the short match
        known = f"(?=[^\\n]*?(?:{on_line(head)}))" if head else ""
        whole = find(text, f"(?m)^{known}(?:" + "|".join(f"[^\\n]*?{a}" for a in arms) + ")", 0)
        value = let(whole, lambda m: F.when(m.isNotNull(), F.coalesce(*[find(m, f"^[^\\n]*?{a}") for a in arms])))
    value = let(value, clean) if clean else value
    return let(value, lambda v: F.when(guard(v), v)) if guard else value


def label_line(label: str, value: str, ahead: int = 1) -> str:
    """A pattern for a line that is only a label, with the value on one of the next lines."""
    between = "(?:[^\\n]*\\n){0,%d}?" % (ahead - 1) if ahead > 1 else ""
    return rf"^\s*{label}\s*\n{between}[\s:|\-]*{value}"


def lines_of(text: Column) -> Column:
    """All lines, trimmed."""
    return F.transform(F.split(text, "\n", -1), lambda line: sub(line, r"^\s+|\s+$", "", EXACT))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    # lower-cased once: inside a higher-order function a repeated expression is evaluated again
    return let(F.lower(text), lambda low: reduce(lambda out, w: out | low.contains(w), words, F.lit(False)))


#: So many matches are summed by appending to what is there.
BLOCK = 64


def match_places(text: Column, pattern: str, flags: str = FOLDED) -> Column:
    """(at, match) of all matches in order, at 0-based; the text is searched once, each piece up to a match's end."""
    pieces = F.coalesce(F.regexp_extract_all(text, F.lit(f"{flags}\\G(?s:.*?)(?:{pattern})"), F.lit(0)), F.array().cast("array<string>"))
    # groups of the pattern keep their numbers, so what lies before a match is what is left without it
    found = F.transform(pieces, lambda p: let(F.regexp_extract(p, f"{flags}\\A(?s:.*?)((?:{pattern}))\\z", 1), lambda m: F.struct(F.char_length(p).alias("long"), m.alias("match"))))
    ends = lambda acc, x: F.struct((acc["end"] + x["long"]).alias("end"), F.concat(acc["out"], F.array(F.struct((acc["end"] + x["long"] - F.char_length(x["match"])).alias("at"), x["match"].alias("match")))).alias("out"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,match:string>>").alias("out"))
    summed = lambda part: F.aggregate(part, start, ends)

    def blocks(found: Column) -> Column:
        """Appending copies what is there, so long results are summed in blocks, and then the blocks."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda i: summed(F.slice(found, i * BLOCK + 1, F.lit(BLOCK))))
        before = lambda parts: F.aggregate(parts, F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["end"] + x["end"]).alias("end"), F.concat(acc["out"], F.array(acc["end"])).alias("out")), lambda acc: acc["out"])
        return let(parts, lambda parts: F.flatten(F.zip_with(parts, before(parts), lambda x, n: F.transform(x["out"], lambda z: F.struct((z["at"] + n).alias("at"), z["match"].alias("match"))))))

    return F.when(text.isNotNull(), let(found, lambda found: F.when(F.size(found) > BLOCK, blocks(found)).otherwise(summed(found)["out"])))


def match_starts(text: Column, pattern: str, flags: str = FOLDED) -> Column:
    """0-based offsets of all matches."""
    return F.transform(match_places(text, pattern, flags), lambda z: z["at"])


def strip_lead(c: Column) -> Column:
    """Without leading colons, bars, dashes and white space."""
    return sub(sub(c, r"^[\s:|\-]+", "", EXACT), r"\s+$", "", EXACT)


def trim_tail(c: Column, chars: str = r"\.,;|/ ") -> Column:
    """Trimmed, and without trailing characters of a class."""
    return sub(sub(c, r"^\s+|\s+$", "", EXACT), f"[{chars}]+$", "", EXACT)


def squeeze(c: Column) -> Column:
    return strip(sub(c, r"\s+", " ", EXACT))
