"""Java text for Python patterns, emitted from the parsed tree.

``java_pattern`` writes a pattern that Spark's (Java's) engine matches as Python's ``re`` does, or
gives None where there is none, so that the caller runs it in Python:

* ``\\w``, ``\\d``, ``\\s``, their complements and ``\\b`` become explicit classes with Python's members
  (``(?a)`` included).  Characters on which the two Unicode tables differ are found once a session by asking Java.
* ``\\b`` before a character that is surely a word's, or surely not, looks at the character before it alone;
  a loop over one character keeps what it took where what follows can't begin with it.
* ``.``, ``^``, ``$``, ``\\A``, ``\\Z`` and the inline flags become classes and look-arounds, so
  no Java flag is set; with ``(?i)`` a class lists all members that Python finds.
* A loop whose body is more than one character recurses in Java, once an iteration, and a long text
  ends the JVM with a stack overflow.  Such an unbounded loop becomes possessive, which Java walks without
  recursion, where that can't change a match: no part of the body has another way to match, and what
  follows can't begin with a character that begins the body (or always matches).  A body of fixed length without
  alternatives is also walked without recursion.  Any other such loop is left to Python.

Sets of characters are arrays over all code points, filled by running ``re`` itself on them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark import SparkContext

try:  # Python 3.11+
    import re._parser as _parser  # type: ignore[import-not-found]
    import re._constants as _c  # type: ignore[import-not-found]
except ImportError:  # pragma: no cover
    import sre_parse as _parser  # type: ignore[no-redef]
    import sre_constants as _c  # type: ignore[no-redef]

#: Every code point but the surrogates, which no text of Spark's holds.
_POINTS = [*range(0xD800), *range(0xE000, 0x110000)]
_BMP = 0x10000 - 0x800
#: Iterations of a bounded loop that may nest in Java's stack.
NESTED = 1000
#: Ranges that a class may list.
RANGES = 200
#: Ranges of characters that are looked for before a word boundary is.
FEW = 8

_CATEGORIES = {_c.CATEGORY_WORD: r"\w", _c.CATEGORY_DIGIT: r"\d", _c.CATEGORY_SPACE: r"\s",
               _c.CATEGORY_NOT_WORD: r"\W", _c.CATEGORY_NOT_DIGIT: r"\D", _c.CATEGORY_NOT_SPACE: r"\S"}
#: ASCII first; what tells other characters is only asked of those.
_JAVA_BASE = {r"\w": r"A-Za-z0-9_[\x{80}-\x{10FFFF}&&[\p{L}\p{N}]]", r"\d": r"0-9[\x{80}-\x{10FFFF}&&\p{Nd}]"}
_CHARS = (_c.LITERAL, _c.NOT_LITERAL, _c.ANY, _c.IN)
_REPEATS = {_c.MAX_REPEAT: "", _c.MIN_REPEAT: "?"} | ({_c.POSSESSIVE_REPEAT: "+"} if hasattr(_c, "POSSESSIVE_REPEAT") else {})
_ATOMIC = getattr(_c, "ATOMIC_GROUP", None)

#: What can stand next: the characters it can begin with, and whether it matches whatever they are.
Next = tuple[np.ndarray, bool]


class NoJava(Exception):
    """Java can't match this as Python does, or not safely."""


@lru_cache(maxsize=1)
def _all_text() -> str:
    return "".join(map(chr, _POINTS))


def _inline(flags: int) -> int:
    return flags & (re.IGNORECASE | re.DOTALL | re.ASCII)


@lru_cache(maxsize=256)
def _spans(text: str, flags: int) -> tuple[tuple[int, int], ...]:
    return tuple(m.span() for m in re.compile(f"(?:{text})+", flags).finditer(_all_text()))


@lru_cache(maxsize=64)
def members(text: str, flags: int = 0) -> np.ndarray:
    """Which code points (by their place among all) a one-character pattern matches."""
    out = np.zeros(len(_POINTS), dtype=bool)
    for lo, hi in _spans(text, flags):
        out[lo:hi] = True
    return out


def _nothing() -> np.ndarray:
    return np.zeros(len(_POINTS), dtype=bool)


def _anything() -> Next:
    return ~_nothing(), False


def _point(c: int) -> str:
    return chr(c) if chr(c).isascii() and chr(c).isalnum() else f"\\x{{{c:X}}}"


def _listed(spans) -> str:
    return "".join(_point(_POINTS[lo]) + ("" if hi - lo == 1 else "-" + _point(_POINTS[hi - 1])) for lo, hi in spans)


def _ranges(found: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


@lru_cache(maxsize=8)
def _unicode_class(text: str, asked: int) -> str:
    """Inside of a Java class with the members of ``\\w`` or ``\\d``; ``asked`` tells one JVM from another."""
    base = _JAVA_BASE[text]
    sc = SparkContext._active_spark_context
    if sc is None:
        return base
    has = sc._jvm.java.util.regex.Pattern.compile(f"[^{base}]").matcher(_all_text()).replaceAll("")
    points = np.frombuffer(has.encode("utf-32-le"), "<u4").astype(np.int64)
    java = _nothing()
    java[points - np.where(points >= 0xE000, 0x800, 0)] = True
    python = members(text)

    more, less = _listed(_ranges(python & ~java)), _listed(_ranges(java & ~python))
    if less:
        base = f"[{base}]&&[^{less}]"
        return f"[{base}]" + more
    first = np.flatnonzero(python & ~java)
    return base + (f"[{_point(_POINTS[first[0]])}-\\x{{10FFFF}}&&[{more}]]" if more else "")


def _category(text: str, flags: int) -> str:
    """Inside of a Java class with the members of ``\\w``, ``\\d`` or ``\\s``, or a nested class with those of their complements."""
    if text[1].isupper():
        return f"[^{_category(text.lower(), flags)}]"
    if text == r"\s" or flags & re.ASCII:
        spans = _spans(text, flags & re.ASCII)
        rest = [x for x in spans if x[0] >= 0x80]
        return _listed(x for x in spans if x[0] < 0x80) + (f"[\\x{{80}}-\\x{{10FFFF}}&&[{_listed(rest)}]]" if rest else "")
    return _unicode_class(text, id(SparkContext._active_spark_context))


def _python_char(op, av) -> str:
    """The Python text of a node that matches one character."""
    if op is _c.ANY:
        return "."
    if op in (_c.LITERAL, _c.NOT_LITERAL):
        return f"[{'^' if op is _c.NOT_LITERAL else ''}\\U{av:08x}]"
    inside = ""
    for kind, x in av:
        if kind is _c.NEGATE:
            inside += "^"
        elif kind is _c.LITERAL:
            inside += f"\\U{x:08x}"
        elif kind is _c.RANGE:
            inside += f"\\U{x[0]:08x}-\\U{x[1]:08x}"
        else:
            inside += _CATEGORIES[x]
    return f"[{inside}]"


def _any_case(items: list, flags: int) -> str:
    spans = _spans(_python_char(_c.IN, items), _inline(flags))
    if len(spans) > RANGES:
        raise NoJava("a class with very many members")
    return _listed(spans)


def _java_char(op, av, flags: int) -> str:
    if op is _c.ANY:
        return "(?s:.)" if flags & re.DOTALL else r"[^\n]"
    if op in (_c.LITERAL, _c.NOT_LITERAL):
        one = _any_case([(_c.LITERAL, av)], flags) if flags & re.IGNORECASE else _point(av)
        return f"[^{one}]" if op is _c.NOT_LITERAL else one if one == _point(av) else f"[{one}]"
    negated = av[0][0] is _c.NEGATE
    inside = ""
    for kind, x in av[negated:]:
        if flags & re.IGNORECASE and kind is not _c.CATEGORY:
            inside += _any_case([(kind, x)], flags)
        elif kind is _c.LITERAL:
            inside += _point(x)
        elif kind is _c.RANGE:
            inside += f"{_point(x[0])}-{_point(x[1])}"
        else:
            inside += _category(_CATEGORIES[x], flags)
    return f"[{'^' if negated else ''}{inside}]"


def _set(op, av, flags: int) -> np.ndarray:
    return members(_python_char(op, av), _inline(flags))


def _group_flags(av, flags: int) -> int:
    return (flags | av[1]) & ~av[2]


def _first(items: list, flags: int, after: Callable[[], Next]) -> Next:
    """What a sequence of nodes, and then ``after``, can begin with."""
    if not items:
        return after()
    (op, av), rest = items[0], lambda: _first(items[1:], flags, after)
    if op in _CHARS:
        return _set(op, av, flags), False
    if op is _c.SUBPATTERN:
        return _first(list(av[3]), _group_flags(av, flags), rest)
    if op is _ATOMIC:
        return _first(list(av), flags, rest)
    if op is _c.BRANCH:
        found = [_first(list(x), flags, rest) for x in av[1]]
        return np.logical_or.reduce([s for s, _ in found]), any(a for _, a in found)
    if op in _REPEATS:
        chars, always = _first(list(av[2]), flags, rest)
        if av[0] == 0:
            more, anyhow = rest()
            chars, always = chars | more, always or anyhow
        return chars, always
    if op is _c.AT and av is _c.AT_END:
        return members(r"\n"), False
    if op is _c.AT and av is _c.AT_END_STRING:
        return _nothing(), False
    return _anything()


def _must(items: list, flags: int) -> np.ndarray | None:
    """The characters one of which a sequence of nodes must begin with; None where that isn't told, or it may take none."""
    if not items:
        return None
    op, av = items[0]
    if op in _CHARS:
        return _set(op, av, flags)
    if op is _c.SUBPATTERN:
        return _must(list(av[3]), _group_flags(av, flags))
    if op is _ATOMIC:
        return _must(list(av), flags)
    if op in _REPEATS and av[0] > 0:
        return _must(list(av[2]), flags)
    if op is _c.BRANCH:
        found = [_must(list(x), flags) for x in av[1]]
        return None if any(x is None for x in found) else np.logical_or.reduce(found)
    return None


def _rigid(items: list, flags: int, after: Callable[[], Next]) -> bool:
    """Whether a sequence of nodes has one way to match at most, wherever it begins, and takes it without
    looking at what follows: an empty alternative comes last, no loop is lazy."""
    for i, (op, av) in enumerate(items):
        def rest(i=i):
            return _first(items[i + 1:], flags, after)
        if op is _c.SUBPATTERN:
            if not _rigid(list(av[3]), _group_flags(av, flags), rest):
                return False
        elif op is _c.BRANCH:
            seen = _nothing()
            for x in av[1]:
                chars, always = _first(list(x), flags, rest)
                if always or (seen & chars).any() or x.getwidth()[0] == 0 and x is not av[1][-1] or not _rigid(list(x), flags, rest):
                    return False
                seen = seen | chars
        elif op in _REPEATS and op is not getattr(_c, "POSSESSIVE_REPEAT", None):
            lo, hi, body = av
            chars, _ = _first(list(body), flags, _anything)
            more, always = rest()
            if body.getwidth()[0] == 0 or (lo != hi and (op is _c.MIN_REPEAT or always or (chars & more).any())) \
                    or not _rigid(list(body), flags, lambda c=chars, m=more, a=always: (c | m, a)):
                return False
        elif op not in _CHARS and op not in (_c.AT, _c.ASSERT, _c.ASSERT_NOT, _ATOMIC) and op not in _REPEATS:
            return False
    return True


def _fixed(items: list, flags: int) -> bool:
    """A sequence of characters of the basic plane, which are as long as each other in Java."""
    for op, av in items:
        if op in _CHARS:
            if _set(op, av, flags)[_BMP:].any():
                return False
        elif op is not _c.SUBPATTERN or not _fixed(list(av[3]), _group_flags(av, flags)):
            return False
    return True


def _holds_groups(node) -> bool:
    if isinstance(node, _parser.SubPattern):
        return any(op is _c.SUBPATTERN and av[0] is not None or _holds_groups(av) for op, av in node)
    return isinstance(node, (tuple, list)) and any(map(_holds_groups, node))


class _Emitter:
    def __init__(self) -> None:
        self.nested = 1   # iterations of the bounded loops around

    def sequence(self, items: list, flags: int, after: Callable[[], Next]) -> str:
        return "".join(self.boundary(items[i + 1:], flags) if op is _c.AT and av is _c.AT_BOUNDARY else
                       self.node(op, av, flags, lambda i=i: _first(items[i + 1:], flags, after)) for i, (op, av) in enumerate(items))

    def boundary(self, following: list, flags: int) -> str:
        """``\\b``: where what follows begins with a word character for sure, or with another one, only the character
        before is looked at, and where few characters can follow, those first."""
        begin, word = _must(following, flags), members(r"\w", flags & re.ASCII)
        if begin is None or not begin.any() or (begin & word).any() and (begin & ~word).any():
            return self.place(_c.AT_BOUNDARY, flags)
        spans = _ranges(begin)
        ahead = f"(?=[{_listed(spans)}])" if len(spans) <= FEW else ""
        return f"{ahead}(?<{'!' if (begin & word).any() else '='}[{_category(chr(92) + 'w', flags)}])"

    def node(self, op, av, flags: int, rest: Callable[[], Next]) -> str:
        if op in _CHARS:
            return _java_char(op, av, flags)
        if op is _c.AT:
            return self.place(av, flags)
        if op is _c.SUBPATTERN:
            inner = self.sequence(list(av[3]), _group_flags(av, flags), rest)
            return f"({'?:' if av[0] is None else ''}{inner})"
        if op is _c.BRANCH:
            return f"(?:{'|'.join(self.sequence(list(x), flags, rest) for x in av[1])})"
        if op in _REPEATS:
            return self.loop(op, av, flags, rest)
        if op is _ATOMIC:
            return f"(?>{self.sequence(list(av), flags, lambda: (_nothing(), True))})"
        if op in (_c.ASSERT, _c.ASSERT_NOT):
            if op is _c.ASSERT_NOT and _holds_groups(av[1]):
                raise NoJava("groups in a negative look-around")
            inner = self.sequence(list(av[1]), flags, lambda: (_nothing(), True))
            return f"(?{'<' if av[0] < 0 else ''}{'=' if op is _c.ASSERT else '!'}{inner})"
        if op is _c.GROUPREF and not flags & re.IGNORECASE:
            return f"(?:\\{av})"
        if op is _c.FAILURE:
            return "(?!)"
        raise NoJava(str(op))

    def place(self, at, flags: int) -> str:
        lines = flags & re.MULTILINE
        if at in (_c.AT_BEGINNING, _c.AT_BEGINNING_STRING):
            return r"(?:\A|(?<=\n))" if lines and at is _c.AT_BEGINNING else r"\A"
        if at is _c.AT_END:
            return r"(?=\n|\z)" if lines else r"(?=\n?\z)"
        if at is _c.AT_END_STRING:
            return r"\z"
        w = f"[{_category(chr(92) + 'w', flags)}]"
        if at is _c.AT_BOUNDARY:
            return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
        empty = "" if re.search(r"\B", "") else r"(?!\A\z)"   # an empty text: by Python's version
        return f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}){empty})"

    def loop(self, op, av, flags: int, rest: Callable[[], Next]) -> str:
        lo, hi, body = av
        items = list(body)
        while len(items) == 1 and items[0][0] is _c.SUBPATTERN and items[0][1][0] is None and not items[0][1][1] and not items[0][1][2]:
            items = list(items[0][1][3])
        endless = hi is _c.MAXREPEAT or hi >= _c.MAXREPEAT
        count = "*" if endless and lo == 0 else "+" if endless and lo == 1 else "?" if (lo, hi) == (0, 1) else \
            f"{{{lo},}}" if endless else f"{{{lo}}}" if lo == hi else f"{{{lo},{hi}}}"
        if len(items) == 1 and items[0][0] in _CHARS:
            mode = _REPEATS[op]
            if op is _c.MAX_REPEAT and endless:
                more, always = rest()
                if not always and not (more & _set(*items[0], flags)).any():
                    mode = "+"   # what follows can't begin inside the loop: giving back is in vain
            return _java_char(*items[0], flags) + count + mode
        if body.getwidth()[0] == 0 and (endless or hi > 1):
            raise NoJava("a loop over what can be empty")
        was, self.nested = self.nested, self.nested * (1 if endless else max(hi, 1))
        if self.nested > NESTED:
            endless, self.nested = True, was   # too deep for the stack: only without recursion
        begin = None
        if endless:
            begin, _ = _first(items, flags, _anything)
            more, always = rest()

            def again() -> Next:
                return begin | more, always
        text = self.sequence(items, flags, again if endless else (lambda: self._again(items, flags, rest)))
        self.nested = was
        text = text if len(items) == 1 and items[0][0] is _c.SUBPATTERN and items[0][1][0] is not None else f"(?:{text})"
        mode = _REPEATS[op]
        if endless and mode != "+":
            apart = not (begin & more).any()
            if _rigid(items, flags, again) and (apart and not always if mode == "?" else apart or always):
                mode = "+"
            elif mode == "?" or not _fixed(items, flags):
                raise NoJava("a loop that Java walks by recursion")
        return text + count + mode

    @staticmethod
    def _again(items: list, flags: int, rest: Callable[[], Next]) -> Next:
        chars, _ = _first(items, flags, _anything)
        more, always = rest()
        return chars | more, always


def java_pattern(pattern: str) -> str | None:
    """``pattern`` (Python) for Java's engine with the same groups, or None."""
    tree = _parser.parse(pattern)
    flags = tree.state.flags
    if flags & (re.LOCALE | re.DEBUG):
        return None
    try:
        return _Emitter().sequence(list(tree), flags, lambda: (_nothing(), True))
    except NoJava:
        return None
