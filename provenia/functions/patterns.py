"""Python's regular expressions as Java's: the parsed pattern is written anew, each part so that it means in Java what it means in Python.

What differs and is spelled out: \\d \\s \\w and \\b (Unicode's decimal digits, Python's white space, letters and numbers without marks), ^ and $ and \\Z,
the dot, case folding, classes within classes, named groups, conditional groups. What Java can't say is a PatternError.
"""

import re
import re._constants as op
from collections import defaultdict
from functools import lru_cache
from re import _parser

#: Python's white space: what str.isspace() holds for.
SPACE = r"\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CLASSES = {op.CATEGORY_DIGIT: r"\p{Nd}", op.CATEGORY_SPACE: SPACE, op.CATEGORY_WORD: r"\p{L}\p{N}_"}
ASCII_CLASSES = {op.CATEGORY_DIGIT: "0-9", op.CATEGORY_SPACE: r"\t-\r\x20", op.CATEGORY_WORD: "0-9A-Za-z_"}
NEGATED = {op.CATEGORY_NOT_DIGIT: op.CATEGORY_DIGIT, op.CATEGORY_NOT_SPACE: op.CATEGORY_SPACE, op.CATEGORY_NOT_WORD: op.CATEGORY_WORD}
ANY = "(?s:.)"


class PatternError(ValueError):
    """A pattern that Python takes and Java can't say."""


@lru_cache(maxsize=1)
def _folds() -> dict[str, set[str]]:
    """By lower, upper and folded first letter, the characters that have it; of those alone that have a case."""
    out: dict[str, set[str]] = defaultdict(set)
    for i in range(0x110000):
        c = chr(i)
        forms = {c.lower()[0], c.upper()[0], c.casefold()[0]}
        if forms != {c}:
            for f in forms | {c}:
                out[f].add(c)
    return out


@lru_cache(maxsize=10_000)
def variants(c: str, ascii_only: bool = False) -> frozenset[str]:
    """The characters that Python takes for c when case is ignored, c itself included."""
    flags = re.IGNORECASE | (re.ASCII if ascii_only else 0)
    folds, near = _folds(), {c}
    for _ in range(2):
        near |= {x for y in near for f in (y, y.lower()[0], y.upper()[0], y.casefold()[0]) for x in folds.get(f, ())}
    return frozenset(x for x in near if x == c or re.fullmatch(re.escape(c), x, flags))


def _char(code: int) -> str:
    if 0xD800 <= code < 0xE000:
        raise PatternError("half of a surrogate pair")
    c = chr(code)
    return c if c.isascii() and c.isalnum() else f"\\x{{{code:x}}}"


class _Writer:
    def __init__(self, state: "_parser.State", conditions: set[int]):
        self.conditions, self.count = conditions, 0
        self.groups: dict[int, int] = {}  # Python's number to Java's
        self.marks: dict[int, int] = {}  # the number of the empty group at the end of a group that a condition asks for

    def sequence(self, parts, flags: int) -> str:
        return "".join(self.start(parts[k + 1][1], flags) if self.starts_word(parts, k, flags) else self.part(kind, value, flags) for k, (kind, value) in enumerate(parts))

    def starts_word(self, parts, k: int, flags: int) -> bool:
        """Whether part k is a word boundary right before an ASCII letter, digit or underscore."""
        if parts[k] != (op.AT, op.AT_BOUNDARY) or k + 1 == len(parts) or flags & re.IGNORECASE:
            return False
        kind, value = parts[k + 1]
        return kind is op.LITERAL and re.match(r"(?a:\w)", chr(value)) is not None

    def start(self, code: int, flags: int) -> str:
        """A boundary before this word character: no word character before it. It is looked for first, as most places aren't one and looking back is slow."""
        return f"(?={self.literal(code, flags)})(?<![{self.classes(flags)[op.CATEGORY_WORD]}])"

    def whole(self, parts, flags: int) -> str:
        """The pattern as it is searched for. If it begins with alternatives that each begin with a known character, that comes before them, as one class: most places
        in a text are then left after one look, where alternatives are tried one by one."""
        told = [self.first(x, flags) for x in parts[0][1][1]] if len(parts) and parts[0][0] is op.BRANCH else []
        if not told or not all(told):
            return self.sequence(parts, flags)
        inside = "".join(dict.fromkeys(c[1:-1] if c.startswith("[") else c for c, _ in told))
        return f"[{inside}](?:" + "|".join(rest() for _, rest in told) + ")" + self.sequence(parts[1:], flags)

    def first(self, parts, flags: int):
        """The first character of an alternative and a function for what follows it, which looks back at the character; None if it doesn't begin with one."""
        if not len(parts):
            return None
        kind, value = parts[0]
        if kind is op.LITERAL:
            c = self.literal(value, flags)
            return c, lambda: f"(?<={c})" + self.sequence(parts[1:], flags)
        if self.starts_word(parts, 0, flags):
            c, w = self.literal(parts[1][1], flags), self.classes(flags)[op.CATEGORY_WORD]
            return c, lambda: f"(?<={c})(?<![{w}]{c})" + self.sequence(parts[2:], flags)
        if kind is op.SUBPATTERN and value[0] is None and not value[1] & (re.ASCII | re.UNICODE):
            told = self.first(value[3], (flags | value[1]) & ~value[2])
            return told and (told[0], lambda: told[1]() + self.sequence(parts[1:], flags))
        return None

    def classes(self, flags: int) -> dict:
        return ASCII_CLASSES if flags & re.ASCII else CLASSES

    def literal(self, code: int, flags: int) -> str:
        if flags & re.IGNORECASE:
            found = variants(chr(code), bool(flags & re.ASCII))
            if len(found) > 1:
                return "[" + "".join(_char(ord(x)) for x in sorted(found)) + "]"
        return _char(code)

    def members(self, items, flags: int) -> tuple[str, bool]:
        """The inside of a class and whether it is negated."""
        out, negated, ranges = [], False, []
        for kind, value in items:
            if kind is op.NEGATE:
                negated = True
            elif kind is op.LITERAL:
                out.append(_char(value))
                ranges.append((value, value))
            elif kind is op.RANGE:
                lo, hi = value
                ranges.append((lo, hi))
                # half surrogates are no characters: a range goes around them
                for a, b in ((lo, min(hi, 0xD7FF)), (max(lo, 0xE000), hi)):
                    if a <= b:
                        out.append(f"{_char(a)}-{_char(b)}")
            elif kind is op.CATEGORY and value in NEGATED:
                out.append(f"[^{self.classes(flags)[NEGATED[value]]}]")
            elif kind is op.CATEGORY:
                out.append(self.classes(flags)[value])
            else:
                raise PatternError(f"{kind} in a class")
        if flags & re.IGNORECASE and ranges:
            has = lambda x: any(lo <= ord(x) <= hi for lo, hi in ranges)
            cased = {x for group in _folds().values() for x in group}
            out += [_char(ord(x)) for x in sorted(cased) if not has(x) and any(map(has, variants(x, bool(flags & re.ASCII)) - {x}))]
        return "".join(out), negated

    def boundary(self, flags: int, inside: bool) -> str:
        w = f"[{self.classes(flags)[op.CATEGORY_WORD]}]"
        if inside:  # no inside in an empty text
            return rf"(?!\A\z)(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"
        return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"

    def at(self, where, flags: int) -> str:
        if where is op.AT_BEGINNING:
            return r"(?:\A|(?<=\n))" if flags & re.MULTILINE else r"\A"
        if where is op.AT_END:
            return r"(?=\n|\z)" if flags & re.MULTILINE else r"(?=\n?\z)"
        fixed = {op.AT_BEGINNING_STRING: r"\A", op.AT_END_STRING: r"\z", op.AT_BOUNDARY: self.boundary(flags, False), op.AT_NON_BOUNDARY: self.boundary(flags, True)}
        if where not in fixed:
            raise PatternError(str(where))
        return fixed[where]

    def part(self, kind, value, flags: int) -> str:
        if kind is op.LITERAL:
            return self.literal(value, flags)
        if kind is op.NOT_LITERAL:
            return f"(?:(?!{self.literal(value, flags)}){ANY})"
        if kind is op.ANY:
            return ANY if flags & re.DOTALL else r"[^\n]"
        if kind is op.IN:
            inside, negated = self.members(value, flags)
            return f"(?:(?![{inside}]){ANY})" if negated else f"[{inside}]"
        if kind is op.AT:
            return self.at(value, flags)
        if kind is op.BRANCH:
            return "(?:" + "|".join(self.sequence(x, flags) for x in value[1]) + ")"
        if kind is op.SUBPATTERN:
            group, more, less, parts = value
            flags = (flags | more) & ~less
            if more & (re.ASCII | re.UNICODE):
                raise PatternError("(?a:...) and (?u:...) for a part")
            if group is None:
                return f"(?:{self.sequence(parts, flags)})"
            self.count += 1
            self.groups[group] = self.count
            inside = self.sequence(parts, flags)
            if group in self.conditions:
                self.count += 1
                self.marks[group] = self.count
                inside = f"(?:{inside})()"
            return f"({inside})"
        if kind is op.GROUPREF:
            back = rf"(?:\{self.groups[value]})"
            if flags & re.IGNORECASE:
                return f"(?i:{back})" if flags & re.ASCII else f"(?iu:{back})"
            return back
        if kind is op.GROUPREF_EXISTS:
            group, yes, no = value
            if group not in self.marks:
                raise PatternError("a condition on a group that is still open")
            mark = rf"(?:\{self.marks[group]})"
            return f"(?:{mark}{self.sequence(yes, flags)}|(?!{mark}){self.sequence(no or [], flags)})"
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            lo, hi, parts = value
            often = f"{{{lo},{'' if hi is op.MAXREPEAT else hi}}}"
            return f"(?:{self.sequence(parts, flags)}){often}" + {op.MAX_REPEAT: "", op.MIN_REPEAT: "?", op.POSSESSIVE_REPEAT: "+"}[kind]
        if kind is op.ATOMIC_GROUP:
            return f"(?>{self.sequence(value, flags)})"
        if kind in (op.ASSERT, op.ASSERT_NOT):
            way, parts = value
            return "(?" + ("<" if way < 0 else "") + ("=" if kind is op.ASSERT else "!") + self.sequence(parts, flags) + ")"
        if kind is op.FAILURE:
            return "(?!)"
        raise PatternError(str(kind))


def _walk(parts):
    for kind, value in parts:
        yield kind, value
        for x in value if isinstance(value, tuple | list) else [value]:
            if isinstance(x, _parser.SubPattern):
                yield from _walk(x)
            elif isinstance(x, list) and kind is op.BRANCH:
                for branch in x:
                    yield from _walk(branch)


@lru_cache(maxsize=1000)
def java(pattern: str) -> str:
    """The pattern in Java's dialect; its group 1 is Java's group 1. PatternError for what can't be said, re.error for what is no pattern."""
    parsed = _parser.parse(pattern)
    conditions = {value[0] for kind, value in _walk(parsed) if kind is op.GROUPREF_EXISTS}
    return _Writer(parsed.state, conditions).whole(parsed, parsed.state.flags)


def java_full(pattern: str) -> str:
    """A match of the whole text, a line end at its end included."""
    return rf"\A(?:{java(pattern)})\z"


def needs_text(pattern: str) -> None:
    """PatternError for a pattern that matches the empty text: after an empty match Python looks for a longer one at the same place, Java doesn't."""
    if _parser.parse(pattern).getwidth()[0] == 0:
        raise PatternError("the pattern matches the empty text, so its matches can't be listed")


def can_be_empty(pattern: str) -> bool:
    """Whether the group that counts, once it took part, may have matched the empty text."""
    parsed = _parser.parse(pattern)
    if parsed.state.groups == 1:
        return parsed.getwidth()[0] == 0
    return next(value[3] for kind, value in _walk(parsed) if kind is op.SUBPATTERN and value[0] == 1).getwidth()[0] == 0


@lru_cache(maxsize=1000)
def capture_of(pattern: str) -> tuple[int, bool]:
    """The group that counts (1 if there are groups, else 0), and whether an empty capture is a text: else it is a group that took no part.

    Java gives an empty text for both. A first group that may be left out and may be empty can't be told apart: a PatternError.
    """
    parsed = _parser.parse(pattern)
    if parsed.state.groups == 1:
        return 0, True

    def always(parts) -> bool:
        """Whether a match of the parts always goes through group 1."""
        for kind, value in parts:
            if kind is op.SUBPATTERN and (value[0] == 1 or always(value[3])):
                return True
            if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0 and always(value[2]):
                return True
            if kind is op.ATOMIC_GROUP and always(value) or kind is op.ASSERT and always(value[1]) or kind is op.BRANCH and all(map(always, value[1])):
                return True
        return False

    first = next(value[3] for kind, value in _walk(parsed) if kind is op.SUBPATTERN and value[0] == 1)
    if always(parsed):
        return 1, True
    if first.getwidth()[0] == 0:
        raise PatternError("the first group may be left out and may be empty, which can't be told apart")
    return 1, False
