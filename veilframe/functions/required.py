"""Strings that any match of a pattern must hold: cheap tests that spare most texts the pattern."""

from __future__ import annotations

import re
import re._constants as K
import re._parser as parser

from .dialect import SPACES

#: Strings told of by name: one of the ten digits.
DIGITS = frozenset("0123456789")
#: Most alternatives of one test, most tests of a pattern.
MOST_ALTERNATIVES, MOST_TESTS = 60, 3
#: Signs that most texts have.
COMMON = frozenset(".,- ")
#: White space of the packs' dialect, as a class of a SQL literal's pattern has it.
_SPACES_SQL = SPACES.replace("\\", "\\\\")
#: Letters that equal others under case folding but whose lower case differs (fixed values): long s, dotless and dotted i, capital sharp s; and what stands for them.
ODD, EVEN = "\u017f\u0131\u0130\u1e9e", "sii\u00df"


def folded(text: str) -> str:
    """A form in which texts that differ in case alone are equal; the same as :func:`folded_sql`."""
    return text.translate(str.maketrans(ODD, EVEN)).lower()


def folded_sql(text: str) -> str:
    return f"lower(translate({text}, '{ODD}', '{EVEN}'))"


def required(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of folded strings, of each of which any match holds at least one; the most telling ones first.  ``pattern`` in the packs' dialect."""
    plain = re.sub(r"\\p\{L\}", "a+", pattern.replace("(?<name>", "(?P<name>").replace("(?<legal>", "(?P<legal>"))
    try:
        tree = parser.parse(plain)
    except re.error:
        return ()
    found = {s for s in _sets(tree) if s and _telling(s)}
    return tuple(sorted(found, key=lambda s: (*(-x for x in _rare(s)), sorted(s)))[:MOST_TESTS])


def _telling(alternatives: frozenset[str]) -> bool:
    """Not a set in which a single letter or blank would do: nearly every text has it."""
    return len(alternatives) <= MOST_ALTERNATIVES and all(len(x.strip()) > 1 or x in DIGITS or not (x.isalnum() or x.isspace()) for x in alternatives)


def _rare(alternatives: frozenset[str]) -> tuple[int, ...]:
    """How telling a set is: long strings before digits and rare signs, those before signs of every sentence; then few before many."""
    least = min(3 if len(x) > 2 else 2 if len(x) == 2 else 0 if x in COMMON else 1 for x in alternatives)
    return least, min(map(len, alternatives)), -len(alternatives)


def _characters(items: list) -> frozenset[str]:
    """Folded characters of a class, or none where it is open or large."""
    out: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(folded(chr(value)))
        elif op is K.RANGE and value[1] - value[0] < 12:
            out |= {folded(chr(c)) for c in range(value[0], value[1] + 1)}
        elif op is K.CATEGORY and value is K.CATEGORY_DIGIT:
            out |= DIGITS
        else:
            return frozenset()
    return frozenset(out)


def _words(items) -> frozenset[str]:
    """All folded strings of a part that has few, else none."""
    out = {""}
    for op, value in items:
        if op is K.LITERAL:
            part = {folded(chr(value))}
        elif op is K.IN:
            part = _characters(value)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and tuple(value[:2]) == (0, 1):
            part = _words(value[2]) | {""} if _words(value[2]) else frozenset()
        elif op is K.SUBPATTERN:
            part = _words(value[3])
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        else:
            part = frozenset()
        out = {x + y for x in out for y in part}
        if not out or len(out) > 16:
            return frozenset()
    return frozenset(out)


def _sets(items) -> list[frozenset[str]]:
    """One set for each part that every match goes through; runs of single characters are one string."""
    out: list[frozenset[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            out.append(frozenset([run]))
        run = ""

    for op, value in items:
        if op is K.LITERAL:
            run += folded(chr(value))
        elif op is K.IN:
            got = _characters(value)
            if len(got) == 1:
                run += next(iter(got))
            else:
                end()
                out.append(got)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            end()
            if value[0]:
                out += _sets(value[2])
        elif op is K.SUBPATTERN:
            end()
            out += _sets(value[3])
        elif op is K.ATOMIC_GROUP:
            end()
            out += _sets(value)
        elif op is K.BRANCH:
            end()
            best = [max((s for s in (*_sets(branch), _words(branch)) if s and _telling(s)), key=_rare, default=frozenset()) for branch in value[1]]
            if all(best):
                out.append(frozenset().union(*best))
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue  # no characters of the match
        else:
            end()
    end()
    return out


#: Signs that part a label from its value, longest stretch of a label's end that is told.
SEPARATORS, LONGEST_END = frozenset(":\uff1a="), 10


def ends_sql(fold: str) -> str:
    """The folded text with each separator, and the space before it, as one colon: what a label ends in stands right before it."""
    return f"regexp_replace({fold}, '(?=[^0-9a-z])(?:(?<![{_SPACES_SQL}])[{_SPACES_SQL}]++)?[:\uff1a=]', ':')"


def label_ends(pattern: str) -> frozenset[str]:
    """Folded strings, a colon behind each, of which :func:`ends_sql` of any text with a match holds at least one; empty where a match needs no label with a separator."""
    try:
        items = list(parser.parse(re.sub(r"\\p\{L\}", "a+", pattern.replace("(?<name>", "(?P<name>").replace("(?<legal>", "(?P<legal>"))))
    except re.error:
        return frozenset()
    while True:
        at = next((k for k, (op, value) in enumerate(items) if op is K.IN and all(kind is K.LITERAL and chr(x) in SEPARATORS for kind, x in value)), None)
        if at is not None:
            break
        inner = next((value[3] for op, value in items if op is K.SUBPATTERN), None)
        if inner is None:
            return frozenset()
        items = list(inner)
    before = items[:at]
    while before and before[-1][0] is K.MAX_REPEAT and _blank(before[-1][1][2]):
        before.pop()
    ends = {x + ":" for x, _ in _ends(before, {("", True)})}
    # an end that is a blank or a separator itself may have gone into the colon
    if not ends or len(ends) > MOST_ALTERNATIVES or any(len(x) < 3 or x[-2].isspace() or SEPARATORS & set(x[:-1]) for x in ends):
        return frozenset()
    return frozenset(ends)


def _blank(items) -> bool:
    """Whether a part takes white space only."""
    return all(op is K.LITERAL and chr(value) in " \t" or op is K.IN and all(kind is K.LITERAL and chr(x) in " \t" or kind is K.CATEGORY and x is K.CATEGORY_SPACE for kind, x in value) for op, value in items)


def _ends(items, after: set[tuple[str, bool]]) -> set[tuple[str, bool]]:
    """Strings that any text of the items and what follows ends in, and whether more is told before each."""
    for op, value in reversed(list(items)):
        going = {x for x, on in after if on and len(x) < LONGEST_END}
        done = {(x, False) for x, on in after if not on or len(x) >= LONGEST_END}
        some = {(x, True) for x in going}
        if not going:
            break
        if op is K.LITERAL:
            some = {(folded(chr(value)) + x, True) for x in going}
        elif op is K.IN and 0 < len(_characters(value)) <= 4:
            some = {(c + x, True) for c in _characters(value) for x in going}
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and tuple(value[:2]) == (0, 1):
            some |= _ends(value[2], some)
        elif op is K.SUBPATTERN:
            some = _ends(value[3], some)
        elif op is K.BRANCH:
            some = set().union(*(_ends(b, some) for b in value[1]))
        elif op not in (K.AT, K.ASSERT, K.ASSERT_NOT):
            some = {(x, False) for x in going}
        after = done | some
    return after
