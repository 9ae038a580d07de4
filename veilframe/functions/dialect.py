"""Bridge from the packs' pattern dialect (ECMAScript) to Java regular expressions with the same matches."""

from __future__ import annotations

import re
import re._constants as K
import re._parser as parser

#: White space and line ends of the packs' dialect (fixed values).
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
LINE_ENDS = r"\n\r\u2028\u2029"
#: A sign of an ASCII word, whatever the text's script: as Java's own class, which is one look into a table.  Where case is told by Unicode, a few more signs equal a letter.
WORD, WORD_ANY_CASE = r"\w", r"(?-iu:[\w\u017F\u212A\u0130\u0131])"
#: Signs beyond the two cases that equal a letter where case is told by Unicode; letters outside ASCII whose cases are plain; most signs that a match may begin with for these to be asked for first.
TWINS, PLAIN_CASE, MOST_LEADS = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131", "\u00df": "\u1e9e"}, "äöüß", 60


def boundary(word: str = WORD, before: bool = False, after: bool = False) -> str:
    """Boundary of a word; half of it is enough where what stands ``before`` or ``after`` it is sure to be of a word."""
    if before:
        return f"(?!{word})"
    return f"(?<!{word})" if after else f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"


BOUNDARY = boundary()
#: Repetitions of a group that go in one possessive block while as many are left after it; Java recurses for each one that may be given back.
BLOCK = 32
HAN = "\u4e00-\u9fff"
#: What stands for any letter where a pattern is read; first signs of a match that are looked at.
LETTER, LEADS = "\u00e9", 6
SPECIAL = set("\\^$.|?*+()[]{}/")


def plain(pattern: str, letter: str) -> str:
    """The pattern as Python's parser reads it, ``letter`` standing for any letter."""
    return re.sub(r"\\p\{L\}", letter, pattern.replace("(?<name>", "(?P<name>").replace("(?<legal>", "(?P<legal>"))


def boundaries(pattern: str) -> list[tuple[bool, bool]]:
    """For each ``\\b`` in order: whether what stands before it, and after it, is sure to be a sign of a word."""
    try:
        tree = parser.parse(plain(pattern, LETTER))
    except re.error:
        return []
    marks: list = []
    _edges(list(tree), False, False, marks)
    return marks


def _of_word(op, value) -> bool:
    """Whether an item of one character takes only signs of a word."""
    if op is K.LITERAL:
        return re.match(r"\w", chr(value), re.ASCII) is not None
    if op is K.RANGE:
        return any(ord(a) <= value[0] and value[1] <= ord(z) for a, z in ("09", "AZ", "az"))
    if op is K.CATEGORY:
        return value in (K.CATEGORY_DIGIT, K.CATEGORY_WORD)
    return op is K.IN and all(_of_word(*x) for x in value)


def _edge(item, beyond: bool, last: bool) -> bool:
    """Whether what begins (``last``: ends) with this item begins with a sign of a word; ``beyond``: whether what lies behind the item does."""
    op, value = item
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        return _side(value[2], False, last) and (value[0] > 0 or beyond)
    if op is K.SUBPATTERN:
        return _side(value[3], beyond, last)
    if op is K.BRANCH:
        return all(_side(b, beyond, last) for b in value[1])
    return beyond if op in (K.AT, K.ASSERT, K.ASSERT_NOT) else _of_word(op, value)


def _side(items, beyond: bool, last: bool) -> bool:
    for item in items if last else reversed(list(items)):
        beyond = _edge(item, beyond, last)
    return beyond


def _edges(items: list, before: bool, after: bool, marks: list) -> None:
    """Adds what :func:`boundaries` tells of the items, given what stands around them."""
    for k, (op, value) in enumerate(items):
        here, there = _side(items[:k], before, True), _side(items[k + 1 :], after, False)
        if op is K.AT and value is K.AT_BOUNDARY:
            marks.append((here, there))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            _edges(list(value[2]), False, False, marks)
        elif op is K.SUBPATTERN:
            _edges(list(value[3]), here, there, marks)
        elif op is K.BRANCH:
            for b in value[1]:
                _edges(list(b), here, there, marks)
        elif op in (K.ASSERT, K.ASSERT_NOT):
            _edges(list(value[1]), False, False, marks)


def _forms(c: int, flags: str) -> set[str] | None:
    """All signs that a literal takes; None for letters whose cases are not told here."""
    low, up = chr(c).lower(), chr(c).upper()
    if "i" not in flags or low == up or (c > 127 and "u" not in flags):
        return {chr(c)}
    if c > 127 and low not in PLAIN_CASE:
        return None
    return {low, *(up if len(up) == 1 else ""), *(TWINS.get(low, "") if "u" in flags else "")}


def _signs(items, flags: str) -> set[str] | None:
    """All signs that a class takes; None where it is open or large."""
    chars: list[int] = []
    for kind, x in items:
        wide = range(x, x + 1) if kind is K.LITERAL else range(x[0], x[1] + 1) if kind is K.RANGE else range(48, 58) if kind is K.CATEGORY and x is K.CATEGORY_DIGIT else None
        if wide is None or len(wide) > MOST_LEADS:
            return None
        chars += wide
    forms = [None if chr(c) == LETTER else _forms(c, flags) for c in chars]
    return None if None in forms else set().union(*forms)


def _either(parts: list[list[set[str] | None]]) -> list[set[str] | None]:
    """Signs at each place of one of several; as far as the shortest goes."""
    return [None if None in place else set().union(*place) for place in zip(*parts, strict=False)]


def _heads(items, flags: str, after: list[set[str] | None]) -> list[set[str] | None]:
    """Signs that a match may have at each of its first places (None: open), given those of what follows the items; as far as every match goes."""
    for op, value in reversed(list(items)):
        if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        if op is K.LITERAL:
            after = [None if chr(value) == LETTER else _forms(value, flags), *after]
        elif op is K.IN:
            after = [_signs(value, flags), *after]
        elif op in (K.ANY, K.NOT_LITERAL):
            after = [None, *after]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            least, more = value[0], value[1] - value[0]
            once, after = after, after if more <= LEADS else []
            for _ in range(min(more, LEADS)):
                after = _either([once, _heads(value[2], flags, after)])
            for _ in range(min(least, LEADS)):
                after = _heads(value[2], flags, after)
        elif op is K.SUBPATTERN:
            after = _heads(value[3], flags, after)
        elif op is K.BRANCH:
            after = _either([_heads(b, flags, after) for b in value[1]])
        else:
            after = []
        after = [None if s is None or len(s) > MOST_LEADS else s for s in after[:LEADS]]
    return after


def lead(pattern: str, flags: str = "") -> str:
    """A look at the first signs of a match, to stand before the pattern: most places of a text fail it, and it is one look into a table a sign.  Empty where a match may begin with many signs."""
    try:
        places = _heads(parser.parse(plain(pattern, LETTER)), flags, [])
    except re.error:
        return ""
    while places and places[-1] is None:
        places.pop()
    if not places or not places[0]:
        return ""
    sign = lambda c: c if c.isascii() and c.isalnum() else f"\\u{ord(c):04X}"
    return "(?-iu:(?=" + "".join("[\\s\\S]" if p is None else "[" + "".join(map(sign, sorted(p))) + "]" for p in places) + "))"


def sooner(pattern: str) -> str:
    """The same pattern with what must match looked for before what must not: a pattern of a whole line that begins with a look at all of the line would take it at every line."""
    if not pattern.startswith("^(?!") or not pattern.endswith("$"):
        return pattern
    depth, inside, k = 0, False, 1
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside or c == "[":
            inside = c != "]"
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                break
        k += 1
    never, body = pattern[1 : k + 1], pattern[k + 1 :]
    tree = re.compile(plain(pattern, LETTER))
    if tree.groupindex or re.search(r"\\[1-9]", pattern):
        return pattern
    bare = re.sub(r"(\\.|\[(?:\\.|[^\]\\])*\])|\((?!\?)", lambda m: m[1] or "(?:", body)
    return pattern if "|" in re.sub(r"\(.*\)", "", body) else f"^(?={bare}){never}{body}"


def listed(inner: str, flags: str) -> str | None:
    """A class of the packs' dialect with its ranges of ASCII letters and digits sign by sign, which Java keeps in one table of bits; those that it keeps apart come behind.  None where the class holds anything else."""
    signs: list[str] = []
    k, wide = 0, "i" in flags and "u" in flags
    while k < len(inner):
        one = re.compile(r"([0-9A-Za-z])-([0-9A-Za-z])|\\[dtnr]|\\[^0-9A-Za-z]|[^\\\[&^-]|&(?!&)|-\Z", re.DOTALL).match(inner, k)
        if not one:
            return None
        if one[1]:
            # a range takes other signs that equal these letters than the letters alone do
            signs += [f"{chr(c)}-{chr(c)}" if wide and chr(c) in "iskISK" else chr(c) for c in range(ord(one[1]), ord(one[2]) + 1)]
        else:
            signs += "0123456789" if one[0] == "\\d" else ["\\-" if one[0] == "-" else one[0]]
        k = one.end()
    if "i" in flags:
        signs = [c.lower() if len(c) == 1 and c.isascii() else c for c in signs]
    signs = list(dict.fromkeys(signs))
    apart = [c for c in signs if ord(c[-1]) > 255 or (wide and c[0] in "iskISK")]
    table = "".join(c for c in signs if c not in apart)
    return f"[[{table}][{''.join(apart)}]]" if table and apart else f"[{table}{''.join(apart)}]"


def to_java(pattern: str, flags: str = "", led: bool = False) -> str:
    """Java form of a pattern: ASCII ``\\b``, Unicode ``\\s``, absolute ``$``, line ends of ``.``, and no repetition of a group that recurses without bound.

    A repeated group at the very end becomes possessive (nothing after it could make it give back).  Any other takes possessive blocks as
    long as another block is left, and the rest one by one: it can still give back as many, and has no upper limit.  ``led``: behind its :func:`lead`.
    """
    pattern = sooner(pattern)
    out, k, depth, n = [], 0, False, len(pattern)
    opened: list[int] = []
    begun = 0  # where the last closed group began in ``out``
    multi = "m" in flags
    word = WORD_ANY_CASE if "i" in flags and "u" in flags else WORD
    marks, seen = boundaries(pattern), 0
    if len(marks) != len(re.findall(r"\\b", re.sub(r"\\[^b]|\[(?:\\.|[^\]\\])*\]", "", pattern, flags=re.DOTALL))):
        marks = []  # the parser joined some of them
    while k < n:
        c = pattern[k]
        if c == "\\":
            pair = pattern[k : k + 2]
            if pair == "\\b" and not depth:
                out.append(boundary(word, *marks[seen]) if marks else boundary(word))
                seen += 1
            elif pair == "\\s":
                out.append(SPACES if depth else f"[{SPACES}]")
            elif pair == "\\S":
                out.append(f"[^{SPACES}]")
            else:
                out.append(pair)
            k += 2
            continue
        if depth:
            if c == "]":
                depth = False
            elif c == "[" or pattern.startswith("&&", k):
                c = "\\" + c
            out.append(c)
        elif c == "[" and (whole := re.compile(r"\[((?:[^\]\\^]|\\.)(?:[^\]\\]|\\.)*)\]", re.DOTALL).match(pattern, k)) and (form := listed(whole[1], flags)):
            out.append(form)
            k = whole.end()
            continue
        elif c == "[":
            depth = True
            out.append(c)
            if pattern.startswith("[^", k):
                out.append("^")
                k += 1
        elif c == ".":
            out.append(f"[^{LINE_ENDS}]")
        elif c == "$":
            out.append(f"(?=[{LINE_ENDS}]|\\z)" if multi else "\\z")
        elif c == "^":
            out.append(f"(?:\\A|(?<=[{LINE_ENDS}]))" if multi else "\\A")
        elif c in "*+" and out and out[-1] == ")":
            lazy = pattern[k + 1 : k + 2] == "?"
            if not lazy and not pattern[k + 1 :].strip(")"):
                out.append(c + "+")
            else:
                group = "".join(out[begun:])
                if not group.startswith("(?:") or re.search(r"(?<!\\)\((?!\?)|\(\?<[A-Za-z]", group) or lazy:
                    raise ValueError(f"a repeated group must not capture or be lazy: {group}")
                out[begun:] = [f"(?:{group}{{{BLOCK}}}+(?={group}{{{BLOCK}}}+))*+", group, f"{{{int(c == '+')},{2 * BLOCK}}}"]
        else:
            if c == "(":
                opened.append(len(out))
            elif c == ")":
                begun = opened.pop()
            out.append(c)
        k += 1
    case = "(?iu)" if "i" in flags and "u" in flags else "(?i)" if "i" in flags else ""
    return case + (lead(pattern, flags) if led else "") + "".join(out)


def escape(term: str) -> str:
    return "".join("\\" + c if c in SPECIAL or c == "-" else c for c in term)


def term_pattern(term: str) -> tuple[str, int]:
    """Java pattern of a manual term and the group that holds it: whole words of Latin terms, Han terms not inside other Han text."""
    if re.search(f"[{HAN}]", term):
        return f"(^|[^{HAN}])({escape(term)})(?=\\z|[^{HAN}])", 2
    edge = boundary(WORD_ANY_CASE)
    return f"(?iu){lead(escape(term), 'iu')}{edge}{escape(term)}{edge}", 0


def groups(pattern: str) -> int:
    """Number of capturing groups of a pattern."""
    return re.compile(plain(pattern, "a")).groups
