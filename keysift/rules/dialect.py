"""Rule patterns are written in RE2 syntax; Spark matches with java.util.regex.

``translate`` rewrites one pattern so that both engines find the same text, and refuses
what RE2 itself refuses (look-around, back-references, nested repetition).  The places
where the two differ:

* ``\\b`` and ``\\B`` look at ASCII letters, digits and ``_`` only;
* ``\\s`` does not include the vertical tab;
* ``.`` excludes the line feed only, ``$`` means the end of the text only;
* ``(?i)`` folds Unicode, so the Kelvin sign matches ``k``;
* inside a class ``[`` and ``&&`` are ordinary characters.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

BOUNDARY = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
NOT_BOUNDARY = "(?:(?<![0-9A-Za-z_])(?![0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_]))"
MAX_REPEAT = 1000
SPECIAL = set("\\.[]{}()*+?^$|&-~#")

# RE2's named sets, each as first and last characters of its ranges.
PERL = {"d": "09", "s": "\t\n\f\r  ", "w": "09AZ__az"}
POSIX = {
    "alnum": "09AZaz", "alpha": "AZaz", "ascii": "\0\x7f", "blank": "\t\t  ", "cntrl": "\0\x1f\x7f\x7f",
    "digit": "09", "graph": "!~", "lower": "az", "print": " ~", "punct": "!/:@[`{~",
    "space": "\t\r  ", "upper": "AZ", "word": "09AZ__az", "xdigit": "09AFaf",
}
# The Unicode names accepted after \\p.
CATEGORIES = set("C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps "
                 "S Sc Sk Sm So Z Zl Zp Zs".split())
SCRIPTS = set("Arabic Armenian Bengali Cyrillic Devanagari Georgian Greek Han Hangul Hebrew "
              "Hiragana Katakana Latin Tamil Thai".split())


def _members(ranges: str, negated: bool = False) -> str:
    """Class members for a string of range ends, or for everything outside them."""
    pairs = sorted(zip(ranges[::2], ranges[1::2]))
    if negated:
        edges = [0] + [edge for low, high in pairs for edge in (ord(low) - 1, ord(high) + 1)] + [0x10FFFF]
        pairs = [(chr(low), chr(high)) for low, high in zip(edges[::2], edges[1::2]) if low <= high]
    return "".join(f"{_code(low)}-{_code(high)}" if low != high else _code(low) for low, high in pairs)


def _code(ch: str) -> str:
    return ch if ch.isascii() and ch.isalnum() else r"\x{%x}" % ord(ch)


class PatternError(ValueError):
    """The pattern is not valid RE2 syntax."""


@dataclass(frozen=True)
class JavaPattern:
    text: str
    min_width: int  # least number of characters a match can have
    ending: str = ""  # the one character that every match ends with, if there is one


class _Part(NamedTuple):
    text: str
    width: int
    firsts: frozenset[str] | None = frozenset()  # what a match can start with; None is anything
    repeatable: bool = True
    ending: str = ""


def translate(pattern: str) -> JavaPattern:
    reader = _Reader(pattern)
    part = reader.alternatives(_Flags())
    if reader.more():
        raise PatternError(f"unexpected ) in {pattern!r}")
    return JavaPattern(_look_first(part), part.width, part.ending)


def _look_first(part: _Part) -> str:
    """Let a pattern that starts with a choice test the first character before trying the branches."""
    start = part.text.removeprefix("(?iu)").removeprefix(BOUNDARY)
    if not part.firsts or part.width == 0 or not start.startswith("("):
        return part.text
    return f"(?=[{''.join(map(_code, sorted(part.firsts)))}]){part.text}"


def _first_of(ch: str, flags: "_Flags") -> frozenset[str] | None:
    if not flags.i:
        return frozenset(ch)
    if not ch.isascii():
        return None
    return frozenset(ch.lower() + ch.upper() + {"k": "\u212a", "s": "\u017f"}.get(ch.lower(), ""))


@dataclass
class _Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    U: bool = False

    def copy(self) -> "_Flags":
        return _Flags(self.i, self.m, self.s, self.U)


def _literal(ch: str) -> str:
    return "\\" + ch if ch in SPECIAL else ch


class _Reader:
    def __init__(self, source: str):
        self.source, self.at = source, 0

    def more(self) -> bool:
        return self.at < len(self.source)

    def peek(self, text: str) -> bool:
        return self.source.startswith(text, self.at)

    def take(self) -> str:
        if not self.more():
            raise PatternError(f"pattern ends too early: {self.source!r}")
        self.at += 1
        return self.source[self.at - 1]

    def until(self, end: str) -> str:
        stop = self.source.find(end, self.at)
        if stop < 0:
            raise PatternError(f"missing {end} in {self.source!r}")
        found, self.at = self.source[self.at:stop], stop + len(end)
        return found

    # -- structure -----------------------------------------------------------------

    def alternatives(self, flags: _Flags) -> _Part:
        """Everything up to the closing parenthesis of the current group."""
        branches = [self.sequence(flags)]
        while self.peek("|"):
            self.at += 1
            branches.append(self.sequence(flags))
        firsts = [b.firsts for b in branches]
        endings = {b.ending for b in branches}
        return _Part("|".join(b.text for b in branches), min(b.width for b in branches),
                     None if None in firsts else frozenset().union(*firsts),
                     ending=endings.pop() if len(endings) == 1 else "")

    def sequence(self, flags: _Flags) -> _Part:
        out, total, firsts, ending = [], 0, frozenset(), ""
        while self.more() and self.source[self.at] not in "|)":
            if self.peek("\\Q"):
                self.unquote()
                continue
            part = self.atom(flags)
            text, width, ending = part.text, part.width, part.ending
            if part.repeatable:
                suffix, least = self.repetition(flags)
                if suffix and width == 0:
                    text = f"(?:{text})"
                text, width, ending = text + suffix, width * least, "" if suffix else ending
            if total == 0 and firsts is not None:
                firsts = None if part.firsts is None else firsts | part.firsts
            out.append(text)
            total += width
        return _Part("".join(out), total, firsts, ending=ending)

    def unquote(self) -> None:
        """Put the escaped form of a \\Q...\\E text in its place."""
        quoted, _, rest = self.source[self.at + 2:].partition("\\E")
        escaped = "".join("\\" + c if c in SPECIAL else c for c in quoted)
        self.source = self.source[:self.at] + escaped + rest

    def repetition(self, flags: _Flags) -> tuple[str, int]:
        least, most = 1, 1
        bounds = self.bounds()
        if bounds:
            least, most = bounds
            suffix = "{%d}" % least if least == most else "{%d,%s}" % (least, "" if most is None else most)
        elif self.more() and self.source[self.at] in "*+?":
            suffix = self.take()
            least = 1 if suffix == "+" else 0
        else:
            return "", 1
        lazy = self.peek("?")
        self.at += lazy
        if (self.more() and self.source[self.at] in "*+?") or self.bounds(consume=False):
            raise PatternError(f"nested repetition in {self.source!r}")
        return suffix + ("?" if lazy != flags.U else ""), least

    def bounds(self, consume: bool = True) -> tuple[int, int | None] | None:
        """A {n}, {n,} or {n,m} at the current place; anything else starting with { is text."""
        if not self.peek("{"):
            return None
        stop = self.source.find("}", self.at)
        low, comma, high = self.source[self.at + 1:max(stop, self.at + 1)].partition(",")
        if not low.isdigit() or (high and not high.isdigit()):
            return None
        least = int(low)
        most = (int(high) if high else None) if comma else least
        if least > MAX_REPEAT or (most is not None and (most > MAX_REPEAT or most < least)):
            raise PatternError(f"bad repetition count in {self.source!r}")
        if consume:
            self.at = stop + 1
        return least, most

    def atom(self, flags: _Flags) -> _Part:
        ch = self.take()
        if ch == "(":
            return self.group(flags)
        if ch == "[":
            return _Part(self.bracket(flags), 1, None)
        if ch == ".":
            return _Part(r"[\s\S]" if flags.s else r"[^\n]", 1, None)
        if ch == "^":
            return _Part(r"(?<![^\n])" if flags.m else r"\A", 0)
        if ch == "$":
            return _Part(r"(?![^\n])" if flags.m else r"\z", 0)
        if ch == "\\":
            return self.escape(flags)
        if ch in "*+?":
            raise PatternError(f"nothing to repeat in {self.source!r}")
        return _Part(_literal(ch), 1, _first_of(ch, flags), ending="" if flags.i and ch.isalpha() else ch)

    def group(self, flags: _Flags) -> _Part:
        inner, opening = flags.copy(), "("
        before = flags.i
        if self.peek("?P<") or (self.peek("?<") and not self.peek("?<=") and not self.peek("?<!")):
            name = self.until(">").rpartition("<")[2]
            if not name.isidentifier():
                raise PatternError(f"bad group name in {self.source!r}")
        elif self.peek("?"):
            self.at += 1
            names, ends = "", ""
            while ends not in (":", ")") or not ends:
                ends = self.take()
                names += ends
            if names == ")" or any(c not in "imsU-:)" for c in names) or names.count("-") > 1 \
                    or names[:-1].endswith("-"):
                raise PatternError(f"unsupported group (?{names} in {self.source!r}")
            switched = flags if ends == ")" else inner
            value = True
            for c in names[:-1]:
                value = value and c != "-"
                if c != "-":
                    setattr(switched, c, value)
            fold = "" if switched.i == before else "iu" if switched.i else "-iu"
            if ends == ")":
                return _Part(f"(?{fold})" if fold else "", 0, repeatable=False)
            opening = f"(?{fold}:"
        body = self.alternatives(inner)
        if self.take() != ")":
            raise PatternError(f"missing ) in {self.source!r}")
        return body._replace(text=f"{opening}{body.text})")

    # -- single characters and sets --------------------------------------------------

    def escape(self, flags: _Flags) -> _Part:
        for letter, java in (("b", BOUNDARY), ("B", NOT_BOUNDARY), ("A", r"\A"), ("z", r"\z")):
            if self.peek(letter):
                self.at += 1
                return _Part(java, 0)
        members = self.members(flags)
        if members is None:
            ch = self.character()
            return _Part(_literal(ch), 1, _first_of(ch, flags))
        return _Part(f"[{members}]", 1, None)

    def members(self, flags: _Flags) -> str | None:
        """Class members of \\d, \\s, \\w, \\p{..} and their negations; None for other escapes."""
        letter = self.source[self.at:self.at + 1]
        if letter and letter in "dsw" + "DSW":
            self.at += 1
            ranges = PERL[letter.lower()]
            if letter in "wW" and flags.i:
                ranges += "\u017f\u017f\u212a\u212a"
            return _members(ranges, letter.isupper())
        if letter in ("p", "P"):
            self.at += 1
            name = self.take()
            if name == "{":
                name = self.until("}")
            negated = (letter == "P") != name.startswith("^")
            name = name.lstrip("^")
            if name not in CATEGORIES and name not in SCRIPTS:
                raise PatternError(f"bad \\p name in {self.source!r}")
            return r"\%s{%s}" % ("P" if negated else "p", name if len(name) <= 2 else "Is" + name)
        return None

    def character(self) -> str:
        """The character after a backslash."""
        ch = self.take()
        simple = {"a": "\a", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
        if ch in simple:
            return simple[ch]
        if ch == "x":
            digits = ""
            if self.peek("{"):
                self.at += 1
                digits = self.until("}")
            else:
                digits = self.take() + self.take()
            try:
                return chr(int(digits, 16))
            except (ValueError, OverflowError):
                raise PatternError(f"bad \\x escape in {self.source!r}") from None
        if ch in "01234567" and (ch == "0" or self.source[self.at:self.at + 1] in tuple("01234567")):
            digits = ch
            while len(digits) < 3 and self.source[self.at:self.at + 1] in tuple("01234567"):
                digits += self.take()
            return chr(int(digits, 8))
        if ch.isalnum() or ord(ch) > 126:
            raise PatternError(f"\\{ch} is not supported in {self.source!r}")
        return ch

    def bracket(self, flags: _Flags) -> str:
        negated = self.peek("^")
        self.at += negated
        parts, first = [], True
        while first or not self.peek("]"):
            first = False
            if self.peek("[:"):
                self.at += 2
                name = self.until(":]")
                inverse = name.startswith("^")
                if name.lstrip("^") not in POSIX:
                    raise PatternError(f"unknown class [:{name}:] in {self.source!r}")
                parts.append(_members(POSIX[name.lstrip("^")], inverse))
                continue
            if self.peek("\\"):
                self.at += 1
                members = self.members(flags)
                if members is not None:
                    parts.append(members)
                    continue
                low = self.character()
            else:
                low = self.take()
            if self.peek("-") and self.source[self.at + 1:self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.take()
                if high == "\\":
                    high = self.character()
                if high < low:
                    raise PatternError(f"bad range {low}-{high} in {self.source!r}")
                parts.append(f"{_literal(low)}-{_literal(high)}")
            else:
                parts.append(_literal(low))
        self.at += 1
        return f"[{'^' if negated else ''}{''.join(parts)}]"
