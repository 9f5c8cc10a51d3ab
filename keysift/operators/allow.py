"""Allowlists: known harmless secrets, paths, lines and commits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keysift.rules.pack import RulePack, usable_patterns

DEFAULT_MARKERS = ("keysift:allow",)

# The comment forms around a marker m.
COMMENT_FORMS = (r"#\s*{m}", r"//\s*{m}", r"/\*\s*{m}\s*\*/", r"\{{\{{\s*/*\s*{m}\s*\*/\s*\}}\}}",
                 r"<!--\s*{m}\s*-->", r"\{{%\s*comment\s%\}}{m}")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_allowed_path(path: Column, pack: RulePack) -> Column:
    """Some global path pattern is found anywhere in the path."""
    return _any([path.rlike(p) for p in pack.allow_patterns("paths")])


def is_globally_allowed(secret: Column, pack: RulePack) -> Column:
    return _any([secret.rlike(p) for p in pack.allow_patterns("regexes")]
                + [has_stopword(secret, w) for w in pack.stopwords])


def has_stopword(secret: Column, word: str) -> Column:
    """The first occurrence of the word has no ASCII letter or digit next to it."""
    low = F.lower(secret)
    at = F.instr(low, word)
    before = F.substring(low, at - 1, F.lit(1))
    after = F.substring(low, at + len(word), F.lit(1))
    edge = "[a-z0-9]"
    return (at > 0) & ((at == 1) | ~before.rlike(edge)) & ~after.rlike(edge)


def is_rule_allowed(secret: Column, rule_idx: Column, pack: RulePack) -> Column:
    """A rule's own patterns; its ``paths`` are looked up in the secret too."""
    checks = []
    for index, rule in enumerate(pack.rules):
        patterns = usable_patterns(p for a in rule.allowlist for p in a.paths + a.regexes)
        if patterns:
            checks.append((rule_idx == index) & _any([secret.rlike(p) for p in patterns]))
    return _any(checks)


def mentions_marker(text: Column, markers: tuple[str, ...] = DEFAULT_MARKERS) -> Column:
    """Some marker is anywhere in the text; without one no line needs a closer look."""
    return text.rlike("(?iu)" + "|".join(map(re.escape, markers)))


def has_inline_allow(line: Column, markers: tuple[str, ...] = DEFAULT_MARKERS) -> Column:
    """The line carries a comment with one of the markers."""
    forms = [form.format(m=re.escape(marker)).replace(r"\s", r"[\t\n\f\r ]")
             for marker in markers for form in COMMENT_FORMS]
    return _any([line.rlike("(?iu)" + form) for form in forms])


def drop_allowed_commits(df: DataFrame, pack: RulePack, commit: str = "commit") -> DataFrame:
    """Leave out commits whose hash is, or starts with, an allowed hash."""
    by_length: dict[int, list[str]] = {}
    for allowed in pack.allowed_commits:
        by_length.setdefault(len(allowed), []).append(allowed)
    checks = [F.left(F.col(commit), F.lit(n)).isin(hashes) for n, hashes in by_length.items()]
    return df.filter(~F.coalesce(_any(checks), F.lit(False))) if checks else df


__all__ = ["COMMENT_FORMS", "DEFAULT_MARKERS", "drop_allowed_commits", "has_inline_allow",
           "has_stopword", "is_allowed_path", "is_globally_allowed", "is_rule_allowed", "mentions_marker"]
