"""Composite rules: a match counts only near a match of a companion pattern."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from keysift.operators.detect import rule_matches
from keysift.rules.pack import RulePack


def with_companions(pack: RulePack) -> tuple[RulePack, dict[int, list[tuple[int, int]]]]:
    """The pack with companion patterns appended as rules, and per rule its (companion, lines).

    A companion pattern is looked for in the texts in which its rule is a candidate, so it takes
    that rule's keywords.  A companion without a pattern is the rule of that id.
    """
    rules, needs = list(pack.rules), {}
    index_of = {rule.id: i for i, rule in enumerate(pack.rules)}
    for i, rule in enumerate(pack.rules):
        for required in rule.required:
            companion = index_of.get(required.id, -1)
            if required.regex:
                companion = len(rules)
                rules.append(replace(rule, id=f"{rule.id}/{required.id}", regex=required.regex,
                                     required=(), allowlist=()))
            needs.setdefault(i, []).append((companion, required.within_lines))
    return replace(pack, rules=tuple(rules)), needs


def composite_matches(texts: DataFrame, pack: RulePack, text: str, **detect) -> DataFrame:
    """``rule_matches`` in which rules with companions count only near them, decided inside the row of each text.

    All matches of a text are in one array before they leave as rows, so texts never meet, whatever their paths, and nothing is
    joined or written.
    """
    extended, needs = with_companions(pack)
    matches = rule_matches(texts, extended, text, near=needs, **detect)
    return matches.filter(F.col("rule_idx") < len(pack.rules)) if needs else matches
