"""Rule packs: small driver-side objects that the operators turn into column expressions."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from functools import cached_property
from importlib import resources
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T

from keysift.rules.dialect import JavaPattern, PatternError, translate

DEFAULT_SEVERITY = "medium"
DEFAULT_ENTROPY = 3.0


@dataclass(frozen=True)
class Allowlist:
    description: str = ""
    paths: tuple[str, ...] = ()
    regexes: tuple[str, ...] = ()
    commits: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()


@dataclass(frozen=True)
class Required:
    """A companion pattern that must occur within some lines of a match."""

    id: str = ""
    regex: str = ""
    within_lines: int = 0


@dataclass(frozen=True)
class Rule:
    id: str
    description: str = ""
    regex: str = ""
    entropy: float = 0.0
    keywords: tuple[str, ...] = ()
    severity: str = ""
    tags: tuple[str, ...] = ()
    validate: str = ""
    allowlist: tuple[Allowlist, ...] = ()
    required: tuple[Required, ...] = ()

    def with_defaults(self) -> "Rule":
        return replace(self, severity=self.severity or DEFAULT_SEVERITY,
                       entropy=self.entropy or DEFAULT_ENTROPY)


@dataclass(frozen=True)
class CompiledRule:
    """A rule that can fire: its place in the pack, its Spark pattern, its lower-cased keywords."""

    index: int
    rule: Rule
    java: str
    keywords: tuple[str, ...]
    ending: str = ""  # every match ends with this character, and may reach far to find it


@dataclass(frozen=True)
class RulePack:
    title: str = ""
    allowlist: tuple[Allowlist, ...] = ()
    rules: tuple[Rule, ...] = ()
    extend_builtin: bool = False
    declared: tuple[Rule, ...] = field(default=(), repr=False)  # rules before defaults

    @cached_property
    def _checked(self) -> tuple[dict[int, JavaPattern], list[tuple[int, str, str, str]]]:
        good, bad = {}, []
        for index, rule in enumerate(self.rules):
            if not rule.regex:
                bad.append((index, rule.id, rule.regex, "no pattern"))
                continue
            try:
                java = translate(rule.regex)
            except PatternError as error:
                bad.append((index, rule.id, rule.regex, str(error)))
                continue
            if java.min_width == 0:
                bad.append((index, rule.id, rule.regex, "pattern can match the empty text"))
            else:
                good[index] = java
        return good, bad

    @property
    def rejected(self) -> list[tuple[int, str, str, str]]:
        """(index, id, regex, reason) of the rules that cannot be used."""
        return self._checked[1]

    @property
    def has_keywords(self) -> bool:
        return any(k for rule in self.rules for k in rule.keywords)

    def compiled(self, keyless: str = "never") -> list[CompiledRule]:
        """The rules that can fire.

        A rule without keywords is a candidate only in a pack in which no rule has any;
        ``keyless="always"`` lets such rules look at every text.
        """
        if keyless not in ("never", "always"):
            raise ValueError(f"keyless must be never or always, not {keyless!r}")
        gated = self.has_keywords
        rules = [CompiledRule(index, self.rules[index], java.text,
                              tuple(dict.fromkeys(k.lower() for k in self.rules[index].keywords if k)),
                              java.ending if "[^" in java.text else "")
                 for index, java in self._checked[0].items()]
        return [rule for rule in rules if rule.keywords or not gated or keyless == "always"]

    def allow_patterns(self, kind: str) -> list[str]:
        """Spark patterns of the global allowlist's ``paths`` or ``regexes``; bad ones are left out."""
        return usable_patterns(p for a in self.allowlist for p in getattr(a, kind))

    @property
    def stopwords(self) -> list[str]:
        return list(dict.fromkeys(w.lower() for a in self.allowlist for w in a.stopwords))

    @property
    def allowed_commits(self) -> list[str]:
        return list(dict.fromkeys(c for a in self.allowlist for c in a.commits))

    def merged(self, base: "RulePack") -> "RulePack":
        """This pack on top of ``base``: same ids override, allowlists add up."""
        own = {rule.id: rule for rule in self.rules}
        kept = [own.pop(rule.id, rule) for rule in base.rules]
        return RulePack(self.title or base.title, base.allowlist + self.allowlist,
                        tuple(kept) + tuple(own.values()))


def usable_patterns(patterns) -> list[str]:
    found = []
    for pattern in dict.fromkeys(patterns):
        try:
            found.append(translate(pattern).text)
        except PatternError:
            continue
    return found


def _allowlists(items: list[dict[str, Any]]) -> tuple[Allowlist, ...]:
    return tuple(Allowlist(a.get("description", ""), tuple(a.get("paths", ())),
                           tuple(a.get("regexes", ())), tuple(a.get("commits", ())),
                           tuple(a.get("stopwords", ()))) for a in items)


def pack_from_dict(config: dict[str, Any]) -> RulePack:
    declared = tuple(
        Rule(id=r.get("id", ""), description=r.get("description", ""), regex=r.get("regex", ""),
             entropy=float(r.get("entropy", 0.0)), keywords=tuple(r.get("keywords", ())),
             severity=r.get("severity", ""), tags=tuple(r.get("tags", ())),
             validate=r.get("validate", ""), allowlist=_allowlists(r.get("allowlist", [])),
             required=tuple(Required(q.get("id", ""), q.get("regex", ""), int(q.get("withinLines", 0)))
                            for q in r.get("required", [])))
        for r in config.get("rules", []))
    return RulePack(title=config.get("title", ""), allowlist=_allowlists(config.get("allowlist", [])),
                    rules=tuple(rule.with_defaults() for rule in declared),
                    extend_builtin=bool(config.get("extend", {}).get("useDefault", False)),
                    declared=declared)


def load_pack(path: str | Path, apply_extend: bool = False) -> RulePack:
    """Read a TOML rule file; with ``apply_extend`` a ``useDefault`` file adds to the built-in pack."""
    with open(path, "rb") as handle:
        pack = pack_from_dict(tomllib.load(handle))
    return pack.merged(builtin_pack()) if apply_extend and pack.extend_builtin else pack


def builtin_pack() -> RulePack:
    text = resources.files("keysift.rules").joinpath("builtin.toml").read_text(encoding="utf-8")
    return pack_from_dict(tomllib.loads(text))


ALLOWLIST_TYPE = T.ArrayType(T.StructType(
    [T.StructField("description", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("paths", "regexes", "commits", "stopwords")]))
RULE_SCHEMA = T.StructType([
    T.StructField("rule_idx", T.IntegerType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("regex", T.StringType(), False),
    T.StructField("entropy", T.DoubleType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType(), False), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("tags", T.ArrayType(T.StringType(), False), False),
    T.StructField("validate", T.StringType(), False),
    T.StructField("allowlist", ALLOWLIST_TYPE),
    T.StructField("required", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("regex", T.StringType()),
        T.StructField("withinLines", T.IntegerType())]))),
])


def rules_frame(spark: SparkSession, pack: RulePack, declared: bool = False) -> DataFrame:
    """One row per rule; ``declared`` shows them as written, before defaults."""
    rows = [(i, r.id, r.description, r.regex, r.entropy, list(r.keywords), r.severity, list(r.tags),
             r.validate,
             [(a.description, list(a.paths), list(a.regexes), list(a.commits), list(a.stopwords))
              for a in r.allowlist],
             [(q.id, q.regex, q.within_lines) for q in r.required])
            for i, r in enumerate(pack.declared if declared else pack.rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rejected_rules_frame(spark: SparkSession, pack: RulePack) -> DataFrame:
    return spark.createDataFrame(pack.rejected, "rule_idx int, id string, regex string, reason string")
