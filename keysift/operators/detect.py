"""Keyword gate, pattern matching and location of matches.

One narrow stage: every text row is lowered once, checked for keywords, matched by its candidate
rules only, and leaves as one small row per match.  Nothing is shuffled and the text itself is
never copied per rule or per match.

Two habits of the optimizer shape the code.  A filter on a computed column is pushed below the
projection that computes it and so evaluates it again; a filter on the output of ``explode`` is
not, which is why masks and matches leave through one.  And an expression named once inside a
lambda may be inlined there and run per element; ``let`` binds it first.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keysift.functions.text import let, match_context, sql_string
from keysift.operators.allow import DEFAULT_MARKERS, has_inline_allow, mentions_marker
from keysift.rules.pack import CompiledRule, RulePack

# Common parts of keywords, rarest first.  A text without the part cannot hold any keyword
# containing it, so one search rules out a whole group.
KEYWORD_PARTS = ("://", "cret", "wd", "key", "_", "-")
# Characters from frequent to rare in prose and source text; all others count as rarer.
COMMON_FIRST = " etaoinsrhldcumfpgwybvk.,-_xjqz"
RULES_PER_MASK = 60
KEYWORDS = "array<struct<ending:string,word:string,masks:array<bigint>>>"
KEYWORD_GROUPS = f"array<struct<part:string,words:{KEYWORDS}>>"
BLOCK = 128


def _needed_keywords(keywords: tuple[str, ...]) -> list[str]:
    """Keywords that contain another keyword of the same rule add nothing."""
    return [k for k in keywords if not any(o != k and o in k for o in keywords)]


def _rare_ending(keyword: str) -> str:
    """The keyword from its rarest character on.

    A search stops at every place where the first byte fits, so it is several times faster for
    what starts with a rare one; only texts holding this ending are searched for the whole.
    """
    start = max(range(max(len(keyword) - 1, 1)), key=lambda i: (COMMON_FIRST.find(keyword[i]) % (len(COMMON_FIRST) + 1), -i))
    return keyword[start:]


def _keyword_groups(rules: list[CompiledRule]) -> list[dict]:
    """The keywords by their common part, each with the masks of the rules that it makes candidates."""
    masks: dict[str, list[int]] = {}
    for place, rule in enumerate(rules):
        for keyword in _needed_keywords(rule.keywords):
            own = masks.setdefault(keyword, [0] * len(_blocks(rules)))
            own[place // RULES_PER_MASK] |= 1 << place % RULES_PER_MASK
    parts = [p for p in KEYWORD_PARTS if sum(p in k for k in masks) > 1]
    groups: dict[str, list[dict]] = {}
    for keyword, own in masks.items():
        part = next((p for p in parts if p in keyword), "")
        groups.setdefault(part, []).append({"ending": _rare_ending(keyword), "word": keyword, "masks": own})
    return [{"part": p, "words": w} for p, w in groups.items()]


def candidate_masks(df: DataFrame, text: str, rules: list[CompiledRule]) -> DataFrame:
    """Add ``masks``: bit i of entry b is set when rule b*60+i is a candidate for the text.

    The keywords are one folded literal that a single expression walks, group by group: however many rules there are, the generated method stays
    small enough to be compiled.  Rows without any candidate leave here.
    """
    kept = [F.col(c) for c in df.columns]
    lowered = df.select(*kept, F.lower(text).alias("_low"))
    groups = F.from_json(F.lit(json.dumps(_keyword_groups(rules))), KEYWORD_GROUPS)
    low = F.col("_low")
    held = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(low, g["part"])), lambda g: F.filter(
        g["words"], lambda w: F.contains(low, w["ending"]) & F.contains(low, w["word"]))))
    always = [sum(1 << i for i, rule in enumerate(block) if not _needed_keywords(rule.keywords)) for block in _blocks(rules)]
    masks = F.aggregate(F.coalesce(held, F.array().cast(KEYWORDS)), F.array(*[F.lit(x).cast("bigint") for x in always]),
                        lambda done, w: F.zip_with(done, w["masks"], lambda a, b: a.bitwiseOR(b)))
    once = lowered.select(*kept, F.explode(F.array(masks)).alias("masks"))
    return once.filter(reduce(lambda a, b: a | b, [F.col("masks")[b] != 0 for b in range(len(_blocks(rules)))]))


def _blocks(rules: list[CompiledRule]) -> list[list[CompiledRule]]:
    return [rules[i:i + RULES_PER_MASK] for i in range(0, len(rules), RULES_PER_MASK)]


def _is_candidate(place: int) -> str:
    return f"masks[{place // RULES_PER_MASK}] & {1 << place % RULES_PER_MASK}L != 0"


def candidate_rules(df: DataFrame, pack: RulePack, text: str, keyless: str = "never") -> DataFrame:
    """One row per text and candidate rule: the input columns and ``rule_idx``; the text is left out."""
    rules = pack.compiled(keyless)
    if not rules:
        return df.drop(text).withColumn("rule_idx", F.lit(0)).filter(F.lit(False))
    kept = [c for c in df.columns if c != text]
    indexes = F.expr("array(%s)" % ", ".join(
        f"CASE WHEN {_is_candidate(i)} THEN {rule.index} END" for i, rule in enumerate(rules)))
    return (candidate_masks(df, text, rules).select(*kept, F.explode(indexes).alias("rule_idx"))
            .filter(F.col("rule_idx").isNotNull()))


def _newlines(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def _tail(s: Column) -> Column:
    return F.length(F.substring_index(s, "\n", -1))


def _at_match(before: Column, piece: Column) -> dict[str, Column]:
    """Offset, line and column of a match, from the place where its piece (gap, then match) starts."""
    return {"at": before["at"] + piece["gap_length"], "line": before["line"] + piece["gap_lines"],
            "column": (F.when(piece["gap_lines"] > 0, piece["gap_tail"] + 1)
                       .otherwise(before["column"] + piece["gap_tail"]))}


def _after(before: Column, piece: Column) -> Column:
    """The place where the next piece starts."""
    here = _at_match(before, piece)
    return F.struct((here["at"] + piece["match_length"]).alias("at"),
                    (here["line"] + piece["match_lines"]).alias("line"),
                    F.when(piece["match_lines"] > 0, piece["match_tail"] + 1)
                    .otherwise(here["column"] + piece["match_tail"]).alias("column"))


def _placed(before: Column, piece: Column) -> Column:
    here = _at_match(before, piece)
    return F.struct(piece["match"].alias("match"), here["at"].alias("start"), here["line"].alias("line"),
                    here["column"].alias("column"), (here["at"] + piece["match_length"]).alias("end"),
                    (here["line"] + piece["match_lines"]).alias("end_line"))


def _running(pieces: Column) -> Column:
    """``_placed`` for every piece, each from the place where the one before it ended.

    ``aggregate`` copies its state at every step, so the state is three numbers, kept for one
    block of pieces at a time: first the place where each block starts, then the places inside.
    """
    first = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit(1).alias("column"))

    def states(items: Column, start: Column, step) -> Column:
        """The start, and the state after each item but the last."""
        grown = F.aggregate(items, F.array(start), lambda done, item: F.concat(
            done, F.array(step(F.element_at(done, -1), item))))
        return F.slice(grown, F.lit(1), F.size(items))

    def in_blocks(blocks: Column) -> Column:
        starts = states(blocks, first, lambda before, block: F.aggregate(block, before, _after))
        return F.flatten(F.zip_with(blocks, starts, lambda block, start: F.zip_with(
            states(block, start, _after), block, _placed)))

    def cut(items: Column) -> Column:
        numbers = F.sequence(F.lit(0), ((F.size(items) - 1) / BLOCK).cast("int"))
        return let(F.transform(numbers, lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK))), in_blocks)

    return let(pieces, cut)


def _searched(text: Column, ending: Column) -> Column:
    """The text up to the last ``ending``; no match that ends with it can lie beyond.

    Java's matcher tries every start anew.  A log full of ``redis://host:port`` without an ``@``
    would be read to its end from each of them; cut this way, the first start that gets so far
    is a match and the search goes on behind it.
    """
    beyond = F.call_function("substring_index", text, ending, F.lit(-1))
    return F.left(text, F.length(text) - F.length(beyond))


def _locate(text: Column, hit: Column, patterns: Column, endings: Column, markers: tuple[str, ...] | None,
            context: int | None) -> Column:
    """The matches of one rule in one text, with their places.

    Splitting by the same pattern gives the stretches between the matches, and their lengths and
    line feeds give the places in one walk over the text.
    """
    ending = F.element_at(endings, hit["place"] + 1)
    searched = F.when(ending == "", text).otherwise(_searched(text, ending))
    gaps = F.split(searched, F.element_at(patterns, hit["place"] + 1), -1)
    pieces = F.zip_with(hit["found"], gaps, lambda match, gap: F.struct(
        match.alias("match"), F.length(gap).alias("gap_length"), _newlines(gap).alias("gap_lines"),
        _tail(gap).alias("gap_tail"), F.length(match).alias("match_length"),
        _newlines(match).alias("match_lines"), _tail(match).alias("match_tail")))
    placed = _running(F.slice(pieces, F.lit(1), F.size(hit["found"])))

    def row(lines: Column, allowed: Column, p: Column) -> Column:
        last_line = p["end_line"] - p["match"].endswith("\n").cast("int")
        fields = [hit["rule_idx"].alias("rule_idx"), p["match"].alias("match"), p["start"].alias("start"),
                  p["end"].alias("end"), p["line"].alias("line"), p["column"].alias("column")]
        if markers is not None:
            fields.append(F.coalesce(F.element_at(allowed, p["line"]), F.lit(False)).alias("inline_allow"))
        if context is not None:
            fields.append(match_context(lines, p["line"], last_line, context).alias("context"))
        return F.struct(*fields)

    nothing = F.lit(None)
    if markers is None and context is None:
        return F.transform(placed, lambda p: row(nothing, nothing, p))
    lines = F.split(text, "\n", -1)
    if markers is None:
        return let(lines, lambda lines: F.transform(placed, lambda p: row(lines, nothing, p)))
    # Lines are judged once each, however many matches they hold.
    judged = F.when(mentions_marker(text, markers),
                    F.transform(lines, lambda line: has_inline_allow(line, markers)))
    if context is None:
        return let(judged, lambda allowed: F.transform(placed, lambda p: row(nothing, allowed, p)))
    return let(lines, lambda lines: let(judged, lambda allowed: F.transform(
        placed, lambda p: row(lines, allowed, p))))


def _near(matches: Column, needs: dict[int, list[tuple[int, int]]]) -> Column:
    """The matches of one text whose rule has each of its companions (rule, lines) that near."""
    wanted = sorted({companion for pairs in needs.values() for companion, _ in pairs})

    def lines_of(companion: int) -> Column:
        return F.array_distinct(F.transform(F.filter(matches, lambda m: m["rule_idx"] == companion), lambda m: m["line"]))

    return let(F.array(*[lines_of(c) for c in wanted]), lambda lines: F.filter(matches, lambda m: _fits(m, lines, wanted, needs)))


def _fits(m: Column, lines: Column, wanted: list[int], needs: dict[int, list[tuple[int, int]]]) -> Column:
    """Whether each companion of the match's rule has a line near enough."""
    def close(companion: int, distance: int) -> Column:
        return F.exists(lines[wanted.index(companion)], lambda line: F.abs(line - m["line"]) <= distance)

    fits = F.lit(True)
    for rule, pairs in needs.items():
        near = reduce(lambda a, b: a & b, [close(companion, distance) for companion, distance in pairs])
        fits = F.when(m["rule_idx"] == rule, near).otherwise(fits)
    return fits


def rule_matches(df: DataFrame, pack: RulePack, text: str, keyless: str = "never",
                 markers: tuple[str, ...] | None = DEFAULT_MARKERS,
                 context: int | None = 2, near: dict[int, list[tuple[int, int]]] | None = None) -> DataFrame:
    """Every non-overlapping match of every candidate rule; of rules in ``near`` only those close to their companions.

    Returns the input columns without the text, plus ``rule_idx``, ``match``, ``start`` and
    ``end`` (0-based, in characters), ``line`` and ``column`` (1-based), ``inline_allow`` (unless
    ``markers`` is None) and ``context`` (unless ``context`` is None).
    """
    rules = pack.compiled(keyless)
    kept = [c for c in df.columns if c != text]
    if not rules:
        rules = [CompiledRule(0, None, r"[^\s\S]", ("-",))]  # matches nothing, keeps the columns
    body, name = F.col(text), f"`{text}`"
    cut = "left({0}, length({0}) - length(substring_index({0}, {1}, -1)))"
    found = F.expr("array(%s)" % ", ".join(
        f"named_struct('place', {place}, 'rule_idx', {rule.index}, 'found', CASE WHEN {_is_candidate(place)} THEN "
        f"regexp_extract_all({cut.format(name, sql_string(rule.ending)) if rule.ending else name}, "
        f"{sql_string(rule.java)}, 0) END)"
        for place, rule in enumerate(rules)))
    patterns = F.expr("array(%s)" % ", ".join(sql_string(rule.java) for rule in rules))
    endings = F.expr("array(%s)" % ", ".join(sql_string(rule.ending) for rule in rules))
    hits = F.filter(found, lambda hit: F.size(hit["found"]) > 0)
    located = F.flatten(F.transform(hits, lambda hit: _locate(body, hit, patterns, endings, markers, context)))
    if near:
        located = let(located, lambda matches: _near(matches, near))
    return candidate_masks(df, text, rules).select(*kept, F.inline(located))
