"""Scanning: rules over a text column, with byte offsets; captures; allowed secrets; entropy; wrapped tokens; order.

For one pattern, split() and regexp_extract_all() interleave, so that the running sum of the
lengths of both gives the byte offset of each match. All stays in the JVM.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import bind, empty, fold
from ..functions.patterns import opened
from ..functions.text import ascii_lower, contains_any, digest, entropy
from ..sources.rules import DEFAULT_RULES, Rule, Scanner, scanner_of, usable

Rules = Scanner | list[Rule] | tuple[Rule, ...]
HIT = "struct<rule:string,start:int,end:int,secret:string>"
FINDING = f"array<{HIT}>"
# What a token of three parts looks like if white space may break it up; its spans are no longer than so many bytes.
LONGEST_WRAPPED = 8192
WRAPPED = r"(?<![A-Za-z0-9_])ey[A-Za-z0-9_+/\r\n\t -]{17,2048}\.[ \t\r\n]*ey[A-Za-z0-9_+/\r\n\t -]{17,4096}\.[A-Za-z0-9_+/=\r\n\t -]{10,2048}"
WRAPPED_RULE = "jwt"
#: How each of them begins: most texts have no such place, and are not searched further.
BEGINS_WRAPPED = r"(?<![A-Za-z0-9_])ey[A-Za-z0-9_+/\r\n\t -]{17,2048}+\.[ \t\r\n]*ey"


#: A rule as a value of a column. numbers: the groups of the opened pattern that tell where its captures stand; captures: of each the place of its own
#: group among them, and of those before it. whole: whether the whole match counts if no capture holds anything.
RULE = "struct<id:string,pattern:string,keywords:array<string>,entropy:double,whole:boolean,numbers:array<int>,captures:array<struct<at:int,before:array<int>>>>"
#: Of more keywords than this, those that stand in a text are found in one pass.
MANY_WORDS = 48


@lru_cache(4096)
def compiled(rule: Rule) -> dict:
    """A rule as RULE has it."""
    pattern, captures = opened(rule.regex)
    if rule.group:
        captures = [c for c in captures if c.own == rule.group]
    numbers = sorted({n for c in captures for n in (c.group, *c.before)})
    places = [{"at": numbers.index(c.group), "before": [numbers.index(n) for n in c.before]} for c in captures]
    return {"id": rule.id, "pattern": pattern, "keywords": sorted({k.lower() for k in rule.keywords}), "entropy": rule.entropy, "whole": not rule.group, "numbers": numbers, "captures": places}


def rules_column(rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """Rules as one constant, array<RULE>: the plan is as large for hundreds of them as for one."""
    return F.from_json(F.lit(json.dumps([compiled(r) for r in usable(rules)])), f"array<{RULE}>")


def matches_of(text: Column, rule: Column) -> Column:
    """All secrets of a rule (RULE) as (rule, start, end, secret); offsets in bytes of UTF-8, end exclusive."""

    def hit(start: Column, secret: Column) -> Column:
        return F.array(F.named_struct(F.lit("rule"), rule["id"], F.lit("start"), start, F.lit("end"), start + F.octet_length(secret), F.lit("secret"), secret))

    def secret(m: Column, start: Column) -> Column:
        """The first capture that is not empty, or else the whole match, if that counts."""
        full = F.filter(rule["captures"], lambda c: F.length(F.get(m["parts"], c["at"])) > 0)
        of = lambda c: hit(F.aggregate(c["before"], start, lambda at, n: at + F.octet_length(F.get(m["parts"], n))), F.get(m["parts"], c["at"]))
        other = F.when(rule["whole"], hit(start, m["hit"])).otherwise(empty(FINDING))
        return F.when(F.size(rule["captures"]) == 0, other).otherwise(bind(full, lambda f: F.when(F.size(f) > 0, of(F.get(f, F.lit(0)))).otherwise(other)))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = at + F.octet_length(m["gap"])
        return start + F.octet_length(m["hit"]), secret(m, start)

    def over(found: Column) -> Column:
        gaps = F.split(text, rule["pattern"], -1)
        groups = F.transform(rule["numbers"], lambda n: F.regexp_extract_all(text, rule["pattern"], n))
        lists = F.named_struct(F.lit("gaps"), gaps, F.lit("groups"), groups)
        items = bind(lists, lambda x: F.transform(found, lambda h, i: F.named_struct(F.lit("gap"), F.get(x["gaps"], i), F.lit("hit"), h, F.lit("parts"), F.transform(x["groups"], lambda g: F.get(g, i)))))
        return F.when(F.size(found) > 0, fold(items, F.lit(0), step, HIT)).otherwise(empty(FINDING))

    # Where there is no match, one pass over the text is all.
    return bind(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), over)


def matches(text: Column, rule_id: str, regex: str, group: int = 0) -> Column:
    """Those of one pattern. group: see Rule."""
    one = F.get(rules_column([Rule(rule_id, regex, (), 0.0, group)]), F.lit(0))
    return bind(F.named_struct(F.lit("rule"), one, F.lit("text"), text), lambda x: matches_of(x["text"], x["rule"]))


def words_in(low: Column, words: list[str]) -> Column:
    """Those of words (in lower case) that a text in lower case holds.

    Many words are looked for in one pass, by a pattern that shares their beginnings; it gives the longest word at each place, and so also those
    that this one begins with. The time hardly depends on how many words there are that the text has not."""
    if len(words) <= MANY_WORDS:
        return F.filter(F.lit(words) if words else empty("array<string>"), lambda w: F.contains(low, w))
    begins = {w: [v for v in words if w.startswith(v)] for w in words}
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({shared_beginnings(words)}))"), 1))
    more = {w: v for w, v in begins.items() if len(v) > 1}
    if not more:
        return found
    table = F.from_json(F.lit(json.dumps(more)), "map<string,array<string>>")
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.coalesce(F.try_element_at(table, w), F.array(w)))))


def shared_beginnings(words: list[str]) -> str:
    """A pattern for the longest of words at a place, in which words with one beginning share it."""
    if "" in words:
        return f"(?:{shared_beginnings([w for w in words if w])})?" if len(words) > 1 else ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    quote = lambda c: c if c.isalnum() or c == "_" else "\\" + c if c.isascii() else f"\\x{{{ord(c):x}}}"
    parts = [quote(c) + shared_beginnings(rest) for c, rest in sorted(by.items())]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def wrapped(text: Column, rule: Rule) -> Column:
    """Findings of rule in tokens that line ends and blanks break up, the secret without the breaks.

    A candidate must hold a line end. Its white space goes, the rule is searched in what is left,
    and the span is mapped back. It counts if it is no longer than LONGEST_WRAPPED and itself holds a line end.
    """

    def place(raw: Column, n: Column, more: str) -> Column:
        """The length of raw up to its nth character that is no white space: candidates are ASCII, so characters are bytes."""
        pattern = F.concat(F.lit(r"\A(?:[ \t\r\n]*+[^ \t\r\n]){"), n.cast("string"), F.lit("}" + more))
        return F.coalesce(F.length(F.regexp_substr(raw, pattern)), F.lit(0))

    def of(c: Column) -> Column:
        compact = F.regexp_replace(c["secret"], "[\r\n\t ]", "")
        found = F.transform(matches(compact, rule.id, rule.regex, rule.group), lambda f: F.named_struct(
            F.lit("rule"), f["rule"], F.lit("start"), c["start"] + place(c["secret"], f["start"], r"[ \t\r\n]*+"), F.lit("end"), c["start"] + place(c["secret"], f["end"], ""), F.lit("secret"), f["secret"]))
        own = lambda f: F.substring(c["secret"], f["start"] - c["start"] + 1, f["end"] - f["start"])
        return F.filter(found, lambda f: (F.length(f["secret"]) > 0) & (f["end"] - f["start"] <= LONGEST_WRAPPED) & F.contains(own(f), F.lit("\n")))

    candidates = F.filter(matches(text, "candidate", WRAPPED), lambda c: F.contains(c["secret"], F.lit("\n")))
    return F.flatten(F.transform(candidates, of))


def scan(text: Column, rules: Rules = DEFAULT_RULES, table: Column | None = None) -> Column:
    """The findings of a scanner in one array, by start, longest first, then rule. A rule's keywords gate its pattern.

    table: rules as a column (array<RULE>), in place of the scanner's own: each row may have others."""
    s = scanner_of(rules)
    none, ready = empty(FINDING), usable(s.rules)
    if not ready and table is None:
        return none

    def kept(found: Column, bound: Column) -> Column:
        """Without what is allowed. bound: the entropy that a secret must pass."""
        tests = []
        if s.hashes:
            tests.append(lambda f: ~digest(f["secret"]).isin(sorted(s.hashes)))
        if s.stopwords:
            tests.append(lambda f: ~f["secret"].isin(sorted(s.stopwords)))
        if s.use_entropy:
            tests.append(lambda f: (bound <= 0) | (entropy(f["secret"]) > bound))
        return F.filter(found, lambda f: reduce(lambda a, b: a & b, [t(f) for t in tests])) if tests else found

    def found(x: Column) -> Column:
        if table is None:
            words = sorted({k.lower() for r in ready for k in r.keywords})
            gated = bind(words_in(x["low"], words), lambda own: F.filter(x["rules"], lambda r: (F.size(r["keywords"]) == 0) | F.arrays_overlap(r["keywords"], own)))
        else:
            gated = F.filter(x["rules"], lambda r: (F.size(r["keywords"]) == 0) | F.exists(r["keywords"], lambda w: F.contains(x["low"], w)))
        lists = [F.flatten(F.transform(gated, lambda r: kept(matches_of(x["text"], r), r["entropy"])))]
        for r in ready if table is None else ():
            if r.id == WRAPPED_RULE:
                broken = F.contains(x["text"], F.lit("\n")) & x["text"].rlike(BEGINS_WRAPPED) & x["text"].rlike(WRAPPED)
                lists.append(F.when(broken, kept(wrapped(x["text"], r), F.lit(r.entropy))).otherwise(none))
        return in_order(F.concat(*lists))

    # The text, its lower case and the rules are made once.
    bound = F.named_struct(F.lit("text"), text, F.lit("low"), ascii_lower(text), F.lit("rules"), rules_column(ready) if table is None else table)
    return F.when(text.isNotNull(), bind(bound, found)).otherwise(none)


def in_order(findings: Column) -> Column:
    keyed = F.transform(findings, lambda f: F.named_struct(F.lit("start"), f["start"], F.lit("minus_end"), -f["end"], F.lit("rule"), f["rule"], F.lit("secret"), f["secret"]))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda k: F.named_struct(F.lit("rule"), k["rule"], F.lit("start"), k["start"], F.lit("end"), -k["minus_end"], F.lit("secret"), k["secret"]))


def find(df: DataFrame, keys: list[str], text: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row for each finding: keys, rule, start, end, secret. Texts without any keyword never meet a pattern."""
    s = scanner_of(rules)
    gate = F.lit(False)
    for r in usable(s.rules):
        gate = gate | contains_any(F.col(text), list(r.keywords))
    rows = df.where(gate).select(*keys, F.explode(scan(F.col(text), s)).alias("f"))
    return rows.select(*keys, "f.*")


def without_hashes(findings: DataFrame, carnet: DataFrame) -> DataFrame:
    """Drops findings whose secret's digest is in carnet (hash)."""
    return findings.join(carnet, digest(findings["secret"]) == carnet["hash"], "left_anti")


def without_stopwords(findings: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Drops findings whose whole secret is in stopwords (word)."""
    return findings.join(stopwords, findings["secret"] == stopwords["word"], "left_anti")


def above_entropy(findings: DataFrame, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    """Keeps findings with more entropy than their rule asks for; a rule with 0 asks for none."""
    bound = F.lit(0.0)
    for r in rules:
        if r.entropy > 0:
            bound = F.when(F.col("rule") == r.id, F.lit(r.entropy)).otherwise(bound)
    return findings.where((bound == 0) | (entropy(F.col("secret")) > bound))


def wrapped_tokens(df: DataFrame, keys: list[str], text: str, rule: Rule) -> DataFrame:
    """Findings of rule in wrapped tokens alone: keys, rule, start, end, secret."""
    rows = df.where(F.contains(F.col(text), F.lit("ey")) & F.contains(F.col(text), F.lit("\n")))
    return rows.select(*keys, F.explode(wrapped(F.col(text), rule)).alias("f")).select(*keys, "f.*")
