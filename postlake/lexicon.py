"""Word lists and rules of the hint operators, compiled to Columns.

A lexicon is configuration: it is read on the driver and turned into literals, so matching
needs neither a join nor a Python worker.  Lifecycle and billing patterns match between
non-word characters, event patterns match anywhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import bind, contains_any
from .wordlists import BILLING_RULES, LIFECYCLE_RULES, PATTERNS

WORD = r"\p{L}\p{N}_"
RESERVATIONS = ("restaurant", "hotel", "spa", "salon", "bar")
LIFECYCLE_KINDS = ("subscription_canceled", "subscription_renewed", "subscription_created", "membership_updated", "billing_notice", "order_confirmation", "ticket_confirmation", "unknown")
ACTION_KINDS = ("view_invoice", "pay_now", "manage_subscription", "update_payment_method", "billing_portal", "unknown")


class Regex(str):
    """A pattern that is an expression, to be found anywhere in lower-case text."""


def _quoted(p: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", p)


def bounded(patterns: list[str] | tuple[str, ...]) -> str:
    """An expression that finds any of the literals between non-word characters, or any of the expressions."""
    literals = [_quoted(p) for p in patterns if not isinstance(p, Regex)]
    found = [f"(?:^|[^{WORD}])(?:{'|'.join(literals)})(?:$|[^{WORD}])"] if literals else []
    return "|".join(found + [f"(?:{p})" for p in patterns if isinstance(p, Regex)]) or "(?!)"


def anywhere(text: Column, patterns: list[str]) -> Column:
    """Whether any of the literals or expressions is in a text."""
    out = contains_any(text, [p for p in patterns if not isinstance(p, Regex)])
    for p in patterns:
        if isinstance(p, Regex):
            out = out | text.rlike(p)
    return out


@dataclass
class Rule:
    priority: int
    id: str
    kind: str
    signal: str | None
    groups: list[list[str]]


@dataclass
class Lexicon:
    patterns: dict[str, list[str]] = field(default_factory=dict)
    lifecycle: list[Rule] = field(default_factory=list)
    billing: list[tuple[str, str, list[str]]] = field(default_factory=list)

    def matches(self, family: str, text: Column) -> Column:
        """Bounded match of lifecycle and gate patterns, substring match of the others."""
        if family in ("lifecycle_keyword", "confirmation_gate"):
            return text.rlike(bounded(self.patterns[family]))
        return anywhere(text, self.patterns[family])

    def finds(self, family: str, text: str) -> bool:
        """matches() of a family that is found anywhere, for a string on a worker."""
        return any(re.search(p, text) if isinstance(p, Regex) else p in text for p in self.patterns[family])

    def _ordered(self) -> list[Rule]:
        return sorted(self.lifecycle, key=lambda r: (-r.priority, r.id))

    def lifecycle_rule(self, text: Column) -> Column:
        """The place, from 1, of the first rule that holds, by falling priority, then id (L05); null for none."""
        out = F.lit(None).cast("int")
        for i, r in reversed(list(enumerate(self._ordered(), 1))):
            hit = F.lit(True)
            for g in r.groups:
                hit = hit & text.rlike(bounded(g))
            out = F.when(hit, F.lit(i)).otherwise(out)
        return out

    def lifecycle_values(self, rule: Column, value) -> Column:
        """value(rule) for the place of a rule."""
        return F.try_element_at(F.array(*(F.lit(value(r)).cast("string") for r in self._ordered())), rule) if self.lifecycle else F.lit(None).cast("string")

    def classify_lifecycle(self, text: Column) -> Column:
        return self.lifecycle_values(self.lifecycle_rule(text), lambda r: r.kind)

    def lifecycle_signal(self, text: Column) -> Column:
        return self.lifecycle_values(self.lifecycle_rule(text), lambda r: r.signal)

    def classify_billing(self, line: Column) -> Column:
        """Action of the first rule in file order that matches a line."""
        out = F.lit(None).cast("string")
        for _, kind, patterns in reversed(self.billing):
            out = F.when(line.rlike(bounded(patterns)), F.lit(kind)).otherwise(out)
        return out

    def reservation_type(self, text: Column) -> Column:
        """restaurant before hotel, spa, salon, bar; other for a reservation without any; else null."""
        return bind(text, lambda t: self.reservation_of(lambda family: self.matches(family, t)))

    def reservation_of(self, has: Callable[[str], Column]) -> Column:
        """reservation_type() by whether a text has a family."""
        out = F.when(has("event_reservation_intent"), F.lit("other"))
        for kind in reversed(RESERVATIONS):
            out = F.when(has(f"event_reservation_{kind}"), F.lit(kind)).otherwise(out)
        return out


def default_lexicon() -> Lexicon:
    split = lambda s: s.split("|")
    return Lexicon({k: split(v) for k, v in PATTERNS.items()}, [Rule(p, i, k, s, [split(g) for g in groups]) for p, i, k, s, groups in LIFECYCLE_RULES], [(i, k, split(v)) for i, k, v in BILLING_RULES])


def from_config(config: dict) -> Lexicon:
    """A lexicon of a parsed configuration; raises ValueError where it isn't valid.

    An event family that is missing or empty takes the default's patterns.
    """
    if config.get("version") != 1:
        raise ValueError(f"unsupported lexicon version: {config.get('version')}")
    base, out = default_lexicon(), Lexicon()

    def patterns(items: list, where: str) -> list[str]:
        return [pattern_of(x.get("pattern"), x.get("match_mode"), where) if isinstance(x, dict) else pattern_of(x, None, where) for x in items or []]

    for family in base.patterns:
        own = patterns(config.get(family) or config.get(f"{family}_patterns"), family)
        if not own and family == "lifecycle_keyword":
            raise ValueError(f"{family} must not be empty")
        out.patterns[family] = own if own or not family.startswith("event_") else base.patterns[family]
    ids: set[str] = set()
    for section in ("lifecycle_rules", "billing_action_rules"):
        if not config.get(section):
            raise ValueError(f"{section} must not be empty")
        for r in config[section]:
            if r["id"] in ids:
                raise ValueError(f"duplicate rule id: {r['id']}")
            ids.add(r["id"])
            if section == "lifecycle_rules":
                groups = [patterns(g, r["id"]) for g in r.get("all_groups") or []]
                any_ = patterns(r.get("any"), r["id"])
                if not groups and not any_:
                    raise ValueError(f"rule {r['id']} has no pattern")
                if r["kind"] not in LIFECYCLE_KINDS:
                    raise ValueError(f"unknown kind: {r['kind']}")
                out.lifecycle.append(Rule(int(r.get("priority", 0)), r["id"], r["kind"], r.get("signal"), groups + ([any_] if any_ else [])))
            else:
                if r["action_kind"] not in ACTION_KINDS:
                    raise ValueError(f"unknown action: {r['action_kind']}")
                out.billing.append((r["id"], r["action_kind"], patterns(r["patterns"], r["id"])))
    return out


def pattern_of(pattern, mode: str | None, where: str) -> str:
    """A literal in lower case, or an expression, which must be a valid one."""
    p = str(pattern or "").strip()
    if not p:
        raise ValueError(f"empty pattern in {where}")
    if mode in (None, "literal"):
        return re.sub("[A-Z]+", lambda m: m.group().lower(), p)
    if mode != "regex":
        raise ValueError(f"unknown match_mode in {where}: {mode}")
    try:
        re.compile(p)
    except re.error as e:
        raise ValueError(f"invalid expression in {where}: {e}") from e
    return Regex(p)


def load(path: str) -> Lexicon:
    """A lexicon of a YAML or JSON file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return from_config(json.loads(text))
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("YAML files need PyYAML; a JSON file does not") from e
    return from_config(yaml.safe_load(text))


def parse_overrides(text: str) -> list[tuple[str, str]]:
    """(target, pattern) of JSON lines that add patterns; blank lines and # comments are skipped."""
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.strip().startswith("#"):
            continue
        op = json.loads(line)
        if extra := set(op) - {"op", "target", "pattern", "match_mode"}:
            raise ValueError(f"line {number}: unknown field {sorted(extra)[0]}")
        if op.get("op") != "add_pattern":
            raise ValueError(f"line {number}: unknown op {op.get('op')}")
        out.append((re.sub("_patterns$", "", str(op.get("target"))), pattern_of(op.get("pattern"), op.get("match_mode"), f"line {number}")))
    return out


def apply_overrides(lexicon: Lexicon, ops: list[tuple[str, str]]) -> Lexicon:
    """The lexicon with the patterns added that it doesn't have."""
    patterns = {k: list(v) for k, v in lexicon.patterns.items()}
    for target, pattern in ops:
        if target not in patterns:
            raise ValueError(f"unknown target: {target}")
        if not any(p == pattern and isinstance(p, Regex) == isinstance(pattern, Regex) for p in patterns[target]):
            patterns[target].append(pattern)
    return Lexicon(patterns, lexicon.lifecycle, lexicon.billing)
