"""Service-level rules in YAML, read and written."""

from __future__ import annotations

from dataclasses import dataclass, field

from strideline.operators.labels import Apdex
from strideline.operators.sla import METRICS, OPS, Rule, normal_metric


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    steady_window: bool = True
    apdex: Apdex = field(default_factory=Apdex)


def loads(text: str) -> RuleSet:
    """Rules with defaults for the window and the Apdex thresholds; unknown metrics and comparisons are refused."""
    import yaml

    doc = yaml.safe_load(text) or {}
    defaults = doc.get("defaults") or {}
    given = defaults.get("apdex") or {}
    out = RuleSet(steady_window=str(defaults.get("window", "steady-state")) != "full-run", apdex=Apdex(int(given.get("satisfied_ms", 500)), int(given.get("tolerated_ms", 1500))))
    for rule in doc.get("rules") or []:
        for a in rule.get("assert") or []:
            metric, op = str(a["metric"]), str(a["op"])
            if normal_metric(metric) not in METRICS or op not in OPS:
                raise ValueError(f"rule for {rule['match']!r}: {metric} {op} isn't known")
            out.rules.append(Rule(str(rule["match"]), metric, op, float(a["value"]), None if a.get("warn") is None else float(a["warn"])))
    return out


def dumps(rules: list[Rule], satisfied: int | None = None, tolerated: int | None = None) -> str:
    import yaml

    by_match: dict[str, list[dict]] = {}
    for r in rules:
        entry = {"metric": r.metric, "op": r.op, "value": r.value} | ({} if r.warn is None else {"warn": r.warn})
        by_match.setdefault(r.match, []).append(entry)
    defaults: dict = {"window": "full-run"}
    if satisfied is not None:
        defaults["apdex"] = {"satisfied_ms": int(satisfied), "tolerated_ms": int(tolerated)}
    return yaml.safe_dump({"version": 1, "defaults": defaults, "rules": [{"match": m, "assert": a} for m, a in by_match.items()]}, sort_keys=False)
