"""Rules as canonical bytes: the same rule gives the same bytes, which read back to it."""

from __future__ import annotations

import json
from dataclasses import fields

from trivium.plans.rulelang import Rule, RuleError

VERSION = 1


def _plain(value):
    if isinstance(value, tuple):
        return {"t": [_plain(v) for v in value]}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {"d": sorted([k, _plain(v)] for k, v in value.items())}
    return value


def _back(value):
    if isinstance(value, list):
        return [_back(v) for v in value]
    if isinstance(value, dict):
        return tuple(_back(v) for v in value["t"]) if "t" in value else {k: _back(v) for k, v in value["d"]}
    return value


def encode(rule: Rule) -> bytes:
    body = {f.name: _plain(getattr(rule, f.name)) for f in fields(Rule)}
    return json.dumps({"version": VERSION, "rule": body}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def decode(data: bytes) -> Rule:
    """The rule of :func:`encode`; anything else is refused."""
    try:
        held = json.loads(data)
        body = held["rule"] if held["version"] == VERSION else None
        rule = Rule(**{k: _back(v) for k, v in body.items()})
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise RuleError(f"no rule: {e}") from e
    if encode(rule) != data:
        raise RuleError("no rule in its canonical form")
    return rule
