"""A target schema proposed from profiles alone, and names that headers suggest as aliases; both are offers, never applied."""

from __future__ import annotations

import re
from collections import defaultdict
from typing import Any

from quernstone.operators.profiling import mask_regex
from quernstone.operators.scoring import tokens
from quernstone.schema import Field, TargetSchema

# Words of columns that keep records of the system itself, words of identifiers, and thresholds.
PLUMBING = re.compile(r"(?:^|_)(?:created|updated|modified|synced|deleted|checksum|hash|etl|batch|audit|version|seq|row|sync|ts|internal)(?:_|$)")
IDENTIFIER = re.compile(r"(?:^|_)(?:id|code|no|num|number|key|ref)$")
LEAST_VALUES, LOOKUP_RATIO, UNIQUE_RATIO, ID_MASK, PATTERN_MASK, REQUIRED_COVERAGE, REFERENCE_SHARE, ALIAS_VOTE = 8, 0.9, 0.99, 0.9, 0.95, 0.80, 0.9, 0.80


def model_view(profile: Any) -> dict[str, Any]:
    """A short, rounded view of one profile, of a size that no table changes."""
    return {
        "column": profile.column, "rows": profile.total, "filled": profile.non_null, "distinct": profile.distinct, "unique": round(profile.cardinality_ratio, 3),
        "types": {t: round(r, 3) for t, r in (profile.types or {}).items()}, "dates": list(profile.date_formats or []), "masks": [(m.mask, round(m.coverage, 3)) for m in profile.masks or []], "values": [t.v for t in (profile.top or [])[:5]],
    }


def _type(p: Any) -> str:
    rates = p.types or {}
    if (p.date_rate or 0) >= 0.95:
        return "date"
    return next((t for t in ("email", "integer", "number") if rates.get(t, 0) >= 0.95), "string")


def propose_schema(profiles: list[Any], lookups: dict[str, set[str]] | None = None, entity: str = "record") -> TargetSchema:
    """Fields from column names over all files: the plumbing left out (unless all is), required where most rows have them, unique and patterned where all their columns are."""
    groups: dict[str, list[Any]] = defaultdict(list)
    for p in profiles:
        groups["_".join(tokens(p.column)) or p.column].append(p)
    kept = {n: ps for n, ps in groups.items() if not PLUMBING.search(n)} or groups
    fields = []
    for name, ps in kept.items():
        rows: dict[str, int] = {}
        for p in ps:
            rows[p.file] = max(rows.get(p.file, 0), p.total)
        full = [p for p in ps if p.non_null >= LEAST_VALUES]
        coverage = sum(p.non_null for p in ps) / max(1, sum(rows.values()))
        f = Field(name, _type(max(ps, key=lambda p: p.non_null)), required=coverage >= REQUIRED_COVERAGE, aliases=sorted({p.column for p in ps} - {name}))
        unique = bool(full) and all(p.cardinality_ratio >= UNIQUE_RATIO for p in full)
        f.unique = unique and (bool(IDENTIFIER.search(name)) or f.type == "email")
        shapes = {p.masks[0].mask for p in full if p.masks and p.masks[0].coverage >= (ID_MASK if IDENTIFIER.search(name) else PATTERN_MASK)}
        if f.type == "string" and full and len(shapes) == 1 and all(p.masks for p in full) and any(c.isdigit() or c == "#" for c in next(iter(shapes))):
            f.pattern = mask_regex(next(iter(shapes)))
        for lookup, codes in (lookups or {}).items():
            top = [t.v for p in full for t in p.top or []]
            if top and min(p.cardinality_ratio for p in full) < LOOKUP_RATIO and sum(v in codes for v in top) / len(top) >= REFERENCE_SHARE:
                f.reference = f"{lookup}.code"
        fields.append(f)
    first = next((f.name for f in fields if f.unique), fields[0].name if fields else None)
    return TargetSchema(entity, fields, {k: ["code"] for k in lookups or {}}, blocking=[[first]] if first else [])


def offer_aliases(schema: TargetSchema, headers: list[str], votes: dict[str, dict[str, float]]) -> dict[str, list[str]]:
    """Headers that no name or alias speaks for, by the field that a vote of ALIAS_VOTE or more names."""
    taken = {re.sub(r"[^a-z0-9]+", "", n.casefold()) for f in schema.fields for n in (f.name, *f.aliases)}
    offers: dict[str, list[str]] = defaultdict(list)
    for h in headers:
        if re.sub(r"[^a-z0-9]+", "", h.casefold()) not in taken:
            for name, vote in votes.get(h, {}).items():
                if vote >= ALIAS_VOTE:
                    offers[name].append(h)
    return dict(offers)
