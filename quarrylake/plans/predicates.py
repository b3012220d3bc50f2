"""Predicates built on the driver and handed to Catalyst, which pushes them to the scan where it can."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# Authorities that count as approved guidance.
ELIGIBLE_AUTHORITIES = ("canonical_repo", "reviewed_shared", "user_approved")


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def uri_scope(column: Column, scopes: list[str] | None) -> Column:
    """Inside any scope (itself or below). None or an empty list restricts nothing; a list of blanks matches nothing."""
    if not scopes:
        return F.lit(True)
    names = [s.strip().split("#", 1)[0].rstrip("/") for s in scopes]
    names = [s for s in names if s]
    return reduce(lambda a, b: a | b, [(column == s) | column.startswith(s + "/") for s in names], F.lit(False))


def normalize_scope(scope: str | None) -> str:
    out: list[str] = []
    for part in (scope or "").replace("\\", "/").lower().split("/"):
        part = part.strip()
        if part == "..":
            out = out[:-1]
        elif part and part != ".":
            out.append(part)
    return "/".join(out)


def ancestors(scope: str) -> list[str]:
    parts = normalize_scope(scope).split("/")
    return ["/".join(parts[: i + 1]) for i in range(len(parts)) if parts[0]]


def workspace_scope(column: Column, scope: str | None, mode: str = "hierarchy") -> Column:
    """hierarchy: unscoped rows and those of the scope or above; sibling: scoped rows elsewhere."""
    names = ancestors(scope or "")
    if not names:
        return F.lit(True)
    if mode == "sibling":
        return column.isNotNull() & ~column.isin(*names)
    return column.isNull() | column.isin(*names)


def project_is(column: Column, project: str | None) -> Column:
    p = (project or "").strip().lower()
    return F.lower(F.trim(column)) == p if p else F.lit(True)


def eligibility(project: Column, approved: Column, policy: dict) -> Column:
    """policy kinds: all, projects (listed ones and rows without a project), approved (approved rows only), none."""
    kind = policy.get("kind", "all")
    if kind == "projects":
        names = [p.strip().lower() for p in policy.get("projects", ())]
        return project.isNull() | F.lower(project).isin(*names) if names else F.lit(False)
    if kind == "approved":
        return approved.eqNullSafe(F.lit(True))
    return F.lit(kind == "all")


def authority_is_eligible(authority: Column, trust: Column) -> Column:
    return (trust == "approved") & authority.isin(*ELIGIBLE_AUTHORITIES)


def requests_approved_guidance(query: str) -> bool:
    """approved or canonical within eight words of a guidance term, in a clause without a negation."""
    for clause in re.split(r"[.;!?\n]", query.lower()):
        words = re.findall(r"[\w'-]+", clause)
        if any(w in ("not", "no", "never", "without", "don't") for w in words):
            continue
        a = [i for i, w in enumerate(words) if w in ("approved", "canonical")]
        b = [i for i, w in enumerate(words) if w in ("guidance", "guideline", "guidelines", "convention", "conventions", "policy", "policies", "standard", "standards", "rule", "rules")]
        if any(abs(i - j) <= 8 for i in a for j in b):
            return True
    return False


def derive_policy(query: str, project: str | None = None, workset: list[str] | None = None) -> dict:
    if workset is not None and not workset:
        return {"kind": "none"}
    if requests_approved_guidance(query):
        return {"kind": "approved"}
    if workset:
        return {"kind": "projects", "projects": workset}
    return {"kind": "projects", "projects": [project]} if project else {"kind": "all"}


def valid_now(now: Column, start: Column, end: Column) -> Column:
    """Both ends inclusive, open where null: the rule of connections."""
    return F.coalesce(start <= now, F.lit(True)) & F.coalesce(now <= end, F.lit(True))


def expired(now: Column, end: Column) -> Column:
    """The rule of hygiene: the end itself has expired."""
    return F.coalesce(end <= now, F.lit(False))


def within(candidate: Column, root: Column) -> Column:
    """Containment by path segments."""
    c, r = (F.split(F.regexp_replace(x, "/+$", ""), "/") for x in (candidate, root))
    return F.slice(c, 1, F.size(r)) == r


def tenant(column: Column, tenant_id: str) -> Column:
    """Row isolation: to be applied by every view of a hosted table."""
    return column == F.lit(tenant_id)


def physical_limit(n: int) -> int:
    """How many rows to fetch so that n distinct ones survive: 8 n within 256 and 4096."""
    return max(256, min(4096, 8 * n))


def threshold(value: str | float | None, default: float = 0.3) -> float:
    if value is None:
        return default
    x = float(value)
    if not 0 <= x <= 1:
        raise ValueError("a score threshold is between 0 and 1")
    return x


def split_budget(total: int, repositories: int) -> list[int]:
    """Even shares, the first ones a unit larger."""
    return [total // repositories + (i < total % repositories) for i in range(repositories)] if repositories else []


def parse_endpoint(value: str) -> dict:
    """path#symbol, a stable id cgs_..., or a bare symbol."""
    value = value.strip()
    if value.startswith("cgs_"):
        return {"id": value}
    path, mark, symbol = value.partition("#")
    return {"path": path or None, "symbol": symbol} if mark else {"path": None, "symbol": value}


def refresh_required(force: bool, initialised: bool, integrity_ok: bool, generation: str | None, indexed: str | None) -> bool:
    """Age alone never asks for a refresh."""
    return force or not initialised or not integrity_ok or generation != indexed


def expansion_batches(n: int, sizes: tuple = (4, 4, 16)) -> list[range]:
    out, at = [], 0
    for s in sizes:
        if at >= n:
            break
        out.append(range(at, min(n, at + s)))
        at += s
    return out


def glob_bounds(prefix: str) -> tuple[str, str]:
    """Half-open range of strings that start with prefix."""
    return prefix, prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix else "\U0010ffff"


# What a query says of the records that it is about; a space stands for itself, ? and .* as in patterns.
SCOPE_WORDS = {
    "preferences": ("preferences?", "prefer", "styles?", "tone", "voice", "writing", "persona", "communication"),
    "handoffs": ("handoffs?", "status", "next step", "in progress", "wip", "current work", "where .* left"),
    "durable": ("durable", "feature knowledge", "design decisions?", "invariants?", "api contract", "gotchas?"),
    "incidents": ("incidents?", "outage", "post-?mortem", "on-?call", "escalation"),
}


def scope_intents(query: Column) -> Column:
    """The kinds of record that a query is about, in the order of SCOPE_WORDS; none: unclear, search everywhere."""
    hit = lambda words: F.coalesce(query, F.lit("")).rlike(rf"(?i)\b(?:{'|'.join(words)})\b")
    return F.filter(F.array(*[F.when(hit(words), F.lit(name)) for name, words in SCOPE_WORDS.items()]), lambda x: x.isNotNull())


def exact_scopes(query: Column, project: Column, base: str, agents: str, repositories: str, external: str, archived: bool = False) -> Column:
    """The folders that a query's exact terms are looked up in.

    A clear query asks the folders of its kinds, those of a project where one is known, besides what is shared and what comes from
    outside; an unclear one asks all, the agents' and the repositories' too. archived adds the archives of what is asked.
    """
    own = lambda folder: F.concat(F.lit(f"{base}/{folder}"), F.coalesce(F.concat(F.lit("/"), project), F.lit("")))
    places = {"preferences": F.lit(f"{base}/preferences"), "durable": own("durable/projects"), "handoffs": own("handoffs/active"), "incidents": own("incidents/active")}
    intents = scope_intents(query)
    broad = F.size(intents) == 0
    wants = lambda kind: broad | F.array_contains(intents, kind)
    rows = [F.when(wants(kind), place) for kind, place in places.items()]
    rows += [F.lit(f"{base}/shared"), F.when(broad, F.lit(agents)), F.when(broad, F.lit(repositories)), F.lit(external)]
    if archived:
        rows += [F.when(wants(kind), F.lit(f"{base}/{kind}/archived")) for kind in ("durable", "handoffs", "incidents")]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())
