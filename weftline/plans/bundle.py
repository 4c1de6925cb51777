"""Bundles: several mappings put together to one job, and a run's summary held against an expected one."""

from __future__ import annotations

import copy
import hashlib
from pathlib import Path


class BundleConflict(ValueError):
    pass


def assemble(modules: dict[str, dict], base: dict) -> dict:
    """The plain form of one job: rule ids prefixed by module, value maps that differ under one name renamed.

    Defaults of modules must agree. `base` gives the job's inputs, outputs and strategies.
    """
    out = copy.deepcopy(base)
    mapping = out.setdefault("mapping", {})
    rules, enums, defaults = mapping.setdefault("rules", []), mapping.setdefault("enums", {}), mapping.setdefault("defaults", {})
    for module, job in modules.items():
        own = copy.deepcopy(job.get("mapping", {}))
        renamed = {}
        for name, values in own.get("enums", {}).items():
            new = name if enums.get(name, values) == values else f"{module}_{name}"
            enums[new] = values
            if new != name:
                renamed[name] = new
        for name, value in own.get("defaults", {}).items():
            if defaults.get(name, value) != value:
                raise BundleConflict(f"default {name} of module {module} differs")
            defaults[name] = value
        ids = {r["id"] for r in own.get("rules", [])}
        for r in own.get("rules", []):
            r["id"] = f"{module}.{r['id']}"
            for ref in r.get("refs", []):
                if ref.get("targetRule") in ids:
                    ref["targetRule"] = f"{module}.{ref['targetRule']}"
            r = _renamed(r, renamed)
            rules.append(r)
    return out


#: Calls whose second argument names a value map.
MAPPED = {"enummap", "enummapdefault", "enummapstrict"}


def _renamed(x, names: dict[str, str]):
    """A rule's plain form with the names of value maps changed, wherever a call refers to one."""
    if isinstance(x, dict):
        if len(x) == 1:
            ((call, args),) = x.items()
            if call.lower() in MAPPED and isinstance(args, list) and len(args) > 1:
                return {call: [_renamed(args[0], names), names.get(args[1], args[1]), *(_renamed(a, names) for a in args[2:])]}
        return {k: _renamed(v, names) for k, v in x.items()}
    return [_renamed(v, names) for v in x] if isinstance(x, list) else x


def run_bundle(spark, manifest: dict, modules: dict[str, dict], *, source: str | None = None, expected: dict | None = None, commit: bool = True) -> dict:
    """Check the source's digest, put the modules together, run the job and hold its summary against the expected one.

    `manifest`: base (the job's plain form without rules), source {path, sha256} and
    expectedSummary. Gives the report, the summary, the differences, and `ok`.
    """
    from weftline.plans.job import job_of
    from weftline.plans.runner import run

    told = manifest.get("source") or {}
    path = source or told.get("path")
    if told.get("sha256") and not source_matches(path, told["sha256"]):
        raise BundleConflict(f"source {path} is not the one that the bundle was made for")
    report = run(spark, job_of(assemble(modules, manifest["base"])), commit=commit)
    expected = expected if expected is not None else manifest.get("expectedSummary")
    found = summary(report)
    differences = summaries_match(expected, found) if expected is not None else []
    return {"report": report, "summary": found, "differences": differences, "ok": report["status"] != "ROLLED_BACK" and not differences}


def source_matches(path: str, sha256: str) -> bool:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest() == sha256.lower()


def summary(report: dict) -> dict:
    """What of a run's report is compared: counters, diagnostics by code and by rule; no times."""
    codes: dict[str, int] = {}
    by_rule: dict[str, int] = {}
    for d in report["diagnostics"]:
        codes[d["code"]] = codes.get(d["code"], 0) + d["n"]
        by_rule[d.get("rule") or ""] = by_rule.get(d.get("rule") or "", 0) + d["n"]
    return {"rules": {r["rule"]: {k: r[k] for k in ("visited", "filtered", "created")} for r in report["rules"]}, "diagnostics": codes, "diagnosticsByRule": by_rule}


def summaries_match(expected: dict, actual: dict) -> list[str]:
    """Paths at which two summaries differ."""
    out = []

    def walk(a, b, path):
        if isinstance(a, dict) and isinstance(b, dict):
            for k in sorted({*a, *b}, key=str):
                walk(a.get(k), b.get(k), f"{path}/{k}")
        elif a != b:
            out.append(f"{path}: {a!r} and {b!r}")

    walk(expected, actual, "")
    return out
