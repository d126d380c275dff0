"""Report lines from the statistics' rows."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path


def rate_text(n: int, of: int, noun: str = "") -> str:
    """`x.x% (n/of noun)`, or n/a where there is nothing to divide by."""
    tail = f"({n}/{of}{' ' + noun if noun else ''})"
    return f"{n / of:.1%} {tail}" if of else f"n/a (0/0{' ' + noun if noun else ''})"


def histogram_lines(counts: Iterable[tuple[str, int]], indent: str = "  ") -> list[str]:
    """Counts from the highest, ties by label."""
    return [f"{indent}{n:>4}  {label}" for label, n in sorted(counts, key=lambda x: (-x[1], x[0]))]


def outcome_line(ident: str, title: str, outcome: str, match: str | None) -> str:
    """What curation did with a candidate."""
    if outcome == "dropped":
        return f"dropped {ident}: {title} (matches a rejected tombstone)"
    more = {"amendment": f" (proposes amendment of {match})", "supersession": f" (may supersede {match})"}.get(outcome, "")
    return f"staged {ident}: {title}{more}"


def review_lines(s, reasons: Iterable[tuple[str, int]] = (), gates: Iterable[tuple[str, int]] = ()) -> list[str]:
    """Of one row of stats.review_stats: human decisions and extraction apart, each with its own denominator."""
    reasons, gates = list(reasons), list(gates)
    out = [f"{label:<22} {n:>5}" for label, n in (("shown to a human", s.shown), ("  approved, all ways", s.approved), ("  rejected", s.rejected), ("  skipped", s.skipped))]
    out += [f"{'approval rate':<22} {rate_text(s.approved, s.shown, 'shown')}", f"{'  excluding skipped':<22} {rate_text(s.approved, s.shown - s.skipped, 'decided')}"]
    out += ["", "rejection reasons", *histogram_lines(reasons)] if reasons else []
    out += ["", f"{'extracted':<22} {s.extracted:>5}", f"{'  dropped by a gate':<22} {s.gate_dropped:>5}", f"{'gate-drop rate':<22} {rate_text(s.gate_dropped, s.extracted, 'extracted')}"]
    return out + histogram_lines(gates)


def capture_lines(s, modes: Iterable[tuple[str, int]] = ()) -> list[str]:
    """Of one row of stats.capture_stats."""
    modes = list(modes)
    out = [f"{label:<22} {n:>5}" for label, n in (("sessions", s.considered), ("  captured", s.captured), ("  never logged", s.missed), ("  logged, not queued", s.failed))]
    return out + [f"{'capture rate':<22} {rate_text(s.captured, s.considered, 'sessions')}"] + (["", "by mode", *histogram_lines(modes)] if modes else [])


def review_summary(approved: int, rejected: int, skipped: int, remaining: int) -> str:
    return f"{approved} approved, {rejected} rejected, {skipped} skipped, {remaining} remaining in staging"


def check_line(status: str, name: str, detail: str) -> str:
    return f"{status:<10} {name}: {detail}"


def write_report(path: str, modes: dict, summary: dict, fixtures: list[dict]) -> None:
    """The evaluation's report as one JSON file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"modes": modes, "summary": summary, "fixtures": fixtures}, indent=2) + "\n", encoding="utf-8")
