"""The life of a rule: draft, approved, rejected, retired. A ledger, not data; no Spark."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

MOVES = {("draft", "approved"), ("draft", "rejected"), ("approved", "retired")}


@dataclass(frozen=True)
class Candidate:
    rule_id: str
    spec: dict[str, Any]
    state: str = "draft"
    strength: str = "weak"
    origin: str = "suggested"
    history: tuple[dict[str, Any], ...] = field(default=())


class Repository:
    """Candidates by id. With a folder, every step is appended to ``ledger.jsonl`` there, with what the candidate is after it.

    A repository opened on a folder goes on from its ledger; a line that was cut short by a crash is passed over.
    """

    def __init__(self, folder: str | Path | None = None):
        self.folder = Path(folder) if folder else None
        self.items: dict[str, Candidate] = {}
        if self.folder and (self.folder / "ledger.jsonl").exists():
            for line in (self.folder / "ledger.jsonl").read_text().splitlines():
                try:
                    entry = json.loads(line)
                except ValueError:
                    continue
                after = entry.pop("after")
                earlier = self.items.get(entry["rule_id"])
                self.items[entry["rule_id"]] = Candidate(entry["rule_id"], **after, history=(*(earlier.history if earlier else ()), entry))

    def _note(self, c: Candidate, step: str, by: str, **more) -> Candidate:
        entry = {"rule_id": c.rule_id, "step": step, "by": by, "at": datetime.now(UTC).isoformat(), **more}
        done = replace(c, history=(*c.history, entry))
        self.items[c.rule_id] = done
        if self.folder:
            self.folder.mkdir(parents=True, exist_ok=True)
            with (self.folder / "ledger.jsonl").open("a") as f:
                f.write(json.dumps(entry | {"after": {"spec": done.spec, "state": done.state, "strength": done.strength, "origin": done.origin}}) + "\n")
        return done

    def _move(self, rule_id: str, state: str) -> Candidate:
        c = self.items[rule_id]
        if (c.state, state) not in MOVES:
            raise ValueError(f"{rule_id} can't go from {c.state} to {state}")
        return replace(c, state=state)

    def load(self, specs: list[dict[str, Any]], by: str = "import") -> list[Candidate]:
        """Drafts of specs that aren't known yet."""
        return [self._note(Candidate(s["rule_id"], s), "load", by) for s in specs if s["rule_id"] not in self.items]

    def add(self, spec: dict[str, Any], by: str) -> Candidate:
        if spec["rule_id"] in self.items:
            raise ValueError(f"{spec['rule_id']} is known already")
        return self._note(Candidate(spec["rule_id"], spec, origin="manual"), "add", by)

    def approve(self, rule_id: str, by: str) -> Candidate:
        return self._note(self._move(rule_id, "approved"), "approve", by)

    def reject(self, rule_id: str, by: str, reason: str) -> Candidate:
        if not reason.strip():
            raise ValueError("a rejection needs a reason")
        return self._note(self._move(rule_id, "rejected"), "reject", by, reason=reason)

    def edit_and_approve(self, rule_id: str, changes: dict[str, Any], by: str) -> Candidate:
        moved = self._move(rule_id, "approved")  # checked before anything is changed
        diff = {k: [moved.spec.get(k), v] for k, v in changes.items() if moved.spec.get(k) != v}
        return self._note(replace(moved, spec=moved.spec | changes), "edit_and_approve", by, diff=diff)

    def retire(self, rule_id: str, by: str) -> Candidate:
        return self._note(self._move(rule_id, "retired"), "retire", by)

    def promote(self, rule_id: str, strength: str, by: str) -> Candidate:
        if strength not in ("weak", "moderate", "strong"):
            raise ValueError(f"unknown strength {strength!r}")
        return self._note(replace(self.items[rule_id], strength=strength), "promote", by, strength=strength)

    def by_state(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for c in self.items.values():
            out[c.state] = out.get(c.state, 0) + 1
        return out

    def export_approved(self, path: str | Path | None = None) -> list[dict[str, Any]]:
        specs = [c.spec for _, c in sorted(self.items.items()) if c.state == "approved"]
        if path:
            import yaml

            Path(path).write_text(yaml.safe_dump({"rules": specs}, sort_keys=False))
        return specs
