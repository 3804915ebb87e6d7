"""Skill files: Markdown with front matter. They are a handful of small files, read on the driver."""

from __future__ import annotations

import re
from pathlib import Path

_ITEM, _RULE = re.compile(r"^[-*]\s+(.*)$"), re.compile(r"^(?:\d+\.|[-*])\s+(.*)$")


def scalar(text: str):
    """A list in brackets, a quoted text, a truth value, a number or else the text."""
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [part.strip().strip("\"'") for part in text[1:-1].split(",") if part.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def front_matter(text: str) -> dict:
    """Keys and values, one level of nesting, and lists of lines that begin with a dash."""
    top: dict = {}
    at, name, owner = top, None, top
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare[0] == "#":
            continue
        if bare.startswith("- "):
            if name is not None:
                if not isinstance(owner.get(name), list):
                    owner[name] = []
                owner[name].append(scalar(bare[2:]))
            continue
        key, colon, value = bare.partition(":")
        if not colon:
            continue
        if not line.startswith(" "):
            at = top
        name, owner = key.strip().strip("\"'"), at
        if value.strip():
            at[name] = scalar(value)
        else:
            at[name] = {}
            at = at[name]
    return top


def sections(body: str) -> tuple[dict[str, list[str]], list[str]]:
    """(patterns by category, rules) of the body's parts of these names."""
    patterns: dict[str, list[str]] = {}
    rules: list[str] = []
    part, category = None, "General"
    for line in map(str.strip, body.splitlines()):
        if line.startswith("## "):
            part, category = line[3:].strip().split(" ")[0].lower(), "General"
        elif part == "patterns" and line.startswith("### "):
            category = line[4:].strip()
        elif part == "patterns" and (found := _ITEM.match(line)):
            patterns.setdefault(category, []).append(found[1].strip().strip("`"))
        elif part == "rules" and (found := _RULE.match(line)):
            rules.append(found[1].strip())
    return patterns, rules


def load_skills(root: str) -> list[dict]:
    """All valid skill files below root, by path; others are skipped."""
    out = []
    for path in sorted(Path(root).rglob("*.md")):
        text = path.read_text(encoding="utf-8", errors="replace")
        parts = re.split(r"(?m)^---\s*$", text, maxsplit=2)
        if len(parts) < 3 or not (head := front_matter(parts[1])).get("name"):
            continue
        patterns, rules = sections(parts[2])
        triggers = head.get("triggers") if isinstance(head.get("triggers"), dict) else head
        out.append({"name": head["name"], "keywords": triggers.get("keywords") or [], "patterns": [p for ps in patterns.values() for p in ps] + (triggers.get("patterns") or []), "rules": rules, "meta": head})
    return out
