"""What all page parsers share: the rules they apply and the rows they give.

Each input line ends as a row, a drop with its reason, or unparsed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import VENDOR_TAGS

FIELDS = ["credit_order", "name_raw", "name_canonical", "category", "role_raw", "character", "studio", "inclusion_class", "source_ref"]
CLASSES = ["core", "publishing", "special-thanks", "babies", "legacy", "community"]

_BREAK = re.compile(r"(?i)<br\s*/?>")


def clean(text: str | None) -> str:
    """Breaks and any white space to single spaces."""
    return " ".join(_BREAK.sub(" ", text or "").split())


@dataclass
class Rules:
    """Ordered (pattern, category), and patterns of what isn't a person."""

    categories: list[tuple[str, str]] = field(default_factory=list)
    denied: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._categories = [(re.compile(p), c) for p, c in self.categories]
        self._denied = [re.compile(p) for p in self.denied]

    def category(self, text: str) -> str:
        return next((c for p, c in self._categories if p.search(text)), "Other")

    def is_denied(self, text: str) -> bool:
        c = clean(text)
        return not c or any(p.search(c) for p in self._denied)


@dataclass
class Output:
    """Rows of one page; credit_order counts rows."""

    rules: Rules
    events: list[dict] = field(default_factory=list)
    order: int = 0

    def row(self, name: str, ref: str, **more: str) -> None:
        out = dict.fromkeys(FIELDS, "") | {"inclusion_class": "core"} | more
        self.events.append(out | {"kind": "row", "name_raw": name, "source_ref": ref, "credit_order": self.order})
        self.order += 1

    def drop(self, line: str, reason: str) -> None:
        self.events.append({"kind": "dropped", "line": line, "reason": reason})

    def fail(self, line: str, ref: str) -> None:
        self.events.append({"kind": "unparsed", "line": line, "source_ref": ref})

    def person(self, name: str, ref: str, **more: str) -> bool:
        """A row, unless the name is denied."""
        if self.rules.is_denied(name):
            self.drop(name, "non-person")
            return False
        self.row(name, ref, **more)
        return True


def standing(tests: list[tuple[str, str]], *texts: str) -> str:
    """Class of the first text that any test finds: all tests on one text, then the next text."""
    return next((cls for t in texts if t for p, cls in tests if re.search(p, t)), "core")


def vendor_tag(text: str, mode: str | bool | None) -> tuple[str, str]:
    """(text without its trailing agency, the agency)."""
    if not mode:
        return text, ""
    key = "suffix" if mode is True else mode
    if key not in VENDOR_TAGS:
        raise ValueError(f"unknown inline_vendor {mode!r}; it is true or one of {sorted(VENDOR_TAGS)}")
    m = re.search(VENDOR_TAGS[key], text)
    return (text[: m.start()], clean(m[1])) if m else (text, "")


def headings(option: list | dict | None) -> dict[str, str]:
    """Headings that name a company, by folded text: a list, or a map to the company's name."""
    pairs = option.items() if isinstance(option, dict) else ((h, h) for h in option or [])
    return {clean(k).casefold(): clean(v) for k, v in pairs}


#: Words that decide standing, by page kind; their order is their precedence.
BABIES = (r"(?i)\bproduction babies\b", "babies")
THANKS = (r"(?i)special thanks", "special-thanks")
WIKI_STANDING = [BABIES, THANKS, (r"(?i)\b(xbox|playstation|microsoft|localization|marketing|public relations)\b", "publishing")]
TABLE_STANDING = [BABIES, (r"(?i)special thanks|^thanks$", "special-thanks"), (r"(?i)\b(xbox|microsoft|mgs|marketing|public relations|localization)\b", "publishing")]
PANE_PUBLISHING = (r"(?i)\b(microsoft|marketing|public relations|localization|xbox)\b", "publishing")
SPAN_STANDING = [(r"(?i)\bcommunity members\b", "community"), BABIES, THANKS, (r"(?i)^(xbox|playstation|microsoft|marketing|public relations)$", "publishing")]
SHEET_STANDING = [BABIES, THANKS, (r"(?i)\b(xbox|marketing|public relations|publishing|localization)\b", "publishing")]
