"""Credit pages compiled into a script: one bundle holds several releases' tiers.

The frozen text is the page, a marker and the script. Options: release, functions
(blocks that aren't companies), publishing (blocks), publishing_areas, vague
(headings that say nothing about the work), helper (a pattern of blocks that name
the company behind the work, with the company as its group).
"""

from __future__ import annotations

import json
import re

from .credits import Output, Rules, clean

MARKER = "/*__SCRIPT__*/"
#: How the compiled script spells strings, tiers, titles, paragraphs and rosters.
_STRING = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
_VALUE = rf"(?:\w+\(\s*(?P<{{0}}key>{_STRING})\s*\)|(?P<{{0}}lit>{_STRING}))"
_TIER_KEY = "credits.block-titles."
_TIER = re.compile(r"=\s*function\s*\([A-Za-z_$][\w$]*\)\s*\{[^{}]*?\"(credits\.block-titles\.[^\"]+)\"")
_COMPONENT = re.compile(r"[A-Za-z_$][\w$]*\s*=\s*function\s*\(")
_STRUCTURE = re.compile(
    r"blockTitle:\s*" + _VALUE.replace("{0}", "b") + r"|areaTitle:\s*" + _VALUE.replace("{0}", "a") + r"|(?P<p>\"p\",\s*\{)"
    rf"|(?P<roster>\b[A-Za-z_$][\w$]*\s*=\s*\[\s*{_STRING}\s*(?:,\s*{_STRING}\s*)*\])"
)
_AREA = re.compile(r"areaTitle:\s*" + _VALUE.replace("{0}", "a"))
_INSIDE = re.compile(
    r"\"strong\",\s*\{children:\s*" + _VALUE.replace("{0}", "s") + rf"|\"span\",\s*\{{[^{{}}]*?children:\s*(?P<span>{_STRING})"
    rf"|\w+\(\s*(?P<call>{_STRING})\s*\)|[,\[]\s*(?P<text>{_STRING})"
)
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


#: An agency behind a name, and blocks that say who helped with what.
_AGENCY = re.compile(r"\s*\(\s*([^()]{1,60}?)\s*\)\s*$")
_HELPER = r"(?i)(?:test|art|audio|localization|additional \w+)\s+by\s+(.+)$"


#: Where a page keeps its data.
PAGE_DATA = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def unescape(literal: str) -> str:
    code = lambda m: next((chr(int(h, 16)) for h in m.groups()[:3] if h), None) or _SIMPLE.get(m[4], m[4])
    return _ESCAPE.sub(code, literal[1:-1])


def messages(page: str) -> dict[str, str]:
    """All texts below any key ``credits`` of the page's data, by dotted path."""
    m = re.search(PAGE_DATA, page)
    try:
        todo = [("", json.loads(m[1]))] if m else []
    except json.JSONDecodeError:
        todo = []
    out = {}
    while todo:  # path is '' outside a credits namespace
        path, node = todo.pop()
        if isinstance(node, dict):
            for k, v in node.items():
                inside = f"{path}.{k}" if path else "credits" if k == "credits" and isinstance(v, dict) else ""
                todo.append((inside, v))
        elif isinstance(node, list) and not path:
            todo += [("", v) for v in node]
        elif isinstance(node, str) and path:
            out[path] = node
    return out


def _end_of_braces(text: str, at: int, stop: int) -> int:
    """Where the brace that opens at ``at`` closes, strings skipped; ``stop`` if it doesn't."""
    depth = 0
    for m in re.compile(rf"{_STRING}|[{{}}]").finditer(text, at, stop):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return m.start()
    return stop


class _Bundle:
    def __init__(self, text: str, options: dict, rules: Rules):
        page, marker, script = text.partition(MARKER)
        self.page, self.script = (page, script) if marker else ("", text)
        self.offset = len(page) + len(marker) if marker else 0
        self.out, self.opt, self.say = Output(rules), options, messages(self.page)
        self.low = {k: {clean(s).lower() for s in options.get(k, [])} for k in ("functions", "publishing", "publishing_areas", "vague")}
        self.block = self.area = self.role = ""

    def read(self, value: str) -> str:
        """A key's message, a key's last part in words if it has none, or the text itself."""
        if value in self.say:
            return clean(self.say[value])
        return clean(value.rpartition(".")[2].replace("-", " ").title() if value.startswith("credits.") else value)

    def literal(self, m: re.Match, group: str) -> str:
        return self.read(unescape(m[f"{group}key"] or m[f"{group}lit"]))

    def tier(self) -> tuple[str, int, int]:
        """The wanted release's part of the script; never a mix of several."""
        wanted = clean(self.opt.get("release", ""))
        starts = [(m.start(), self.read(m[1])) for m in _TIER.finditer(self.script)]
        if not starts:
            if _TIER_KEY in self.script or sum(k.startswith(_TIER_KEY) for k in self.say) > 1:
                raise ValueError("the bundle names release tiers but none can be located")
            return wanted, 0, len(self.script)
        last = _COMPONENT.search(self.script, starts[-1][0] + 1)
        ends = [s for s, _ in starts[1:]] + [last.start() if last else len(self.script)]
        found = [(t, s, e) for (s, t), e in zip(starts, ends, strict=True) if t.lower() == wanted.lower()]
        if not found:
            raise ValueError(f"no release {wanted!r} in the bundle, only {[t for _, t in starts]}")
        return found[0]

    def run(self) -> list[dict]:
        self.release, start, stop = self.tier()
        for m in _STRUCTURE.finditer(self.script, start, stop):
            if m["p"]:
                self.paragraph(m.end() - 1, _end_of_braces(self.script, m.end() - 1, stop))
            elif m["roster"]:
                self.roster(m.start(), m.end(), stop)
            elif m["akey"] or m["alit"]:
                self.area, self.role = self.literal(m, "a"), ""
            else:
                self.block, self.area, self.role = self.literal(m, "b"), "", ""
        return self.out.events

    def roster(self, start: int, end: int, stop: int) -> None:
        name = self.area or self.block
        if not name and (ahead := _AREA.search(self.script, end, stop)):
            name = self.literal(ahead, "a")
        name = name or "Community"
        for m in re.finditer(_STRING, self.script[start:end]):
            if person := clean(unescape(m[0])):
                self.out.person(person, f"{self.release}/{name}@{self.offset + start + m.start()}", category=self.out.rules.category(name), role_raw=name, inclusion_class="community")

    def paragraph(self, start: int, end: int) -> None:
        """A role in bold, then names; a paragraph without a role goes on with the last."""
        base, names, prose = f"{self.release}/{self.block}/{self.area}", [], False
        for m in _INSIDE.finditer(self.script, start, end):
            if m["skey"] or m["slit"]:
                self.role = self.literal(m, "s") or self.role
            elif m["call"]:
                if text := self.read(unescape(m["call"])):
                    prose = True
                    ref = f"{base}@{self.offset + m.start('call')}"
                    self.out.drop(text, "non-person") if self.out.rules.is_denied(text) else self.out.fail(text, ref)
            else:
                group = "span" if m["span"] else "text"
                if text := clean(unescape(m[group])):
                    names.append((text, f"{base}@{self.offset + m.start(group)}"))
        if not names and not prose:
            self.out.drop(self.role or "(empty paragraph)", "section-heading" if self.role else "empty-paragraph")
        for text, ref in names:
            self.person(text, ref)

    def person(self, text: str, ref: str) -> None:
        m = _AGENCY.search(text)
        name, studio = (clean(text[: m.start()]), clean(m[1])) if m else (text, "")
        if not name:
            return self.out.drop(text, "vendor-tag-without-name")
        if not studio and self.block.lower() not in self.low["functions"]:
            m = re.match(self.opt.get("helper", _HELPER), self.block)
            studio = clean(m[1]) if m else self.block
        role = self.role or self.area or self.block
        category = self.out.rules.category(role)
        if category == "Other":
            category = self.out.rules.category(" ".join(h for h in (role, self.area, self.block) if h and h.lower() not in self.low["vague"]))
        self.out.person(name, ref, category=category, role_raw=role, studio=studio, inclusion_class=self.standing())

    def standing(self) -> str:
        block, area, role = self.block.lower(), self.area.lower(), self.role.lower()
        if "production babies" in (block, area):
            return "babies"
        if "special thanks" in (block, area, role):
            return "special-thanks"
        return "publishing" if block in self.low["publishing"] or area in self.low["publishing_areas"] else "core"


def parse(text: str, options: dict, rules: Rules) -> list[dict]:
    return _Bundle(text, options, rules).run()
