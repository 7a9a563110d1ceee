"""Credit pages in HTML: credit table, two panes, spans, spreadsheet.

Names that only one site uses (its companies, departments, classes of a
spreadsheet's styles) come as options.
"""

from __future__ import annotations

import re

from .credits import PANE_PUBLISHING, SHEET_STANDING, SPAN_STANDING, TABLE_STANDING, THANKS, BABIES, Output, Rules, clean, headings, standing, vendor_tag
from .html import Node, parse_html


def _text(n: Node | None) -> str:
    return clean(n.text()) if n is not None else ""


# --- credit table: sections in h4, then rows of (role, linked names) -----------


def _scope(heading: str, options: dict) -> str | None:
    """The section's name if the page's options want it."""
    if prefix := options.get("game_prefix"):
        return clean(heading[len(prefix) + 1 :]) if heading.startswith(f"{prefix}:") else None
    wanted = options.get("sections")
    return heading if wanted is None or heading in map(clean, wanted) else None


def credit_table(text: str, options: dict, rules: Rules) -> list[dict]:
    """Options: studio_headings (map), exclude_sections, exclude_roles, game_prefix, sections, cast_sections."""
    out, companies = Output(rules), headings(options.get("studio_headings"))
    without, silent, cast = ({clean(s) for s in options.get(k, [])} for k in ("exclude_sections", "exclude_roles", "cast_sections"))
    table = parse_html(text).first("table", cls="table-credits")
    section: str | None = None
    for i, tr in enumerate(table.find("tr") if table else []):
        ref = f"tr{i}"
        if (head := tr.first("h4")) is not None:
            section = _scope(_text(head), options)
            section = None if section in without else section
            continue
        if section is None:
            continue
        cells = tr.own("td")
        if len(cells) < 2:
            if line := _text(tr):
                out.fail(line, ref)
            continue
        role, people = _text(cells[0]), cells[1].own("a")
        if role in silent:
            continue
        if not people:
            for company in filter(None, map(str.strip, _text(cells[1]).split(","))):
                out.drop(company, "studio-mention")
        for a in people:
            if not (name := _text(a)):
                continue
            studio = companies.get(role.casefold(), companies.get(section.casefold(), ""))
            m = re.match(r"\(([^)]+)\)", clean(a.following()))
            behind = m[1].strip() if m else ""
            character = ""
            if section in cast:
                character = role
            elif behind.casefold() in companies:
                studio = companies[behind.casefold()]
            elif not re.match(r"(?i)(as|credited as)\s+|uncredited$", behind):
                character = behind
            out.person(
                name, ref,
                category="Voice" if character else rules.category(f"{role} {section}"),
                role_raw="Voice Actor" if section in cast else role or section,
                character=character, studio=studio, inclusion_class=standing(TABLE_STANDING, section, role),
            )
    return out.events


# --- two panes: staff under company, support and section rows; then voices ---------


def two_pane(text: str, options: dict, rules: Rules) -> list[dict]:
    """Options: first_party (names of the makers), publishers."""
    out, root = Output(rules), parse_html(text)
    by_id = {n.attrs.get("id"): n for n in root.walk() if n.attrs.get("id")}
    makers, publishers = ({clean(s).casefold() for s in options.get(k, [])} for k in ("first_party", "publishers"))
    makers |= publishers
    if "credits-employees" in by_id:
        _staff(by_id["credits-employees"], out, makers, publishers)
    if "credits-voice" in by_id:
        _voices(by_id["credits-voice"], out)
    return out.events


def _unreadable(tr: Node, out: Output, ref: str) -> None:
    if line := _text(tr):
        out.fail(line, ref)


def _staff(pane: Node, out: Output, makers: set[str], publishers: set[str]) -> None:
    studio = section = company = ""
    for i, tr in enumerate(pane.find("tr")):
        ref, cells = f"employees:tr{i}", tr.own("td")
        label = _text(cells[0] if cells else tr)
        if "credits-company" in tr.classes:
            company, studio = label, "" if label.casefold() in makers else label
        elif "credits-supportcompany" in tr.classes:
            company = ""
            said = clean(re.sub(r"(?i)\s*\(support company\)\s*$", "", _text(cells[1]))) if len(cells) > 1 else ""
            if said and said == section:  # thanked, not employing
                out.drop(label, "support-company-thanked")
            else:
                studio = label
        elif "credits-misc" in tr.classes:
            section, studio = _text(tr), ""
        elif len(cells) < 2 or not label:
            _unreadable(tr, out, ref)
        elif len(label) > 80:
            out.drop(label, "non-person")
        else:
            role = _text(cells[1])
            cls = standing([BABIES, THANKS, PANE_PUBLISHING], section)
            if cls == "core":
                cls = "publishing" if company.casefold() in publishers else standing([THANKS], role)
            out.person(label, ref, category=out.rules.category(f"{role} {section}".strip()), role_raw=role or section, studio=studio, inclusion_class=cls)


def _voices(pane: Node, out: Output) -> None:
    language = ""
    for i, tr in enumerate(pane.find("tr")):
        ref = f"voice:tr{i}"
        if (head := tr.first("h3", "h4")) is not None:
            language = _text(head)
            continue
        name, character = _text(tr.first(cls="media-body")), tr.first("td", cls="text-right")
        if not name or character is None:
            _unreadable(tr, out, ref)
        elif language.lower() != "english":
            out.drop(f"{name} - {_text(character)}", f"non-english-voice:{language or 'unknown'}")
        else:
            said = _text(character)
            out.person(name, ref, category="Voice", role_raw="Performance Capture" if re.search(r"(?i)\(performance\)", said) else "Voice Actor", character=said)


# --- spans: department and group headers, one div an entry --------------------------


def span_page(text: str, options: dict, rules: Rules) -> list[dict]:
    """Options: departments (functions, not companies), legacy and community_headings (patterns), other_language and characters ([department, group] pairs)."""
    out = Output(rules)
    functions = {clean(s) for s in options.get("departments", [])}
    other, cast = ({tuple(p) for p in options.get(k, [])} for k in ("other_language", "characters"))
    department = group = ""
    for i, div in enumerate(parse_html(text).find("div")):
        if div.starts("credits_group_header__") or div.starts("credits_section_header__"):
            if (h := div.first("h2")) is not None:
                department, group = _text(h), ""
            if (h := div.first("h3")) is not None:
                group = _text(h)
            continue
        if div.starts("credits_software_entry__"):
            if label := _text(div.first("div", prefix="credits_software_name__") or div):
                out.drop(label, "middleware")
            continue
        if not div.starts("credits_entry__"):
            continue
        part = {"": "", "title": "", "agency": ""}
        for span in div.own("span"):
            kind = next((k for k in ("title", "agency") if span.starts(f"credits_entry_{k}__")), "" if not span.classes else None)
            if kind is not None and not (kind == "" and part[""]):
                part[kind] = _text(span)
        name, title, ref = part[""], part["title"], f"{department}/{group}#{i}"
        if not name:
            _unreadable(div, out, ref)
        elif not rules.is_denied(name) and (department, group) in other:
            out.drop(name, f"non-english-voice:{department}/{group}")
        else:
            role, voiced = title or group, (department, group) in cast
            category = "Voice" if voiced else rules.category(f"{role} {group} {department}")
            if category == "Voice" and not voiced:
                category = rules.category(f"{role} {department}")
            legacy = any(re.search(p, department) for p in options.get("legacy", []))
            out.person(
                name, ref, category=category, role_raw=role, character=title if voiced else "",
                studio=part["agency"] or ("" if department in functions else department),
                inclusion_class="legacy" if legacy else standing([*((p, "community") for p in options.get("community_headings", [])), *SPAN_STANDING], department, group),
            )
    return out.events


# --- spreadsheet: two columns, headings by the style class of their cell ----------------


def sheet(text: str, options: dict, rules: Rules) -> list[dict]:
    """Options: ranks (style class to depth, 0 for departments), vendors, cast (headings), middleware (a heading), plain_departments."""
    out = Output(rules)
    ranks = options.get("ranks", {})
    deepest = max(ranks.values(), default=0)
    key = lambda s: re.sub(r"(?i)\s+special thanks$", "", clean(s)).upper()
    vendors, cast = {key(v): v for v in options.get("vendors", [])}, set(options.get("cast", []))
    department = heading = role_above = studio = ""
    studio_rank = 0
    for i, tr in enumerate(parse_html(text).find("tr")):
        cells = tr.find("td")
        left, right = (_text(cells[k]) if len(cells) > k else "" for k in (0, 1))
        ref, memoriam = f"{department}/{heading}#{i}", bool(re.search(r"(?i)in loving memor", department))
        if len(cells) == 1:
            if left and left != options.get("middleware"):
                if memoriam or rules.is_denied(left):
                    out.drop(left, "in-memoriam-tribute" if memoriam else "non-person")
                else:
                    out.fail(left, ref)
        elif left and not right and memoriam:
            if re.fullmatch(r"\d{4}\s*[-–—]\s*\d{4}", left):
                out.drop(left, "memoriam-date-range")
            elif len(left) > 60 or "." in left:
                out.drop(left, "in-memoriam-tribute")
            else:
                out.person(left, ref, category=rules.category(department), role_raw=department)
        elif left and not right:
            heading = role_above = left
            rank = next((ranks[c] for c in cells[0].classes if c in ranks), deepest)
            if rank == 0 and any(c in ranks for c in cells[0].classes):
                department = left
            if vendor := vendors.get(key(left)):
                studio, studio_rank = vendor, rank
            elif rank <= studio_rank:
                studio, studio_rank = "", rank
        elif right:
            name, agency = vendor_tag(right, True)
            name, voiced = clean(name), heading in cast
            role = "Voice Actor" if voiced else left or role_above
            category = "Voice" if voiced else rules.category(f"{role} {heading}")
            if category == "Other" and department not in options.get("plain_departments", []):
                category = rules.category(department)
            role_above = left or role_above
            if not name:
                out.fail(right, ref)
            else:
                out.person(name, ref, category=category, role_raw=role, character=left if voiced else "", studio=agency or ("" if voiced else studio), inclusion_class=standing(SHEET_STANDING, department, heading))
    return out.events
