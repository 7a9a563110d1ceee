import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import pii


def brute_base(text):
    """By the patterns as they are written."""
    out = []
    pats = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, p in pats.items():
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.+-0123459 (é%\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == brute_base(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_query(spark):
    shared = "mail to zed.k@mail7.example.com"
    texts = [None, "", "nothing here", "call +1 (939) 555-0359 now", "card 4111 1111 1111 1111 and 56.245.126.157"]
    texts += [f"Quixote wrote {shared} on day number {'abcdefgh'[i] * 6}" for i in range(6)]
    texts += [f"some other plain text on day number {'abcdefgh'[i % 8] * 5}{i}" for i in range(60)]
    texts += ["long " * 30000 + shared + "0"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, texts[3], "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    assert len(got) == len(texts) + 1
    # the brute-force method: counts over documents
    n = len(texts) + 1
    sets = [set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())) for t in [*texts, texts[3]]]
    with_e = [shared + "0" not in (t or "") and shared in (t or "") for t in [*texts, texts[3]]]
    c_e = sum(with_e)
    reveal = set()
    for w in set().union(*sets):
        c_t, c_et = sum(w in s for s in sets), sum(w in s and e for s, e in zip(sets, with_e))
        texts_et = len({t for t, s, e in zip([*texts, texts[3]], sets, with_e) if w in s and e})
        share = (texts_et * c_et / c_t + pii.PRIOR * c_e / n) / (texts_et + pii.PRIOR)
        if len(w.encode()) >= 4 and c_et and math.log2(n * share / c_e) >= 0.9 * math.log2(n / c_e):
            reveal.add(w)
    assert "quixote" in reveal and "number" not in reveal
    for i, t in enumerate(texts):
        base = brute_base(t)
        terms = [("term", m.start(), m.end()) for m in re.finditer(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "") if with_e[i] and m[0].lower() in reveal and not any(a < m.end() and m.start() < b for _, a, b in base)]
        want = sorted(base + terms, key=lambda s: s[1])
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want), t[:80]
        assert got[i].base == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[3] == "call [PHONE] now" and clean[4] == "card [CARD] and [IP]" and clean[0] is None
    hidden = re.sub(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lambda m: "[TERM]" if m[0].lower() in reveal else m[0], texts[5].replace(shared.split()[-1], "\0"))
    assert clean[5] == hidden.replace("\0", "[EMAIL]") and clean[5].startswith("[TERM]")
    assert clean[20] == texts[20]
    empty = docs.limit(0)
    assert pii.spans(empty).count() == 0 and pii.sanitise(empty).columns == docs.columns


def test_entities_of_one_text_have_terms(spark):
    own = "Zanzibar harbour letter from plain day to rare.q@mail3.example.com"
    pair = "common letter by Kestrelman about a day and +1 (939) 555-0359 number"
    own += " second.q@mail3.example.com"  # entities of one text reveal alike
    texts = [own, own, f"{pair} one", f"{pair} two"] + [f"some harbour letter on a plain common day and number {i}" for i in range(250)]
    docs = spark.createDataFrame([(i, t, "h", "t") for i, t in enumerate(texts)], "doc_id long, text string, __h string, terms string")
    got = {r.doc_id: r.spans for r in pii.spans(docs).collect()}
    terms = {i: [texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[i].split(",") if s.startswith("term:")] for i in got}
    assert terms[0] == terms[1] == ["Zanzibar", "from"] and terms[2] == terms[3] == ["Kestrelman", "about"]
    assert not any(terms[i] for i in range(4, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "[TERM] harbour letter [TERM] plain day to [EMAIL] [EMAIL]" and clean[9] == texts[9]
