import random
import re

from rollcall.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UP))


def fewest(notice, s):
    """Least edits of the notice against any substring (Sellers)."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in s:
        last, row[0] = row[:], 0
        for i, n in enumerate(notice, 1):
            row[i] = min(last[i - 1] + (n != c), last[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def brute(text):
    w = words(text)
    places = [(i, label) for phrase, label in li.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    s, hits = f" {' '.join(w)} ", []
    for label, notice in li.NOTICES:
        if (e := fewest(notice, s)) <= len(notice) // li.SLACK:
            hits.append((label, 1 - e / len(notice)))
    score = 1.0 if places else max((x for _, x in hits), default=0.0)
    at = [i for i, _ in places]
    join = lambda x: ",".join(sorted(set(x)))
    return len(w), len(places), min(at, default=None), max(at, default=None), join(x for _, x in places), join([x for _, x in places] + [x for x, _ in hits]), round(score, 9)


def mutated(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = rnd.randrange(len(s)), rnd.randrange(3)
        if kind == 0:
            s[i] = rnd.choice("abcdefg xyzé")
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, rnd.choice("abcdefg xyzé"))
    return "".join(s)


def texts():
    rnd, out = random.Random(5), [None, "", " \n.", "MIT License", "mit licenses", "the Apache-License, GENERAL public\nlicense", "mit license mit license", "xmit license", "É licensed under\nCC BY-NC 4.0.", "Released under the MIT-Licence"]
    for _, notice in li.NOTICES:
        for n in (0, 1, len(notice) // li.SLACK, len(notice) // li.SLACK + 1, len(notice) // li.SLACK + 3):
            said = mutated(rnd, notice, n)
            out.append(f"Ñandú {' '.join(rnd.choice(notice.split()) for _ in range(4))}: {said.upper() if n % 2 else said.replace(' ', ', ')}!\nlicense with or without {said[: len(said) // 2]}")
    out.append(". ".join(notice for _, notice in li.NOTICES) * 3)
    out.append("lorem ipsum " * 40_000 + "Released under the MlT Licence. " + "dolor " * 2_000)
    return out


def test_query_against_brute_force(spark, tmp_path):
    given = [(i, t, "own") for i, t in enumerate(texts())] + [(3, "MIT License", "again"), (None, "apache license", "x")]
    spark.createDataFrame(given, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    out = li.op12_licenses(spark, str(tmp_path)).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in out]
    # the long text by its end: Sellers is slow on all of it
    want = []
    for i, t, _ in given:
        if t and len(t) > 100_000:
            n, *rest = brute(t[-13_000:])
            want.append((i, len(words(t)), *rest))
        else:
            want.append((i, *brute(t)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    (tmp_path / "e").mkdir()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert li.op12_licenses(spark, f"{tmp_path}/e").count() == 0


def test_spans_are_matches(spark):
    for t in texts():
        found = li.scanner(li.PHRASES, li.NOTICES, li.SLACK).scan(t)
        w = words(t)
        for x in found.spans:
            inside = words(t[x.start : x.stop])
            assert inside == w[x.first : x.last + 1]
            notice = min((n for label, n in li.NOTICES if label == x.label and len(n) == x.size), key=lambda n: fewest(n, f" {' '.join(inside)} "))
            assert fewest(notice, f" {' '.join(inside)} ") <= x.errors <= len(notice) // li.SLACK
        by = [(x.label, x.size, x.first, x.last) for x in found.spans]
        assert len(by) == len(set(by))


def test_seeds_make_up_the_notice():
    for _, n in li.NOTICES:
        for k in range(8):
            assert "".join(p for _, p in li.seeds(n, k)) == n and all(n[a : a + len(p)] == p for a, p in li.seeds(n, k)) and len(li.seeds(n, k)) == k + 1
