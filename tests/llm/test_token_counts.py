import math
import random
from collections import Counter

import pytest

from rollcall.llm import token_counts

sentencepiece = pytest.importorskip("sentencepiece")


def brute_model(texts):
    """(piece scores, byte scores) by counting, over all words of all texts."""
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    n = Counter(i for t in texts for w in (t or "").encode().split() for i in sp.encode(w.decode()))
    ids = range(3, sp.get_piece_size())
    total = sum(n[i] + 1 for i in ids)
    score = {sp.id_to_piece(i): math.log(n[i] + 1) - math.log(total) for i in ids}
    return score, [score.pop(f"<0x{b:02X}>") for b in range(256)]


def brute(text, pieces):
    """Best segmentation of each word on its own, backwards and with no sharing."""
    total = 0
    for w in (text or "").encode().split():
        s = token_counts.MARK + w.decode()
        best = {0: (0.0, 0)}
        for end in range(1, len(s) + 1):
            opts = []
            for start in range(end):
                p = pieces.score.get(s[start:end])
                if p is not None:
                    opts.append((-(p + best[start][0]), best[start][1] + 1))
            raw = s[end - 1].encode()
            opts.append((-(best[end - 1][0] + sum(pieces.byte[b] for b in raw)), best[end - 1][1] + len(raw)))
            score, n = min(opts)
            best[end] = (-score, n)
        total += best[len(s)][1]
    return total


def test_a_walk_scores_shared_prefixes_once(monkeypatch):
    pieces = token_counts.Pieces(*brute_model(["the theme then there other others otherwise"]))
    grown, trie = [], token_counts.Trie(pieces)
    single = pieces.single
    monkeypatch.setattr(pieces, "one_wins", frozenset())
    monkeypatch.setattr(pieces, "single", lambda ch, *a: grown.append(ch) or single(ch, *a))
    words = sorted(token_counts.MARK + w for w in ("the", "theme", "then", "there", "other", "others", "otherwise", "t"))
    for w in words:
        trie.tokens(w)
    assert len(grown) == len({w[:i] for w in words for i in range(1, len(w) + 1)})  # the nodes of their trie


def test_very_long_texts_and_words(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["the", "thermal", "nation", "é" * 3, "9-9"]) for _ in range(150_000)), "nationthe" * 40_000, "x"]
    pieces = token_counts.Pieces(*brute_model(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, token_counts.model_path()).collect()}
    each = {w: brute(w, pieces) for w in set(texts[0].split())}
    assert got[0] == (150_000, sum(each[w] for w in texts[0].split())) and got[2] == (1, brute("x", pieces))
    # a long word of a period: windows of it add a fixed number of tokens a period
    some = [brute("nationthe" * k, pieces) for k in (40, 41, 42)]
    assert some[2] - some[1] == some[1] - some[0] and got[1] == (1, some[0] + (40_000 - 40) * (some[1] - some[0]))


def test_query_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    syl = ["the", "Of", "tion", "é", "ß", "12", "'ll", "|", "***", "漢", "and", "er"]
    texts = [None, "", " \n", "a", "word word word", "x" * 300, "the" * 40 + " and"]
    texts += [" ".join("".join(rnd.choice(syl) for _ in range(rnd.randint(1, 6))) for _ in range(40)) for _ in range(60)]
    texts += ["\t\v\f\r the\u2003and \n", "\x1cand\x1d", "tion" * 600 + " er"]
    pieces = token_counts.Pieces(*brute_model(texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, token_counts.model_path()).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [brute(t, pieces) for t in texts]
    assert [got[i].n_words for i in range(len(texts))] == [len((t or "").encode().split()) for t in texts]
    learned = token_counts.model_of(token_counts.model_path(), token_counts.piece_counts(docs, token_counts.model_path()))
    assert learned.score == pieces.score and learned.byte == pieces.byte
    monkeypatch.setattr(token_counts, "CACHED", 20)
    few = token_counts.Counter(pieces)
    assert [n for t in texts for _, n in few([t])] == [brute(t, pieces) for t in texts]
    assert token_counts.token_counts(docs.limit(0), token_counts.model_path()).count() == 0
