"""Token counts against the library and plain merging, filter audits and source divergence against plain loops."""

import os
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from cases import LONG, awkward, table, words

from gristmill.llm import divergence, filter_audit, token_counts
from gristmill.llm.token_files import tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(FILE)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(FILE)


def plain_symbols(symbols, ranks):
    """Joins the lowest pair, the leftmost of equals, over and over."""
    symbols = list(symbols)
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]:
        i = min(pairs)[1]
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
    return len(symbols)


def test_heap_merging_against_plain_merging():
    r = random.Random(5)
    for _ in range(400):
        known, ranks = list("abc"), {}
        for k in range(r.randrange(12)):
            pair = r.choice(known), r.choice(known)
            ranks.setdefault(pair, r.randrange(8))  # equal ranks: the leftmost pair first
            known.append("".join(pair))
        symbols = [r.choice("abc") for _ in range(r.randrange(30))]
        assert token_counts.count_symbols(symbols, ranks) == plain_symbols(symbols, ranks)


def test_counts_are_the_library_s(counter, library):
    r = random.Random(6)
    alphabet = "aAbz09'’ \t\n\r\x0b\x85\xa0 　.,<|>é́ßж中文ก๑กำかな한글\U0001f600‍﻿\x00\x1c\x1f՘࢏\U00010940²½Ⅷ"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "   <|endoftext|>   x", "it's we'll 'S ''s", "word " * 400, "x" * 3000, "ab" * 2000, "  \n  ", "\r\n\r\n a"]
    for t in texts:
        assert counter.count(t) == library(t), t


def test_long_texts_are_cut_where_a_boundary_is_certain(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 50)
    r = random.Random(7)
    for _ in range(60):
        t = "".join(r.choice(["a", "b ", " c", "  ", "'s", " 1", ".", "é", "\n"]) for _ in range(600))
        assert counter.count(t) == library(t)
    monkeypatch.setattr(token_counts, "REMEMBERED", 0)
    assert counter.count("a b c") == library("a b c")


def test_token_counts_of_awkward_rows(spark, library):
    got = token_counts.token_counts(table(spark), FILE, limit=10).collect()
    want = Counter((i, len((t or "").encode()), library(t or ""), library(t or "") > 10) for i, t, *_ in awkward())
    assert Counter(map(tuple, got)) == want and any(t == LONG for _, t, *_ in awkward())
    assert token_counts.token_counts(table(spark, []), FILE).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.TokenCounter(tokenizer_file("word_bpe_49k.json"))


def plain_report(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = defaultdict(list)
    for i, t, lang, *_ in docs:
        t = t or ""
        w = WORD.findall(t)
        failed = "".join(x for x, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])) if bad)
        fails[lang or ""].append((failed, i in good, i in toxic))
    out = {}
    for part, rows in fails.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = list(rows)
            for k, x in enumerate(order):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                failing = [r for r in rows if x in r[0]]
                total[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(r[0] == x for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), x]
        for key, row in out.items():
            if key[0] == part:
                row[6] = total[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_report_against_a_loop(spark):
    r = random.Random(8)
    pool = [words(n, n) for n in (40, 99, 100, 101, 150)] + ["Ab # " + words(120, 4, 5000), "ABC " * 120, " ".join(f"x{i}" for i in range(100)), "", None, "#"]
    docs = awkward() + [(100 + i, r.choice(pool), r.choice(["en", "de", "", None]), "s", 1, "t", 1, 1, 1, 1.0) for i in range(300)]
    docs.append((0, "another text of the same id", "en", "s", 1, "t", 1, 1, 1, 1.0))
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in [*range(0, 400, 2), 100, 102, None]]
    flags = filter_audit.filter_flags(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for x in filter_audit.interaction_report(flags).collect()}
    assert got == plain_report(docs, labels) and len(got) == 600 * 3
    empty = filter_audit.filter_flags(table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert filter_audit.interaction_report(empty).collect() == []


def plain_divergence(docs, least_docs, top):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, source, *_ in docs]
    out = set()
    for lang in {x[0] for x in texts}:
        found = Counter(w for x, _, ws in texts if x == lang for w in set(ws))
        kept = [w for w, n in found.items() if n >= least_docs]
        counts = {s: Counter(w for x, y, ws in texts if (x, y) == (lang, s) for w in ws) for s in {y for x, y, _ in texts if x == lang}}

        def p(c, n):
            return 1 + 10**9 * (c + 2) // (n + 2 * len(kept))

        size = {s: sum(c[w] for w in kept) for s, c in counts.items()}
        share = {s: {w: p(c[w], size[s]) for w in kept} for s, c in counts.items()}
        whole = {w: p(sum(c[w] for c in counts.values()), sum(size.values())) for w in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in counts:
            pairs = [(-sum(f(share[s][w], share[o][w]) for w in kept), o.encode()) for o in counts if o != s]
            terms = [(-f(share[s][w], whole[w]), w.encode()) for w in kept if counts[s][w] and share[s][w] > whole[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, w.decode(), -x, k + 1) for k, (x, w) in enumerate(sorted(items)[:most])}
    return out


@pytest.mark.parametrize("chunk", [3, 4096])
def test_divergence_against_a_loop(spark, monkeypatch, chunk):
    for name, value in (("HELD", 50), ("PIECE", 64)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence.term_chunks, "__defaults__", (chunk,))
    r = random.Random(9)
    vocabulary = ["a", "B", "bé", "été", "naïve", "中文", "zz", "\U0001f600", "x1y", "don't", "Straße", "İ", "AB", "ab"] + [f"w{chr(97 + k)}" for k in range(20)]
    docs = awkward() + [(100 + i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(40))), r.choice(["en", "de", "", None]), r.choice(["s1", "s2", "", None, "é"]), 1, "t", 1, 1, 1, 1.0) for i in range(200)]
    got = [tuple(x) for x in divergence.source_divergence(table(spark, docs), least_docs=4, top=5).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(docs, 4, 5)


def test_divergence_without_terms_and_without_rows(spark):
    docs = [(i, t, "en", s, 1, "t", 1, 1, 1, 1.0) for i, (t, s) in enumerate([("a b", "s1"), (None, "s2"), ("", "s3")])]
    got = {tuple(x) for x in divergence.source_divergence(table(spark, docs)).collect()}
    assert got == plain_divergence(docs, 10, 10) and len(got) == 6 and {x[4] for x in got} == {0}
    assert divergence.source_divergence(table(spark, [])).collect() == []


def test_shares_are_exact():
    import numpy as np

    r = random.Random(10)
    size = np.array([r.randrange(1, 9 * 10**15) for _ in range(500)], np.int64)
    count = np.array([r.randrange(0, int(s) + 1) for s in size], np.int64)
    assert divergence.shares(count, size).tolist() == [1 + 10**9 * int(c) // int(s) for c, s in zip(count, size, strict=True)]
