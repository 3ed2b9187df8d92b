import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import awkward, table, words

from gristmill.llm import kernels, katz, langid, license_scan, line_quality, minhash_forest, mix_sources, packing, simple8b, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_word_hashes_agree_with_words():
    texts = [r[1] for r in awkward()]
    h, at = kernels.word_hashes(texts)
    seen = {}
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t))
        assert at[i + 1] - at[i] == len(w)
        for x, y in zip(w, h[at[i] : at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_long_text_is_hashed_in_pieces(monkeypatch):
    t = words(5000, 7)
    whole, _ = kernels.word_hashes([t])
    monkeypatch.setattr(kernels, "PIECE", 1000)
    cut, at = kernels.word_hashes(["a", t, None, "b"])
    assert (cut[1:-1] == whole).all() and at.tolist() == [0, 1, 5001, 5001, 5002]


def test_min_hashes_against_plain_minima():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 40000, 3, 70000, 100)]
    got = minhash_forest.min_hashes(sets)
    for s, g in zip(sets, got, strict=True):
        x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        for k in (0, 17, 127):
            v = (x ^ minhash_forest._XOR[k]) * minhash_forest._MUL[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(13)
            assert v.min() == g[k]


def brute_groups(rows, n, percent):
    sets = {}
    for r in rows:
        w = WORD.findall(lower(r[1]))
        s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.setdefault(r[0], []).append(s)
    ids = sorted(k for k in sets if k is not None)
    root = {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in ids}, sets


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, sf, shingle, percent):
    rows = awkward() + [(1000 + r["doc_id"], r["text"], None, None, 1, "", 1, 1, 1, 1.0) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for k in range(30):  # a group of near copies
        t = words(200, 50).split()
        t[6 * k] = f"x{k}"
        rows.append((5000 + k, " ".join(t), None, None, 1, "", 1, 1, 1, 1.0))
    want, sets = brute_groups(rows, shingle, percent)
    got = minhash_forest.near_duplicates(table(spark, rows), shingle, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def crowd_rows(n, seed=11):
    """Texts of one template, 82 % alike; every tenth shares two changes with the one before: 86 %."""
    r, base, rows, last = np.random.default_rng(seed), words(480, 5, 5000).split(), [], None
    for k in range(n):
        at = r.permutation(158)[:8]
        new = [f"n{k}x{j}" for j in range(8)]
        if k % 10 == 9:
            at = np.concatenate((last[0][:2], [p for p in at if p not in last[0][:2]][:6]))
            new[:2] = last[1][:2]
        t = list(base)
        for p, w in zip(at, new, strict=True):
            t[3 * int(p) + 1] = w
        rows.append((k, " ".join(t), None, None, 1, "", 1, 1, 1, 1.0))
        last = at, new
    return rows


def test_near_duplicates_in_a_crowded_region(spark):
    rows = crowd_rows(400)
    want, _ = brute_groups(rows, 3, 85)
    assert 40 <= len(rows) - len(set(want.values())) < 150
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(table(spark, rows), 3, 85).collect()}
    assert got == want


def test_crowded_pairs_do_not_depend_on_the_sketch(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "MARGIN", -0.2)  # no sketch agrees so well
    rows = crowd_rows(100)
    want, _ = brute_groups(rows, 3, 85)
    assert len(rows) - len(set(want.values())) >= 10
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(table(spark, rows), 3, 85).collect()}
    assert got == want


def test_empty_tables(spark):
    empty = table(spark, [])
    assert minhash_forest.near_duplicates(empty).count() == 0
    assert mix_sources.mixed_sizes(empty).count() == 0
    assert mix_sources.mix_documents(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert line_quality.quality_verdicts(empty).count() == 0
    assert license_scan.license_scan(empty).count() == 0
    assert langid.train_and_identify(empty).count() == 0
    assert token_files.write_and_digest(empty).count() == 0
    assert katz.score_held_out(empty).count() == 0


def test_simple8b_round_trip():
    r = np.random.default_rng(5)
    for values in ([], [0], [1] * 500, [0] * 1000, [2**30 - 1] * 7, [2**63, 5, 2**40, 2**40, 3], r.integers(0, 50000, 20000), r.integers(0, 3, 9000), (r.pareto(0.4, 20000)).clip(0, 2**50)):
        v = np.asarray(values).astype(np.uint64)
        w, starts = simple8b.encode(v)
        assert (simple8b.decode(w, starts, len(v)) == v).all()
        if len(v) > 100:
            assert (simple8b.decode_range(w, starts, len(v), len(v) // 3, len(v) // 2) == v[len(v) // 3 : len(v) // 3 + len(v) // 2]).all()


def test_token_files_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_file("word_bpe_49k.json"))
    rows = [r for r in awkward()]
    got = token_files.write_and_digest(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows]
    key = lambda x: (x[0] is not None, x[0] or 0)
    crc = Counter((i, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for i, x in want)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == crc
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [key((r["doc_id"],)) for r in sorted(got, key=lambda r: r["start"])] == sorted(key((r["doc_id"],)) for r in got)


def targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        t = {s: most * sizes[s] if s in capped else left * w[s] / free for s in order}
        over = {s for s in order if s not in capped and t[s] > most * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mix_targets_and_copies(spark):
    rows = awkward() + [(1000 + i, words(5 + i % 90, i), None, f"big{i % 5}", 1, "", 1, 1, 1, 1.0) for i in range(600)]
    rows += [(9000 + i, words(400, i), None, "a-tiny" if i < 2 else "zz", 1, "", 1, 1, 1, 1.0) for i in range(8)]
    got = mix_sources.mixed_sizes(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken = targets(sizes, (5, 2, 1), 3.0), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        if s and s.startswith("big"):
            assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 10
    again = mix_sources.mixed_sizes(table(spark, rows).repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mix_sources.mix_documents(table(spark, rows)).count() == sum(r["copies"] for r in got)


def test_mix_is_unbiased(spark):
    # Many sources alike: with weights 2 and 1 their documents expect 4/3 and 2/3 copies.
    rows = [(i, "x " * (13 + i % 12), None, f"s{i // 12:04d}", 1, "", 1, 1, 1, 1.0) for i in range(12 * 400)]
    taken, copies = Counter(), Counter()
    for r in mix_sources.mixed_sizes(table(spark, rows), weights=(2, 1)).collect():
        kind = int(r["source"][1:]) % 2
        taken[kind] += r["taken"] - r["target"] / 12
        copies[kind, r["size"]] += r["copies"]
    # A source is off by at most 12 words (standard deviation), the mean of 200 by less than one.
    assert all(abs(v / 200) < 4 for v in taken.values()), taken
    for (kind, _), n in copies.items():
        assert abs(n / 200 - (4 / 3, 2 / 3)[kind]) < 5 * (2 / 9 / 200) ** 0.5


def test_packing_places_every_token_once(spark):
    rows = awkward() + [(2000 + i, words(1 + (i * i) % 900, i), None, None, 1, "", 1, 1, 1, 1.0) for i in range(300)]
    got = packing.pack_documents(table(spark, rows), shard_pieces=60).collect()
    size = Counter()
    for r in rows:
        size[r[0]] += len(WORD.findall(r[1] or "")) + 1
    have, bins = Counter(), defaultdict(list)
    for r in got:
        have[r["doc_id"]] += r["length"]
        bins[r["bin_id"], r["capacity"]].append((r["offset"], r["length"]))
    assert have == size and len({b for b, _ in bins}) == len(bins)
    for (_, cap), parts in bins.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap and cap in packing.LENGTHS and all(c < at for c in packing.LENGTHS if c < cap)
    assert sum(size.values()) >= 0.9 * sum(c for _, c in bins)


def base_stats(t):
    w = WORD.findall(t or "")
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[g] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_figures_and_frequent_lines(spark):
    menu = "home about contact and all the other entries of the menu"
    rows = awkward()
    for i in range(40):
        entries = "\n".join(f"{menu} {k}" for k in range(12)) if i < 30 else menu
        rows.append((3000 + i, f"{entries}\n{menu}\n{words(70 if i >= 30 else 170, i)}", None, "host", 1, "", 1, 1, 1, 1.0))
        rows.append((4000 + i, "\n".join(f"{menu}  {k} " if i % 2 else f"{menu} {k}".upper() for k in range(12)) + f"\nown {i}", None, "host", 1, "", 1, 1, 1, 1.0))
        rows.append((5000 + i, words(80, 77), None, "copies", 1, "", 1, 1, 1, 1.0))
    got = line_quality.quality_verdicts(table(spark, rows), least_docs=20, host_share=0.05).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        n, *rest = base_stats(by_id[r["doc_id"]])
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [n, *rest]
        assert r["base_failed"] == (n < 50 or 100 * rest[3] > 50 * n)
        if r["host"] == "host":
            assert r["kept"] == (r["doc_id"] < 4000) or r["base_failed"]
            assert r["removed_words"] >= 11
        elif r["doc_id"] is not None and r["doc_id"] >= 5000:
            assert r["kept"] and not r["removed_words"]
    left = line_quality.quality_filter(table(spark, rows)).collect()
    assert all("menu" not in r["text"] for r in left if r["source"] == "host")
    assert sum(r["source"] == "copies" for r in left) == 40


def test_near_copies_do_not_make_their_lines_boilerplate(spark):
    body = [words(14, 900 + k, 5000) for k in range(10)]
    notice = "all of this may be used by anyone for any purpose at all"
    rows = []
    for i in range(120):
        copy = list(body)
        copy[i % 10] = words(14, 5000 + i, 5000)
        rows.append((i, "\n".join(copy), None, "host", 1, "", 1, 1, 1, 1.0))
        rows.append((1000 + i, f"{words(80, 20000 + i, 5000)}\n{notice}", None, "host", 1, "", 1, 1, 1, 1.0))
    rows.append((2000, "\n".join([notice] * 3 + [words(20, 3)] + [notice] * 12), None, "host", 1, "", 1, 1, 1, 1.0))
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in line_quality.quality_verdicts(docs).collect()}
    assert all(got[i]["kept"] and not got[i]["removed_words"] for i in range(120))
    assert all(got[1000 + i]["kept"] and got[1000 + i]["removed_words"] == 13 for i in range(120))
    assert not got[2000]["kept"] and got[2000]["removed_words"] == 13 * 15
    left = {r["doc_id"]: r["text"] for r in line_quality.quality_filter(docs).collect()}
    assert all(left[i] == rows[2 * i][1] and notice not in left[1000 + i] for i in range(120))

    against_sql(docs, got)


def against_sql(docs, got):
    import duckdb

    from gristmill.llm import queries

    c = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toPandas()
    c.register("documents", documents)
    want = c.sql(queries.ORACLES["op7_line_quality"]).df().set_index("doc_id")
    assert {i: (r["kept"], r["removed_words"]) for i, r in got.items()} == {i: (bool(r.kept), r.removed_words) for i, r in want.iterrows()}


def test_depleted_documents_are_rejected(spark):
    """Pages of a hundred words that all share, in three lines, and twenty of their own; ordinary ones beside them."""
    shared = [words(34, 1, 5000), words(33, 2, 5000), words(33, 3, 5000)]
    rows = [(i, "\n".join([*shared, words(20, 100 + i, 5000)]), None, "host", 1, "", 1, 1, 1, 1.0) for i in range(200)]
    rows += [(1000 + i, "\n".join(words(20, 9000 + 7 * i + k, 5000) for k in range(5)), None, "host", 1, "", 1, 1, 1, 1.0) for i in range(100)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in line_quality.quality_verdicts(docs).collect()}
    assert not any(got[i]["kept"] for i in range(200)) and {got[i]["removed_words"] for i in range(200)} == {100}
    assert all(got[1000 + i]["kept"] and not got[1000 + i]["removed_words"] for i in range(100))
    against_sql(docs, got)


def test_edited_copies_are_copies(spark):
    """Copies of five lines in each of which one word is changed, left out or put in: no line of theirs is boilerplate."""
    import random

    r = random.Random(12)
    body = [words(16, 700 + k, 5000).split() for k in range(5)]
    rows = []
    for i in range(150):
        copy = [list(line) for line in body]
        line, at = copy[i % 5], r.randrange(16)
        line[at : at + (i % 3 != 2)] = [] if i % 3 == 1 else [f"edit{i}"]
        rows.append((i, "\n".join(map(" ".join, copy)), None, "host", 1, "", 1, 1, 1, 1.0))
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in line_quality.quality_verdicts(docs).collect()}
    assert all(x["kept"] and not x["removed_words"] for x in got.values())
    against_sql(docs, got)


def test_license_places(spark):
    notice = license_scan.NOTICES[0].text
    texts = ["Under the MIT License, and under the mit license", "x Apache License, Version 2.0", "CC BY-NC cc.by.nc", "under the mit licenses", "mıt under the mİt license", "under the Kit license", notice.upper(), "permission is hereby granted free of charge to nobody", "", None, "all rights\nreserved", "été cc by nc"]
    rows = [(i, t, None, None, 1, "", 1, 1, 1, 1.0) for i, t in enumerate(texts)] + awkward()[4:]
    got = license_scan.license_scan(table(spark, rows)).collect()
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    texts_of = defaultdict(set)
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r[1]))
        at = {k: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for k, p in phrases.items()}
        every = [i for x in at.values() for i in x]
        texts_of[r[0]].add((len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k in at if at[k]))))
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in texts_of[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got if r["doc_id"] is not None and r["doc_id"] in (6, 7, 10)}
    assert any(r["doc_id"] == 6 and r["labels"] == "mit-grant" and r["score"] == 1.0 for r in got)
    assert any(r["doc_id"] == 10 and "all-rights-reserved" in r["labels"] for r in got), labels


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: (r["lang"], len(r["text"] or "")) for r in d.collect()}
    got = langid.train_and_identify(d).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got} == {True}
    right = sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held)
    assert right >= 0.95 * len(held), right / len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_awkward_and_mixture(spark):
    got = langid.train_and_identify(table(spark)).collect()
    assert len(got) == len(awkward())
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {3, 4, 5, 16} <= und and 0 not in und
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(d)
    one = {lang: d.where((d.lang == lang) & (d.n_chars > 3000)).first()["text"][:3000] for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, one["en"] + "\n" + one["de"]), (2, one["en"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(mixed, model).collect()}
    assert got[1]["n_langs"] == 2 and abs(got[1]["shares"]["en"] - 0.5) < 0.1
    assert got[2]["n_langs"] == 1 and got[2]["lang_pred"] == "en"


def test_language_filter_rejects_what_no_language_explains(spark):
    import random

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("n_chars > 400")
    r = random.Random(4)
    junk = [(-1 - k, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 10))) for _ in range(90)), None) for k in range(20)]
    other = [(-100 - k, x["text"], None) for k, x in enumerate(d.where("lang = 'es'").limit(20).collect())]
    clean = [(-200 - k, x["text"], None) for k, x in enumerate(d.where("lang = 'fr'").limit(20).collect())]
    # Texts of two learned languages, 50 to 50 up to 90 to 10, and of three.
    texts = {x: [t["text"] for t in d.where((d.lang == x) & d["text"].rlike("(?s)^.{800}")).orderBy("doc_id").limit(40).collect()] for x in ("en", "de", "fr")}
    mixed = [(-300 - 10 * k - j, f"{a[:8 * share]}\n{b[:800 - 8 * share]}", None) for k, (a, b) in enumerate(zip(texts["en"], texts["de"], strict=False)) for j, share in enumerate((50, 60, 70, 90))]
    mixed += [(-2000 - k, "\n".join(t[:400] for t in three), None) for k, three in enumerate(zip(*texts.values(), strict=False))]
    assert len(mixed) >= 100
    rows = d.where("lang <> 'es'").unionByName(spark.createDataFrame(junk + other + clean + mixed, d.schema))
    left = {x["doc_id"]: x["lang"] for x in langid.language_filter(rows).collect() if x["doc_id"] < 0}
    assert set(left) == {i for i, _, _ in clean + mixed}
    assert all(left[i] == "fr" for i, _, _ in clean) and all(left[i] in texts for i, _, _ in mixed)


def plain_katz(rows, order):
    """The model from its definition, token by token."""
    import math

    docs = [(r[0], WORD.findall(lower(r[1])) + ["</end>"], zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1) for r in rows]

    def grams(w, k):
        w = ["<begin>"] * (k - 1) + w
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    counts = [Counter(g for _, w, h in docs if not h for g in grams(w, k)) for k in range(1, order + 1)]
    nd = sum(not h for _, _, h in docs)
    big = sum(counts[0].values())
    d = [katz.discounts([sum(v == r for v in c.values()) for r in range(katz.GT_MOST + 2)]) for c in counts]
    seen = [defaultdict(dict) for _ in counts]
    for k, c in enumerate(counts):
        for g, r in c.items():
            ctx = g[:-1]
            times = big if not k else nd if set(ctx) == {"<begin>"} else counts[k - 1][ctx]
            seen[k][ctx][g[-1]] = d[k][min(r, katz.GT_MOST + 1)] * r / times
    unk = 1 - sum(seen[0][()].values())
    weight = [{}]
    for k in range(1, order):
        weight.append({v: (1 - sum(x.values())) / (1 - sum(seen[k - 1][v[1:]][w] for w in x)) for v, x in seen[k].items()})

    def prob(ctx, w):
        k = len(ctx)
        if w in seen[k].get(ctx, {}):
            return seen[k][ctx][w]
        return weight[k].get(ctx, 1.0) * prob(ctx[1:], w) if k else unk

    for v in list(seen[-1])[:50]:  # each context sums to one
        assert abs(sum(prob(v, g[0]) for g in counts[0]) + prob(v, "never seen") - 1) < 1e-9
    out = Counter()
    for i, w, h in docs:
        base = sum(math.log10((counts[0][x,] + 0.5) / (big + 0.5 * (len(counts[0]) + 1))) for x in w)
        score = sum(math.log10(prob(g[:-1], g[-1])) for g in grams(w, order))
        out[i, h, len(w), sum(counts[0][x,] > 0 for x in w), big, round(base, 4), round(score, 4)] += 1
    return out


@pytest.mark.parametrize(("order", "tokens"), [(2, None), (2, 300), (3, 300), (1, 300)])
def test_katz_against_the_definition(spark, monkeypatch, order, tokens):
    rows = awkward() + [(100 + i, words(30 + i % 50, i, 60), None, None, 1, "", 1, 1, 1, 1.0) for i in range(120)]
    if tokens:  # several chunks in each task
        monkeypatch.setattr(katz, "CHUNK_TOKENS", tokens)
    got = katz.score_held_out(table(spark, rows), order=order).collect()
    have = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in got)
    assert have == plain_katz(rows, order)


def test_katz_deals_keys_to_shares_that_have_one():
    keys = np.unique(np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 64, 500, np.uint64, endpoint=False))
    for shares in (1, 8, 300, 20_000_000):
        present, cut = katz.dealt_out(keys, shares)
        assert len(present) == len(cut) - 1 <= min(shares, len(keys)) and (cut[0], cut[-1]) == (0, len(keys))
        for s, a, b in zip(present, cut[:-1], cut[1:], strict=True):
            assert {(int(k) >> 32) * shares >> 32 for k in keys[a:b]} == {s} and b > a


def test_licenses_against_every_place(spark):
    """All columns against a scan of every start for every template."""
    templates = [(t, t.words, license_scan._key_places(t)) for t in license_scan.NOTICES]
    texts = []
    for k, (_, w, _) in enumerate(templates):
        for cut in (0, len(w) // 8, len(w) // 4):  # words changed at the front, in the middle, at the end
            for at in (0, len(w) // 2, len(w) - cut):
                texts.append(" ".join([*["software", "the"] * k, *w[:at], *["other"] * cut, *w[at + cut :], "the"]))
        texts.append(" ".join(w + w[1:] + templates[k - 1][1]))
    rows = [(i, t, None, None, 1, "", 1, 1, 1, 1.0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan.license_scan(table(spark, rows)).collect()}
    for i, text in enumerate(texts):
        w, best, found = text.split(), 0.0, {t.label for t in license_scan.BASE if f" {t.text} " in f" {text} "}
        base = bool(found)
        for t, own, keys in templates:
            for x in range(len(w) - len(own) + 1):
                share = sum(a == b for a, b in zip(w[x:], own, strict=False)) / len(own)
                if share >= 0.8 and all(w[x + p : x + p + len(k)] == k for p, k in keys):
                    best = max(best, share)
                    found.add(t.label)
        assert got[i] == (",".join(sorted(found)), 1.0 if base else round(best, 9)), text


def test_packing_against_plain_best_fit(spark):
    rows = awkward() + [(2000 + i, words(1 + (i * i) % 900, i), None, None, 1, "", 1, 1, 1, 1.0) for i in range(150)]
    parts = []
    for r in rows:
        n = len(WORD.findall(r[1] or "")) + 1
        parts += [(min(8192, n - a), r[0], a // 8192, a) for a in range(0, n, 8192)]
    parts.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
    bins = []  # [capacity, fill, pieces]
    for k, (n, *_) in enumerate(parts):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0] - b[1])
        else:
            price = {}
            for c in packing.LENGTHS:
                if c >= n:  # the smaller pieces to come that still go in beside it may fill it up
                    fill = min(c - n, sum(m for m, *_ in parts[k + 1 :] if m <= c - n))
                    price[c] = packing.bin_cost(c) / (n + fill)
            b = [min(price, key=lambda c: (price[c], c)), 0, []]
            bins.append(b)
        b[2].append((parts[k], b[1]))
        b[1] += n
    want = Counter((i, piece, start, n, k, next(c for c in packing.LENGTHS if c >= b[1]), at) for k, b in enumerate(bins) for (n, i, piece, start), at in b[2])
    got = packing.pack_documents(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["bin_id"], r["capacity"], r["offset"]) for r in got) == want
    again = packing.pack_documents(table(spark, rows[::-1]).repartition(5), shard_pieces=40).collect()
    assert Counter(again) == Counter(packing.pack_documents(table(spark, rows), shard_pieces=40).collect())


def test_language_letters_are_unicode_letters(spark):
    rows = [(i, t, "en" if i > 9 else None, None, 1, "", 1, 1, 1, 1.0) for i, t in enumerate(["²", "½ 3", "Ⅷ", "٣", "ª", "é", "漢", "_", "", None, *[words(50, k) for k in range(8)]])]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.train_and_identify(table(spark, rows)).collect()}
    assert [i for i in range(10) if got[i] == "und"] == [0, 1, 2, 3, 7, 8, 9]


def plain_mixture(bins, log_p):
    """EM over the units of one text, languages removed one by one; loops over units and languages."""
    units = [bins[a : a + langid.UNIT] for a in range(0, len(bins), langid.UNIT)]
    ll = [[langid.TEMPER * sum(float(log_p[b, j]) for b in u) for j in range(log_p.shape[1])] for u in units]
    lik = [[np.exp(max(x - max(row), -60.0)) for x in row] for row in ll]
    active, best = list(range(log_p.shape[1])), (np.inf, None)
    while active:
        pi = {j: 1 / len(active) for j in active}
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(active, 0.0)
            for row in lik:
                norm = sum(row[j] * pi[j] for j in active)
                for j in active:
                    new[j] += row[j] * pi[j] / norm / len(lik)
            pi = new
        fit = sum(np.log(sum(row[j] * pi[j] for j in active)) for row in lik)
        price = (len(active) - 1) * (0.5 * np.log(max(len(units), 2)) + 1) - fit
        if price < best[0]:
            best = price, pi
        active.remove(min(active, key=lambda j: pi[j]))
    j = int(np.argmax(np.sum(ll, 0)))
    if -sum(np.log(row[j]) for row in lik) < best[0]:
        return {j: 1.0}
    return best[1]


def test_mixtures_against_plain_em(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(d)
    texts = [r["text"][:700] for r in d.where("n_chars > 700").orderBy("doc_id").limit(12).collect()]
    texts += [a[:400] + b[:300] for a, b in zip(texts, texts[1:], strict=False)] + ["x", "ab cd"]
    bins, at = langid.features(texts)
    whole = langid.mixtures(bins, at, model)
    for i in range(len(texts)):
        want = plain_mixture(bins[at[i] : at[i + 1]].tolist(), model.log_p)
        assert np.allclose([want.get(j, 0.0) for j in range(len(model.langs))], whole[0][i], atol=1e-6)
        units = [bins[k : min(k + langid.UNIT, at[i + 1])] for k in range(at[i], at[i + 1], langid.UNIT)]
        with np.errstate(divide="ignore"):
            plain = sum(np.logaddexp.reduce([np.log(whole[0][i, j]) + model.log_p[u, j].astype(float).sum() for j in range(len(model.langs))]) for u in units)
        assert not units or abs(plain / (at[i + 1] - at[i]) + np.log(langid.BINS) - whole[2][i]) < 1e-6
    monkeypatch.setattr(langid, "SLICE", 3)  # long texts are looked up in slices
    sliced = langid.mixtures(bins, at, model)
    assert all(np.allclose(x, y) for x, y in zip(whole, sliced, strict=True))


def test_long_text_without_white_space():
    h, at = kernels.word_hashes(["y" * (3 * kernels.PIECE), "a " + "z" * kernels.PIECE + " b"])
    assert at.tolist() == [0, 1, 4] and len(set(h.tolist())) == 4


@pytest.mark.parametrize("meet", [2, 3, 256])
def test_neighbours_meet_across_tasks(spark, monkeypatch, meet):
    """Neighbours do not depend on how an order is dealt out: ends of tasks meet up a tree."""
    import random

    monkeypatch.setattr(minhash_forest, "MEET", meet)
    r = random.Random(21)
    rows = []
    for tree in range(3):
        for node in range(150):
            values = [r.randrange(3 if k < 4 else 2) for k in range(minhash_forest.DEPTH)]
            label = b"".join(v.to_bytes(2, "big") for v in values) if node % 5 else b"\0\1" * minhash_forest.DEPTH  # some run of equals
            rows.append((tree, bytearray(label), node, bytearray(r.choice(b"ab") for _ in range(minhash_forest.SKETCH))))
    df = spark.createDataFrame(rows, "tree int, label binary, node long, sketch binary")
    whole, ties, _ = minhash_forest.candidates(df, 0.5, 1)
    dealt, tied, made = minhash_forest.candidates(df, 0.5, 40)
    want, got = ({tuple(x) for x in d.collect()} for d in (whole, dealt))
    assert got == want and len(want) > 500
    roots = {}

    def root(x):
        while roots.get(x, x) != x:
            x = roots[x]
        return x

    for a, b in tied.collect():
        roots[root(a)] = root(b)
    assert all(root(a) == root(b) for a, b in ties.collect())
    minhash_forest.drop_stored(*made)
