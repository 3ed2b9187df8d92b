import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import chat_format, pivot_index, token_files

SAID = "<|im_end|><|im_start|>assistant ok"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("user<|\\\nn"), st.text("<|\\>im_startend \né")), max_size=5))
def test_render_is_reversible(turns):
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for _, t in turns:
        assert "<|" not in chat_format.escape(t)


def conversations(spark):
    r = [(i, t, ["system", "user", "assistant"][t % 3], f"text {i} {t} <|im_start|> \U0001F600é\n" * (1 + t)) for i in range(30) for t in range(1 + i % 6)]
    r += [(100, 0, "user", None), (100, 1, "assistant", ""), (100, 2, None, "x"), (100, 2, "assistant", " lead and trail "), (None, 1, "assistant", "no id"), (-1, 0, "user", SAID), (-1, 1, "assistant", SAID)]
    r += [(200, k, "assistant" if k % 2 else "user", f"turn {k} " * 3) for k in range(900)] + [(100, 1, "assistant", "")]
    return r, spark.createDataFrame([(*x, "extra", 1) for x in r], "conv_id long, turn long, role string, text string, part string, segment int")


@pytest.mark.parametrize("segment", [200, 1 << 20])
def test_digests_are_those_of_the_turns(spark, segment):
    rows, df = conversations(spark)
    segments = chat_format.format_conversations(df, token_files.tokenizer_file("byte_bpe_50k.json"), segment_chars=segment)
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(segments).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == len(chat_format.render([(a, b) for _, a, b in turns])[0])


def test_no_conversations(spark):
    _, df = conversations(spark)
    s = chat_format.format_conversations(df.limit(0), token_files.tokenizer_file("byte_bpe_50k.json"))
    assert chat_format.conversation_digests(s).count() == 0


def vectors(seed=1, n=400, hot=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    near = x[:80] + r.normal(size=(80, 64)) * r.uniform(0.01, 0.5, (80, 1))
    group = x[5] + r.normal(size=(hot, 64)) * 0.1
    every = [[float(np.float32(v)) for v in row] for row in np.concatenate((x, near, group, x[:3]))]
    return [*every, None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 8, [2.0] * 8]


def brute(rows):
    ids = [i for i, _ in rows]
    links, root = defaultdict(int), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(i, np.asarray(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    good = [(i, v / np.sqrt((v * v).sum())) for i, v in good]
    for k, (i, v) in enumerate(good):
        for j, u in good[k + 1 :]:
            if len(u) == len(v) and u @ v >= 0.95:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i in ids}


@pytest.mark.parametrize(("hot", "size"), [(0, 4096), (150, 40)])
def test_links_against_all_pairs(spark, monkeypatch, hot, size):
    rows = list(enumerate(vectors(hot=hot)))
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, node string, list long")
    if size != 4096:
        monkeypatch.setattr(pivot_index.search, "__defaults__", (pivot_index.SHARED, size))
    got = {r["vec_id"]: r for r in pivot_index.near_vectors(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    found, total = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
    assert 0.98 * total <= found <= total
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert sum(got[i]["component_id"] != c for i, (_, c) in want.items()) <= 2
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pivot_index.near_vectors(df).count() == 0


def test_more_pivots_than_by_default(spark):
    rows = list(enumerate(vectors()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    got = {r["vec_id"]: r for r in pivot_index.near_vectors(df, pivots=300).collect()}
    found, total = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
    assert 0.9 * total <= found <= total and all(got[i]["n_links"] <= n for i, (n, _) in want.items())
