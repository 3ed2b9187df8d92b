"""License scans by a positional index of rare words.

The index posts each licence template under the words of its key phrases that are rarest (of highest
IDF) in the scanned corpus, with their positions in the template. In each file the index words that it
holds are looked up, those with the fewest places in this file first; a place less a posting's position
is where the template would start, and the postings of a template are intersected by that. Key phrases
are mandatory, so every index word stands in every true place and the intersection loses none. A start
that is left is verified on the key phrases, and scored by the share of the template's words that stand
where they should.

DataFrame functions only: no Python runs on the executors. The only shuffle is the count of how many
documents hold each template word; everything else happens inside a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_runs

#: Words of licence texts: ASCII letters and digits, and everything beyond ASCII. A-Z are words here
#: too, as they are lower-cased after the split.
APART = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
LICENSE_WORD = f"[^{APART}]+"


@dataclass(frozen=True)
class Template:
    """A label, the template's words, and the key phrases that must stand in their places."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()


# Phrases whose every occurrence counts, with their labels.
BASE = (
    Template("mit", "under the mit license", ("under the mit license",)),
    Template("apache-2", "apache license version 2", ("apache license version 2",)),
    Template("cc-by-nc", "cc by nc", ("cc by nc",)),
)
# Wording of common licence notices, lower case without punctuation, and key phrases.
NOTICES = (
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy")),
    Template("mit-warranty", "the software is provided as is without warranty of any kind express or implied", ("the software is provided as is", "without warranty of any kind")),
    Template("apache-2-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "except in compliance with the license")),
    Template("apache-2-line", "licensed under the apache license version 2 0", ("licensed under the apache license version 2 0",)),
    Template("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software you can redistribute it", "gnu general public license")),
    Template("lgpl-name", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mpl-2-notice", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("cc-by-line", "creative commons attribution", ("creative commons attribution",)),
    Template("mit-line", "released under the mit license", ("released under the mit license",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with"
        " the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "shall be included in all copies or substantial portions", "merchantability fitness for a particular purpose and noninfringement"),
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
        " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ("permission to use copy modify", "disclaims all warranties with regard to this software", "other tortious action"),
    ),
)


def _sql(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _lower(text):
    """ASCII A-Z only; everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _any_of(words: list[str]) -> str:
    """A pattern of the words, in any ASCII case, as a tree by letter: each letter is looked at once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [c + pattern(n) for c, n in sorted(node.items()) if c]
        body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return "" if not parts else f"(?:{body})?+" if "" in node else body

    return f"(?i)(?=[{''.join(sorted(tree))}])(?<![^{APART}]){pattern(tree)}(?![^{APART}])"


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of ``vocabulary``, counted over all documents.

    The result has a row per template word at most, whatever the corpus.
    """
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_any_of(vocabulary)), F.lit(0))
    rows = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.array_join(found, " ")), " "))).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows if r["word"] in vocabulary}


def _key_places(t: Template) -> list[tuple[int, list[str]]]:
    """Where each key phrase stands in the template, and its words."""
    words, out = t.words, []
    for key in t.keys:
        k = key.split()
        out.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
    return out


def index(templates: Sequence[Template], df: dict[str, int], most: int) -> dict[str, list[tuple[str, list[int]]]]:
    """Postings by label: (word, its positions in the key phrases), the ``most`` rarest words of each template; ties by word."""
    out = {}
    for t in templates:
        places: dict[str, list[int]] = {}
        for p, key in _key_places(t):
            for k, w in enumerate(key):
                if p + k not in places.setdefault(w, []):
                    places[w].append(p + k)
        rare = sorted(places, key=lambda w: (df.get(w, 0), w))[:most]
        out[t.label] = [(w, places[w]) for w in rare]
    return out


def _starts(postings: list[tuple[str, list[int]]]) -> str:
    """SQL for the starts that all index words of a template agree on, from ``hits``."""
    lists = []
    for w, ps in postings:
        at = f"array({', '.join(f'h.i - {p}' for p in ps)})"
        lists.append(f"flatten(transform(filter(hits, h -> h.x = '{w}'), h -> {at}))")
    if len(lists) == 1:
        return f"array_distinct({lists[0]})"
    # The word with the fewest places in this file comes first.
    ranked = f"array_sort(array({', '.join(f'named_struct({chr(39)}n{chr(39)}, size(s{k}), {chr(39)}s{chr(39)}, s{k})' for k in range(len(lists)))}))"
    for k, x in reversed(list(enumerate(lists))):
        ranked = f"transform(array({x}), s{k} -> {ranked})[0]"
    return f"transform(array({ranked}), r -> aggregate(slice(r, 2, size(r)), array_distinct(r[0].s), (a, x) -> if(size(a) = 0, a, array_intersect(a, x.s))))[0]"


def license_scan(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, rare_words: int = 3, least_score: float = 0.8) -> DataFrame:
    """Licences of each row of ``docs`` (doc_id, text), which may have further columns.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (least and
    largest start, from 0, else null), base_labels, labels (distinct, sorted, comma-joined; empty
    strings without any), score (1 with a base phrase, else the best notice's share of words in
    place, 0 without one). A notice counts if its key phrases stand in their places and
    ``least_score`` of its words do. Null texts count as empty; equal rows get equal results; an empty
    table gives an empty result. Whole texts are scanned.
    """
    templates = [*base, *notices]
    df = word_frequencies(docs, sorted({w for t in templates for key in t.keys for w in key.split()}))
    postings = index(base, df, 1) | index(notices, df, rare_words)
    index_words = sorted({w for p in postings.values() for w, _ in p})
    # Files without an index word have nothing to align: their words are counted but not listed.
    d = docs.select("doc_id", count_runs("text", APART).alias("n_words"), F.when(F.col("text").rlike(_any_of(index_words)), F.col("text")).alias("text"))
    d = d.select("doc_id", "n_words", F.split(_lower(F.array_join(F.regexp_extract_all("text", F.lit(LICENSE_WORD), F.lit(0)), " ")), " ").alias("w"))
    hits = f"CASE WHEN w IS NULL THEN NULL ELSE filter(transform(w, (x, i) -> struct(x AS x, i AS i)), h -> array_contains({_sql(index_words)}, h.x)) END"
    d = d.select("doc_id", "n_words", "w", F.expr(hits).alias("hits"))
    columns = []
    for k, t in enumerate(templates):
        fits = " AND ".join([f"x >= 0 AND x + {len(t.words)} <= n_words", *(f"slice(w, x + {p + 1}, {len(key)}) = {_sql(key)}" for p, key in _key_places(t))])
        places = f"filter({_starts(postings[t.label])}, x -> CASE WHEN {fits.replace(' AND slice', ' THEN slice', 1)} ELSE false END)"
        if k < len(base):
            columns.append(F.expr(f"CASE WHEN hits IS NULL THEN cast(array() AS array<int>) ELSE {places} END").alias(f"at{k}"))
        else:
            share = f"aggregate(zip_with(slice(w, x + 1, {len(t.words)}), {_sql(t.words)}, (a, b) -> if(a = b, 1, 0)), 0, (a, b) -> a + b) / {float(len(t.words))}D"
            columns.append(F.expr(f"CASE WHEN hits IS NULL THEN 0D ELSE coalesce(array_max(transform({places}, x -> {share})), 0D) END").alias(f"at{k}"))
    d = d.select("doc_id", "n_words", *columns)
    b, n = range(len(base)), range(len(base), len(templates))
    d = d.withColumn("starts", F.concat(*[F.col(f"at{k}") for k in b]))
    base_found = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(templates[k].label)) for k in b]))
    notice_found = F.array_compact(F.array(*[F.when(F.col(f"at{k}") >= least_score, F.lit(templates[k].label)) for k in n]))
    best = F.greatest(F.lit(0.0), *[F.when(F.col(f"at{k}") >= least_score, F.col(f"at{k}")).otherwise(0.0) for k in n])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return d.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        joined(base_found).alias("base_labels"), joined(F.concat(base_found, notice_found)).alias("labels"), F.when(F.size("starts") > 0, 1.0).otherwise(best).alias("score"),
    )
