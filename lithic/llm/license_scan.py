"""Licence scan by a positional index of rare tokens, in DataFrame functions only.

A file's licence words of high inverse document frequency are looked up in the templates' postings: their places in the
file minus their places in the template give the places where the template may start. A start that two of them agree on
is verified: the template's mandatory key phrase must stand there word for word, and the share of template words that
stand in place is the match's score. Frequencies are those among the templates, words of everyday English last, and
the words that are looked up are the two rarest of each key phrase. So every start that can be verified is found, and
a file's labels depend on the file alone. Exact base phrases are reported beside the templates, wherever they stand.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import text_or_empty

#: Words of a template's key phrase that are looked up, and must agree on a start.
RARE = 2
#: Words of everyday English, which are looked up only if a key phrase has too few others.
EVERYDAY = frozenset(("a", "and", "any", "are", "by", "for", "in", "into", "is", "of", "or", "the", "this", "to", "under", "with"))
#: Share of a template's words that must stand in place, beside its key phrase.
SHARE = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All that stands between words: ASCII but for digits and letters.
_BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_STEP = 1 << 40


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


#: Opening words of public licences as files state them, with the phrase that must be there.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("gpl-2.0", "under the terms of the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "under the terms of the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mit", "licensed under the mit license", "mit license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def words_of(text_col: str) -> Column:
    """Lower-cased words; cut at single spaces, which needs no regular expression, once all that is between words is a space."""
    spaced = F.translate(text_or_empty(text_col), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def rare_words(template: Template) -> list[str]:
    """The words of the template's key phrase that are looked up: the highest inverse document frequencies among templates, ties by place."""
    holds = Counter(w for t in TEMPLATES for w in set(t.words))
    idf = lambda w: -1.0 if w in EVERYDAY else math.log((len(TEMPLATES) + 1) / holds[w])
    words = list(dict.fromkeys(template.key.split()))
    return sorted(words, key=lambda w: (-idf(w), words.index(w)))[:RARE]


def _phrase_starts(words: Column, phrase: list[str]) -> Column:
    """Places where the phrase's words stand consecutively; empty without looking further where its first word is missing."""
    n = len(phrase)

    def here(word, at):
        rest = [F.try_element_at(words, at + 1 + i) == F.lit(w) for i, w in enumerate(phrase) if i]
        same = word == F.lit(phrase[0])
        for test in rest:
            same = same & F.coalesce(test, F.lit(False))
        return F.when(same, at)

    found = F.filter(F.transform(words, here), lambda x: x.isNotNull())
    return F.when(F.array_contains(words, phrase[-1]) & (F.size(words) >= n), found).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null and empty texts have no words and score 0. score is the best verified template match, 1.0 where a base phrase
    stands. Repeated rows are treated alike; other columns are ignored; an empty table gives no rows. One pass over the
    texts, without a shuffle; a row depends on its text alone.
    """
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(TEMPLATES):
        for word in rare_words(template):
            postings.setdefault(word, []).extend((t, i) for i, w in enumerate(template.words) if w == word)
    rare = sorted(postings)
    # per rare word the numbers template * _STEP - place: adding a place in the file gives template and start at once
    index = F.create_map(*(x for w in rare for x in (F.lit(w), F.array(*(F.lit((t + 1) * _STEP - i) for t, i in postings[w])))))
    needed = [len(rare_words(t)) for t in TEMPLATES]

    base = docs.select(F.col(id_col), words_of(text_col).alias("__words"))
    marked = base.select(
        id_col, "__words", *(_phrase_starts(F.col("__words"), p.split()).alias(f"__base{k}") for k, (p, _) in enumerate(phrases)),
        F.when(F.arrays_overlap("__words", _strings(rare)), F.transform("__words", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i"))))).alias("__places"),
    )
    hits = F.flatten(F.transform(F.filter("__places", lambda x: x.isNotNull()), lambda x: F.transform(F.element_at(index, x["w"]), lambda p: p + x["i"])))
    hit = marked.select("*", F.sort_array(hits).alias("__hits"))
    # a number that comes as often as the template needs is a start on which that many rare words agree
    twice = lambda x, i: F.coalesce(F.try_element_at(F.col("__hits"), i + 2) == x, F.lit(False))
    single = [t + 1 for t, n in enumerate(needed) if n < 2]
    alone = (lambda x: F.floor((x + _STEP / 2) / _STEP).isin(single)) if single else (lambda x: F.lit(False))
    starts = hit.select("*", F.array_distinct(F.filter("__hits", lambda x, i: twice(x, i) | alone(x))).alias("__starts"))

    def verified(code: Column) -> Column:
        number = F.floor((code + _STEP // 2) / _STEP).cast("int")
        start = (code - number * F.lit(_STEP)).cast("int")
        out = F.lit(None).cast("struct<label:string,score:double>")
        for t, template in enumerate(TEMPLATES):
            key, words = template.key.split(), template.words
            at = start + template.key_at + 1
            same = F.when(at >= 1, F.slice("__words", F.greatest(at, F.lit(1)), len(key)) == _strings(key)).otherwise(F.lit(False))
            place = lambda i: F.when(start + i + 1 >= 1, F.try_element_at("__words", F.greatest(start + i + 1, F.lit(1))))  # noqa: E731, B023
            share = sum((F.coalesce((place(i) == F.lit(w)).cast("int"), F.lit(0)) for i, w in enumerate(words)), F.lit(0)) / float(len(words))
            out = F.when((number == t + 1) & same & (share >= SHARE), F.struct(F.lit(template.label).alias("label"), share.alias("score"))).otherwise(out)
        return out

    matched = starts.select("*", F.filter(F.transform("__starts", verified), lambda x: x.isNotNull()).alias("__matches"))
    all_starts = F.flatten(F.array(*(F.col(f"__base{k}") for k in range(len(phrases)))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"__base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases))))
    named = F.coalesce(F.transform("__matches", lambda m: m["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("__matches", lambda m: m["score"])), F.lit(0.0))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    out = matched.select(id_col, F.size("__words").cast("long").alias("n_words"), all_starts.alias("__at"), base_labels.alias("__labels"), named.alias("__named"), best.alias("__best"))
    return out.select(
        id_col, "n_words", F.size("__at").cast("long").alias("n_base"), F.array_min("__at").cast("long").alias("first_word"), F.array_max("__at").cast("long").alias("last_word"),
        joined(F.col("__labels")).alias("base_labels"), joined(F.concat("__labels", "__named")).alias("labels"), F.when(F.size("__labels") > 0, F.lit(1.0)).otherwise(F.col("__best")).alias("score"),
    )
