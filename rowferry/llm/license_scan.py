"""Licence scans: TF-IDF cosine of licence statements to templates, and inheritance down directories.

Around every word that speaks of licences a passage is taken. Passages become sparse vectors over the words of the
templates, weighted by term frequency and by how rare a word is among all texts; the most similar template
above a threshold names the licence. The whole text of a licence file is first compared with whole licence texts. In any file, what
follows the opening words of a licence text or of a usual file header is compared with that text or header, as many words as it has.
The identifiers of SPDX lines are looked up as they stand. A file without one of its own takes that of the licence file (a file so named) in
the nearest directory above it, found by joining directories and their ancestors.

Null and empty texts have no licence of their own; a null path is in no directory. Of equally similar templates the
first listed one is taken. Repeated rows are scanned alike, an empty table gives an empty result, and input
columns named like a result column are replaced. Texts are read whole. Only built-in column functions are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.workspace import materialise


@dataclass(frozen=True)
class Statement:
    license: str
    text: str


# Usual statements of well-known licences, by their public identifiers.
STATEMENTS = (
    Statement("MIT", "Released under the MIT License"),
    Statement("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Statement("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Statement("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    Statement("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Statement("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    Statement("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    Statement("BSD-2-Clause", "Licensed under the Simplified BSD 2-Clause License"),
    Statement("BSD-3-Clause", "Licensed under the Modified BSD 3-Clause License"),
    Statement("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Statement("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    Statement("ISC", "Licensed under the ISC License"),
    Statement("CC0-1.0", "Licensed under CC0 1.0 Universal public domain dedication"),
    Statement("CC-BY-4.0", "Licensed under CC BY 4.0"),
    Statement("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    Statement("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    Statement("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    Statement("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    Statement("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0"),
    Statement("Zlib", "This software is provided 'as-is', without any express or implied warranty"),
    Statement("Unlicense", "This is free and unencumbered software released into the public domain"),
)
SPEAKS = r"licen[sc]ed?\b|licen[sc]es?\b|permission is hereby|redistribution and use|public domain|spdx-license|provided 'as-is'"
SPDX = r"(?i)spdx-license-identifier:[\x20\t]*([^\r\n]*)"
TEXTS = Path(__file__).parent / "license_texts"
"""Whole licence texts by identifier, read by the driver."""
OPENING = 8
"""Words at the beginning of a licence text or header by which it is found in other files."""


@dataclass(frozen=True)
class Header:
    """The usual header of source files, as a licence text gives it between an opening and a closing."""

    license: str
    text: str
    opening: str
    closing: str
    needs: tuple[str, ...] = ()
    instead: tuple[str, str] = ("", "")


# Where the headers stand in the licence texts (in lower-case words), what tells apart those that read
# alike, and the name that takes the place of another in headers of licences that only refer to a text.
_FREE = "free software you can redistribute it and or modify"
_POST = "boston ma 02110 1301 usa"
_SITE = "see https www gnu org licenses"
HEADERS = (
    Header("Apache-2.0", "Apache-2.0", "licensed under the apache license version 2 0", "limitations under the license"),
    Header("GPL-2.0", "GPL-2.0", _FREE, _POST, ("gnu general public", "version 2 of")),
    Header("GPL-3.0", "GPL-3.0", _FREE, _SITE, ("gnu general public", "version 3 of")),
    Header("LGPL-2.1", "LGPL-2.1", _FREE, _POST, ("gnu lesser general public", "version 2 1 of")),
    Header("LGPL-3.0", "GPL-3.0", _FREE, _SITE, ("gnu lesser general public", "version 3 of"), ("gnu general", "gnu lesser general")),
    Header("AGPL-3.0", "GPL-3.0", _FREE, _SITE, ("gnu affero general public", "version 3 of"), ("gnu general", "gnu affero general")),
    Header("MPL-2.0", "MPL-2.0", "this source code form is subject to the terms", "mozilla org mpl 2 0"),
)


@dataclass(frozen=True)
class Template:
    """What a licence file or a stretch of a file is compared with."""

    name: str
    license: str
    words: tuple[str, ...]
    needs: tuple[str, ...] = ()

    @property
    def opening(self) -> tuple[str, ...]:
        return self.words[:OPENING]


WHOLE_SIMILAR = 0.9
BEFORE, AFTER = 60, 100
"""Characters of a passage before and from the word that speaks of licences."""
SIMILAR = 0.75
FILE_NAME = r"(?i)(?:^|/)(?:un)?licen[sc]e[^/]*$|(?:^|/)copying[^/]*$"
PARTS = 8
STRETCHES = "array<struct<_only: string, _words: array<string>>>"
_WORD = "[a-z0-9]+"
_RESULT = ("license", "score", "passages", "license_file", "effective_license", "licensed_by")


def passages(text: Column) -> Column:
    """What stands around each mention: the end of the part before it and the beginning of its own part."""
    parts = F.split(text, f"(?i)(?={SPEAKS})", -1)
    begin = lambda at: F.coalesce(F.substring(F.get(parts, at), 1, AFTER), F.lit(""))
    # A passage runs on over the mentions right behind its own.
    mention = F.transform(parts, lambda part, at: F.when(
        part.rlike(f"(?i)^(?:{SPEAKS})"),
        F.concat(F.when(at > 0, F.substring(F.get(parts, at - 1), -BEFORE, BEFORE)).otherwise(F.lit("")),
                 F.substring(F.concat(*[begin(at + k) for k in range(4)]), 1, AFTER))))
    return F.when(text.rlike(f"(?i){SPEAKS}"), F.filter(mention, lambda m: m.isNotNull())).otherwise(F.array().cast("array<string>"))


def mainly_license(text: Column) -> Column:
    """Whether lines that speak of licences make up half of a text or more."""
    spoken = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"(?i){SPEAKS}"))
    size = F.aggregate(spoken, F.lit(0), lambda total, line: total + F.length(line) + 1)
    return F.when(text.rlike(f"(?i){SPEAKS}"), size * 2 >= F.length(text)).otherwise(False)


def document_path(key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> Column:
    """A path for documents that have none: parts in the directory of a language in that of a source.

    A document that is mainly a licence statement is a licence file, of its source, language or part by its number.
    """
    number, name = F.coalesce(F.col(key), F.lit(0)), F.coalesce(F.col(key).cast("string"), F.lit("-"))
    part = F.concat(F.lit("part"), F.pmod(number, F.lit(PARTS)).cast("string"))
    steps = F.array(F.lit(""), F.coalesce(source, F.lit("-")), F.coalesce(lang, F.lit("-")), part)
    above = F.slice(steps, F.lit(1), (2 + F.pmod(F.floor(number / PARTS), F.lit(3))).cast("int"))
    return F.when(mainly_license(F.coalesce(F.col(text), F.lit(""))), F.concat(F.array_join(above, "/"), F.lit("/LICENSE."), name)) \
        .otherwise(F.concat(F.array_join(steps, "/"), F.lit("/"), name))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def vocabulary(statements: Sequence[Statement]) -> list[str]:
    return sorted({w for s in statements for w in re.findall(_WORD, s.text.lower())})


def rarity(docs: DataFrame, text: str, words: Sequence[str]) -> dict[str, float]:
    """Inverse document frequency of the template words over all texts; as many numbers as words reach the driver."""
    present = F.array_intersect(terms(F.coalesce(docs[text], F.lit(""))), F.array(*map(F.lit, words)))
    counts = docs.select(F.explode(present).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1 for w in words}


def _template_rows(docs: DataFrame, statements: Sequence[Statement], weights: dict[str, float]) -> DataFrame:
    rows = []
    for rank, s in enumerate(statements):
        words = re.findall(_WORD, s.text.lower())
        vector = {w: words.count(w) * weights[w] for w in words}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        rows += [(rank, s.license, w, v / norm) for w, v in vector.items()]
    return docs.sparkSession.createDataFrame(rows, "rank int, license string, word string, unit double")


def similarities(found: DataFrame, statements: Sequence[Statement], weights: dict[str, float]) -> DataFrame:
    """Best statement of every passage: (`_row`, `_at`, `license`, `score`), null where none is similar."""
    words = F.array(*map(F.lit, weights))
    known = F.filter(terms(F.col("passage")), lambda w: F.array_contains(words, w))
    each = found.select("_row", "_at", F.explode(known).alias("word")).groupBy("_row", "_at", "word").agg(F.count("*").alias("tf"))
    factor = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weighed = each.withColumn("weight", F.col("tf") * factor[F.col("word")])
    norms = weighed.groupBy("_row", "_at").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    # The templates are a list in this module, so their vectors are of fixed size.
    templates = F.broadcast(_template_rows(found, statements, weights))
    dots = weighed.join(templates, "word").groupBy("_row", "_at", "rank", "license").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    scored = dots.join(norms, ["_row", "_at"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
    best = scored.groupBy("_row", "_at").agg(F.max(F.struct("score", (-F.col("rank")).alias("order"), "license")).alias("_best"))
    return best.select("_row", "_at", "_best.score", F.when(F.col("_best.score") >= SIMILAR, F.col("_best.license")).alias("license"))


def scan(files: DataFrame, statements: Sequence[Statement], path: str = "path", text: str = "text") -> DataFrame:
    """Files with their own licence, its score and passages, and the licence that holds for them with its path.

    Texts are not carried on: the columns of the input come back without the text.
    """
    files = files.drop(*[c for c in _RESULT if c in files.columns])
    others = [c for c in files.columns if c != text]
    weights = rarity(files, text, vocabulary(statements))
    content = F.coalesce(files[text], F.lit(""))
    named = F.coalesce(files[path].rlike(FILE_NAME), F.lit(False))
    none = F.array().cast("array<string>")
    tagged = F.when(content.rlike(SPDX), F.regexp_extract_all(content, F.lit(SPDX), F.lit(1))).otherwise(none)
    texts = whole_texts()
    made = templates(texts)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("_only"), terms(content).alias("_words")))
    # Identifiers are not statements: cosine would take an unknown one for a known one.
    stated = F.when(content.rlike(SPDX), F.regexp_replace(content, SPDX, "")).otherwise(content)
    joined = F.when(_holds_opening(content, made), F.concat(F.lit(" "), F.array_join(terms(content), " "), F.lit(" ")))
    read = files.select(
        *others, F.monotonically_increasing_id().alias("_row"), files[path].alias("_path"),
        passages(stated).alias("_passages"), tagged.alias("_tagged"), joined.alias("_joined"),
        F.when(named, whole).otherwise(F.array().cast(STRETCHES)).alias("_whole"))
    rows = materialise(read.withColumn("_wholes", F.concat("_whole", F.when(
        F.col("_joined").isNotNull(), stretches(F.col("_joined"), made)).otherwise(F.array().cast(STRETCHES)))).drop("_joined", "_whole"))
    found = rows.filter(F.size("_passages") > 0).select("_row", F.posexplode("_passages").alias("_at", "passage"))
    hits = similarities(found, statements, weights).filter("license is not null")
    compared = rows.filter(F.size("_wholes") > 0).select("_row", F.posexplode("_wholes").alias("_at", "_one"))
    wholes = whole_similarities(compared.select("_row", "_at", "_one.*"), made)
    names = F.regexp_extract_all(F.array_join("_tagged", " "), F.lit(r"[A-Za-z0-9.+-]+"), F.lit(0))
    tags = rows.filter(F.size("_tagged") > 0).select("_row", F.posexplode(names).alias("_at", "_name")).select(
        "_row", "_at", spdx_license(F.col("_name"), [*texts, *[s.license for s in statements]]).alias("license"),
        F.lit(1.0).alias("score")).filter("license is not null")
    hits = hits.withColumn("_sure", F.lit(0)).unionByName(tags.withColumn("_sure", F.lit(1))).unionByName(
        wholes.withColumn("_sure", F.lit(2)))
    best = hits.groupBy("_row").agg(F.max(F.struct("_sure", "score", (-F.col("_at")).alias("_order"), "license")).alias("_hit"),
                                    F.count("*").alias("_n"))
    named = F.coalesce(F.col("_path").rlike(FILE_NAME), F.lit(False))
    own = materialise(rows.join(best, "_row", "left").select(
        *others, "_row", "_path", F.col("_hit.license").alias("license"), F.col("_hit.score").alias("score"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("passages"),
        (F.col("_hit").isNotNull() & named).alias("license_file")))
    nearest = _nearest(own)
    # Joined on one key more than the directories were grouped by: a directory with very many files can then be split.
    again = F.xxhash64("_directory")
    inherited = own.withColumn("_directory", directory(F.col("_path"))).withColumn("_again", again).join(
        nearest.withColumn("_again", again), ["_again", "_directory"], "left")
    return inherited.select(
        *others, "license", "score", "passages", "license_file",
        F.coalesce("license", "_license").alias("effective_license"),
        F.when(F.col("license").isNotNull(), F.col("_path")).otherwise(F.col("_by")).alias("licensed_by"))


def whole_texts() -> dict[str, str]:
    """Whole licence texts. That of the AGPL is the GPL's by its own name and date, from which it hardly differs otherwise."""
    texts = {p.stem: p.read_text(encoding="utf-8").lower() for p in sorted(TEXTS.glob("*.txt"))}
    affero = texts["GPL-3.0"].replace("gnu general", "gnu affero general").replace("29 june 2007", "19 november 2007")
    return texts | {"AGPL-3.0": affero}


def templates(texts: dict[str, str], headers: Sequence[Header] = HEADERS) -> list[Template]:
    """Whole texts and the headers cut out of them, as words."""
    words = {k: re.findall(_WORD, t) for k, t in texts.items()}
    made = [Template(k, k, tuple(w)) for k, w in words.items()]
    for header in headers:
        text = " ".join(words[header.text])
        begin = text.index(header.opening)
        end = text.index(header.closing, begin) + len(header.closing)
        cut = text[begin:end].replace(*header.instead) if header.instead[0] else text[begin:end]
        made.append(Template(f"{header.license} header", header.license, tuple(cut.split()), header.needs))
    return made


def _opened(made: Sequence[Template]) -> str:
    """A pattern of the openings, whatever stands between their words."""
    between = "[^a-z0-9]+"
    return "(?i)" + "|".join(sorted({rf"\b{between.join(t.opening)}\b" for t in made}))


def _holds_opening(text: Column, made: Sequence[Template]) -> Column:
    """Whether an opening stands in a text. Its longest words are looked for first, which is much cheaper than the pattern."""
    rare = {tuple(sorted(t.opening, key=len)[-3:]) for t in made}
    some = F.transform(F.array(F.lower(text)), lambda low: reduce(or_, [
        reduce(and_, [low.contains(w) for w in words]) for words in sorted(rare)]))
    return F.get(some, F.lit(0)) & text.rlike(_opened(made))


def stretches(joined: Column, made: Sequence[Template]) -> Column:
    """(`_only`, `_words`): after every opening as many words as each of its templates has.

    `joined` holds a text's words with one blank around each. A stretch ends where its opening comes again,
    so stretches of one template do not overlap.
    """
    groups: dict[tuple[str, ...], list[Template]] = {}
    for t in made:
        groups.setdefault(t.opening, []).append(t)
    found = [_after(joined, f" {' '.join(opening)} ", group) for opening, group in groups.items()]
    none = F.array().cast(STRETCHES)
    return F.flatten(F.array(*[F.coalesce(f, none) for f in found]))


def _after(joined: Column, mark: str, group: Sequence[Template]) -> Column:
    """The stretches of one opening."""

    def cut(part: Column) -> Column:
        each = []
        for t in group:
            words = F.slice(F.split(F.trim(part), " "), 1, len(t.words))
            there = [F.array_join(words, " ").contains(phrase) for phrase in t.needs]
            wanted = F.struct(F.lit(t.name).alias("_only"), words.alias("_words"))
            each.append(F.when(reduce(and_, there), wanted) if there else wanted)
        return F.filter(F.array(*each), lambda one: one.isNotNull())

    parts = F.filter(F.split(joined, f"(?={mark})", -1), lambda part: part.startswith(mark))
    return F.when(joined.contains(mark), F.flatten(F.transform(parts, cut)))


def whole_similarities(found: DataFrame, made: Sequence[Template]) -> DataFrame:
    """(`_row`, `_at`, `license`, `score`) of the words in `found` (`_row`, `_at`, `_only`, `_words`) that are like a template.

    Words are weighted by how rare they are among the templates. `_only` names the one template to compare with, null: all.
    """
    counted = {t: Counter(t.words) for t in made}
    among = Counter(w for words in counted.values() for w in words)
    rarity = {w: math.log((len(made) + 1) / (n + 1)) + 1 for w, n in among.items()}
    norms = {t: math.sqrt(sum((n * rarity[w]) ** 2 for w, n in words.items())) for t, words in counted.items()}
    session = found.sparkSession
    # Of the size of the licence texts, whatever the input.
    weights = F.broadcast(session.createDataFrame(list(rarity.items()), "word string, rarity double"))
    units = F.broadcast(session.createDataFrame(
        [(t.name, t.license, w, n * rarity[w] / norms[t]) for t, words in counted.items() for w, n in words.items()],
        "name string, license string, word string, unit double"))
    each = found.select("_row", "_at", "_only", F.explode("_words").alias("word")).groupBy("_row", "_at", "_only", "word").agg(
        F.count("*").alias("tf")).join(weights, "word").withColumn("weight", F.col("tf") * F.col("rarity"))
    norm = each.groupBy("_row", "_at").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = each.join(units, "word").filter("_only is null or _only = name").groupBy("_row", "_at", "name", "license").agg(
        F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    scored = dots.join(norm, ["_row", "_at"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
    best = scored.groupBy("_row", "_at").agg(F.max(F.struct("score", "license")).alias("_best"))
    return best.select("_row", "_at", "_best.license", "_best.score").filter(F.col("score") >= WHOLE_SIMILAR)


def spdx_license(name: Column, known: Sequence[str]) -> Column:
    """The licence of an SPDX identifier, null if unknown; `-only`, `-or-later` and `+` do not change it."""
    bare = F.regexp_replace(F.lower(name), r"(?:-only|-or-later|\+)$", "")
    return F.create_map(*[F.lit(x) for k in sorted(set(known)) for x in (k.lower(), k)])[bare]


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _nearest(own: DataFrame) -> DataFrame:
    """For every directory with files the licence file of the nearest directory at or above it."""
    found = own.filter("license_file").groupBy(directory(F.col("_path")).alias("_above")).agg(
        F.min(F.struct((-F.col("score")).alias("_order"), "_path", "license")).alias("_file"))
    places = own.select(directory(F.col("_path")).alias("_directory")).filter("_directory is not null").distinct()
    steps = F.split("_directory", "/")
    above = places.select("_directory", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("_above"))
    reached = above.join(found, "_above").groupBy("_directory").agg(
        F.max_by("_file", F.length("_above")).alias("_file"))
    return reached.select("_directory", F.col("_file.license").alias("_license"), F.col("_file._path").alias("_by"))
