"""License scans: ordered signature rules over word sequences, in DataFrame operations only.

Texts become their words (A-Z in lower case, cut at ASCII signs and spaces) joined by single spaces. Each
family of rules runs only where its own keyword stands, and texts without any family's keyword are not
scanned. Every rule is a regular expression over the words and gives the intervals where it
matches; of overlapping detections one that lies inside an interval of higher priority, or of the same
priority and greater length, is suppressed.

A line is looked at in pieces of ``PIECE`` words with a margin of the longest rule on both sides, so every
interval, and every interval that can contain it, lies whole in the piece where it starts: work grows in
proportion to the length of a text, and no position is counted again from the head of the text.

The rules are the product of licence names, versions and the forms in which texts state a licence.

Defined results: null and empty texts have no words and no hits; a text of any length is scanned whole; repeated
rows repeat their result; an empty table gives no rows; columns of the table may have any name but ``scan``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.llm.shared import lower_ascii

CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Families as (keyword, label, name, versions). A name is an expression over words; a
#: version is written as its words; a label with a version gets "-version".
FAMILIES = [
    ("mit", "mit", "(?:the )?mit", []),
    ("mit", "mit-0", "mit (?:0|no attribution)", []),
    ("apache", "apache", "(?:the )?apache(?: software)?", ["1 0", "1 1", "2 0"]),
    ("gpl", "gpl", "(?:gnu )?gpl", ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("general", "gpl", "(?:gnu )?general public", ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2 0", "2 1", "3 0", "2", "3"]),
    ("lesser", "lgpl", "(?:gnu )?lesser general public", ["2 1", "3 0", "3"]),
    ("library", "lgpl", "(?:gnu )?library general public", ["2 0", "2"]),
    ("agpl", "agpl", "(?:gnu )?agpl", ["1 0", "3 0", "3"]),
    ("affero", "agpl", "(?:gnu )?affero general public", ["1 0", "3 0", "3"]),
    ("documentation", "gfdl", "(?:gnu )?free documentation", ["1 1", "1 2", "1 3"]),
    ("bsd", "bsd", "(?:the )?(?:new |modified |simplified |revised )?bsd", ["2 clause", "3 clause", "4 clause", "0 clause"]),
    ("mozilla", "mpl", "mozilla public", ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", "mpl", ["1 0", "1 1", "2 0"]),
    ("eclipse", "epl", "eclipse public", ["1 0", "2 0"]),
    ("epl", "epl", "epl", ["1 0", "2 0"]),
    ("european", "eupl", "european union public", ["1 0", "1 1", "1 2"]),
    ("cddl", "cddl", "cddl", ["1 0", "1 1"]),
    ("distribution", "cddl", "common development and distribution", ["1 0", "1 1"]),
    ("creative", "cc-by", "creative commons attribution", ["2 0", "2 5", "3 0", "4 0"]),
    ("creative", "cc-by-sa", "creative commons attribution share ?alike", ["2 0", "2 5", "3 0", "4 0"]),
    ("creative", "cc-by-nc", "creative commons attribution non ?commercial", ["2 0", "2 5", "3 0", "4 0"]),
    ("creative", "cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s", ["2 0", "2 5", "3 0", "4 0"]),
    ("creative", "cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike", ["2 0", "2 5", "3 0", "4 0"]),
    ("creative", "cc0", "creative commons (?:cc0|zero)", ["1 0"]),
    ("cc", "cc-by", "cc by", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc", "cc-by-sa", "cc by sa", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc", "cc-by-nc", "cc by nc", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc", "cc-by-nd", "cc by nd", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc", "cc-by-nc-sa", "cc by nc sa", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc", "cc-by-nc-nd", "cc by nc nd", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc0", "cc0", "cc0", ["1 0"]),
    ("isc", "isc", "(?:the )?isc", []),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)?", []),
    ("boost", "bsl", "boost software", ["1 0"]),
    ("artistic", "artistic", "(?:the )?artistic", ["1 0", "2 0"]),
    ("unlicense", "unlicense", "(?:the )?unlicense", []),
    ("wtfpl", "wtfpl", "wtfpl", ["2"]),
    ("python", "psf", "python(?: software foundation)?", ["2", "2 0"]),
    ("php", "php", "php", ["3 0", "3 01"]),
    ("ruby", "ruby", "ruby", []),
    ("perl", "perl", "perl", ["5"]),
    ("sil", "ofl", "sil open font", ["1 0", "1 1"]),
    ("ofl", "ofl", "ofl", ["1 0", "1 1"]),
    ("database", "odbl", "open (?:data commons )?(?:open )?database", ["1 0"]),
    ("odbl", "odbl", "odbl", ["1 0"]),
    ("microsoft", "ms-pl", "microsoft public", []),
    ("microsoft", "ms-rl", "microsoft reciprocal", []),
    ("openssl", "openssl", "openssl", []),
    ("academic", "afl", "academic free", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("open", "osl", "open software", ["1 0", "2 0", "2 1", "3 0"]),
    ("common", "cpl", "common public", ["1 0"]),
    ("ibm", "ipl", "ibm public", ["1 0"]),
    ("qt", "qpl", "qt public", ["1 0"]),
    ("qpl", "qpl", "qpl public", ["1 0"]),
    ("sleepycat", "sleepycat", "sleepycat", []),
    ("server", "sspl", "server side public", ["1"]),
    ("business", "busl", "business source", ["1 1"]),
    ("elastic", "elastic", "elastic", ["2 0"]),
    ("beerware", "beerware", "beerware", []),
    ("postgresql", "postgresql", "postgresql", []),
]
#: Statements without a name of the families above, as (keyword, label, expression, priority).
STATEMENTS = [
    ("permission", "mit", "permission is hereby granted free of charge to any person obtaining a copy", 80),
    ("permission", "isc", "permission to use copy modify and(?: or)? distribute this software for any purpose", 80),
    ("redistribution", "bsd", "redistribution and use in source and binary forms with or without modification", 80),
    ("redistributions", "bsd", "redistributions of source code must retain the above copyright notice", 75),
    ("redistributions", "bsd", "redistributions in binary form must reproduce the above copyright notice", 75),
    ("domain", "public-domain", "(?:released into|dedicated to|is in|placed in) the public domain", 70),
    ("reserved", "proprietary", "all rights reserved", 30),
    ("warranty", "no-warranty", "(?:provided )?as is without warranty of any kind", 20),
    ("spdx", "spdx", "spdx license identifier [a-z0-9]+(?: [0-9]+){0,3}", 25),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 15),
    ("dual", "dual", "dual licensed under", 20),
    ("terms", "terms", "under the (?:same )?terms (?:and conditions )?of the", 10),
]
#: Names written in one word with their version.
STATEMENTS += [(f"{n}v{v}", f"{n}-{v}", f"(?:gnu )?{n}v{v}(?: 0)?", 70) for n in ("gpl", "lgpl", "agpl") for v in (1, 2, 3)]
LICENSE = "(?:public )?licen[sc]e"
VERSION = "(?:version |v ?)?"
#: Forms as (expression with the name and version, priority, confidence); the first that states more wins.
VERSIONED = [
    ("licensed under (?:the )?(?:terms of )?(?:the )?{name}(?: " + LICENSE + ")? " + VERSION + "{version}", 100, 1.0),
    ("spdx license identifier {name} {version}", 98, 1.0),
    ("{name} " + LICENSE + " " + VERSION + "{version}", 90, 0.95),
    ("{name} " + VERSION + "{version}", 70, 0.8),
]
PLAIN = [
    ("(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{name}(?: " + LICENSE + ")?", 60, 0.9),
    ("spdx license identifier {name}", 58, 0.9),
    ("{name} " + LICENSE, 50, 0.8),
    ("(?:licen[sc]e|lizenz|licencia) {name}", 45, 0.7),
]


def rules() -> list[tuple]:
    """(keyword, label, expression, priority, confidence) of every rule, in order of priority."""
    found = [(k, label, p, priority, priority / 100) for k, label, p, priority in STATEMENTS]
    for keyword, label, name, versions in FAMILIES:
        found += [(keyword, label, form.format(name=name), rank, sure) for form, rank, sure in PLAIN]
        for version in versions:
            own = f"{label}-{version.replace(' ', '.')}"
            words = version if " clause" not in version else version.replace(" ", " ?")
            found += [(keyword, own, form.format(name=name, version=words), rank, sure) for form, rank, sure in VERSIONED]
    return sorted(found, key=lambda r: (-r[3], r[1], r[2]))


#: Texts with the keyword of any rule; no rule matches elsewhere.
GATE = " (?:" + "|".join(sorted({r[0] for r in rules()})) + ") "


#: Words that the longest rule can take: all its parts, counted numbers included.
LONGEST = max(r[2].count(" ") for r in rules()) + 4
PIECE = 128  # words whose intervals are found together
TABLE = "array<struct<keyword:string,rules:array<struct<p:string,label:string,rank:int,sure:double>>>>"
SPANS = "array<struct<start:int,end:int,label:string,rank:int,sure:double>>"


def word_line(text: Column) -> Column:
    """``^``, then every word behind a space, then a space."""
    line = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), CUT, " "))
    return F.when(line == "", F.lit("^ ")).otherwise(F.concat(F.lit("^ "), line, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hits(line: Column, rule: Column) -> Column:
    """Intervals (first word, end) of all places of a piece where a rule matches; the piece is cut before each."""
    own = F.struct(
        F.regexp_extract_all(line, F.concat(F.lit("(?= ("), rule["p"], F.lit(") )")), F.lit(1)).alias("found"),
        F.concat(F.lit("(?= "), rule["p"], F.lit(" )")).alias("cut"),
    )
    starts = lambda pieces: F.transform(pieces, lambda _, k: _spaces(F.array_join(F.slice(pieces, F.lit(1), k + 1), "")))
    interval = lambda words, start: F.struct(
        start.alias("start"),
        (start + _spaces(words) + 1).alias("end"),
        rule["label"].alias("label"),
        rule["rank"].alias("rank"),
        rule["sure"].alias("sure"),
    )
    placed = lambda h: _let(
        starts_of(h["cut"]), lambda at: F.transform(h["found"], lambda words, k: interval(words, F.get(at, k)))
    )
    starts_of = lambda cut: _let(F.split(line, cut), starts)
    return _let(own, lambda h: F.when(F.size(h["found"]) > 0, placed(h)).otherwise(F.array().cast(SPANS)))


def detections(line: Column) -> Column:
    """All intervals of all rules on a line of words, suppressed ones left out."""
    families: dict[str, list] = {}
    for keyword, label, pattern, rank, sure in rules():
        families.setdefault(keyword, []).append((pattern, label, rank, sure))
    listed = [
        {"keyword": f" {k} ", "rules": [dict(zip(("p", "label", "rank", "sure"), rule)) for rule in own]} for k, own in families.items()
    ]
    table = F.from_json(F.lit(json.dumps(listed)), TABLE)  # a constant, worked out once while planning
    open_ = F.filter(table, lambda f: F.contains(line, f["keyword"]))
    return F.flatten(F.transform(F.flatten(F.transform(open_, lambda f: f["rules"])), lambda r: _hits(line, r)))


def kept(hits: Column) -> Column:
    """Intervals that no interval of higher priority, or of equal priority and greater length, contains."""
    size = lambda h: h["end"] - h["start"]
    covers = lambda g, h: (g["start"] <= h["start"]) & (g["end"] >= h["end"])
    wins = lambda g, h: (g["rank"] > h["rank"]) | ((g["rank"] == h["rank"]) & (size(g) > size(h)))
    return F.filter(hits, lambda h: ~F.exists(hits, lambda g: covers(g, h) & wins(g, h)))


def spans(line: Column) -> Column:
    """The kept intervals of a line of any length, in order of the pieces where they start."""
    size = lambda piece: F.least(piece["n"] - piece["first"], F.lit(PIECE))
    own = lambda piece: F.transform(
        F.filter(
            _let(detections(piece["line"]), kept),
            lambda h: (h["start"] >= piece["margin"]) & (h["start"] < piece["margin"] + size(piece)),
        ),
        lambda h: F.struct(
            (h["start"] + piece["first"] - piece["margin"]).alias("start"),
            (h["end"] + piece["first"] - piece["margin"]).alias("end"),
            h["label"].alias("label"),
            h["rank"].alias("rank"),
            h["sure"].alias("sure"),
        ),
    )
    cut = lambda words: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(PIECE)),
        lambda first: F.struct(
            first.alias("first"),
            F.least(first, F.lit(LONGEST)).alias("margin"),
            F.size(words).alias("n"),
            F.concat(
                F.lit("^ "),
                F.array_join(F.slice(words, F.greatest(first - LONGEST, F.lit(0)) + 1, F.lit(PIECE + 2 * LONGEST)), " "),
                F.lit(" "),
            ).alias("line"),
        ),
    )
    gated = lambda pieces: F.filter(pieces, lambda piece: piece["line"].rlike(GATE))
    words = F.split(F.trim(F.substr(line, F.lit(2))), " ")
    return F.flatten(F.transform(gated(_let(words, cut)), own)).cast(SPANS)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``scan``, always the last.

    It holds n_words, n_base, first_word, last_word, base_labels, labels, score and the kept ``spans``
    (start, end, label, rank, sure). The score is the largest confidence of a kept rule, and at least
    one half where a base phrase stands.
    """
    line = word_line(F.col(text))
    rows = docs.select(F.struct(*docs.columns).alias("own"), line.alias("line"))
    base = "(?= (?:" + "|".join(BASE) + ") )"
    pieces = F.when(F.contains("line", F.lit(" license ")), F.split("line", base))
    found = F.when(F.col("line").rlike(GATE), spans(F.col("line")))
    rows = rows.withColumn("pieces", pieces).withColumn("spans", F.coalesce(found, F.array().cast(SPANS)))
    n_words = F.when(F.col("line") == "^ ", F.lit(0)).otherwise(_spaces(F.col("line")) - 1).cast("long")
    n_base = F.coalesce(F.size("pieces") - 1, F.lit(0)).cast("long")
    last = _spaces(F.element_at("pieces", -1))
    has = F.size("pieces") > 1
    own = F.filter(
        F.array(*[F.when(F.contains("line", F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]),
        lambda x: x.isNotNull(),
    )
    labels = F.array_union(own, F.transform("spans", lambda s: s["label"]))
    sure = F.coalesce(F.array_max(F.transform("spans", lambda s: s["sure"])), F.lit(0.0))
    scan = F.struct(
        n_words.alias("n_words"),
        n_base.alias("n_base"),
        F.when(has, _spaces(F.get("pieces", F.lit(0)))).cast("long").alias("first_word"),
        F.when(has, _spaces(F.col("line")) - last).cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.greatest(sure, F.when(has, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
        F.col("spans"),
    )
    return rows.select("own.*", scan.alias("scan"))
