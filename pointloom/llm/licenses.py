"""License scans: ordered signature rules over normalised words.

A text is reduced to its words, ASCII lower-cased and joined by single spaces.
Texts without any keyword of the rules go no further (the prefilter).  In the
others each rule whose own keyword is there is tried; all its matches become
detections (first word, last word, label, priority).  Detections are sorted by
first word, last word downwards and priority; one that lies inside an earlier
one of the same or a stronger priority is suppressed, and hints count only where
nothing stronger was found.  The labels of the plain base phrases always stay.

Rules are sentences from the texts of licences, single names, and families of
licences by fixed templates, in order of priority: the tag of a file header, a
full name with a version or a sentence, a name, a hint.

Cases: a null text is empty; a very long text is one line that every rule whose
keyword it holds searches once; detections of equal place and priority go by label;
repeated rows are scanned alike; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.lets import let

#: Anything but letters, digits and non-ASCII characters parts words.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that are looked for at every place, and their labels.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

#: Families as (label, keyword, name pattern, versions); every match of the pattern holds the keyword.
FAMILIES = [
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", ["1", "3"]),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[sc]e", ["2", "2 1", "3"]),
    ("gpl", "general public", "(?:gnu )?general public licen[sc]e", ["1", "2", "3"]),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[sc]e", ["1 1", "1 2", "1 3"]),
    ("apache", "apache", "apache(?: software)? licen[sc]e", ["1", "1 1", "2", "2 0"]),
    ("mpl", "mozilla", "mozilla public licen[sc]e", ["1", "1 1", "2", "2 0"]),
    ("epl", "eclipse", "eclipse public licen[sc]e", ["1", "1 0", "2", "2 0"]),
    ("eupl", "european union", "european union public licen[sc]e", ["1", "1 1", "1 2"]),
    ("cddl", "common development", "common development and distribution licen[sc]e", ["1", "1 1"]),
    ("cpl", "common public", "common public licen[sc]e", ["1", "1 0"]),
    ("artistic", "artistic", "artistic licen[sc]e", ["1", "1 0", "2", "2 0"]),
    ("bsl", "boost", "boost software licen[sc]e", ["1", "1 0"]),
    ("mit", "mit licen", "(?:the )?mit licen[sc]e", []),
    ("isc", "isc licen", "isc licen[sc]e", []),
    ("zlib", "zlib", "zlib licen[sc]e", []),
    ("bsd", "bsd licen", "(?:[234] clause |new |simplified |modified )?bsd licen[sc]e", []),
    ("unlicense", "unlicen", "(?:the )?unlicen[sc]e", []),
    ("wtfpl", "what the fuck", "do what the fuck you want to public licen[sc]e", ["1", "2"]),
    ("ofl", "open font", "(?:sil )?open font licen[sc]e", ["1", "1 0", "1 1"]),
    ("odbl", "database", "open (?:data commons )?(?:open )?database licen[sc]e", ["1", "1 0"]),
    ("psf", "python software", "python software foundation licen[sc]e", ["2", "2 0"]),
    ("osl", "open software", "open software licen[sc]e", ["1", "2", "2 1", "3", "3 0"]),
    ("afl", "academic free", "academic free licen[sc]e", ["1 1", "1 2", "2", "2 1", "3", "3 0"]),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", []),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", []),
]
#: The parts of Creative Commons licences.
CC_PARTS = ["by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by"]
CC_NAMES = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv[a-z]*", "sa": "share ?alike"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Single signatures as (label, keyword, pattern).
SINGLE = [
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", "public domain", "(?:dedicated to|placed in|released into) the public domain"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy", "permission to use copy modify and or distribute this software"),
    ("apache", "www apache org", "www apache org licen[sc]es licen[sc]e 2 0"),
    ("gpl", "www gnu org", "www gnu org licen[sc]es(?: gpl)?"),
    ("zlib", "as is without any express", "as is without any express or implied warranty"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "unauthori", "unauthori[sz]ed (?:copying|reproduction|distribution)"),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("noncommercial", "commercial", "(?:for )?non ?commercial (?:use|purposes) only"),
]
#: Sentences from the texts of licences as (label, keyword, pattern).
BODY = [
    ("mit", "associated documentation", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "this permission notice", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium permission"),
    ("boost", "accompanying documentation covered", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the(?: above)? copyright notice(?:s)?"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the(?: above)? copyright notice(?:s)?"),
    ("bsd-3-clause", "written permission", "may be used to endorse or promote products derived from this software without(?: specific)? prior written permission"),
    ("bsd-4-clause", "all advertising materials", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met all advertising materials"),
    ("bsd-clear", "no express or implied licenses", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2.0", "in compliance with the license", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "specific language governing", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "each contributor hereby grants", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl", "you can redistribute it", "(?:this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it", "(?:this library|it) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "you can redistribute it", "(?:this program|it) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "without even the implied warranty", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received a copy of the gnu", "you should have received a copy of the gnu general public license along with"),
    ("lgpl", "received a copy of the gnu", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("agpl", "received a copy of the gnu", "you should have received a copy of the gnu affero general public license along with"),
    ("gpl", "verbatim copies of this license document", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "freedom not price", "when we speak of free software we are referring to freedom not price our general public licenses are designed"),
    ("gpl-exception", "special exception", "as a special exception to the gnu general public license"),
    ("agpl-3", "remote network interaction", "remote network interaction use with the gnu general public license"),
    ("gfdl", "distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "source code form is subject", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "contents of this file", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "incompatible with secondary", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "contents of this file", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("isc", "with or without fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("ntp", "and its documentation", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? (?:with or )?without fee is hereby granted"),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("zlib", "redistribute it freely", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("cc0", "related or neighboring rights", "waived all copyright and related or neighboring rights"),
    ("wtfpl", "modified copies of this license", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("ofl", "this font software", "this font software is licensed under the sil open font license"),
    ("ofl", "copy of the font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("artistic", "semblance of artistic control", "such that the copyright holder maintains some semblance of artistic control"),
    ("psf", "between the python software", "this license agreement is between the python software foundation"),
    ("ms-pl", "governs use of the accompanying", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("eupl", "eupl", "licen[sc]ed under the eupl"),
    ("cc-by", "attribution", "this work is licensed under a creative commons attribution"),
    ("cc-by", "share copy and redistribute", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by-sa", "contributions under the same license", "you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "for commercial purposes", "you may not use the material for commercial purposes"),
    ("warranty-disclaimer", "warranty of any kind", "(?:is )?provided as is without warranty of any kind(?: express or implied)?"),
    ("warranty-disclaimer", "implied warranties", "any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose"),
    ("proprietary", "may be reproduced", "no part of this (?:publication|document|book|work|software) may be reproduced(?: or transmitted)?(?: in any form)? without(?: the)?(?: prior)?(?: written)? permission"),
    ("proprietary", "without", "reproduction in whole or in part without(?: written)? permission is (?:prohibited|forbidden)"),
    ("proprietary", "confidential and proprietary", "confidential and proprietary"),
    ("proprietary", "not sold", "(?:this|the) software is licensed not sold"),
    ("proprietary", "end user", "end user licen[sc]e agreement"),
    ("proprietary", "trade secret", "proprietary information and trade secrets?"),
    ("noncommercial", "non commercial", "(?:free )?for(?: personal and)? non commercial use"),
]
#: Licences by name alone as (label, keyword), the keyword being the name without its last word.
NAMED = [
    ("sspl", "server side public"), ("busl", "business source"), ("elastic", "elastic"), ("commons-clause", "commons clause"),
    ("polyform", "polyform noncommercial"), ("hippocratic", "hippocratic"), ("json", "json"), ("qpl", "q public"),
    ("ipl", "ibm public"), ("spl", "sun public"), ("npl", "netscape public"), ("apsl", "apple public source"),
    ("cpal", "common public attribution"), ("ecl", "educational community"), ("upl", "universal permissive"),
    ("vim", "vim"), ("w3c", "w3c software"), ("zpl", "zope public"), ("ncsa", "ncsa open source"), ("postgresql", "postgresql"),
    ("oldap", "openldap public"), ("php", "php"), ("ruby", "ruby"), ("ftl", "freetype"), ("libpng", "libpng"), ("unicode", "unicode"),
    ("curl", "curl"), ("x11", "x11"), ("sgi-b", "sgi free software"), ("lpl", "lucent public"), ("rpsl", "realnetworks public source"),
    ("sleepycat", "sleepycat"), ("intel", "intel open source"), ("nokia", "nokia open source"), ("oclc", "oclc research public"),
    ("rpl", "reciprocal public"), ("simpl", "simple public"), ("mulan", "mulan permissive software"), ("openssl", "openssl"),
    ("beerware", "beer ware"), ("cecill", "cecill free software"), ("nasa", "nasa open source"), ("odc-by", "open data commons attribution"),
    ("cdla", "community data"), ("ogl", "open government"), ("etalab", "etalab open"), ("rail", "responsible ai"), ("llama", "llama community"),
]
#: How sure a detection of each priority is.
SURE = [1.0, 0.95, 0.85, 0.6]
HINT = 3


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, priority) of every rule, strongest first."""
    found = []
    for label, keyword, name, versions in FAMILIES:
        tag = f"spdx licen[sc]e identifier {label.replace('-', ' ')}"
        found.append((label, "spdx", tag, 0))
        for version in versions:
            code = version.replace(" ", ".")
            ends = "(?: only| or (?:at your option )?(?:any )?later)?"
            found.append((f"{label}-{code}", "spdx", f"{tag} {version}{ends}", 0))
            found.append((f"{label}-{code}", keyword, f"{name}(?: v| version)? ?{version}{ends}", 1))
            if "gpl" in label or label == "apache":
                short = f"{label} ?v?{version}{ends}"
                found.append((f"{label}-{code}", label, short, 1))
        found.append((label, keyword, name, 2))
        found.append((label, keyword, f"licen[sc]ed under(?: the)?(?: terms of)?(?: the)? {name}", 1))
    for parts in CC_PARTS:
        label = "cc-" + parts.replace(" ", "-")
        long = " ".join(CC_NAMES[p] for p in parts.split())
        for version in CC_VERSIONS:
            code = version.replace(" ", ".")
            found.append((f"{label}-{code}", "cc by", f"cc {parts} {version}", 1))
            found.append((f"{label}-{code}", "spdx", f"spdx licen[sc]e identifier cc {parts} {version}", 0))
            found.append((f"{label}-{code}", "creative", f"creative commons {long}(?: international)? {version}", 1))
        found.append((label, "cc by", f"cc {parts}", 2))
        found.append((label, "creative", f"creative commons {long}", 2))
    found += [(label, keyword, pattern, 2) for label, keyword, pattern in SINGLE]
    found += [(label, keyword, pattern, 1) for label, keyword, pattern in BODY]
    found += [(label, keyword, f"(?:the )?{keyword} licen[sc]e(?: agreement)?", 2) for label, keyword in NAMED]
    found.append(("license-hint", "licen", "licen[sc]ed under(?: the)?(?: [^ ]+){0,3}", HINT))
    return sorted(found, key=lambda r: r[3])


#: Every match of a rule or base phrase holds one of these.
STEMS = [
    "licen", "copyright", "gpl", "reserved", "permission", "domain", "redistribut", "proprietary",
    "unauthori", "commercial", "warrant", "apache", "creative",
]


def may_match(text: Column) -> Column:
    """The prefilter over raw texts: plain searches, and one pattern for the word ``cc``."""
    low = F.lower(text)

    def held(x: Column) -> Column:
        found = F.contains(x, F.lit("cc")) & x.rlike(f"(?<!{LETTER})cc(?:0|(?!{LETTER}))")
        for stem in STEMS:
            found = found | F.contains(x, F.lit(stem))
        return found

    return let(low, held)


def base_starts(words: Column, phrase: str) -> Column:
    """Places, from 0, where the words of ``phrase`` stand one after the other."""
    parts = phrase.split()

    def starts(list_: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(list_) - 1),
            lambda i: reduce(
                lambda a, b: a & b,
                [F.coalesce(F.get(list_, i + k) == p, F.lit(False)) for k, p in enumerate(parts)],
            ),
        )

    return let(words, starts)


def rule_spans(line: Column, rule: Column) -> Column:
    """Detections of one rule: an array of (first, end, priority, label), ``first`` from 0.

    The pieces between the matches tell how many spaces, and so words, lie before each.
    """
    bounded = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))

    def spans(cut: Column) -> Column:
        def words_in(x: Column) -> Column:
            return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

        def step(acc: Column, at: Column) -> Column:
            first = acc["words"] + words_in(F.get(cut["rest"], at))
            end = first + words_in(F.get(cut["hits"], at))
            one = F.struct(
                (first - 1).alias("first"),
                (-end).alias("end"),
                rule["priority"].alias("priority"),
                rule["label"].alias("label"),
            )
            return F.struct(
                end.alias("words"), F.concat(acc["found"], F.array(one)).alias("found")
            )

        kind = "array<struct<first:int,end:int,priority:int,label:string>>"
        start = F.struct(F.lit(0).alias("words"), F.array().cast(kind).alias("found"))
        return F.when(
            F.size(cut["hits"]) > 0,
            F.aggregate(
                F.sequence(F.lit(0), F.size(cut["hits"]) - 1), start, step, lambda acc: acc["found"]
            ),
        ).otherwise(F.array().cast(kind))

    cut = F.struct(
        F.split(line, bounded).alias("rest"), F.regexp_extract_all(line, bounded, F.lit(0)).alias("hits")
    )
    return let(cut, spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, base phrases and suppressed detections of every text.

    Returns id, n_words, n_base, first_word, last_word, base_labels, labels,
    score and ``detections`` (first and last word, priority, label), kept ones only.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(keyword).alias("keyword"),
                F.lit(pattern).alias("pattern"),
                F.lit(priority).alias("priority"),
            )
            for label, keyword, pattern, priority in rules()
        ]
    )
    none = F.array().cast("array<struct<first:int,end:int,priority:int,label:string>>")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(id_col, raw.alias("_raw"))
    out = out.withColumn("_pass", may_match(F.col("_raw")))
    split = F.array_remove(F.split("_raw", GAPS), "")
    lower = F.array_remove(F.split(F.translate("_raw", UPPER, LOWER), GAPS), "")
    out = out.select(
        id_col,
        F.size(split).cast("long").alias("n_words"),
        F.when(F.col("_pass"), lower).alias("_words"),
    )
    out = out.withColumn("_line", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    base = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.when(
                    F.contains(F.col("_line"), F.lit(f" {phrase} ")),
                    base_starts(F.col("_words"), phrase),
                )
                .otherwise(F.array().cast("array<int>"))
                .alias("starts"),
            )
            for phrase, label in BASE
        ]
    )
    tried = F.filter(table, lambda r: F.contains(F.col("_line"), r["keyword"]))
    found = F.sort_array(F.flatten(F.transform(tried, lambda r: rule_spans(F.col("_line"), r))))

    def step(acc: Column, d: Column) -> Column:
        # ends are negative, so that the longest comes first
        reach = F.array_min(F.slice(acc["ends"], 1, d["priority"] + 1))
        ends = F.transform(
            acc["ends"],
            lambda e, p: F.when(p == d["priority"], F.least(e, d["end"])).otherwise(e),
        )
        more = F.struct(ends.alias("ends"), F.concat(acc["kept"], F.array(d)).alias("kept"))
        return F.when(d["end"] >= reach, acc).otherwise(more)

    def unless_hint(all_kept: Column) -> Column:
        strong = F.filter(all_kept, lambda d: d["priority"] < HINT)
        return F.when(F.size(strong) > 0, strong).otherwise(all_kept)

    start = F.struct(
        F.array_repeat(F.lit(0), len(SURE)).alias("ends"), none.alias("kept")
    )
    kept = let(F.aggregate(found, start, step, lambda acc: acc["kept"]), unless_hint)
    out = out.select(
        id_col,
        "n_words",
        F.when(F.col("_words").isNotNull(), base).alias("_base"),
        F.when(F.col("_words").isNotNull(), kept).otherwise(none).alias("_kept"),
    )
    starts = F.flatten(F.transform("_base", lambda b: b["starts"]))
    out = out.withColumns(
        {
            "_starts": F.coalesce(starts, F.array().cast("array<int>")),
            "_base_labels": F.coalesce(
                F.transform(
                    F.filter("_base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"]
                ),
                F.array().cast("array<string>"),
            ),
        }
    )
    sure = F.array(*map(F.lit, SURE))
    best = F.array_max(F.transform("_kept", lambda d: F.get(sure, d["priority"])))
    return out.select(
        id_col,
        "n_words",
        F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"),
        F.array_max("_starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base_labels")), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(
                F.array_union("_base_labels", F.transform("_kept", lambda d: d["label"]))
            ),
            ",",
        ).alias("labels"),
        F.greatest(
            F.coalesce(best, F.lit(0.0)), F.when(F.size("_starts") > 0, F.lit(0.9)).otherwise(F.lit(0.0))
        ).alias("score"),
        F.transform(
            "_kept",
            lambda d: F.struct(
                d["first"].alias("first"), (-d["end"] - 1).alias("last"), d["priority"].alias("priority"), d["label"].alias("label")
            ),
        ).alias("detections"),
    )
