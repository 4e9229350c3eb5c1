"""License scan by sentence rules: known sentences become identifiers, and runs of identifiers are matched by ordered rules.

A text is cut into paragraphs at blank lines. A paragraph's sentences are those of its
lines joined, so wrapped sentences are whole, and those of its single lines, so notices of
one line need no mark. Rules are tried in order; one that fits takes its sentences
away, so that a later, weaker rule can't read them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm._rows import each_row
from reelspark.llm._scratch import Scratch

# Licenses by their SPDX identifiers, with the names that notices use.
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "MIT": ["mit license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "ISC": ["isc license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gnu general public license v3 0 or later"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3 0", "gplv3", "gpl v3"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gnu general public license v2 0 or later"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2 0", "gplv2", "gpl v2"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "gnu lesser general public license v3 0", "lgplv3"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu affero general public license v3 0", "agplv3"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license version 2 0"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal license"],
    "Unlicense": ["unlicense"],
}
# How a notice begins before the license's name.
SUBJECTS = ["", "this project is ", "this software is ", "this work is ", "this file is ", "this code is ", "this program is "]
VERBS = ["licensed under", "released under", "distributed under", "available under"]
# Normalised sentences of license texts and headers, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0 the license": "apache2-header",
    "you may not use this file except in compliance with the license": "apache2-condition",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later-header",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later-header",
    "either version 3 of the license or at your option any later version": "version3-later",
    "either version 2 of the license or at your option any later version": "version2-later",
    "either version 2 1 of the license or at your option any later version": "version2.1-later",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "all rights reserved": "reserved",
} | {f"{subject}{verb} {article}{name}": f"{spdx}-notice" for spdx, names in NAMES.items() for name in names for subject in SUBJECTS for verb in VERBS for article in ("", "the ")} | {
    "spdx license identifier " + spdx.lower().replace("-", " ").replace(".", " "): f"{spdx}-tag" for spdx in NAMES
}
# Rules in order: the license, identifiers that follow each other in the text (others may stand between), and more that the license explains.
RULES = [(spdx, [f"{spdx}-tag"], []) for spdx in NAMES] + [
    ("Apache-2.0", ["apache2-header", "apache2-condition"], ["Apache-2.0-notice"]),
    ("Apache-2.0", ["apache2-header"], ["Apache-2.0-notice"]),
    ("Apache-2.0", ["Apache-2.0-notice", "apache2-condition"], []),
    ("AGPL-3.0-or-later", ["agpl3-later-header"], ["AGPL-3.0-only-notice"]),
    ("GPL-3.0-or-later", ["gpl3-later-header"], ["GPL-3.0-only-notice"]),
    ("GPL-3.0-or-later", ["gpl-grant", "version3-later"], ["GPL-3.0-only-notice"]),
    ("GPL-2.0-or-later", ["gpl-grant", "version2-later"], ["GPL-2.0-only-notice"]),
    ("LGPL-3.0-or-later", ["lgpl-grant", "version3-later"], ["LGPL-3.0-only-notice"]),
    ("LGPL-2.1-or-later", ["lgpl-grant", "version2.1-later"], ["LGPL-2.1-only-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], ["BSD-3-Clause-notice", "reserved"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], ["BSD-2-Clause-notice", "reserved"]),
    ("MIT", ["mit-grant", "mit-condition"], ["MIT-notice"]),
    ("ISC", ["isc-grant"], ["ISC-notice"]),
    ("MPL-2.0", ["mpl2-header"], ["MPL-2.0-notice"]),
    ("Unlicense", ["unlicense-grant"], ["Unlicense-notice"]),
] + [(spdx, [f"{spdx}-notice"], []) for spdx in NAMES] + [("LicenseRef-proprietary", ["reserved"], [])]
#: The result where a text speaks of a license, but no rule fits.
UNKNOWN = "LicenseRef-unknown"
# Where a paragraph, a sentence of it, and a sentence of a single line ends; and what speaks of a license.
PARAGRAPH_END = r"\n[\x20\x09\x0B-\x0D]*\n"
SENTENCE_END = r"[.!?;]+[\x20\x09-\x0D]+|[.!?;]+$"
LINE_END = r"[.!?;]+[\x20\x09-\x0D]+|\n|[.!?;]+$"
SPEAKS = r"(?i)(?:licensed|released|distributed|available)[\x20\x09-\x0D]+under|spdx-license-identifier"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalised_sentence(sentence: Column) -> Column:
    """Lower case, with everything but ASCII letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.translate(sentence, *_LOWER), "[^a-z0-9]+", " "))


def sentences_of(text: Column) -> Column:
    """Normalised sentences in the order of paragraphs, each once in its paragraph; null and empty texts have none."""
    parts = lambda p, end: F.transform(F.split(p, end), normalised_sentence)
    of = lambda p: F.when(F.contains(p, F.lit("\n")), F.array_union(parts(p, SENTENCE_END), parts(p, LINE_END))).otherwise(F.array_distinct(parts(p, SENTENCE_END)))
    return F.filter(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), of)), lambda s: s != "")


def pattern_of(ids: list[str]) -> str:
    """A regular expression for identifiers that follow each other in a blank-separated list."""
    return " " + " (?:.* )?".join(x.replace(".", r"\.") for x in ids) + " "


def _by_rules(ids: Column, rules: list[tuple[str, list[str], list[str]]]) -> Column:
    """The licenses of the rules that fit, in the rules' order."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern_of(wanted)).alias("pattern"), F.array(*map(F.lit, wanted + more)).alias("taken")) for name, wanted, more in rules])
    fits = lambda s, r: F.rlike(F.concat(F.lit(" "), F.array_join(s["left"], " "), F.lit(" ")), r["pattern"])
    step = lambda s, r: F.when(fits(s, r), F.struct(F.array_except(s["left"], r["taken"]).alias("left"), F.concat(s["names"], F.array(r["name"])).alias("names"))).otherwise(s)
    return F.aggregate(table, F.struct(F.array_distinct(ids).alias("left"), F.array().cast("array<string>").alias("names")), step, lambda s: s["names"])


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str], list[str]]] | None = None
) -> DataFrame:
    """Per row ``id, sentence_ids`` (in order, blank-separated), ``n_sentences`` (all), ``licenses`` (sorted, comma-separated), ``n_rules``.

    An identifier counts where it first stands; a text that speaks of a license no rule
    knows gives ``LicenseRef-unknown``. Null and empty texts, and texts without a known
    sentence, give empty strings and zeros; long texts are read whole. Ids may be null
    or repeated: each row has a result of its own. An empty table gives none. The
    sentence and rule tables are parameters and stay in memory on every task; they
    don't grow with the documents. Other columns are ignored.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    scratch = Scratch(docs.sparkSession, "licenses")

    def judge(rows: DataFrame) -> DataFrame:
        # A step of its own, so that the sentences are made once.
        cut = rows.select("id", F.coalesce("text", F.lit("")).rlike(SPEAKS).alias("speaks"), F.explode(F.array(sentences_of(F.col("text")))).alias("s"))
        known = rows.sparkSession.createDataFrame(list(sentences.items()), "sentence string, sid string")
        marked = F.filter(F.transform("s", lambda s, k: F.struct(k.alias("k"), s.alias("sentence"))), lambda x: F.length(x["sentence"]) >= min(map(len, sentences)))
        cut = cut.select("id", "speaks", F.size("s").cast("long").alias("n_sentences"), F.filter(marked, lambda x: F.length(x["sentence"]) <= max(map(len, sentences))).alias("s"))
        cut = scratch.stage(cut, "sentences", compression="zstd")
        found = cut.select("id", F.explode("s").alias("x")).select("id", "x.k", "x.sentence").join(F.broadcast(known), "sentence")
        found = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "sid"))).alias("f")).select("id", F.transform("f", lambda x: x["sid"]).alias("ids"))
        judged = scratch.stage(found, "found").select("id", "ids", _by_rules(F.col("ids"), rules).alias("names"))
        names = F.coalesce("names", F.array().cast("array<string>"))
        out = cut.select("id", "speaks", "n_sentences").join(judged, "id", "left")
        licenses = F.when((F.size(names) == 0) & F.col("speaks"), F.lit(UNKNOWN)).otherwise(F.array_join(F.array_sort(F.array_distinct(names)), ","))
        return out.select("id", F.coalesce(F.array_join("ids", " "), F.lit("")).alias("sentence_ids"), "n_sentences", licenses.alias("licenses"), F.size(names).cast("long").alias("n_rules"))

    return each_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), judge)
