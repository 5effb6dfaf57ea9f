"""License scans by canonical digest: normalised entire texts are hash-joined to digests of known license texts.

Units are the whole document and each of its paragraphs and lines, so a notice is found where it is a whole unit; full texts are also found
inside longer documents, from any line on (unit "run"): as many characters of the canonical rest as a known text has. Copyright lines go, letters
are folded, spellings that license guidelines treat as equal become one, and everything but letters and digits becomes one
space. Only digests are compared: the known table is small and fixed (a row a text), so it is broadcast.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.tables import table

# Fixed words: spellings that count as equal in license texts.
EQUAL = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sub license": "sublicense", "sub-license": "sublicense", "utilisation": "utilization", "whilst": "while", "noncommercial": "non commercial", "copyright holder": "copyright owner", "https": "http",
}
# Fixed texts: notices and short licenses by their public identifiers.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", "the Apache-2.0 license"],
    "MIT": ["the MIT License", "MIT", "the MIT license (MIT)"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause", "the New BSD License"],
    "ISC": ["the ISC License", "ISC"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0", "MPL-2.0"],
    "GPL-2.0-only": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPL-2.0-only", "GPL-2.0"],
    "GPL-3.0-only": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPL-3.0-only", "GPL-3.0"],
    "LGPL-2.1-only": ["the GNU Lesser General Public License, version 2.1", "LGPL-2.1-only", "LGPL-2.1"],
    "LGPL-3.0-only": ["the GNU Lesser General Public License, version 3", "LGPL-3.0-only", "LGPL-3.0"],
    "AGPL-3.0-only": ["the GNU Affero General Public License, version 3", "AGPL-3.0-only", "AGPL-3.0"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0", "the CC0 1.0 Universal Public Domain Dedication"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND-4.0"],
    "Unlicense": ["the Unlicense", "Unlicense"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "BSL-1.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "EPL-2.0"],
}
LEADS = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This file is licensed under {}", "This software is licensed under {}", "This program is licensed under {}", "Available under {}", "Published under {}", "SPDX-License-Identifier: {}", "License: {}", "Licensed under the terms of {}", "This work is released under {}", "{}"]
NOTICES = {
    "MIT": [_MIT],
    "ISC": [_ISC],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
}
# Full texts, a file an identifier.
TEXTS = Path(__file__).parent / "texts"
COPYRIGHT = r"(?m)^[\x20\x09]*(?:[*#/;-]+[\x20\x09]*)?(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"


#: What every known unit contains, so that other units need no digest. Names end where the canonical form ends words: beside anything but letters and digits.
MARK = r"(?i)licen[cs]|permission|permitted|(?<![\p{L}\p{N}])(?:MIT|ISC|BSD|MPL|GPL|LGPL|AGPL|CC0|CC|BSL|EPL|Apache)(?![\p{L}\p{N}])"
#: Blank lines between paragraphs.
BLANK = r"\r?\n(?:[\x20\x09]*\r?\n)+"


def full_texts() -> list[tuple[str, str]]:
    """(identifier, text) of the full texts and of what copies of them leave out, as wrapped here and with a line a paragraph."""
    full = {"MIT": [_MIT], "ISC": [_ISC]} | {f.stem: [f.read_text(encoding="utf-8").strip()] for f in sorted(TEXTS.glob("*.txt"))}
    for name in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only"):
        text = full[name][0]
        end = re.search(r"END OF TERMS AND CONDITIONS", text).end()
        full[name].append(text[:end])
    # the header of source files, which is the end of the license's appendix
    full["Apache-2.0"].append(full["Apache-2.0"][0][full["Apache-2.0"][0].index("Licensed under the Apache License") :])
    for name in ("BSL-1.0", "CC0-1.0"):
        full[name].append(full[name][0].partition("\n\n")[2].strip())
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        full[name].append(re.sub(r"(?m)^\d\. ", "* ", full[name][0]))
        # where this word begins a line, the line counts as one of copyright
        full[name] += [re.sub(r"the\s+above\s+copyright", r"the above\ncopyright", text) for text in list(full[name])]
    flat = lambda text: "\n\n".join(re.sub(r"\s*\n\s*", " ", part) for part in re.split(r"\n\s*\n", text))
    return sorted({(k, x) for k, texts in full.items() for text in texts for x in (text, flat(text))})


def titles() -> list[tuple[str, str]]:
    """(identifier, heading) of each name with and without its article."""
    bare = {(k, name.removeprefix("the ")) for k, names in NAMES.items() for name in names}
    return sorted(bare | {(k, f"the {name}") for k, name in bare})


def known_texts() -> list[tuple[str, str]]:
    """(identifier, text) of all known units."""
    out = [(k, lead.format(name)) for k, names in NAMES.items() for name in names for lead in LEADS]
    full = full_texts()
    headed = [(k, f"{title}\n\n{text}") for k, text in full for of, title in titles() if of == k]
    return sorted({*out, *titles(), *full, *headed, *((k, text) for k, texts in NOTICES.items() for text in texts)})


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT, " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    words = "|".join(sorted(map(str, (w.replace("-", " ") for w in EQUAL)), key=len, reverse=True))
    same = out
    for a, b in sorted(EQUAL.items(), key=lambda x: -len(x[0])):
        same = F.regexp_replace(same, rf"\b{a.replace('-', ' ')}\b", b)
    return F.when(out.rlike(rf"\b(?:{words})\b"), same).otherwise(out)


def known(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(known_texts(), "license string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def known_runs(spark: SparkSession) -> dict[str, set[tuple[int, str, str]]]:
    """(length, digest, identifier) of the canonical full texts, by their first three words."""
    rows = spark.createDataFrame(full_texts(), "license string, text string").select("license", canonical(F.col("text")).alias("text"))
    found: dict[str, set[tuple[int, str, str]]] = {}
    for r in rows.select("license", F.substring_index("text", " ", 3).alias("start"), F.length("text").alias("n"), F.sha2("text", 256).alias("digest")).collect():
        found.setdefault(r["start"], set()).add((r["n"], r["digest"], r["license"]))
    return found


def embedded(text: Column, runs: dict[str, set[tuple[int, str, str]]]) -> Column:
    """Names of full texts that begin on a line of the text, whatever their line and paragraph breaks."""
    words = [r"[^\p{L}\p{N}]+".join(re.sub("license", "licen[cs]e", w) for w in start.split()[:2]) for start in sorted(runs)]
    first = rf"(?i)^[^\p{{L}}\p{{N}}]*(?:{'|'.join(words)})\b"
    lengths = F.create_map(*(x for start in sorted(runs) for x in (F.lit(start), F.array(*(F.lit(n) for n in sorted({n for n, _, _ in runs[start]}))))))
    names = F.create_map(*(F.lit(x) for digest, name in sorted({(d, k) for found in runs.values() for _, d, k in found}) for x in (digest, name)))
    lines = F.split(text, r"\n")
    begins = F.filter(F.transform(lines, lambda x, k: F.struct((k + 1).alias("number"), x.rlike(first).alias("able"))), lambda u: u["able"])
    rests = F.transform(begins, lambda u: F.struct(u["number"].alias("number"), canonical(F.array_join(F.slice(lines, u["number"], F.size(lines)), "\n")).alias("rest")))

    def hits(u: Column) -> Column:
        cuts = F.coalesce(F.try_element_at(lengths, F.substring_index(u["rest"], " ", 3)), F.array().cast("array<int>"))
        whole = F.filter(cuts, lambda n: F.substring(u["rest"], n + F.lit(1), F.lit(1)).isin("", " "))
        found = F.transform(whole, lambda n: F.try_element_at(names, F.sha2(F.substring(u["rest"], F.lit(1), n), 256)))
        return F.transform(F.filter(found, lambda name: name.isNotNull()), lambda name: F.concat(name, F.lit("@run:"), u["number"].cast("string")))

    return F.array_distinct(F.flatten(F.transform(rests, hits)))


def document_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, canonical_sha256 of the entire text, license of the entire text or null, notices found.

    notices is a sorted array of "license@unit:number"; a run's number is its first line. Each row stands alone: no exchange, repeated rows each answer. Null and empty texts have the digest of an empty text, no license and no notices.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table_of = {r["digest"]: r["license"] for r in known(docs.sparkSession).collect()}
    lookup = F.create_map(*(F.lit(x) for pair in sorted(table_of.items()) for x in pair))
    digest = lambda c: F.sha2(canonical(c), 256)

    def parts(unit: str, cut: str, when: Column) -> Column:
        pieces = F.transform(F.split("text", cut), lambda x, k: F.struct((k + 1).alias("number"), x.alias("text")))
        able = F.filter(pieces, lambda u: u["text"].rlike(MARK))
        hit = F.transform(able, lambda u: F.struct(u["number"].alias("number"), F.try_element_at(lookup, digest(u["text"])).alias("license")))
        named = F.transform(F.filter(hit, lambda u: u["license"].isNotNull()), lambda u: F.concat(u["license"], F.lit(f"@{unit}:"), u["number"].cast("string")))
        return F.when(when, named).otherwise(F.array().cast("array<string>"))

    marked = F.col("text").rlike(MARK)
    runs = F.when(marked & F.col("text").contains("\n"), embedded(F.col("text"), known_runs(docs.sparkSession))).otherwise(F.array().cast("array<string>"))
    out = base.withColumn("canonical_sha256", digest(F.col("text")))
    out = out.join(F.broadcast(known(docs.sparkSession)), out["canonical_sha256"] == F.col("digest"), "left")
    return out.select(
        "doc_id", "canonical_sha256", "license",
        F.array_sort(F.concat(parts("line", r"\n", marked & F.col("text").contains("\n")), parts("paragraph", BLANK, marked & F.col("text").rlike(BLANK)), runs)).alias("notices"),
    )


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = document_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "canonical_sha256", "license", F.array_join("notices", ",").alias("notices"))
