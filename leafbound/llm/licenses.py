"""Licence recognition by sentence rules (native).

Texts are read twice: line by line, and by paragraphs, whose lines are joined without comment leaders, so that
wrapped notices are seen whole. Either reading is cut into sentences; those that speak of rights are
normalised (ASCII lower case, punctuation to spaces, numbers taken out) and looked up among known licence
sentences, which the same splitter has cut. The identifiers found, in order, form a sequence such as
<apache-notice@2.0>, which ordered rules rewrite: the first rules take the longest sequences, and what a rule
has used is gone for the rules after it. Sentences that aren't known don't part a sequence.

All steps are row by row; the sentence and rule tables are fixed and small, so they are literals.

Defined cases: null and empty texts have no sentences and no licence; repeated rows repeat; sentences of
rights that no rule uses make a text "unknown"; texts of any length are one row's sentences; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: What a sentence must hold to be looked up.
RIGHTS = r"licen[cs]|copyright|permi(?:ssion|tted)|redistribut|warrant|spdx|public domain|merchantab|liab|endorse or promote|advertising materials"
#: Licence sentences as their licences have them, in lower case, and their identifiers. Numbers stand for any.
TEXTS = {
    "mit-grant": 'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:',
    "mit-notice-kept": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
    "mit-as-is": 'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "isc-grant": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": 'the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.',
    "bsd-as-is": 'this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
    "zlib-as-is": "this software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "this is free and unencumbered software released into the public domain.",
    "mit-0-grant": 'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so.',
    "gpl-or-later": "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
    "agpl-or-later": "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
    "mpl-source": "this source code form is subject to the terms of the mozilla public license, v. 2.0.",
    "apache-title": "apache license version 2.0, january 2004 http://www.apache.org/licenses/",
    "mpl-title": "mozilla public license version 2.0",
}
#: Known licence sentences, normalised, "#" for numbers, and their identifiers.
SENTENCES = {
    "licensed under the apache license version #": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice-kept",
    "the software is provided as is without warranty of any kind express or implied": "mit-as-is",
    "this work is licensed under the gnu general public license version #": "gpl-notice",
    "licensed under the gnu general public license version #": "gpl-notice",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "licensed under the gnu lesser general public license version #": "lgpl-notice",
    "this work is licensed under the gnu lesser general public license version #": "lgpl-notice",
    "licensed under the gnu affero general public license version #": "agpl-notice",
    "licensed under cc by #": "cc-by",
    "licensed under cc by sa #": "cc-by-sa",
    "licensed under cc by nc #": "cc-by-nc",
    "licensed under cc by nd #": "cc-by-nd",
    "licensed under cc by nc sa #": "cc-by-nc-sa",
    "licensed under cc by nc nd #": "cc-by-nc-nd",
    "licensed under a creative commons attribution # international license": "cc-by",
    "this work is licensed under a creative commons attribution # international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike # international license": "cc-by-sa",
    "this work is dedicated to the public domain": "public-domain",
    "licensed under cc0 #": "cc0",
    "licensed under the mozilla public license version #": "mpl-notice",
    "this source code form is subject to the terms of the mozilla public license v #": "mpl-source",
    "licensed under the bsd # clause license": "bsd-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed": "bsd-as-is",
    "licensed under the apache license version # the license": "apache-notice",
    "this project is licensed under the apache license version #": "apache-notice",
    "licensed under the mit license the license": "mit-notice",
    "this software is licensed under the mit license": "mit-notice",
    "this software is released under the mit license": "mit-notice",
    "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses": "gpl-received",
    "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses": "gpl-received",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "see the gnu affero general public license for more details": "agpl-see",
    "gnu general public license version # # june #": "gpl-title",
    "gnu general public license version # june #": "gpl-title",
    "gnu lesser general public license version # # june #": "lgpl-title",
    "gnu lesser general public license version # february #": "lgpl-title",
    "gnu affero general public license version # # november #": "agpl-title",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-terms",
    "either version # of the license or at your option any later version": "gnu-either",
    "you can redistribute it and or modify it under the terms of the gnu general public license version # as published by the free software foundation": "gpl-notice",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version # of the license or at your option any later version": "lgpl-or-later",
    "this library is distributed in the hope that it will be useful but without any warranty": "gnu-hope",
    "this program is distributed in the hope that it will be useful but without any warranty": "gnu-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-no-warranty",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-ads",
    "this program and the accompanying materials are made available under the terms of the eclipse public license #": "epl-notice",
    "licensed under the eclipse public license version #": "epl-notice",
    "eclipse public license v #": "epl-title",
    "the contents of this file are subject to the terms of the common development and distribution license": "cddl-notice",
    "common development and distribution license cddl version #": "cddl-title",
    "licensed under the eupl version #": "eupl-notice",
    "the artistic license #": "artistic-title",
    "boost software license version # august # #": "bsl-title",
    "distributed under the boost software license version #": "bsl-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-grant",
    "this font software is licensed under the sil open font license version #": "ofl-notice",
    "sil open font license version # # february #": "ofl-title",
    "do what the fuck you want to public license": "wtfpl",
    "python software foundation license version #": "psf-title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
}
#: Sentences with slots, normalised: a pattern, and the known sentence that it stands for.
SLOTS = [
    (r"^.{0,300}nor the names? of .{0,300}endorse or promote products .{0,300}$", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (r"^the names? of .{1,300} (?:may|must) not be used to endorse or promote products .{0,300}$", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (r"^all advertising materials mentioning features or use of this software must display the following acknowledge?ment.{0,300}$", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (r"^this software is provided by .{1,300} as is and any express or implied warranties .{1,300} are disclaimed$", "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed"),
    (r"^this program and the accompanying materials are made available under the terms of the eclipse public license .{0,300}$", "this program and the accompanying materials are made available under the terms of the eclipse public license #"),
    (r"^the contents of this file are subject to the terms of the common development and distribution license.{0,300}$", "the contents of this file are subject to the terms of the common development and distribution license"),
    (r"^permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.{0,600}$", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (r"^licensed under the eupl version # .{0,300}$", "licensed under the eupl version #"),
]
#: Short names that follow "SPDX-License-Identifier:", numbers taken out, and their identifiers.
SPDX = {
    "mit": "mit-notice", "apache #": "apache-notice", "gpl # or later": "gpl-or-later", "gpl # only": "gpl-notice", "gpl #": "gpl-notice", "lgpl # or later": "lgpl-or-later", "lgpl # only": "lgpl-notice", "lgpl #": "lgpl-notice",
    "agpl # or later": "agpl-or-later", "agpl # only": "agpl-notice", "agpl #": "agpl-notice", "mpl #": "mpl-notice", "bsd # clause": "bsd-notice", "isc": "isc-grant", "zlib": "zlib-grant", "unlicense": "unlicense",
    "cc0 #": "cc0", "cc by #": "cc-by", "cc by sa #": "cc-by-sa", "cc by nc #": "cc-by-nc", "cc by nd #": "cc-by-nd", "cc by nc sa #": "cc-by-nc-sa", "cc by nc nd #": "cc-by-nc-nd",
    "epl #": "epl-notice", "cddl #": "cddl-notice", "eupl #": "eupl-notice", "artistic #": "artistic-title", "bsl #": "bsl-notice", "ofl #": "ofl-notice", "mit #": "mit-0-grant", "psf #": "psf-title", "wtfpl": "wtfpl", "#bsd": "0bsd-grant",
}
#: Rules in the order they apply, each a licence and the identifiers it takes, with the version of the first or of that with a star.
RULES = [
    ("Apache-{v}", ["apache-title", "apache-notice", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-{v}", ["apache-title"]),
    ("Apache-{v}", ["apache-notice", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-{v}", ["apache-notice", "apache-compliance", "apache-copy"]),
    ("Apache-{v}", ["apache-notice"]),
    ("MIT", ["mit-grant", "mit-notice-kept", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice-kept", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice-kept"]),
    ("MIT", ["mit-notice"]),
    ("MIT-0", ["mit-0-grant", "mit-as-is", "mit-liability"]),
    ("MIT-0", ["mit-0-grant"]),
    ("GPL-{v}", ["gpl-title", "gpl-or-later", "gnu-hope", "gnu-no-warranty", "gpl-see", "gpl-received"]),
    ("GPL-{v}", ["gpl-title"]),
    ("GPL-{v}-or-later", ["gpl-or-later", "gnu-hope", "gnu-no-warranty", "gpl-see", "gpl-received"]),
    ("GPL-{v}-or-later", ["gpl-or-later", "gnu-hope", "gnu-no-warranty", "gpl-see"]),
    ("GPL-{v}-or-later", ["gpl-or-later"]),
    ("GPL-{v}", ["gpl-title", "gpl-terms", "gnu-either", "gnu-hope", "gnu-no-warranty", "gpl-see", "gpl-received"]),
    ("GPL-{v}-or-later", ["gpl-terms", "gnu-either*", "gnu-hope", "gnu-no-warranty", "gpl-see", "gpl-received"]),
    ("GPL-{v}-or-later", ["gpl-terms", "gnu-either*", "gnu-hope", "gnu-no-warranty", "gpl-see"]),
    ("GPL-{v}-or-later", ["gpl-terms", "gnu-either*"]),
    ("GPL-{v}", ["gpl-notice", "gnu-hope", "gnu-no-warranty", "gpl-see", "gpl-received"]),
    ("GPL-{v}", ["gpl-notice"]),
    ("LGPL-{v}-or-later", ["lgpl-terms", "gnu-either*", "gnu-hope", "gnu-no-warranty", "lgpl-see"]),
    ("LGPL-{v}-or-later", ["lgpl-terms", "gnu-either*"]),
    ("AGPL-{v}-or-later", ["agpl-terms", "gnu-either*"]),
    ("LGPL-{v}-or-later", ["lgpl-or-later", "lgpl-see"]),
    ("LGPL-{v}-or-later", ["lgpl-or-later"]),
    ("LGPL-{v}", ["lgpl-title"]),
    ("AGPL-{v}-or-later", ["agpl-or-later", "gnu-hope", "gnu-no-warranty", "agpl-see"]),
    ("AGPL-{v}-or-later", ["agpl-or-later"]),
    ("AGPL-{v}", ["agpl-title"]),
    ("LGPL-{v}", ["lgpl-notice"]),
    ("AGPL-{v}", ["agpl-notice"]),
    ("CC-BY-NC-SA-{v}", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND-{v}", ["cc-by-nc-nd"]),
    ("CC-BY-NC-{v}", ["cc-by-nc"]),
    ("CC-BY-SA-{v}", ["cc-by-sa"]),
    ("CC-BY-ND-{v}", ["cc-by-nd"]),
    ("CC-BY-{v}", ["cc-by"]),
    ("CC0-{v}", ["cc0"]),
    ("Public-Domain", ["public-domain"]),
    ("MPL-{v}", ["mpl-title", "mpl-source"]),
    ("MPL-{v}", ["mpl-title"]),
    ("MPL-{v}", ["mpl-source"]),
    ("MPL-{v}", ["mpl-notice"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Unlicense", ["unlicense"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-ads", "bsd-names", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-1-Clause", ["bsd-grant", "bsd-source", "bsd-as-is"]),
    ("BSD-{v}-Clause", ["bsd-notice"]),
    ("EPL-{v}", ["epl-title"]),
    ("EPL-{v}", ["epl-notice"]),
    ("CDDL-{v}", ["cddl-title"]),
    ("CDDL-{v}", ["cddl-notice"]),
    ("EUPL-{v}", ["eupl-notice"]),
    ("Artistic-{v}", ["artistic-title"]),
    ("BSL-1.0", ["bsl-title", "bsl-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("BSL-{v}", ["bsl-notice"]),
    ("BSL-{v}", ["bsl-title"]),
    ("OFL-{v}", ["ofl-notice", "ofl-title"]),
    ("OFL-{v}", ["ofl-notice"]),
    ("OFL-{v}", ["ofl-title"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("0BSD", ["0bsd-grant"]),
    ("PSF-{v}", ["psf-title"]),
    ("WTFPL", ["wtfpl"]),
]


#: What ends a sentence within a line or paragraph, what begins a line of a comment, what parts paragraphs, a short name's mark; patterns that both dialects of SQL read alike.
END, LEADER, BLANK, SHORT = r"([.!?;:])[\x20\x09-\x0D]+", r"(^|\n)[\x20\x09\x0D]*(?:/\*+|//+|#+|\*+/?|;+|--+|>+|<!--+|=+)?[\x20\x09\x0D]*", r"\n\n+", r"spdx-license-identifier:([^\n]*)"
#: What parts the names of a short expression, and a name's sign for "or later".
JOIN, LATER = r"[\x20\x09()*/<>-]*(?:[\x20\x09()]+(?:and|or|with)[\x20\x09()]+|[\x20\x09()]+|\*/|-->)[\x20\x09()]*", r"\+$"
VERSION, NUMBER, OTHER = r"\bv\.[\x20\x09]+([0-9])", r"\b[0-9]+(?:\.[0-9]+)*", r"[^a-z0-9#]+"


def known() -> dict[str, str]:
    """Normalised sentences and their identifiers; of a text that the splitter cuts, its first sentence of rights."""
    out = dict(SENTENCES) | {f"spdx license identifier {k}": v for k, v in SPDX.items()}
    for i, text in TEXTS.items():
        part = next(x for x in re.sub(END, r"\1\n", re.sub(VERSION, r"v \1", text)).split("\n") if re.search(RIGHTS, x))
        out.setdefault(re.sub(OTHER, " ", re.sub(NUMBER, "#", part)).strip(), i)
    return out


def patterns() -> list[tuple[str, str, str]]:
    """(name before the version, name after it, pattern with the version as group 1; an unused version stays outside the group)."""
    out = []
    for name, ids in RULES:
        head, _, tail = name.partition("{v}")
        at = next((k for k, i in enumerate(ids) if i.endswith("*")), 0)
        told = "([^>]*)" if "{v}" in name else "()[^>]*"
        out.append((head, tail, "".join(f"<{i.rstrip('*')}@{told if k == at else '[^>]*'}>" for k, i in enumerate(ids))))
    return out


def _read(rows: DataFrame, text: Column, p: str) -> DataFrame:
    """rows and, of a reading of their texts, columns p + s (sentences of rights), k (known ones), q (sequence), r (what rules leave and find)."""

    def normal(s):
        s = F.trim(F.regexp_replace(F.regexp_replace(s, NUMBER, "#"), OTHER, " "))
        for pattern, sentence in SLOTS:
            s = F.regexp_replace(s, pattern, sentence)
        return s

    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    rows = rows.withColumn(f"{p}s", F.filter(F.split(F.regexp_replace(F.regexp_replace(text, VERSION, "v $1"), END, "$1\n"), "\n"), lambda s: s.rlike(RIGHTS)))
    rows = rows.withColumn(f"{p}k", F.transform(f"{p}s", lambda s: F.struct(normal(s).alias("n"), F.regexp_extract(s, r"\b([0-9]+(?:\.[0-9]+)*)", 1).alias("v"))))
    rows = rows.withColumn(f"{p}k", F.filter(F.transform(f"{p}k", lambda x: F.struct(F.element_at(table, x["n"]).alias("i"), x["v"].alias("v"))), lambda x: x["i"].isNotNull()))
    rows = rows.withColumn(f"{p}q", F.array_join(F.transform(f"{p}k", lambda x: F.concat(F.lit("<"), x["i"], F.lit("@"), x["v"], F.lit(">"))), ""))
    rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(x).alias("p")) for a, b, x in patterns()])
    start = F.struct(F.col(f"{p}q").alias("rest"), F.array().cast("array<string>").alias("found"))

    def apply(acc, rule):
        versions = F.regexp_extract_all(acc["rest"], rule["p"], 1)
        return F.struct(F.regexp_replace(acc["rest"], rule["p"], F.lit("")).alias("rest"), F.concat(acc["found"], F.transform(versions, lambda v: F.concat(rule["a"], v, rule["b"]))).alias("found"))

    return rows.withColumn(f"{p}r", F.when(F.col(f"{p}q") != "", F.aggregate(rules, start, apply)).otherwise(start))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id; of the reading that knows more sentences (of paragraphs, if both know as many) n_sentences (of rights), n_known, sentence_ids (the sequence), n_left (identifiers no rule used); licenses (comma-joined, in rule order: those of paragraphs and, if lines hold other sentences, of lines); verdict."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.when(text.rlike(f"(?i){RIGHTS}"), lower_ascii(text)).otherwise(F.lit("")).alias("_t"))
    # Names of short expressions, each on a line of its own, stand after the text.
    short = F.flatten(F.transform(F.regexp_extract_all("_t", F.lit(SHORT), 1), lambda e: F.split(e, JOIN)))
    named = F.transform(F.filter(short, lambda x: x != ""), lambda x: F.concat(F.lit("\n\nspdx-license-identifier "), F.regexp_replace(x, LATER, "-or-later")))
    rows = rows.withColumn("_t", F.concat(F.regexp_replace("_t", SHORT, "\n\n"), F.array_join(named, "")))
    rows = _read(rows, F.col("_t"), "_l")
    # in paragraphs, \x02 stands for the breaks between them while lines are joined
    joined = F.translate(F.regexp_replace(F.regexp_replace("_t", LEADER, "$1"), BLANK, "\x02"), "\n\x02", " \n")
    rows = _read(rows.withColumn("_p", joined), F.col("_p"), "_p")
    ids = lambda c: F.transform(c, lambda x: x["i"])
    licenses = F.array_distinct(F.when(F.size(F.array_except(ids("_lk"), ids("_pk"))) > 0, F.concat("_pr.found", "_lr.found")).otherwise(F.col("_pr.found")))
    best = lambda c: F.when(F.size("_lk") > F.size("_pk"), F.col(f"_l{c}")).otherwise(F.col(f"_p{c}"))
    left = F.size(F.split(best("r")["rest"], ">")) - 1
    return rows.select(
        F.col("_id").alias(id_col), F.size(best("s")).cast("long").alias("n_sentences"), F.size(best("k")).cast("long").alias("n_known"), best("q").alias("sentence_ids"),
        F.array_join(licenses, ",").alias("licenses"), left.cast("long").alias("n_left"),
        F.when(F.size(licenses) > 1, "several").when(F.size(licenses) == 1, "one").when((F.size("_ls") > 0) | (F.size("_ps") > 0), "unknown").otherwise("none").alias("verdict"),
    )
