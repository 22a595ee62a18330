"""License scans with DataFrame functions only: TF-IDF cosine of files and their parts to license texts and headers, nearest-ancestor inheritance."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from loamgrid.llm.base import cut

#: Names of common licenses as headers and titles write them.
NAMES = {
    "MIT": ("MIT License", "MIT License (MIT)"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0", "Apache 2.0 License", "Apache License Version 2.0, January 2004"),
    "GPL": ("GNU General Public License", "GPL", "GNU GPL"),
    "LGPL": ("GNU Lesser General Public License", "LGPL", "GNU LGPL"),
    "AGPL": ("GNU Affero General Public License", "AGPL", "GNU AGPL"),
    "GPL-1.0": ("GNU General Public License, version 1", "GPL v1", "GPLv1"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License Version 2, June 1991", "GPL v2", "GPLv2", "GNU GPL version 2", "GPL-2.0 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", "GPL v3", "GPLv3", "GNU GPL version 3", "GPL-3.0 License"),
    "LGPL-2.0": ("GNU Library General Public License, version 2", "GNU Library General Public License Version 2, June 1991"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License Version 2.1, February 1999", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1 License"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License Version 3, 29 June 2007", "LGPL v3", "LGPLv3", "LGPL-3.0 License"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License Version 3, 19 November 2007", "AGPL v3", "AGPLv3", "AGPL-3.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "Modified BSD License", "New BSD License", "BSD License", "BSD-style license", "Revised BSD License"),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0", "MPL 2.0"),
    "ISC": ("ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "Unlicense": ("Unlicense", "Unlicense License"),
    "WTFPL": ("Do What The Fuck You Want To Public License", "WTFPL License"),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "Eclipse Public License - v 1.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License - v 2.0"),
    "EUPL-1.2": ("European Union Public Licence, version 1.2", "EUPL v1.2"),
    "Artistic-1.0-Perl": ("Artistic License", "same terms as Perl itself, Artistic License"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, version 2.0"),
    "GFDL-1.2": ("GNU Free Documentation License, Version 1.2",),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3",),
    "PSF-2.0": ("Python Software Foundation License", "PSF License, Version 2"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
FORMS = (
    "{}", "The {}", "License: {}", "Released under the {}.", "Licensed under {}.", "Licensed under the {}.", "This project is licensed under the {}.",
    "This work is licensed under a {}.", "Distributed under the terms of the {}.", "Subject to the terms of the {}.",
    "This software is released under the {}, see the LICENSE file for details.", "Use of this source code is governed by the {} that can be found in the LICENSE file.",
)
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the "
    "Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that "
    "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. "
    "If not, see <https://www.gnu.org/licenses/>."
)
#: Headers of several sentences.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
     "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
     "this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((f"{k}-{v}", GNU.format(lesser, v[:1] if v.endswith(".0") else v)) for k, lesser, v in (
        ("GPL", "", "1.0"), ("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "Library ", "2.0"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3.0"),
        ("AGPL", "Affero ", "3.0"))),
)
RESERVED = "Proprietary"
#: Single statements; the whole texts are the files of ``license_texts``.
TEMPLATES = (
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    (RESERVED, "All rights reserved."),
    *((k, form.format(name)) for k, names in NAMES.items() for name in names for form in FORMS),
    *HEADERS,
)
#: A part with one of these is looked at; every template has one.
CUE = (
    r"(?i)licen[cs]|copyright|rights reserved|spdx|public domain|redistribut|permission|permitted|warrant|creative commons|mozilla public|same terms as perl"
    r"|\bcc(?:0| by)\b|\b[al]?gpl|\bmpl\b|\bwtfpl\b|\beupl\b|public license"
)
#: Who holds the copyright says nothing about the license: left out, up to the end of the sentence or the next statement.
NOTICE = (
    r"(?i)(?:copyright|\u00a9)[ \t]*(?:\(c\)|\u00a9|:|[0-9]{4}).*?"
    r"(?=\.\s|[\r\n]|$|all rights|,?\s*\b(?:licen[cs]|released|distributed|under|mit|bsd|apache|gpl|spdx)\b|licen[cs])"
)
SPDX = r"(?i)spdx-license-identifier[ \t]*:[ \t]*(\(*[\w.+-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[\w.+-]+\)*)*)"
WORD = r"[a-z]+[a-z0-9]*|[0-9]+(?:\.[0-9]+)*"
#: Templates of so many words or more are texts: one of them settles a file's license before any single statement does.
TEXT = 35


@cache
def license_texts() -> tuple[tuple[str, str], ...]:
    return tuple((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, NOTICE, " ")), F.lit(WORD), F.lit(0))


def template_table(like: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``tid, license, rank, w``; rank 0: all rights reserved, 1: statements, 2: texts."""
    rows = [(i, k, t) for i, (k, t) in enumerate((*templates, *license_texts()))]
    t = like.sparkSession.createDataFrame(rows, "tid int, license string, statement string").withColumn("w", words(F.col("statement")))
    rank = F.when(F.col("license") == RESERVED, 0).when(F.size("w") >= TEXT, 2).otherwise(1)
    return t.select("tid", "license", rank.alias("rank"), "w")


def parts(text: Column) -> Column:
    """The parts of a text that hold a cue: lines and runs of two and three, sentences, paragraphs, and runs of paragraphs.

    Comment marks are no words, so a line of marks parts paragraphs like an empty one.  A run of paragraphs may hold
    single ones without a cue.
    """
    lines = F.filter(F.split(text, r"\r\n?|\n"), lambda x: x.rlike(r"\w"))
    paragraphs = F.split(text, r"\r?\n[^\w\n]*+\n")

    def bound(array: Column, fn) -> Column:
        """``fn`` of an array that is made once: within a lambda it would be made anew for each element."""
        return F.transform(F.array(array), fn)[0]

    def wide(x: Column) -> Column:
        two = F.transform(x, lambda line, i: F.concat_ws(" ", line, F.get(x, i + 1)))
        three = F.transform(x, lambda line, i: F.concat_ws(" ", line, F.get(x, i + 1), F.get(x, i + 2)))
        return F.concat(x, two, three)

    def runs(x: Column) -> Column:
        def marked(cues: Column) -> Column:
            near = lambda i: F.coalesce(F.get(cues, i - 1) & F.get(cues, i + 1), F.lit(False))
            return F.transform(x, lambda p, i: F.when(F.get(cues, i) | near(i), p).otherwise(F.lit("\f")))

        cues = F.transform(x, lambda p: p.rlike(CUE))
        return F.concat(F.filter(x, lambda p: p.rlike(CUE)), F.split(F.array_join(bound(cues, marked), "\n\n"), "\f"))

    sentences = F.flatten(F.transform(F.filter(paragraphs, lambda x: x.rlike(CUE)), lambda x: F.split(F.regexp_replace(x, r"\s+", " "), r"(?<=[\w)\"'>][.;:!?]) ")))
    return F.filter(F.concat(bound(lines, wide), sentences, bound(paragraphs, runs)), lambda x: x.rlike(CUE))


def declared(text: Column) -> Column:
    """The license ids of SPDX lines, without ``-only``, ``-or-later``, ``+`` and exceptions, in the spelling of the templates."""
    said = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    ids = F.flatten(F.transform(said, lambda x: F.split(F.regexp_replace(x, r"(?i)\s+with\s+[\w.+-]+|[()]", ""), r"(?i)\s+(?:and|or)\s+")))
    ids = F.transform(ids, lambda x: F.regexp_replace(x, r"(?i)(?:-only|-or-later|\+)$|^-+|[.-]+$", ""))
    known = F.create_map(*(F.lit(x) for k in sorted({*NAMES, *(k for k, _ in license_texts())}) for x in (k.lower(), k)))
    return F.transform(F.filter(ids, lambda x: (x != "") & ~F.upper(x).isin("NONE", "NOASSERTION")), lambda x: F.coalesce(known[F.lower(x)], x))


def scores(files: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """``file, license, score, whole``: each file's best template over its whole text and its parts; ``whole`` if the whole text has one.

    Inverse document frequencies come from the templates, and a word in none of them has the greatest: what a file says
    does not depend on the other files.  Parts equal in their words are scored once; the templates, a fixed list, are broadcast.
    """
    known = templates.select("tid", "license", "rank", F.explode("w").alias("word")).groupBy("tid", "license", "rank", "word").agg(F.count("*").alias("tf"))
    total = templates.agg(F.count("*").alias("total"))
    df = known.groupBy("word").agg(F.count("*").alias("df"))
    idf = cut(df.join(F.broadcast(total)).select("word", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"), (F.log(F.col("total") + 1) + 1).alias("rare")))
    known = known.join(F.broadcast(idf), "word").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = known.groupBy("tid").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    known = F.broadcast(cut(known.join(F.broadcast(norms), "tid").select("tid", "license", "rank", "word", (F.col("weight") / F.col("norm")).alias("other"))))
    rare = templates.agg((F.log(F.count("*") + 1) + 1).alias("rare"))

    part = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("said"))), F.transform(parts(F.col("text")), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("said"))))
    units = files.select("file", F.inline(part)).select("file", "whole", words(F.col("said")).alias("w")).where(F.size("w") > 0)
    units = units.withColumn("unit", F.sha2(F.array_join("w", " "), 256))
    tf = units.groupBy("unit").agg(F.first("w").alias("w")).select("unit", F.explode("w").alias("word")).groupBy("unit", "word").agg(F.count("*").alias("tf"))
    met = tf.join(F.broadcast(idf.drop("rare")), "word", "left").join(F.broadcast(rare))
    weight = F.col("tf") * F.coalesce("idf", "rare")
    asked = met.groupBy("unit").agg(
        F.sqrt(F.sum(weight * weight)).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", weight.alias("weight")))).alias("v")
    )
    dots = asked.select("unit", "norm", F.inline("v")).join(known, "word").groupBy("unit", "norm", "tid", "license", "rank").agg(F.sum(F.col("weight") * F.col("other")).alias("dot"))
    near = dots.withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("dot") / F.col("norm") >= least)
    best = near.groupBy("unit").agg(F.max(F.struct("rank", "score", "license")).alias("best"))
    hit = units.select("file", "whole", "unit").join(best, "unit")
    first = (F.col("whole") & (F.col("best.rank") == 2)).alias("first")
    hit = hit.select("file", F.struct(first, "best.rank", "best.score", "best.license").alias("best"), "whole")
    named = files.select("file", F.explode(declared(F.col("text"))).alias("license"))
    stated = F.struct(F.lit(False).alias("first"), F.lit(2).alias("rank"), F.lit(1.0).alias("score"), "license")
    hit = hit.unionByName(named.select("file", stated.alias("best"), F.lit(False).alias("whole")))
    found = hit.groupBy("file").agg(F.max("best").alias("best"), F.max("whole").alias("whole"))
    return found.select("file", "best.license", "best.score", "whole")


def ancestors(directory: Column) -> Column:
    """A directory and those above it, the root ("") included."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, least: float = 0.7, templates=TEMPLATES) -> DataFrame:
    """``file, directory, license, score, origin``: the license of each row of ``files(file, directory, text)``.

    A file's own license (``origin`` "own") is that of the license text its whole text is like, else of the best text or
    SPDX id among its parts, else of its best statement; reserved rights count if there is nothing else.  A file whose
    whole text is like a template is a license file; its directory takes the license of its best one, and files without
    their own take that of the nearest directory on their path that has one ("inherited"); others have none.  Null texts and directories count
    as empty; each row gets a row by its own text, whether its file is null or repeats; an empty table gives none; further columns of
    any name are left out; ties go to the later name.  Directories are resolved once each, before
    they meet their files, so a directory with a third of the files is a join key with one row on the other side.
    """
    base = files.select(
        "file", F.array_join(F.filter(F.split(F.coalesce("directory", F.lit("")), "/"), lambda x: x != ""), "/").alias("directory"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # what a row says depends on its text alone, so rows are told apart by file and text, whether the file is null or repeats
    said = F.sha2(F.concat(F.coalesce(F.col("file").cast("string"), F.lit("")), F.lit("\n"), F.col("text")), 256)
    marked = cut(base.where(F.col("text").rlike(CUE)).select(said.alias("file"), "text"))
    own = cut(scores(marked, template_table(files, templates), least))
    paths = base.select("file", "directory", said.alias("said"))
    o = own.withColumnRenamed("file", "of")
    joined = paths.join(o, paths.said == o.of, "left").drop("of", "said")
    held = joined.where("whole").groupBy(F.col("directory").alias("held")).agg(F.max(F.struct("score", "license")).alias("given"))
    every = paths.select(F.col("directory").alias("from")).distinct().select("from", F.explode(ancestors(F.col("from"))).alias("held"))
    nearest = every.join(held, "held").groupBy("from").agg(F.max_by("given", F.length("held")).alias("given"))
    out = joined.join(nearest, joined.directory == nearest["from"], "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "file", "directory", F.coalesce("license", "given.license").alias("license"), F.coalesce("score", "given.score").alias("score"),
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
    )
