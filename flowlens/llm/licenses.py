"""License scan; DataFrame functions only.

Lines that hold a license cue are headers; of a document with a cue, paragraphs of several lines with a cue, the
leading comment block and the whole text are looked at as well. Each distinct text of these becomes a sparse TF-IDF
vector (terms: lower-case letter and digit runs; document frequencies over all these texts and the templates) and is
compared by cosine with the templates: short notices, standard headers and whole license texts (`license_texts`).
A document's own license is that of its whole text if that has a cosine of `threshold` or more, else that of its
best part that has. 'All rights reserved' counts only where nothing else does, as many licenses begin with it.

A document is a license file when its whole text is similar to a template. Its license holds for its directory: a
document without a license of its own inherits that of the nearest ancestor directory with a license file.
Directories are resolved first, then documents join theirs.

Every document gets one row. Null and empty texts have no license of their own but may inherit one; a null path
is the top directory. Ties go to the smaller license name. Repeated rows get equal answers; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.work import written

# Short public notices and standard headers by which licenses are known.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal public domain dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "Copyright. All rights reserved"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
# whole license texts, by name
TEXTS = Path(__file__).with_name("license_texts")
CUE = r"(?i)licen[cs]e|copyright|all rights reserved|permission is hereby granted|public domain"
COMMENT = r"(?s)^\s*(/\*.*?\*/|<!--.*?-->|\"{3}.*?\"{3})"
CODE_LINE = r"(?m)^(?![ \t]*(?:#|//|;|--|%|\*|\r?$))"


@dataclass(frozen=True)
class Scan:
    threshold: float = 0.6


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def template_table(spark: SparkSession) -> DataFrame:
    texts = [(path.stem, path.read_text()) for path in sorted(TEXTS.glob("*.txt"))]
    rows = [(i, name, text) for i, (name, text) in enumerate([*TEMPLATES, *texts])]
    return spark.createDataFrame(rows, "template: int, license: string, body: string")


def leading_comment(text: Column) -> Column:
    """The comment a text begins with: one in brackets, or its lines before the first that is none; else empty."""
    bracketed = F.regexp_extract(text, COMMENT, 1)
    code = F.regexp_instr(text, F.lit(CODE_LINE))
    lines = F.when(code > 0, F.substring(text, F.lit(1), code - 1)).otherwise("")
    return F.when(bracketed != "", bracketed).otherwise(lines)


def license_texts(docs: DataFrame) -> DataFrame:
    """(row, whole, body) of the headers, paragraphs, comments and whole texts with a cue, trimmed; docs has row and text."""
    cued = docs.where(F.col("text").rlike(CUE))
    lines = cued.select("row", F.explode(F.split("text", r"\n")).alias("body"))
    blocks = cued.where(r"text RLIKE '\\n[ \\t]*\\n'")
    blocks = blocks.select("row", F.explode(F.split("text", r"\n[ \t]*\n")).alias("body"))
    blocks = blocks.where(F.trim("body").contains("\n"))
    comments = cued.select("row", leading_comment(F.col("text")).alias("body"))
    parts = lines.unionByName(blocks).unionByName(comments).where(F.col("body").rlike(CUE)).withColumn("whole", F.lit(False))
    every = parts.unionByName(cued.select("row", F.col("text").alias("body"), F.lit(True).alias("whole")))
    return every.withColumn("body", F.trim("body"))


def matches(bodies: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """(body, license, score) of the distinct texts whose best template is similar enough."""
    units = bodies.select("body").distinct().withColumn("unit", F.xxhash64("body"))
    return units.join(unit_matches(units, scan), "unit").select("body", "license", "score")


def unit_matches(bodies: DataFrame, scan: Scan) -> DataFrame:
    """(unit, license, score) of the units whose best template is similar enough; bodies has distinct unit and body."""
    templates = template_table(bodies.sparkSession)
    texts = bodies.select(F.lit(-1).alias("template"), "unit", "body")
    units = texts.unionByName(templates.select("template", F.xxhash64("template", "body").alias("unit"), "body"))
    counted = units.select("template", "unit", F.explode(terms(F.col("body"))).alias("term"))
    counted = written(counted.groupBy("template", "unit", "term").agg(F.count(F.lit(1)).alias("tf")), "license-terms")
    total = units.agg(F.count(F.lit(1)).alias("units"))
    known = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))
    idf = written(known.select("term", (F.log((F.col("units") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "license-idf")
    weighed = counted.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighed = weighed.join(norms, ["template", "unit"]).withColumn("w", F.col("w") / F.col("norm"))
    weighed = written(weighed.select("template", "unit", "term", "w"), "license-vectors")
    ours = weighed.where("template >= 0").join(F.broadcast(templates.select("template", "license")), "template")
    ours = ours.select("template", "license", "term", F.col("w").alias("v"))
    theirs = weighed.where("template < 0").select("unit", "term", "w")
    dots = theirs.join(ours, "term").groupBy("unit", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    best = dots.groupBy("unit", "license").agg(F.max(F.round("dot", 6)).alias("score"))
    best = best.where(F.col("score") >= scan.threshold)
    top = F.min(F.struct((-F.col("score")).alias("order"), "license", "score")).alias("top")
    return best.groupBy("unit").agg(top).select("unit", "top.license", "top.score")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, from the top (the empty path) down, each with its depth."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    depths = F.sequence(F.lit(0), F.size(parts))
    return F.transform(depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("up")))


def scan_licenses(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """doc_id, path, license, score, found ('own', 'inherited', 'none') and from_folder of each row of docs.

    docs has doc_id, path and text.
    """
    clean = F.regexp_replace(F.coalesce("path", F.lit("")), r"/+", "/")
    keyed = docs.select("doc_id", "path", "text", F.regexp_replace(clean, r"^/|/$", "").alias("_path"))
    keyed = keyed.withColumn("row", F.xxhash64("doc_id", "_path", "text"))
    rows = written(keyed.select("doc_id", "path", parent(F.col("_path")).alias("folder"), "row"), "license-rows")
    texts = license_texts(keyed.select("row", "text").dropDuplicates(["row"])).withColumn("unit", F.xxhash64("body"))
    bodies = written(texts.dropDuplicates(["unit"]).select("unit", "body"), "license-bodies")
    known = written(unit_matches(bodies, scan), "license-matches")
    hits = texts.select("row", "whole", "unit").join(known, "unit")
    weak = F.col("license") == "proprietary"
    top = F.min(F.struct(weak.alias("weak"), (~F.col("whole")).alias("part"), (-F.col("score")).alias("order"), "license", "score"))
    own = hits.groupBy("row").agg(top.alias("top"))
    own = written(own.select("row", "top.license", "top.score", (~F.col("top.part")).alias("file")), "license-own")
    files = rows.join(own, "row").where("file").select("folder", "license", "score")
    holders = files.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("order"), "license")).alias("top"))
    holders = written(holders.select(F.col("folder").alias("up"), F.col("top.license").alias("license")), "license-folders")
    folders = rows.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("a"))
    near = folders.select("folder", "a.depth", "a.up").join(holders, "up")
    near = near.groupBy("folder").agg(F.max(F.struct("depth", "license", "up")).alias("n"))
    near = written(near.select("folder", F.col("n.license").alias("passed"), F.col("n.up").alias("from_folder")), "license-near")
    out = rows.join(own.select("row", F.col("license").alias("own"), "score"), "row", "left").join(near, "folder", "left")
    found = F.when(F.col("own").isNotNull(), "own").when(F.col("passed").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own", "passed").alias("license"),
        "score",
        found.alias("found"),
        F.when(F.col("own").isNull(), F.col("from_folder")).alias("from_folder"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path and text of the table of documents, which has no paths: source/thousand/ten/id."""
    number = F.coalesce("doc_id", F.lit(0))
    steps = [F.coalesce("source", F.lit("-")), F.floor(number / 1000), F.floor(number / 10), number]
    return docs.select("doc_id", F.concat_ws("/", *[s.cast("string") for s in steps]).alias("path"), "text")
