"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by path joins.

DataFrame functions only. A header is a line with one of the key terms, by itself and with the lines
around it; a file named like a licence gives all its paragraphs. Equal headers are compared once, however
many files carry them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch

#: A header's least cosine to a template.
LEAST = 0.5
#: Lines before and behind a key line that a notice may take.
BEFORE, BEHIND = 2, 6
# The usual short notices of public licences.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Unlicense", "Released under the Unlicense."),
)
# Titles, and opening or granting paragraphs, of the licences' own texts and notices.
PARAGRAPHS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Licences whose identifier also comes as -only and -or-later.
GNU = ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-3.0")
#: Every notice has one of these, and without them no line comes near LEAST.
KEYS = "licen[cs]e|licensed|copyright|spdx|public domain|permission is hereby granted|permission to use, copy"
LICENCE_FILE = "(?i)^(un)?(licen[cs]e|copying|notice)([-._].*)?$"
SPLIT = "[^a-z0-9.+-]+"


def terms(text: Column) -> Column:
    """Lower-case terms; a full stop at a term's end doesn't count."""
    return F.filter(F.transform(F.split(F.lower(text), SPLIT), lambda w: F.regexp_replace(w, "[.]+$", "")), lambda w: w != "")


def template_list() -> list[tuple[str, str]]:
    """(license, text) of notices, paragraphs and SPDX lines."""
    found = [*NOTICES, *PARAGRAPHS]
    for name, _ in NOTICES:
        found += [(name, f"SPDX-License-Identifier: {name}{more}") for more in ("", "-only", "-or-later") if not more or name in GNU]
    return found


def templates(spark: SparkSession) -> DataFrame:
    """(license, template, unit): a fixed list."""
    rows = ", ".join(f"('{name}', {i}, '{text}')" for i, (name, text) in enumerate(template_list()))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(license, template, unit)")


def headers(files: DataFrame) -> DataFrame:
    """(fid, u, unit): the headers of files(fid, path, text), and the paragraphs of files named like a licence; u is their digest."""
    lines = F.split("text", "\r?\n")
    keyed = F.filter(lines, lambda x: F.lower(x).rlike(KEYS))
    blocks = F.filter(F.transform(lines, lambda x, i: F.when(F.lower(x).rlike(KEYS), F.array_join(F.slice(lines, F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(i, F.lit(BEFORE)) + 1 + BEHIND), "\n"))), lambda x: x.isNotNull())
    paragraphs = F.filter(F.split("text", "\r?\n[ \t]*\r?\n"), lambda x: F.trim(x) != "")
    whole = F.when(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), paragraphs).otherwise(F.array().cast("array<string>"))
    return files.where(F.lower("text").rlike(KEYS)).select("fid", F.explode(F.array_distinct(F.concat(keyed, blocks, whole))).alias("unit")).withColumn("u", F.md5(F.col("unit").cast("binary")))


def _weighted(units: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, term, w): sublinear term frequency times inverse document frequency, to length 1."""
    counted = units.select(key, F.explode(terms(F.col("unit"))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = counted.join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("w"))


def classify(found: DataFrame) -> DataFrame:
    """(u, license, cosine): the nearest template of each distinct header of found(u, unit), if at least LEAST.

    Inverse document frequencies count all headers of the corpus, repeats included, and the templates, so
    a header's cosine depends on the corpus it stands in. Ties go to the first name.
    """
    spark = found.sparkSession
    known = templates(spark)
    units = found.groupBy("u").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("files"))
    every = units.select("unit", "files").unionByName(known.select("unit", F.lit(1).cast("long").alias("files")))
    total = every.agg(F.sum("files").alias("total")).scalar()
    df = every.select("files", F.explode(F.array_distinct(terms(F.col("unit")))).alias("term")).groupBy("term").agg(F.sum("files").alias("df"))
    idf = df.select("term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    a = _weighted(units, "u", idf)
    b = _weighted(known, "template", idf).withColumnRenamed("w", "v").join(F.broadcast(known.select("template", "license")), "template")
    # The templates are a fixed list of under a thousand terms.
    cosine = a.join(F.broadcast(b), "term").groupBy("u", "license", "template").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("cosine")).where(F.col("cosine") >= LEAST)
    best = cosine.groupBy("u").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("best"))
    return best.select("u", "best.license", (-F.col("best.less")).alias("cosine"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row for every row: doc_id, path, license, cosine, inherited_license, inherited_from.

    license is that of the file's nearest header, null if none is near. A file without one inherits from
    the nearest directory, its own first, with a licence file that has one; of several there, the highest
    cosine counts, then the first path. Null texts are empty; null paths are the root's; a null id stays null; repeated rows
    keep a row each; files without any licence above them inherit null; extra columns are ignored.
    """
    rows = files.select(files[id_col].cast("long").alias("doc_id"), F.coalesce(files[path_col], F.lit("")).alias("path"), F.coalesce(files[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("fid", F.struct("doc_id", "path", F.xxhash64("text").alias("h")))
    # Few files have headers; both small tables are read several times.
    scratch = Scratch(files.sparkSession, "licenses")
    found = scratch.write(headers(rows.select("fid", "path", "text")), "headers")
    own = found.select("fid", "u").join(scratch.write(classify(found), "nearest"), "u").groupBy("fid").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("best"))
    own = own.select("fid", F.col("best.license").alias("license"), (-F.col("best.less")).alias("cosine"))
    named = own.where(F.element_at(F.split("fid.path", "/"), -1).rlike(LICENCE_FILE)).withColumn("dir", _parent(F.col("fid.path")))
    dirs = named.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("less"), F.col("fid.path").alias("path"), "license")).alias("best")).select("dir", F.col("best.license").alias("dir_license"))
    # Each directory once, with itself and all directories above it.
    places = rows.select(_parent(F.col("path")).alias("at")).distinct()
    steps = F.when(F.col("at") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(F.split("at", "/"))), lambda k: F.array_join(F.slice(F.split("at", "/"), F.lit(1), k), "/"))))
    above = places.select("at", F.posexplode(steps).alias("depth", "dir")).join(dirs, "dir")
    nearest = above.groupBy("at").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("near")).select("at", F.col("near.dir").alias("near_dir"), F.col("near.dir_license").alias("near_license"))
    out = rows.select("doc_id", "path", "fid", _parent(F.col("path")).alias("at")).join(own, "fid", "left").join(nearest, "at", "left")
    inherits = F.col("license").isNull()
    return out.select("doc_id", "path", "license", "cosine", F.when(inherits, F.col("near_license")).alias("inherited_license"), F.when(inherits, F.col("near_dir")).alias("inherited_from"))


def with_paths(docs: DataFrame) -> DataFrame:
    """documents as a tree of files: source, two levels of directories by id, every eighth file a licence."""
    at = F.coalesce(F.col("doc_id"), F.lit(0))
    name = F.when(at % 8 == 0, F.concat(F.lit("LICENSE-"), at)).otherwise(F.concat(F.lit("doc"), at, F.lit(".txt")))
    outer = F.floor(at / 512)
    place = F.when(at % 64 == 0, F.concat_ws("/", F.coalesce("source", F.lit("")), outer, name)).otherwise(F.concat_ws("/", F.coalesce("source", F.lit("")), outer, F.floor(at / 32), name))
    return docs.select("doc_id", place.alias("path"), "text")
