"""License scans with DataFrame functions only.

Templates and texts are words (lower-cased runs of letters and digits) and shingles of five words, hashed. Overlapping
text windows, as many shingles long as a template and moved by one, have MinHash signatures whose bands of one row
each retrieve a template: at similarity s that happens with probability 1 - (1 - s)^BANDS. A window that holds 0.8 of a
template of its length has similarity 0.67 at least, and is missed with probability 1 in 10 million. A window can only
agree with a template in a band if it holds the shingle with the template's least hash there, so windows are laid around
those shingles alone. Retrieved windows are verified by exact containment of the template's shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, BANDS, CONTAINED = 5, 15, 0.8

#: Notices of public licenses, as their texts or authors word them, one or more for each.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: a lambda's variable is not expanded where it is used."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column) -> Column:
    """Hashes of a text's shingles; fewer than WIDTH words are one shingle, none are none."""

    def of(own: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size(own) - (WIDTH - 1)), lambda i: F.xxhash64(*(F.element_at(own, i + k) for k in range(WIDTH))))
        return F.when(F.size(own) >= WIDTH, several).when(F.size(own) > 0, F.array(F.xxhash64(F.array_join(own, " ")))).otherwise(F.array().cast("array<bigint>"))

    return named(words(text), of)


def permuted(h: Column, band: int) -> Column:
    """The hash that a band orders shingles by."""
    return F.xxhash64(h, F.lit(band))


def least(hashes: Column, band: int) -> Column:
    """(v, h): the least of the hashes in a band's order, and the hash itself."""
    return F.array_min(F.transform(hashes, lambda h: F.struct(permuted(h, band).alias("v"), h.alias("h"))))


def least_of(hashes: Column, band: Column) -> Column:
    """The least value of the hashes in the order of the row's band."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band)))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs and each license found in it: (id_col, license, n_windows, first_word, containment).

    n_windows counts the places where it was found, first_word is the place of the best one's first word (the
    first of equals) among the text's words, containment the share of the template's shingles in it, 0.8 or more.
    Null, empty and unlicensed texts have no rows; rows that repeat an id and a text are scanned one by one. Templates
    are few: their table has len(templates) rows, whatever the input. Other columns are left out.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "license string, template string")
    bands = F.array(*(least(F.col("t"), b) for b in range(BANDS)))
    known = known.select("license", shingles(F.col("template")).alias("s")).select("license", F.array_distinct("s").alias("t"), F.size("s").alias("n"))
    known = known.select("license", "t", "n", F.posexplode(bands).alias("band", "least")).select("license", "t", "n", "band", F.col("least.v").alias("v"), F.col("least.h").alias("key"))
    keys = sorted({r["key"] for r in known.select("key").collect()})

    reach = known.agg(F.max("n")).first()[0] or 1

    def found(h: Column) -> Column:
        """Places of shingles that are least of a template, each with the shingles around it that any window may hold."""
        spots = F.transform(h, lambda x, i: F.when(x.isin(keys), F.struct(i.alias("at"), x.alias("key"))))
        return F.transform(F.filter(spots, lambda x: x.isNotNull()), lambda x: around(h, x))

    def around(h: Column, x: Column) -> Column:
        base = F.greatest(F.lit(0), x["at"] - (reach - 1))
        return F.struct(x["at"].alias("at"), x["key"].alias("key"), base.alias("base"), F.slice(h, base + 1, x["at"] - base + reach).alias("h"))

    # the row number also keeps filters above, where they don't compute the shingles again
    each = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), named(shingles(F.col(text_col)), found).alias("x"))
    near = each.select("uid", "id", F.explode("x").alias("x")).select("uid", "id", "x.*")
    pairs = near.join(F.broadcast(known), "key")
    laid = pairs.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("n") + 1), F.col("at"))).alias("from"))
    window = laid.withColumn("s", F.slice("h", F.col("from") - F.col("base") + 1, "n"))
    agrees = least_of(F.col("s"), F.col("band")) == F.col("v")
    met = window.where(agrees).select("uid", "id", "license", "from", (F.size(F.array_intersect("t", "s")) / F.size("t")).alias("containment")).where(F.col("containment") >= CONTAINED)
    best = met.groupBy("uid", "id", "license").agg(F.max(F.struct("containment", (-F.col("from")).alias("back"))).alias("x"), F.count_distinct("from").alias("n_windows"))
    return best.select(F.col("id").alias(id_col), "license", "n_windows", (-F.col("x.back")).cast("bigint").alias("first_word"), F.col("x.containment").alias("containment"))
