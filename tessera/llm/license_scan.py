"""Licence scan: a trained paragraph classifier with template confirmation, in DataFrame operations only.

A logistic regression over sparse word n-grams (one to three words) tells licence families and `unknown`
apart. It is trained in numpy when the scan is planned, on seeded variations of the templates below and of
near misses, never on the data; its temperature is fitted on variations kept aside, so the unknown class is
calibrated. An n-gram counts only if it holds a salient word, so lines without salient words are unknown by the model
itself and need scoring only if they speak of licences. Notices may be one line or wrapped over several: besides each
such line, each run of them (at most one other line between two) is scored as one paragraph, and reported where it
confirms a template of a family that none of its lines confirms; its unconfirmed lines then go. The n-grams meet the
weights and the templates' three-word shingles - a table of fixed size - in one broadcast join and one aggregation: sums
give the softmax, and the share of the best template's shingles that the paragraph contains confirms the prediction.

Edge cases: null and empty texts have no paragraphs; null ids and repeated rows are reported each for
itself; n-grams that a paragraph repeats count once; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import materialise

# Licence notices by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "License: MIT",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "License: GPLv3",
        "Distributed under the GPL.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "License: AGPLv3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "zlib": [
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Released under CC0 1.0 Universal.",
    ],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved. Unauthorised copying is prohibited."],
}
# Texts that share words with notices but are none.
NEAR_MISSES = [
    "the driving license of the driver is valid",
    "a public meeting of the software foundation was held",
    "the general said the public would use it freely",
    "all seats are reserved for the guests",
    "the source of the river and its binary stars",
    "version two of the form was published under a new name",
    "permission to enter was granted by the school",
    "the apache helicopter landed near the river",
    "free of charge for any person under ten",
    "the right to vote is reserved to citizens",
    "creative people in common rooms share attribution of work",
    "license fees rose and the copyright office closed",
]
COMMON = set("a an and any are as at be by can following for from in is it may met not of on or out that the their this to under use was were with without you your new work".split())
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
UNKNOWN = "unknown"
SIZES = (1, 2, 3)


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower().replace("licence", "license"))


def ngrams(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in SIZES for i in range(len(ws) - n + 1)}


def shingles(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()


class LicenceModel:
    """Softmax regression over salient n-grams, with a temperature."""

    def __init__(self, seed: int = 13, copies: int = 40):
        import numpy as np

        rng = random.Random(seed)
        self.classes = [*TEMPLATES, UNKNOWN]
        self.salient = sorted({w for ts in TEMPLATES.values() for t in ts for w in words(t) if w not in COMMON})
        known = set(self.salient)
        self.vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in ngrams(words(t)) if known & set(g.split())})
        self.at = {g: i for i, g in enumerate(self.vocabulary)}
        data: list[tuple[str, int]] = []
        for c, name in enumerate(self.classes[:-1]):
            for t in TEMPLATES[name]:
                data += [(t, c), *[(self._vary(t, rng), c) for _ in range(copies)]]
        for t in NEAR_MISSES:
            data += [(t, len(self.classes) - 1), *[(self._vary(t, rng), len(self.classes) - 1) for _ in range(copies)]]
        for _ in range(10 * copies):  # chance mixtures of salient words, and texts without any
            some = rng.sample(self.salient, rng.randint(0, 3)) + rng.sample(sorted(COMMON), rng.randint(0, 8))
            rng.shuffle(some)
            data.append((" ".join(some), len(self.classes) - 1))
        rng.shuffle(data)
        x = np.zeros((len(data), len(self.vocabulary)), np.float32)
        for r, (t, _) in enumerate(data):
            x[r, [self.at[g] for g in ngrams(words(t)) if g in self.at]] = 1
        y = np.array([c for _, c in data])
        cut = len(data) * 4 // 5
        self.weights, self.bias = self._fit(x[:cut], y[:cut])
        z = x[cut:] @ self.weights + self.bias
        loss = lambda t: -np.log(np.maximum(self._softmax(z / t)[np.arange(len(z)), y[cut:]], 1e-12)).mean()
        self.temperature = float(min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0), key=loss))
        self.accuracy = float((z.argmax(1) == y[cut:]).mean())

    @staticmethod
    def _vary(t: str, rng: random.Random) -> str:
        ws = words(t)
        if len(ws) > 5:
            ws = [w for w in ws if rng.random() > 0.08]
        filler = lambda: ["x%d" % rng.randrange(50) for _ in range(rng.randrange(6))]
        return " ".join(filler() + ws + filler())

    @staticmethod
    def _softmax(z):
        import numpy as np

        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def _fit(self, x, y, rounds: int = 250, rate: float = 2.0, ridge: float = 1e-4):
        import numpy as np

        w, b = np.zeros((x.shape[1], len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        one = np.eye(len(self.classes), dtype=np.float32)[y]
        for _ in range(rounds):
            g = (self._softmax(x @ w + b) - one) / len(x)
            w -= rate * (x.T @ g + ridge * w)
            b -= rate * g.sum(0)
        return w, b

    def predict(self, text: str):
        import numpy as np

        row = [self.at[g] for g in ngrams(words(text)) if g in self.at]
        return self._softmax(((self.weights[row].sum(0) + self.bias) / self.temperature)[None, :].astype(np.float64))[0]


def _grams(n: int, ws: Column) -> Column:
    last = F.size(ws) - n
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(ws, i + 1, n), " "))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<string>"))


def _lines(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """row, doc_id, paragraph (number of the line), low (its text), speaks, run: the lines worth scoring, in a table."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    lines = lines.withColumn("low", F.replace(F.lower("line"), F.lit("licence"), F.lit("license")))
    # Every n-gram of the model holds a salient word: without one, the line's logits are the biases alone.
    salient = r"(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in model.salient) + r")(?![a-z0-9])"
    speaks = F.col("low").rlike(r"license|copyright|rights reserved|public domain")
    held = materialise(lines.where(F.col("low").rlike(salient) | speaks).select("row", "doc_id", "paragraph", "low", speaks.alias("speaks")), "licence-lines")
    order = W.partitionBy("row").orderBy("paragraph")
    new = F.coalesce(F.col("paragraph") - F.lag("paragraph").over(order) > 2, F.lit(True)).cast("int")
    return held.withColumn("new", new).withColumn("run", F.sum("new").over(order)).drop("new")


def scan(docs: DataFrame, model: LicenceModel | None = None, confirm: float = 0.8) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), lines (how many), family, probability, unknown_probability,
    template, similarity, confirmed.

    Reports paragraphs whose likeliest family beats unknown, and those the model calls unknown although
    they speak of licences or copyright."""
    spark = docs.sparkSession
    model = model or LicenceModel()
    classes = model.classes
    templates = [(f, i, shingles(words(t))) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    held: dict[str, list[int]] = {}
    for at, (_, _, parts) in enumerate(templates):
        for part in parts:
            held.setdefault(part, []).append(at)
    # The empty n-gram weighs nothing: lines that speak of licences but hold no known n-gram get the biases.
    grams = [""] + sorted({*model.vocabulary, *held})
    weigh = lambda g: [float(w) for w in model.weights[model.at[g]]] if g in model.at else [0.0] * len(classes)
    table = spark.createDataFrame([(g, weigh(g), held.get(g, [])) for g in grams], "gram string, w array<double>, t array<int>")

    lines = _lines(docs, model)
    several = lines.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("paragraph").alias("paragraph"), (F.max("paragraph") - F.min("paragraph") + 1).alias("lines"),
        F.sort_array(F.collect_list(F.struct("paragraph", "low"))).alias("parts"), F.bool_or("speaks").alias("speaks"),
    ).where(F.size("parts") > 1)
    several = several.select("row", "doc_id", "paragraph", "run", "lines", "speaks", F.array_join(F.transform("parts", lambda x: x["low"]), " ").alias("low"))
    units = lines.select("row", "doc_id", "paragraph", "run", F.lit(1).alias("lines"), "speaks", "low").unionByName(several)
    key = ["row", "doc_id", "paragraph", "run", "lines", "speaks"]
    units = units.withColumn("ws", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))
    none = F.array().cast("array<string>")
    few = F.when(F.size("ws") < 3, F.array(F.array_join("ws", " "))).otherwise(none)
    some = F.when(F.col("speaks"), F.array(F.lit(""))).otherwise(none)
    each = units.select(*key, F.explode(F.array_distinct(F.concat(*[_grams(n, F.col("ws")) for n in SIZES], few, some))).alias("gram"))

    # The table has a fixed size, set by the module.
    scored = each.join(F.broadcast(table), "gram").groupBy(*key)
    scored = scored.agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(classes))], F.flatten(F.collect_list("t")).alias("hits"))
    z = [(F.col(f"z{i}") + float(model.bias[i])) / model.temperature for i in range(len(classes))]
    scored = scored.select(*key, "hits", F.array(*z).alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("z", F.col("top")).cast("int")
    scored = scored.select(
        *key, "hits",
        F.element_at(F.array(*map(F.lit, classes)), best).alias("family"),
        (F.element_at("e", best) / total).alias("probability"),
        (F.element_at("e", len(classes)) / total).alias("unknown_probability"),
    ).where((F.col("family") != UNKNOWN) | F.col("speaks"))

    known = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(f).alias("family"), F.lit(i).alias("template"), F.lit(len(parts)).alias("size")) for at, (f, i, parts) in enumerate(templates)])
    share = lambda t: F.size(F.filter("hits", lambda x: x == t["at"])) / t["size"]
    near = F.transform(F.filter(known, lambda t: t["family"] == F.col("family")), lambda t: F.struct(share(t).alias("similarity"), (-t["template"]).alias("t")))
    scored = scored.withColumn("near", F.array_max(near)).withColumn("similarity", F.coalesce("near.similarity", F.lit(0.0)))
    scored = scored.withColumn("confirmed", F.col("similarity") >= confirm)
    whole, together = F.col("lines") > 1, W.partitionBy("row", "run")
    scored = scored.withColumn("named", F.max(F.when(whole & F.col("confirmed"), F.col("family"))).over(together))
    alone = F.collect_set(F.when(~whole & F.col("confirmed"), F.col("family"))).over(together)
    wrapped = F.col("named").isNotNull() & ~F.array_contains(alone, F.col("named"))
    scored = scored.withColumn("wrapped", F.coalesce(wrapped, F.lit(False))).where(F.when(whole, F.col("wrapped")).otherwise(F.col("confirmed") | ~F.col("wrapped")))
    template = F.when(F.col("similarity") > 0, -F.col("near.t"))
    return scored.select("doc_id", "paragraph", "lines", "family", "probability", "unknown_probability", template.alias("template"), "similarity", "confirmed")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
