"""Quality rules, shards, licences, resampling and the registered queries."""

import functools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillguard.llm import kd_shards, licenses, quality_rules, queries, resampling

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w = BLANK.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    repeated = len({j for i, g in enumerate(windows) if times[g] > 1 for j in range(i, i + 5)})
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    failed = len(w) < 10 or 100 * repeated > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, failed


def test_quality_rules(odd, odd_rows, none):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = quality_rules.assess(odd)
    got = judged.select("doc_id", *[f"quality.{f}" for f in fields]).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], *base_counts(r[1])) for r in odd_rows)
    assert judged.filter("quality.kept AND (quality.base_failed OR size(quality.broken_rules) > 0)").count() == 0
    assert quality_rules.assess(none).count() == 0
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(("text", "rule"), [("$ % & " * 20, "symbols"), ("the OF AND TO IN IS FOR IT ON AS BY AT " * 2, "capitals"), ("zq xv " * 20, "stop_words")])
def test_rules_break(spark, text, rule):
    row = quality_rules.assess(spark.createDataFrame([(text,)], "text string")).select("quality.*").first()
    assert rule in row.broken_rules and not row.kept


def test_kd_shards(odd, odd_rows, none, small, spark):
    got = kd_shards.kd_shards(odd, 3).collect()
    text = lambda t: (t or "").encode()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((r[0], len(text(r[1])) + 8, zlib.crc32(text(r[1]))) for r in odd_rows)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = kd_shards.kd_shards(docs, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    biggest = docs.agg(F.max(F.octet_length("text"))).first()[0]
    assert len(sizes) == 8 and max(r.s for r in sizes) - min(r.s for r in sizes) <= 2 * biggest
    assert kd_shards.kd_shards(docs, target_bytes=200_000).select("shard").distinct().count() >= 2
    assert kd_shards.kd_shards(none, 4).count() == 0


def test_written_shards(odd, tmp_path):
    kd_shards.write_shards(odd, str(tmp_path / "s"), 3)
    assert odd.sparkSession.read.parquet(str(tmp_path / "s")).count() == odd.count()


def test_license_scan(spark, none, small):
    texts = ["plain words\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License.\nAll rights reserved.", "Licensed under the Unicorn License.", None, "", "the and of in"]
    got = [r.families for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[:2] == ["apache", "mit,reserved"] and got[2] in ("unknown", "") and got[3:] == ["", "", ""]
    assert licenses.license_scan(none).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    planted = docs.select("doc_id", F.regexp_like("text", F.lit("(?m)^(Licensed under|Released under the|This work is licensed|All rights reserved)")).alias("p"))
    joined = planted.join(licenses.license_scan(docs), "doc_id")
    assert joined.filter("p <> (n_license > 0)").count() == 0


LICENSED = {
    "gpl": ["Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under GPLv2"],
    "lgpl": ["You can use it under the GNU Lesser General Public License, version 2.1.", "Licensed under LGPL-3.0"],
    "bsd": ["Licensed under the BSD License.", "Available under the 2-clause BSD license"],
    "mit": ["This code is distributed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "apache": ["Licensed under Apache 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "mpl": ["Covered by the Mozilla Public License, v. 2.0"],
    "cc-by": ["The text is available under CC BY 4.0"],
    "cc-by-sa": ["Published under a Creative Commons Attribution-ShareAlike 3.0 license"],
    "unknown": ["Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-ND 4.0.", "Licensed under the GNU Affero General Public License, version 3.", "Licensed under MIT-0"],
    "apache,mit": ["Licensed under either of the Apache License or the MIT license."],
    "": ["ein Haus mit Garten und mit Hund", "she studied the apache people and their land"],
}


@pytest.mark.parametrize("families", sorted(LICENSED))
def test_license_names(families):
    model = _model()
    for line in LICENSED[families]:
        found = licenses.classify(model, [[line]])[0][0]
        assert ",".join(f for f in found if f != "none") == families, line


@functools.cache
def _model():
    return licenses.train(["the house stands by the river and the garden is green", "ein Haus mit Garten", "one of the old towns of the land"] * 20)


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
    "gpl": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3",
    "lgpl": "it under the terms of the GNU Lesser\nGeneral Public License as published",
}


@pytest.mark.parametrize("family", sorted(WRAPPED))
def test_wrapped_notices(family):
    model = _model()
    found = {f for part in licenses.blocks(WRAPPED[family]) for fs, _ in licenses.classify(model, [part]) for f in fs}
    assert found - {"none", "unknown"} == {family}
    apart = licenses.classify(model, licenses.blocks("under the terms of the GNU Lesser\n\nGeneral Public License"))
    assert apart[1][0] == ["gpl"]


def test_log_ratios_see_what_the_target_lacks():
    raw, target = np.full(1000, 400), np.full(1000, 100)
    target[3], target[4] = 0, 300
    got = resampling.log_ratios(raw, target)
    assert got[3] < -2 and got[4] > 0.9 and not got[5:].any()


def test_resampling(spark, odd, none):
    labels = spark.createDataFrame([(7 * i, 1, 0) for i in range(9, 40)] + [(0, 0, 1), (None, 1, 0), (21, None, None)], "doc_id long, quality int, toxic int")
    drawn = resampling.resample(odd, labels, fraction=0.5, buckets=1 << 12)
    n, again = odd.count(), {r.doc_id for r in resampling.resample(odd, labels, fraction=0.5, buckets=1 << 12).collect()}
    rows = drawn.collect()
    assert -(-n // 2) <= len(rows) <= -(-n // 2) + 6 and {r.doc_id for r in rows} == again
    assert resampling.resample(none, labels, buckets=1 << 12).count() == 0
    assert resampling.resample(odd, labels.filter("false"), fraction=0.5, buckets=1 << 12).filter("log_weight <> 0").count() == 0


def test_kth_largest(spark):
    rows = spark.range(30_000).select((F.sin("id") * 100).alias("x"))
    ordered = sorted((r.x for r in rows.collect()), reverse=True)
    for k in (1, 77, 15_000, 30_000):
        assert resampling.kth_largest(rows, "x", k) == ordered[k - 1]
    assert resampling.kth_largest(rows, "x", 30_001) is None


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_counterpart(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    theirs = sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert sorted(map(tuple, got.select(*columns).collect())) == theirs
