import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, AWKWARD_IDS, docs
from tideline.llm import licenses
from tideline.llm.common import durable, table


def test_license_scan(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    texts = [
        "Some prose. Licensed under CC BY-NC 4.0. More prose here.\nReleased under the MIT License.",
        "prose\n" + mit.replace("merge, ", "").replace("Software", "Program", 1) + "\nprose",
        "Licensed under the Apache License, Version 2.0.\nAll rights reserved.",
        "The license of the driver was checked and no copyright was found in it.",
        "this work is licensed under the\nGNU General Public License, version 3.",
        *AWKWARD,
    ]
    got = licenses.scan(docs(spark, texts)).collect()
    names = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        names.setdefault(r.doc_id, []).append(r.license)
        assert 0 <= r.start < r.end <= len(texts[r.doc_id])
    assert names == {0: ["CC-BY-NC-4.0", "MIT"], 1: ["MIT"], 2: ["Apache-2.0", "All-Rights-Reserved"], 4: ["GPL-3.0"]}
    one = next(r for r in got if r.doc_id == 1)
    assert set(one["diff"].split()) == {"-merge", "-software", "+program"}
    assert licenses.scan(docs(spark, texts, [None] * len(texts))).count() == len(got)
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


def test_license_of_every_template():
    s = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        found = s.scan(text)
        assert (found[0][0], found[0][4]) == (name, []), text


def test_license_found_whatever_is_around_it():
    s = licenses.Scanner(licenses.TEMPLATES)
    law = "the permission of the license holder is a license for this license and its permission"
    for notice, name in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("All rights reserved.", "All-Rights-Reserved"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("GNU GPL v3", "GPL-3.0"), ("Mozilla Public License 2.0", "MPL-2.0"), ("Distributed under the BSD license.", "BSD")):
        for n in (0, 10, 20, 40, 160):
            for end in (". ", " "):
                before = "".join(f"{law} {k % 7}{end}" for k in range(n))
                got = s.scan(before + notice + " " + before)
                assert [(g[0], g[1]) for g in got] == [(name, len(before))], (notice, n, end)


def test_bsd_texts_differ():
    two, three = (next(t for n, t in licenses.TEMPLATES if n == k and len(t) > 100) for k in ("BSD-2-Clause", "BSD-3-Clause"))
    s = licenses.Scanner(licenses.TEMPLATES)
    for text, name in ((two, "BSD-2-Clause"), (three, "BSD-3-Clause")):
        for t in (text, text.upper().replace(". ", ".\n")):
            assert [g[0] for a, b in licenses.candidates(t) for g in s.scan(t[a:b])] == [name]


def plainly(text, templates):
    """The scan of a text of one window, by brute force: every template on every stretch, with new compressors each time."""
    import zstandard as zstd

    kw = {"level": 12, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    size = lambda data, **d: len(zstd.ZstdCompressor(**kw, **d).compress(data))
    words = lambda t: [m.group().lower() for m in licenses._WORD.finditer(t)]
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        part, options = text[a:b], []
        for k, (name, t) in enumerate(sorted(templates, key=lambda t: (-len(t[1]), t))):
            wide = 1
            while wide < int(len(t) * 1.3) + 40:
                wide *= 2
            raw = zstd.ZstdCompressionDict(t.lower().encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            own = size(t.lower().encode()) - size(b"")
            for p in range(0, max(1, len(part) - wide), wide):
                data = part[p : p + 2 * wide].lower().encode()
                if (saved := size(data) - size(data, dict_data=raw)) >= 0.3 * own:
                    options.append((-saved, k, p, name, words(t), part[p : p + 2 * wide]))
        for _, _, p, name, want, stretch in sorted(options):
            have = [(m.group().lower(), *m.span()) for m in licenses._WORD.finditer(stretch)]
            hit = [i for i in range(len(have)) if [w for w, _, _ in have[i : i + len(want)]] == want]
            if hit:
                s, e = a + p + have[hit[0]][1], a + p + have[hit[0] + len(want) - 1][2]
                out.append((name, s, e))
                todo += [(a, s), (e, b)]
                break
    return sorted(out, key=lambda x: x[1])


def test_license_scan_against_brute_force(spark, sf):
    """All documents of a table and mixed blocks: all templates, all stretches, exact wording."""
    s = licenses.Scanner(licenses.TEMPLATES)
    texts = [r.text or "" for r in table(spark, sf, "documents").collect()]
    some = [t for _, t in licenses.TEMPLATES]
    texts += [" ".join([some[k], "The permission of a license holder.", some[(k * 7 + 3) % len(some)]]) for k in range(0, len(some), 5)]
    for t in texts:
        for a, b in licenses.candidates(t):
            if b - a < 3 * s.longest:
                assert [g[:3] for g in s.scan(t[a:b])] == plainly(t[a:b], licenses.TEMPLATES), t[a:b]


def test_license_named_by_compression(monkeypatch):
    """Savings rank templates that the wording allows alike, and decide whether words that are there are a notice."""
    body = "the holder of this license may copy share and sell the work in {} form to any person at any price without further permission"
    two = [("A", body.format("printed")), ("B", body.format("digital"))]
    for name, text in two:
        assert [g[0] for g in licenses.Scanner(two).scan(text)] == [name]
    other = licenses.Scanner(two)
    best_first = other.ranked
    other.ranked = lambda part: best_first(part)[::-1]
    assert [g[0] for g in other.scan(two[0][1])] == ["B"]
    apart = "The copyright notice: GNU\t*\tGPL\t*\tv2."
    assert licenses.Scanner(licenses.TEMPLATES).scan(apart) == []
    monkeypatch.setattr(licenses, "LEAST_SAVED", -99)
    assert [g[0] for g in licenses.Scanner(licenses.TEMPLATES).scan(apart)] == ["GPL-2.0"]


def test_license_of_another_version():
    s = licenses.Scanner(licenses.TEMPLATES)
    three = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and len(t) > 100)
    assert [(g[0], g[4]) for g in s.scan(three.replace("version 3", "version 2"))] == [("GPL-2.0", [])]
    assert s.scan(three.replace("version 3", "version 7")) == []


def test_pipeline_stages(spark, sf):
    d = table(spark, sf, "documents")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = durable(stage(spark, d, sf), name)
        rows[name] = out.count()
        if name != "best_fit_packing":
            assert out.columns == d.columns
            d = out
    assert rows["language_id"] >= 195 and rows["simhash_near_dedup"] <= 190 and rows["decontamination"] > 150
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert len(packed) == rows["best_fit_packing"]
    assert set(packed.doc_id) == {r.doc_id for r in d.collect()}


def test_pipeline_awkward(spark, sf):
    d = docs(spark, [*AWKWARD, "Ein Text mit Worten. " * 9, "A text with words in it. " * 9], [*AWKWARD_IDS, 20, 21]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        d = durable(stage(spark, d, sf), name)
    assert d.count() >= 3
    e = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        e = durable(stage(spark, e, sf), name)
    assert e.count() == 0


def test_pipeline_repeated_rows_and_names(spark, sf):
    text = "Plain words of a text that is long enough to be told apart from others, said once and for all. "
    d = docs(spark, [text, text, text, text + "More of it here.", None, "Ein anderer Text mit vielen Worten, der nur einmal steht."], [5, 5, 5, 5, None, None])
    for name in ("_pred", "_score", "_p", "_h", "_k", "_spans", "_kept", "score"):
        d = d.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        d = durable(stage(spark, d, sf), name)
        assert {r._pred + r._h + r._kept + r.removed for r in d.collect()} == {"xxxk"}
        if name == "simhash_near_dedup":
            assert d.count() <= 4 and d.where("doc_id = 5").count() <= 2
    assert corpus_pipeline.language(spark, d, sf).columns == d.columns


def test_oracles(spark, sf):
    import duckdb

    from tideline.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf).toPandas()
        c = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = c.sql(sql).df()[got.columns]
        assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist())), name
